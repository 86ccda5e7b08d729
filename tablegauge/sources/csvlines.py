"""CSV records from physical lines, so that many tasks read one file with line breaks in quotes.

A line break ends a record only outside quotes, and whether a byte range of a file starts
inside quotes follows from all ranges before. Each line maps the state before it (outside
or inside quotes) to the state after it, and such maps compose: one pass gives the map of
every range, a scan over the ranges of a file (a row each) gives the state in which each
starts, and a second pass cuts every range into records by itself. Records that cross
ranges leave one fragment in each and are joined by the range they began in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPTIONS = {"escape": '"', "multiLine": "true"}
#: A quoted value with doubled quotes, a value without quotes at its start, or none.
VALUE = r'(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|)'
FROM_OUTSIDE = re.compile(rf"{VALUE}(?:,{VALUE})*+", re.DOTALL)
FROM_INSIDE = re.compile(rf'(?:[^"]|"")*+"[^,]*+(?:,{VALUE})*+', re.DOTALL)


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a value in quotes is open after ``line``."""
    return (FROM_INSIDE if inside else FROM_OUTSIDE).fullmatch(line) is None


def physical_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, block, at, line): ``at`` rises with the lines of a range."""
    # Files are cut at line feeds alone; a carriage return before one belongs to the end.
    text = spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path))
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Parts of batches that lie in one range."""
    for batch in batches:
        files, blocks = batch.column("file"), batch.column("block")
        start, rows = 0, batch.num_rows
        while start < rows:
            of = files[start].as_py(), blocks[start].as_py()
            same = pc.and_(pc.equal(files.slice(start), of[0]), pc.equal(blocks.slice(start), of[1]))
            length = rows - start if pc.all(same).as_py() else pc.index(same, False).as_py()
            yield of, batch.slice(start, length)
            start += length


MAPS = "file string, block long, outside boolean, inside boolean, ends_outside boolean, ends_inside boolean, returns boolean"


def block_maps(lines: DataFrame) -> DataFrame:
    """For each range, whether quotes are open after it when it starts outside them, and
    when it starts inside; whether some record ends in it, in either case; and whether
    its first line ends in a carriage return."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[tuple[str, int], list[bool]] = {}
        for of, part in _runs(batches):
            quoted = pc.match_substring(part.column("line"), '"')
            if of not in maps:
                maps[of] = [False, True, not quoted[0].as_py(), False, part.column("line")[0].as_py().endswith("\r")]
            own = maps[of]
            for line in part.column("line").filter(quoted).to_pylist():
                own[:2] = (ends_inside(line, state) for state in own[:2])
                own[2:4] = (seen or not state for seen, state in zip(own[2:4], own[:2]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in maps], pa.string()), pa.array([b for _, b in maps], pa.int64()),
             *(pa.array([m[i] for m in maps.values()], pa.bool_()) for i in range(5))],
            names=["file", "block", "outside", "inside", "ends_outside", "ends_inside", "returns"])

    return lines.mapInArrow(work, MAPS)


def block_starts(maps: DataFrame) -> DataFrame:
    """(file, block, open, began, returns): whether a range starts inside quotes, in which
    range the record that is open there began, and whether the file's lines end in carriage
    returns, as its first one tells. A group is the ranges of one file."""

    def scan(ranges: pd.DataFrame) -> pd.DataFrame:
        ranges, state, began, out = ranges.sort_values("block"), False, 0, []
        for r in ranges.itertuples():
            out.append((r.file, r.block, state, began))
            if not (state and not r.ends_inside):
                began = r.block
            state = r.inside if state else r.outside
        return pd.DataFrame(out, columns=["file", "block", "open", "began"]).assign(returns=ranges["returns"].iloc[0])

    return maps.groupBy("file").applyInPandas(scan, "file string, block long, open boolean, began long, returns boolean")


PIECES = "file string, began long, n long, block long, whole boolean, text string"


def record_pieces(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, began, n, block, whole, text): records and, where they cross ranges, their
    pieces; ``n`` counts those that begin in a range."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        held: list[str] = []  # lines of the record that is open
        state = crossing = returns = False
        began, n = 0, 0

        def piece(whole: bool) -> None:
            own = whole and not crossing
            rows.append((now[0], began if crossing else now[1], 0 if crossing else n, now[1], own, "\n".join(held)))

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "began", "n", "block", "whole", "text"])

        for of, part in _runs(batches):
            if of != now:
                if held:
                    piece(False)
                now, held, n = of, [], 0
                state, began, returns = (part.column(c)[0].as_py() for c in ("open", "began", "returns"))
                crossing = state
            for line in part.column("line").to_pylist():
                held.append(line.removesuffix("\r") if returns else line)
                if '"' in line:
                    state = ends_inside(line, state)
                if not state:
                    piece(True)
                    n += not crossing
                    held, crossing = [], False
            yield made()
        if held:
            piece(False)
        yield made()

    told = lines.join(starts, ["file", "block"]).sortWithinPartitions("file", "block", "at")
    return told.select("file", "block", "line", "open", "began", "returns").mapInArrow(work, PIECES)


def records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(record) of all CSV files of ``path``, without their headers and without blank lines.

    Equal to reading each file by one task, as long as lines end in a line feed, with or
    without a carriage return, and quotes are doubled in quoted values; a quote elsewhere
    in a value is itself. Where a file's first line ends in a carriage return, all do, and
    line breaks in its values become line feeds. A file that ends inside quotes keeps its
    last record as it is.
    """
    lines = physical_lines(spark, path)
    pieces = record_pieces(lines, block_starts(block_maps(lines)))
    # One that crosses ranges is gathered from a piece of each; its first one has its number.
    joined = pieces.where("NOT whole").groupBy("file", "began").agg(
        F.max(F.when(F.col("block") == F.col("began"), F.col("n"))).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text"))
    every = pieces.where("whole").select("began", "n", "text").unionByName(joined.select("began", "n", "text"))
    return every.where("NOT (began = 0 AND n = 0)").select(F.col("text").alias("record")).where("record <> ''")


def read_quoted(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV files with headers as text columns; values in quotes may hold line breaks.

    The first file names the columns. Values that a record lacks are null, more than
    there are columns are left out.
    """
    names = spark.read.options(header=True, **OPTIONS).csv(path if isinstance(path, str) else list(path)).schema
    if not names.fields:
        return spark.createDataFrame([], names)
    shape = ", ".join(f"c{i} STRING" for i in range(len(names.fields)))
    parsed = records(spark, path).select(F.from_csv("record", shape, OPTIONS).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(f.name) for i, f in enumerate(names.fields)])
