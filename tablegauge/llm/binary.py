"""Token matrices: best-fit-decreasing packing, written as binary columns.

Each task packs the documents it reads, a bounded buffer of tokens at a time:
pieces in order of falling length, each into the fullest sequence that still has
room. A segment tree over capacities finds that sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import sliced
from tablegauge.llm.packing import WINDOW, ids_of

#: Tokens a task gathers before it packs them.
BUFFER = 1_000_000
SEGMENT = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64())])
ROWS = pa.schema([("sequence_id", pa.int64()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
                  ("position_ids", pa.binary()), ("segments", pa.list_(SEGMENT))])
DDL = ("sequence_id long, ids binary, cu_seqlens array<int>, position_ids binary, "
       "segments array<struct<doc_id: bigint, start: bigint, length: bigint, doc_tokens: bigint>>")


class Capacities:
    """Sequences by their free room; a tree node counts those below it."""

    def __init__(self, window: int):
        self.leaves = 1 << int(window).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.held[room].append(sequence)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A sequence with the least room of at least ``need``, and that room."""
        node = need + self.leaves
        if not self.count[node]:
            # Up to the first right-hand neighbour that holds any, then down its left side.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return self.held[room].pop(), room

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """The places in ``lengths`` that share each sequence, longest first."""
    open_, made = Capacities(window), []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = open_.take(lengths[i])
        if found is None:
            made.append([i])
            found = len(made) - 1, window
        else:
            made[found[0]].append(i)
        if room := found[1] - lengths[i]:
            open_.add(room, found[0])
    return made


def matrices(docs: DataFrame, vocabulary: str, window: int = WINDOW, buffer: int = BUFFER) -> DataFrame:
    """One row per sequence of ``window`` ids.

    ``ids`` and ``position_ids`` are ``window`` little-endian unsigned numbers of
    32 and 16 bits; positions restart at 0 with every segment and in the padding,
    whose ids are 0; ``cu_seqlens`` starts at 0 and ends at the ids used;
    ``segments`` says which ids of which document each segment holds. Null texts
    are empty ones (their closing id alone); overlong documents are cut, every id
    lying in one segment; repeated rows stay; an empty table gives no rows.
    """

    def packed(held: list[tuple[int | None, int, int, np.ndarray]], part: int, done: int) -> pa.RecordBatch:
        rows: dict[str, list] = {name: [] for name in ROWS.names}
        for k, members in enumerate(best_fit([len(x[3]) for x in held], window)):
            own = [held[i] for i in members]
            matrix, positions = np.zeros(window, "<u4"), np.zeros(window, "<u2")
            ends = np.cumsum([0, *(len(x[3]) for x in own)])
            for a, b, x in zip(ends[:-1], ends[1:], own):
                matrix[a:b] = x[3]
                positions[a:b] = np.arange(b - a)
            positions[ends[-1]:] = np.arange(window - ends[-1])
            rows["sequence_id"].append((part << 33) + done + k)
            rows["ids"].append(matrix.tobytes())
            rows["position_ids"].append(positions.tobytes())
            rows["cu_seqlens"].append(ends.tolist())
            rows["segments"].append([{"doc_id": x[0], "start": x[1], "length": len(x[3]), "doc_tokens": x[2]} for x in own])
        return pa.RecordBatch.from_pydict(rows, schema=ROWS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, size, held = TaskContext.get().partitionId(), 0, 0, []
        for batch in sliced(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), ids_of(batch.column("text").to_pylist(), vocabulary)):
                for start in range(0, len(ids), window):
                    held.append((doc, start, len(ids), ids[start:start + window]))
                    size += len(held[-1][3])
                    if size >= buffer:
                        out = packed(held, part, done)
                        done, size, held = done + out.num_rows, 0, []
                        yield out
        if held:
            yield packed(held, part, done)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, DDL)


def segments(written: DataFrame) -> DataFrame:
    """One row per segment of written matrices, its figures taken from the binary columns."""
    return written.select(
        "sequence_id", "ids", "position_ids", "cu_seqlens", F.posexplode("segments").alias("at", "s"),
    ).selectExpr(
        "s.doc_id", "s.start", "s.length", "s.doc_tokens", "sequence_id",
        "CAST(cu_seqlens[at] AS LONG) AS offset",
        "crc32(substring(ids, 4 * cu_seqlens[at] + 1, 4 * (cu_seqlens[at + 1] - cu_seqlens[at]))) AS ids_crc32",
        "hex(substring(position_ids, 2 * cu_seqlens[at] + 1, 2)) = '0000' AS position_reset",
    )
