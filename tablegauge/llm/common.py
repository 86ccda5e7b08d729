"""Helpers the text operators share: tables, staging, word splitting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.sources.staging import staged

__all__ = ["Words", "chunks", "documents", "mixed", "remainder", "ruled", "sampled", "sliced", "staged", "table"]

#: Characters that one step of a vectorised operator holds at a time.
CHUNK = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def remainder(column: Column | str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; null stays null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def ruled(rule: Column) -> Column:
    """A rule on doc_id, true where doc_id is null: such rows are never learnt from."""
    return F.coalesce(rule, F.lit(True))


def sampled(rows: DataFrame, by: Sequence[str], bound: int) -> DataFrame:
    """About ``bound`` of the rows, chosen by a hash of ``by`` (all of them, if
    there are fewer); the choice does not depend on layout or partitions. Rows equal
    in ``by`` are chosen together; where none is, all rows are few different ones
    and are taken."""
    total = rows.count()
    if total <= bound:
        return rows
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("sample"), *by), F.lit(total)) < bound)
    return rows if chosen.isEmpty() else chosen


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that a step holds few long texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(texts: Sequence[str], limit: int = CHUNK) -> Iterator[slice]:
    """Slices of ``texts`` of about ``limit`` characters; a longer text is a
    slice of its own."""
    start = size = 0
    for stop, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield slice(start, stop)
            start, size = stop, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


#: White space beyond ASCII, and what replaces it.
BLANKS = {ord(c): " " for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"}
BLANK_BYTES = np.zeros(256, bool)
BLANK_BYTES[[9, 10, 11, 12, 13, 32]] = True
RADIX = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
BYTE_VALUES = np.random.default_rng(20_000_000).integers(1, 2**63, 256, dtype=np.uint64)


@lru_cache(maxsize=2)
def _powers(length: int, radix: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(length, radix, np.uint64))), dtype=np.uint64)


def mixed(value: np.ndarray) -> np.ndarray:
    """Well spread 64-bit hashes of 64-bit values."""
    with np.errstate(over="ignore"):
        value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def blanked(text: str) -> str:
    """``text`` with every white space beyond ASCII as a blank."""
    if not text.isascii() and any(chr(c) in text for c in BLANKS):
        return text.translate(BLANKS)
    return text


class Words:
    """The words of some texts, cut at white space.

    ``unique`` has each word once and ``hashes`` its 64-bit hash, ``at`` the
    place in them of every word in turn; the words of text i are those from
    ``starts[i]`` to ``ends[i]``. Words are told apart by a hash of their bytes.
    """

    def __init__(self, texts: Sequence[str]):
        joined = " ".join([blanked(text) for text in texts]) + " "
        bytes_ = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
        blank = BLANK_BYTES[bytes_]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edges = np.concatenate(([0], edges))
        first, last = edges[0::2], edges[1::2]
        first = first[:len(last)]  # the text ends in a blank
        room = 1 << max(21, int(len(bytes_)).bit_length())
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[bytes_] * _powers(room, RADIX)[:len(bytes_)], dtype=np.uint64)))
            hashes = mixed((sums[last] - sums[first]) * _powers(room, pow(RADIX, -1, 1 << 64))[first])
        codes, unique = pd.factorize(hashes)
        self.at, self.hashes = codes.astype(np.int32), unique
        seen = np.zeros(len(unique), np.int64)
        seen[codes[::-1]] = np.arange(len(codes))[::-1]
        self._raw, self._first, self._last = bytes_.tobytes(), first[seen], last[seen]
        size = np.array([len(text) if text.isascii() else len(text.encode("utf-8", "replace")) for text in map(blanked, texts)], np.int64)
        stops = np.cumsum(size + 1) if len(texts) else size
        self.ends = np.searchsorted(first, stops)
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64) if len(texts) else self.ends

    def spelled(self, which: np.ndarray) -> list[str]:
        """The text of some of the distinct words."""
        raw = self._raw
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(self._first[which].tolist(), self._last[which].tolist())]

    @property
    def unique(self) -> list[str]:
        """The text of every distinct word."""
        return self.spelled(np.arange(len(self.hashes)))

    def sums(self, of_unique: np.ndarray) -> np.ndarray:
        """Per text, the sum over its words of a value (or row) per unique word."""
        rows = np.concatenate((np.zeros((1, *of_unique.shape[1:])), np.cumsum(of_unique[self.at], axis=0, dtype=np.float64)))
        return rows[self.ends] - rows[self.starts]
