"""Reproducible shuffle into shards, by a Feistel permutation of row numbers.

Rows are numbered in an order that does not depend on files or partitions. A
Feistel network over pairs (left below ``a``, right below ``b``, a * b just over the
row count) permutes the numbers; a number that lands beyond the last row walks on
until it does not. The permuted number is the row's place in the shuffle: its
remainder by the shard count is the shard, its quotient the slot, so both follow
from the row number alone and shards differ by one row at most. Only keys and
numbers are shuffled, never texts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.common import staged

SHARDS = 16
#: A multiplier and an addend per round; halves stay below 2**31, so products fit a long.
ROUNDS = ((1_103_515_245, 12_345), (1_664_525, 1_013_904_223), (214_013, 2_531_011),
          (69_069, 907_133_923), (1_220_703_125, 7), (630_360_016, 2_147_001))
PRIME = 2_147_483_647
#: Times a number may walk on. Fewer than sqrt(rows) numbers lie beyond the last
#: row; a longer walk stops the job rather than give a wrong place.
WALKS = 64


def halves(rows: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    return a, max(1, -(-rows // a))


def network(number: str, rows: int) -> str:
    """SQL for one pass of ``number`` through the network for ``rows`` numbers."""
    a, b = halves(rows)
    text = f"named_struct('l', {number} DIV {b}, 'r', {number} % {b})"
    for i, (multiplier, addend) in enumerate(ROUNDS):
        half, other, size = ("l", "r", a) if i % 2 == 0 else ("r", "l", b)
        stirred = f"(s.{other} * {multiplier} + {addend}) % {PRIME}"
        moved = f"(s.{half} + transform(array({stirred}), m -> (m * m) % {PRIME})[0]) % {size}"
        left, right = (moved, "s.r") if half == "l" else ("s.l", moved)
        text = f"transform(array({text}), s -> named_struct('l', {left}, 'r', {right}))[0]"
    return f"transform(array({text}), s -> s.l * {b} + s.r)[0]"


def place(number: str, rows: int) -> str:
    """SQL for the place of row ``number`` of ``rows``: the network, walked on."""
    walked = f"aggregate(sequence(1, {WALKS}), {network(number, rows)}, (p, i) -> IF(p < {rows}, p, {network('p', rows)}))"
    return f"transform(array({walked}), p -> IF(p < {rows}, p, raise_error('a number walks too far')))[0]"


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with a dense ``number`` from 0 in the order of ``order``.

    Rows are range-partitioned and written; each part's count, summed over the
    parts before it, gives its first number. Rows equal in all of ``order`` get
    neighbouring numbers.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id() % F.lit(1 << 33)
    parts = staged(ordered.select("*", F.spark_partition_id().alias("__part"), within.alias("__at")))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n"))
    firsts = staged(sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__first")))
    return parts.join(firsts, "__part").withColumn("number", F.col("__at") + F.col("__first")).drop("__part", "__at", "__first")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of every row of ``docs``: doc_id, size, text_crc32, law, shard,
    slot, grown_shard.

    Rows are numbered by doc_id (nulls first), then by the text's hash; equal texts
    are rows like others and equal rows neighbours. A null text has size 1 and the
    crc32 of an empty one. The law is ``rows``: shards differ by one row at most,
    so grown_shard is null. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = staged(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash")))
    total = keys.count()
    return numbered(keys, ["doc_id", "text_crc32", "hash", "size"]).withColumn("place", F.expr(place("number", total))).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place DIV {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
