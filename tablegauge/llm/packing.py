"""Packing of token sequences by histogram: non-negative least squares.

Documents become token ids plus one closing id and are cut where they exceed a
window. Piece lengths are counted in classes of ``GRAIN`` tokens. Shallow
combinations of classes that fill a window exactly are enumerated; non-negative
least squares says how often each should occur to use up the histogram; the
counts are rounded down to what is there, and the rest of the histogram is packed
greedily, largest class first. Which sequence a piece belongs to follows from its
rank within its class, so no task ever holds more than its own rows: the
histogram (one row per class) is all that reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.common import sliced, staged
from tablegauge.llm.wordpiece import tokens

WINDOW = 2048
GRAIN = 8
CLOSE = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, rank long"


def ids_of(texts: list[str | None], vocabulary: str) -> list[np.ndarray]:
    """Token ids of each text with the closing id; a null text is an empty one."""
    end = np.array([CLOSE], np.uint32)
    return [np.concatenate((ids, end)) for ids in tokens(vocabulary).encode([text or "" for text in texts])]


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, grain: int = GRAIN, ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` tokens, with their rank among the pieces of
    the same class in the same task; with ``ids``, their ids as little-endian
    unsigned 32-bit numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(window // grain + 1, np.int64)
        for batch in sliced(batches):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            own: list[bytes] = []
            for doc, all_ids in zip(batch.column("doc_id").to_pylist(), ids_of(batch.column("text").to_pylist(), vocabulary)):
                raw = all_ids.astype("<u4").tobytes()
                for start in range(0, len(all_ids), window):
                    piece = raw[4 * start:4 * (start + window)]
                    for k, v in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), len(all_ids))):
                        out[k].append(v)
                    if ids:
                        own.append(piece)
            kind = -(-np.array(out["length"], np.int64) // grain)
            rank = seen[kind] + pd.Series(kind).groupby(kind).cumcount().to_numpy() if len(kind) else kind
            seen += np.bincount(kind, minlength=len(seen))
            columns = {k: pa.array(v, pa.int64()) for k, v in out.items()} | {
                "class": pa.array(kind, pa.int32()), "part": pa.array(np.full(len(kind), part), pa.int32()), "rank": pa.array(rank, pa.int64())}
            if ids:
                columns["ids"] = pa.array(own, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        work, PIECES + ", ids binary" * ids)


def combinations(classes: int) -> np.ndarray:
    """Every combination of up to three classes whose sum is ``classes``, padded with 0."""
    found = [(classes, 0, 0)]
    for a in range(1, classes):
        for b in range(1, min(a, classes - a) + 1):
            c = classes - a - b
            if c == 0 or 0 < c <= b:
                found.append((a, b, c))
    return np.array(found, np.int64)


def least_squares(combos: np.ndarray, wanted: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |A x - wanted|, by the active-set method; column j
    of A counts the classes in combos[j]. ``wanted`` starts at class 0."""
    kinds = len(wanted)
    scale = max(float(wanted.max(initial=0)), 1.0)
    target = wanted / scale
    target[0] = 0

    def columns(which: np.ndarray) -> np.ndarray:
        dense = np.zeros((kinds, len(which)))
        for depth in range(combos.shape[1]):
            np.add.at(dense, (combos[which, depth], np.arange(len(which))), 1.0)
        dense[0] = 0
        return dense

    x, active = np.zeros(len(combos)), np.zeros(0, np.int64)
    rest = target.copy()
    for _ in range(rounds):
        rest[0] = 0
        gain = rest[combos].sum(axis=1)
        gain[active] = -1
        best = int(gain.argmax())
        if gain[best] <= 1e-7:
            break
        active = np.append(active, best)
        while len(active):
            dense = columns(active)
            solved = np.linalg.solve(dense.T @ dense + 1e-10 * np.eye(len(active)), dense.T @ target)
            if solved.min() > 1e-12:
                x[active] = solved
                break
            now = x[active]
            low = solved <= 1e-12
            step = (now[low] / np.maximum(now[low] - solved[low], 1e-300)).min()
            x[active] = np.maximum(now + step * (solved - now), 0)
            x[active[low & (x[active] <= 1e-12)]] = 0
            keep = x[active] > 1e-12
            if keep.all():  # numerically stuck
                break
            active = active[keep]
        rest = target - columns(active) @ x[active] if len(active) else target.copy()
    return x * scale


def plan(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Patterns (class -> how many) and their repeats that use up ``counts``,
    where counts[c] pieces are of class c and the last class fills a window."""
    left, classes = counts.astype(np.int64).copy(), len(counts) - 1
    made: list[tuple[dict[int, int], int]] = []
    if not left.sum():
        return made
    combos = combinations(classes)
    amount = least_squares(combos, left.astype(float))
    for j in np.argsort(-amount, kind="stable"):
        times = int(round(amount[j]))
        if times < 1:
            break
        kinds, many = np.unique(combos[j][combos[j] > 0], return_counts=True)
        if times := min(times, int((left[kinds] // many).min())):
            left[kinds] -= times * many
            made.append((dict(zip(kinds.tolist(), many.tolist())), times))
    while left.any():
        pattern: dict[int, int] = {}
        space = classes
        while space:
            fits = np.flatnonzero(left[:space + 1] > np.array([pattern.get(c, 0) for c in range(space + 1)]))
            if not len(fits):
                break
            pattern[int(fits[-1])] = pattern.get(int(fits[-1]), 0) + 1
            space -= int(fits[-1])
        times = min(int(left[c]) // m for c, m in pattern.items())
        for c, m in pattern.items():
            left[c] -= times * m
        made.append((pattern, times))
    return made


def slots(patterns: list[tuple[dict[int, int], int]], classes: int) -> list[np.ndarray]:
    """For each class, rows (first rank, first sequence, pieces a sequence, first slot)."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(classes + 1)]
    used, sequence = [0] * (classes + 1), 0
    for pattern, times in patterns:
        slot = 0
        for c in sorted(pattern, reverse=True):
            out[c].append((used[c], sequence, pattern[c], slot))
            used[c] += pattern[c] * times
            slot += pattern[c]
        sequence += times
    return [np.array(rows, np.int64).reshape(-1, 4) for rows in out]


def place(cut: DataFrame, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """``cut`` (pieces, written and read back) with sequence_id and offset."""
    classes = window // grain
    counts = cut.groupBy("part", "class").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = staged(counts.withColumn("before", F.coalesce(before, F.lit(0))))
    histogram = np.zeros(classes + 1, np.int64)
    for row in firsts.groupBy("class").agg(F.sum("n").alias("n")).collect():
        histogram[row["class"]] = row["n"]
    table = cut.sparkSession.sparkContext.broadcast(slots(plan(histogram), classes))
    ranked = cut.join(firsts.select("part", "class", "before"), ["part", "class"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields) + ", sequence_id long, slot long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for c in np.unique(kind):
                own = np.flatnonzero(kind == c)
                rows = table.value[c]
                first, base, many, at = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1].T
                sequence[own] = base + (rank[own] - first) // many
                slot[own] = at + (rank[own] - first) % many
            yield batch.append_column("sequence_id", pa.array(sequence)).append_column("slot", pa.array(slot))

    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.mapInArrow(work, out)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("class", "rank", "slot")


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, grain: int = GRAIN, ids: bool = False) -> DataFrame:
    """Every piece of every row of ``docs`` (doc_id, text) with its place.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    with ``ids``, the piece's ids. A null or empty text is its closing id alone; a
    text longer than the window is cut, each id lying in one piece; repeated rows
    are packed as often as they occur, rows with a null doc_id too; other columns
    are ignored; an empty table gives no rows. Sequences hold at most ``window``
    ids and count from 0; pieces of one lie end to end from offset 0.
    """
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return place(staged(pieces(docs, vocabulary, window, grain, ids)), window, grain).select(*columns, *["ids"] * ids)
