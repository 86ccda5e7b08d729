"""Nearest neighbours by block products of quantised vectors.

Vectors are packed in blocks; a tile pairs a block of queries with one of candidates.
Their int8 forms give the distance of the quantised vectors, and the rounding error
of both vectors bounds how far the true distance can be from it. Pairs whose lower
bound exceeds the tenth smallest upper bound cannot be among the ten nearest; the
rest are computed again from the original vectors in double precision, and heaps
merge tiles. Every pair is decided, so the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.common import staged

NEAREST = 10
QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 4096
#: Query vectors that are broadcast (bytes); more are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Queries whose heaps a task holds at once.
HELD = 100_000


def usable() -> Column:
    """Rows that take part: a vec_id and a finite vector that is not all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scale, the square of their length and the rounding error."""
    scale = np.maximum(np.abs(vectors).max(axis=1) / 127, np.finfo(float).tiny)
    small = np.rint(vectors / scale[:, None]).astype(np.int8)
    near = small * scale[:, None]
    return small, scale, (near ** 2).sum(axis=1), np.sqrt(((vectors - near) ** 2).sum(axis=1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, summed in the order of components."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        gap = a[:, i] - b[:, i]
        total += gap * gap
    return np.sqrt(total)


class Nearest:
    """The ``k`` nearest found so far of each query, as heaps of (-distance, -id)."""

    def __init__(self, k: int):
        self.k = k
        self.heaps: dict[int, list[tuple[float, int]]] = {}

    def limit(self, ids: np.ndarray) -> np.ndarray:
        """The distance that a new neighbour must not exceed."""
        full = (self.heaps.get(q) for q in ids.tolist())
        return np.array([-h[0][0] if h and len(h) >= self.k else np.inf for h in full])

    def add(self, query: int, ids: list[int], found: list[float]) -> None:
        heap = self.heaps.setdefault(query, [])
        for item in zip((-d for d in found), (-i for i in ids)):
            if len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)

    def drain(self) -> pa.RecordBatch:
        rows = [(q, -i, -d) for q, heap in self.heaps.items() for d, i in heap]
        self.heaps = {}
        return pa.RecordBatch.from_pydict({"query_id": pa.array([r[0] for r in rows], pa.int64()), "vec_id": pa.array([r[1] for r in rows], pa.int64()),
                                           "score": pa.array([r[2] for r in rows], pa.float64())})


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, best: Nearest, step: int = 512, pairs: int = 500_000) -> None:
    """Adds to ``best`` what candidates c give queries q; a row's own id is left out."""
    # Bounds are taken of vectors brought near one by a power of two, so that no square
    # passes what a double holds, however large or small the components are.
    unit = 2.0 ** int(np.clip(-np.frexp(max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)))[1], -1000, 1000))
    small, scale, square, error = quantised(c * unit)
    exact = np.float32 if c.shape[1] <= 1000 else np.float64  # products of int8 stay exact
    other = small.astype(exact).T
    for at in range(0, len(q), step):
        own, ids = q[at:at + step], q_ids[at:at + step]
        s, sc, sq, er = quantised(own * unit)
        dot = (s.astype(exact) @ other).astype(np.float64)
        near = np.sqrt(np.maximum(sq[:, None] + square[None, :] - 2 * sc[:, None] * scale[None, :] * dot, 0))
        slack = er[:, None] + error[None, :] + 1e-7 * (np.sqrt(sq)[:, None] + np.sqrt(square)[None, :])
        high = near + slack
        high[ids[:, None] == c_ids[None, :]] = np.inf
        kth = np.partition(high, best.k - 1, axis=1)[:, best.k - 1] if high.shape[1] >= best.k else np.full(len(own), np.inf)
        keep = (near - slack <= np.minimum(kth, best.limit(ids) * unit)[:, None]) & np.isfinite(high)
        row, column = np.nonzero(keep)
        for part in range(0, len(row), pairs):
            r, k = row[part:part + pairs], column[part:part + pairs]
            found = distances(own[r], c[k])
            cuts = np.flatnonzero(np.diff(r)) + 1
            for x, y, z in zip(np.split(r, cuts), np.split(c_ids[k], cuts), np.split(found, cuts)):
                best.add(int(ids[x[0]]), y.tolist(), z.tolist())


PACKED = "dim int, ids binary, vectors binary"


def packed(ids: np.ndarray, vectors: list) -> Iterator[dict]:
    """One block per vector length."""
    length = np.array([len(v) for v in vectors])
    for dim in np.unique(length):
        own = np.flatnonzero(length == dim)
        yield {"dim": int(dim), "ids": ids[own].astype("<i8").tobytes(), "vectors": np.array([vectors[i] for i in own], "<f8").tobytes()}


def search(rows: DataFrame, queries: Column, k: int = NEAREST) -> DataFrame:
    """The k nearest rows of each row that ``queries`` selects: query_id, rank, vec_id, score.

    Nearness is the smallest Euclidean distance in double precision, ties to the
    smaller vec_id; rows with the query's own vec_id are left out. Vectors that are
    null, empty, all zero or hold null or non-finite components, and rows without a
    vec_id, take no part. Vectors are compared with those of their own length. Equal
    rows are candidates each; a query id that repeats asks once, with its smallest
    vector. An empty table gives no rows; other columns are ignored.
    """
    valid = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable())
    asked = valid.where(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = staged(asked.withColumn("dim", F.size("embedding")))
    count, size = asked.agg(F.count("*"), F.sum("dim")).first()
    blocks = max(1, -(-count // QUERY_BLOCK))

    def pack_queries(table: pa.Table) -> pa.Table:
        made = list(packed(table.column("vec_id").to_numpy(), table.column("embedding").to_pylist()))
        return pa.Table.from_pydict({"dim": pa.array([m["dim"] for m in made], pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(made), pa.int32()),
                                     "q_ids": [m["ids"] for m in made], "q": [m["vectors"] for m in made]})

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    left = asked.select("vec_id", "embedding", "dim", block).groupBy("dim", "block").applyInArrow(pack_queries, "dim int, block int, q_ids binary, q binary")
    if 8 * (size or 0) <= BROADCAST_BYTES:
        left = F.broadcast(left)

    def pack_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATE_BLOCK):
                part = batch.slice(at, CANDIDATE_BLOCK)
                made = list(packed(part.column("vec_id").to_numpy(), part.column("embedding").to_pylist()))
                yield pa.RecordBatch.from_pydict({"dim": pa.array([m["dim"] for m in made], pa.int32()), "ids": [m["ids"] for m in made], "vectors": [m["vectors"] for m in made]})

    right = valid.mapInArrow(pack_candidates, PACKED).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = right.join(left, ["dim", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(k)
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                ids, vectors, q_ids, q = (batch.column(c)[i].as_buffer() for c in ("ids", "vectors", "q_ids", "q"))
                tile(np.frombuffer(q_ids, "<i8"), np.frombuffer(q, "<f8").reshape(-1, dim), np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(-1, dim), best)
                if len(best.heaps) > HELD:
                    yield best.drain()
        yield best.drain()

    found = tiles.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
