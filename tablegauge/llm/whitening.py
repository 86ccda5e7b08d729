"""Whitening of embeddings by a weighted covariance over distinct vectors.

Entries become whole numbers, identical vectors are grouped and counted, and the fit
runs over the distinct ones: their counts (or one each) are weights of exact sums and of
a centred matrix product. Each distinct vector is whitened once and joined back to its
rows. What reaches the driver is a model: sums and a matrix per vector length, bounded
by the square of that length, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import staged

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond it, scaled, count as it: their whole numbers would not fit 64 bits.
LARGEST = 2.0 ** 62
#: A vector with more than this share of all rows is joined by broadcast: at most 1 / SHARE are.
SHARE = 1 / 256
ROWS = 4096


def usable() -> Column:
    """Rows that take part: a vector without null or non-finite entries, not empty."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & (F.size("embedding") > 0), F.lit(False))


def whole(vectors: np.ndarray) -> np.ndarray:
    """The whole numbers that stand for the entries of double vectors."""
    with np.errstate(over="ignore"):
        return np.floor(np.clip(vectors * SCALE, -LARGEST, LARGEST)).astype(np.int64) + SHIFT


def numbered(rows: DataFrame) -> DataFrame:
    """(vec_id, dim, x): x holds ``dim`` little-endian 64-bit whole numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            size = np.diff(vectors.offsets.to_numpy())
            raw = whole(vectors.flatten().to_numpy(zero_copy_only=False)).astype("<i8").tobytes()
            ends = 8 * np.concatenate(([0], np.cumsum(size)))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "dim": pa.array(size, pa.int32()),
                "x": pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())})

    valid = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable())
    return valid.mapInArrow(work, "vec_id long, dim int, x binary")


def _matrix(cells: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), kind).reshape(-1, dim)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of batches whose vectors have one length."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            own = batch.filter(pa.array(dims == dim))
            for at in range(0, own.num_rows, ROWS):
                yield int(dim), own.slice(at, ROWS)


def exact_sums(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per vector length, the weight and the weighted sum of each dimension, exactly."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for dim, part in _each(batches):
            x, w = _matrix(part.column("x"), dim, "<i8"), part.column("weight").to_numpy()
            held = total.setdefault(dim, [0, np.zeros(dim, object)])
            held[0] += int(w.sum())
            if float(np.abs(x.astype(float)).max()) * float(w.sum()) < 2.0 ** 62:
                held[1] = held[1] + (x * w[:, None]).sum(axis=0).astype(object)
            else:
                held[1] = held[1] + (x.astype(object) * w.astype(object)[:, None]).sum(axis=0)
        for dim, (n, s) in total.items():
            # Limbs, as a sum may pass 64 bits.
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([dim] * (dim + 1), pa.int32()), "at": pa.array(range(-1, dim), pa.int32()),
                "low": pa.array([int(v) & (2 ** 31 - 1) for v in (n, *s)], pa.int64()), "high": pa.array([int(v) >> 31 for v in (n, *s)], pa.decimal128(38, 0))})

    parts = distinct.select("dim", "x", "weight").mapInArrow(work, "dim int, at int, low long, high decimal(38,0)")
    got = parts.groupBy("dim", "at").agg(F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.sum("high").alias("high")).collect()
    out: dict[int, dict[int, int]] = {}
    for r in got:
        out.setdefault(r["dim"], {})[r["at"]] = int(r["low"]) + (int(r["high"]) << 31)
    return {dim: (own[-1], [own[i] for i in range(dim)]) for dim, own in out.items()}


def gathered(rows: DataFrame, square: Callable[[int, pa.RecordBatch], np.ndarray]) -> dict[int, np.ndarray]:
    """Per vector length, the sum over all parts of a matrix of doubles that ``square``
    makes of each. Tasks send one matrix per length; they are added by their rows, in
    the order of tasks, so that the sum does not depend on which comes first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for dim, part in _each(batches):
            own = square(dim, part)
            total[dim] = total[dim] + own if dim in total else own
        for dim, matrix in total.items():
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([dim] * len(matrix), pa.int32()), "line": pa.array(range(len(matrix)), pa.int32()),
                "task": pa.array([TaskContext.get().partitionId()] * len(matrix), pa.int32()), "cells": pa.array([r.astype("<f8").tobytes() for r in matrix], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0)
        for batch in batches:
            for row in batch.to_pylist():
                of, cells = (row["dim"], row["line"]), np.frombuffer(row["cells"], "<f8")
                if of == now:
                    total = total + cells
                else:
                    if now is not None:
                        yield line(now, total)
                    now, total = of, cells
        if now is not None:
            yield line(now, total)

    def line(of: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"dim": pa.array([of[0]], pa.int32()), "line": pa.array([of[1]], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(work, "dim int, line int, task int, cells binary")
    sent = parts.repartition("dim", "line").sortWithinPartitions("dim", "line", "task")
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in sent.mapInArrow(add, "dim int, line int, cells binary").collect():
        out.setdefault(r["dim"], {})[r["line"]] = np.frombuffer(r["cells"], "<f8")
    return {dim: np.stack([own[i] for i in range(len(own))]) for dim, own in out.items()}


@dataclass
class Whitening:
    """The model of one vector length."""

    n: int  # rows that were fitted, by weight
    sums: list[int]  # of each dimension, exact
    axes: np.ndarray  # dim x components: unit eigenvectors over the root of their eigenvalue
    explained: np.ndarray  # eigenvalues over the trace

    @property
    def base(self) -> np.ndarray:
        """The whole numbers next to the means; what is left of them is below one."""
        return np.array([s // self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the means: a whole part that is exact, then what is below one."""
        base = self.base
        rest = np.array([(s - int(b) * self.n) / self.n for s, b in zip(self.sums, base)])
        return (x - base).astype(float) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - sum)^2, exact; None where it passes 64 bits."""
        sums, n, dim = np.array(self.sums, object), self.n, len(self.sums)
        gap = float(np.abs(self.centred(x)).max(initial=0)) + 1
        if dim * (n * gap) ** 2 < 2.0 ** 62 and n * (float(np.abs(x.astype(float)).max(initial=0)) + 1) < 2.0 ** 62:
            return ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
        return [int(v) if v < 2 ** 63 else None for v in exact]


def fitted(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A model per vector length of (dim, x, weight) rows, each x once.

    Eigenvectors are signed so that their largest entry is positive. Components whose
    eigenvalue is not above what rounding leaves, as in a single or constant vector, are
    none.
    """
    sums = exact_sums(distinct)
    models = {dim: Whitening(n, s, np.zeros((dim, 0)), np.zeros(0)) for dim, (n, s) in sums.items()}
    shared = distinct.sparkSession.sparkContext.broadcast(models)

    def product(dim: int, part: pa.RecordBatch) -> np.ndarray:
        gap = shared.value[dim].centred(_matrix(part.column("x"), dim, "<i8"))
        return (gap * part.column("weight").to_numpy()[:, None]).T @ gap

    for dim, total in gathered(distinct.select("dim", "x", "weight"), product).items():
        variance, axes = np.linalg.eigh((total + total.T) / (2 * models[dim].n))
        order = np.argsort(-variance, kind="stable")[:components]
        order = order[variance[order] > dim * np.finfo(float).eps * max(variance.max(), 0)]
        own = axes[:, order] * np.sign(axes[np.abs(axes[:, order]).argmax(axis=0), order])
        models[dim].axes = own / np.sqrt(variance[order])
        models[dim].explained = variance[order] / max(variance.sum(), np.finfo(float).tiny)
    return models


def applied(distinct: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """(dim, x, weight, count, deviation, whitened) of each distinct vector, whitened once."""
    shared = distinct.sparkSession.sparkContext.broadcast(models)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in _each(batches):
            model, x = shared.value[dim], _matrix(part.column("x"), dim, "<i8")
            made = model.whitened(x)
            yield pa.RecordBatch.from_pydict({
                **{c: part.column(c) for c in ("dim", "x", "weight", "count")}, "deviation": pa.array(model.deviation(x), pa.int64()),
                "whitened": pa.array(list(made), pa.list_(pa.float64()))})

    return distinct.select("dim", "x", "weight", "count").mapInArrow(work, "dim int, x binary, weight long, count long, deviation long, whitened array<double>")


def identity_errors(done: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """Per vector length, how far the covariance of the whitened vectors is from the identity."""

    def of(part: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
        return np.stack(part.column("whitened").to_pylist()).reshape(part.num_rows, -1), part.column("weight").to_numpy()

    def total(dim: int, part: pa.RecordBatch) -> np.ndarray:
        made, weight = of(part, dim)
        return (made * weight[:, None]).sum(axis=0)[None, :]

    rows = done.select("dim", "weight", "whitened").where(F.size("whitened") > 0)
    mean = {dim: (s[0] / models[dim].n) for dim, s in gathered(rows, total).items()}

    def product(dim: int, part: pa.RecordBatch) -> np.ndarray:
        made, weight = of(part, dim)
        gap = made - mean[dim]
        return (gap * weight[:, None]).T @ gap

    return {dim: float(np.abs(s / models[dim].n - np.eye(len(s))).max()) for dim, s in gathered(rows, product).items()}


def whiten(rows: DataFrame, components: int = COMPONENTS, counted: bool = True) -> DataFrame:
    """vec_id, dim, n, deviation, whitened (array), explained (array) and identity_error
    of every row of ``rows`` that takes part.

    Rows whose vector is null, empty or holds null or non-finite entries take no part;
    a null vec_id does. Each vector length is fitted by itself. ``counted`` weighs a
    vector by its rows, else each distinct one counts once; n is the summed weight.
    Repeated rows get a row each, equal vectors equal values; scaled entries beyond 2**62
    count as that; a deviation that passes 64 bits is null. Without variance, as in a
    table of one row, there are no components and identity_error is null. An empty table
    gives no rows; other columns are ignored.
    """
    each = staged(numbered(rows))
    weight = F.count("*") if counted else F.lit(1).cast("long")
    distinct = staged(each.groupBy("dim", "x").agg(F.count("*").alias("count"), weight.alias("weight")))
    models = fitted(distinct, components)
    done = staged(applied(distinct, models))
    errors = identity_errors(done, models)
    total = done.agg(F.sum("count")).first()[0] or 0

    spark = rows.sparkSession
    model = spark.createDataFrame(
        [(dim, m.n, m.explained.tolist(), errors.get(dim)) for dim, m in models.items()], "dim int, n long, explained array<double>, identity_error double")
    frequent = F.col("count") > SHARE * total
    made = done.select(F.col("dim").alias("__dim"), F.col("x").alias("__x"), "count", "deviation", "whitened")
    hot = made.where(frequent).drop("count")
    own = (F.col("dim") == F.col("__dim")) & (F.col("x") == F.col("__x"))
    # Frequent vectors, at most 1 / SHARE, are broadcast; any other has few rows.
    often = each.join(F.broadcast(hot), own)
    seldom = each.join(F.broadcast(hot.select("__dim", "__x")), own, "left_anti").join(made.where(~frequent).drop("count"), own)
    return often.unionByName(seldom).join(F.broadcast(model), "dim").select("vec_id", "dim", "n", "deviation", "whitened", "explained", "identity_error")
