"""Isolation forest (Liu, Ting, Zhou 2008) as Spark jobs.

Trees grow in parallel, one group of at most 256 sampled rows each; scoring
walks all trees over Arrow batches. The sample that leaves the table has a
fixed size, and so has the fitted model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.quantiles import quantile_row
from tablegauge.functions.scalars import aggregate, assign, one_row, q, to_number, types_of
from tablegauge.sources.staging import staged

RAW = "__isolation_raw"
LIMITS = "__isolation_limits"
MEDIANS = "__medians"
NODE_SCHEMA = "tree int, node int, feature int, cut double, length double"
#: Rows scored at a time, so that all trees' positions stay in the CPU cache.
CHUNK = 1024


def mean_path(size):
    """Mean depth of a failed search in a binary tree of ``size`` keys."""
    size = np.asarray(size, dtype=float)
    harmonic = np.log(np.maximum(size - 1, 1)) + np.euler_gamma
    return np.where(size > 2, 2 * harmonic - 2 * (size - 1) / np.maximum(size, 1),
                    np.where(size == 2, 1.0, 0.0))


def depth_limit(size: int) -> int:
    return max(1, math.ceil(math.log2(max(size, 2))))


def grow(values: np.ndarray, limit: int, rng: np.random.Generator) -> pd.DataFrame:
    """A tree as a full binary layout of depth ``limit``.

    Node ``k`` has children ``2k+1`` and ``2k+2``. A branch that ends early
    always steps left (its cut is infinite) down to the bottom, where
    ``length`` holds the path length of the rows that end there.
    """
    nodes = 2 ** (limit + 1) - 1
    feature, cut, length = np.zeros(nodes, dtype=int), np.full(nodes, np.inf), np.zeros(nodes)
    pending = [(0, values, 0)]
    while pending:
        at, part, depth = pending.pop()
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(1), np.zeros(1))
        usable = np.flatnonzero(high > low)
        if depth == limit or len(part) <= 1 or len(usable) == 0:
            bottom = (at + 1) * 2 ** (limit - depth) - 1
            length[bottom] = depth + mean_path(len(part))
            continue
        feature[at] = rng.choice(usable)
        cut[at] = rng.uniform(low[feature[at]], high[feature[at]])
        right = part[:, feature[at]] > cut[at]
        pending += [(2 * at + 1, part[~right], depth + 1), (2 * at + 2, part[right], depth + 1)]
    return pd.DataFrame({"node": np.arange(nodes), "feature": feature, "cut": cut, "length": length})


@dataclass(frozen=True)
class Trees:
    """All trees side by side; every array is ``trees x nodes``."""

    feature: np.ndarray
    cut: np.ndarray
    length: np.ndarray
    limit: int

    def mean_length(self, values: np.ndarray) -> np.ndarray:
        """Mean path length of each row, all rows and trees stepping together."""
        count, nodes = self.feature.shape
        base = (np.arange(count, dtype=np.int64) * nodes)[:, None]
        feature, cut, length = self.feature.ravel(), self.cut.ravel(), self.length.ravel()
        out = np.empty(len(values))
        for start in range(0, len(values), CHUNK):
            part = np.ascontiguousarray(values[start:start + CHUNK].T)
            rows = part.shape[1]
            flat, place = part.ravel(), np.arange(rows)
            at = np.zeros((count, rows), dtype=np.int64)
            for _ in range(self.limit):
                here = base + at
                seen = flat.take(feature.take(here) * rows + place)
                at = 2 * at + 1 + (seen > cut.take(here))
            out[start:start + CHUNK] = length.take(base + at).mean(axis=0)
        return out


def with_numbers(
    df: DataFrame, names: Sequence[str], medians: DataFrame | None
) -> tuple[DataFrame, list[str]]:
    """Number expressions without gaps, over ``df`` with the medians at hand."""
    kinds = types_of(df)
    if medians is None:
        return df, [f"coalesce({to_number(c, kinds[c])}, 0.0D)" for c in names]
    stand_in = {c: f"{MEDIANS}.{q(c)}, " for c in medians.columns}
    df = df.withColumn(MEDIANS, one_row(medians))
    return df, [f"coalesce({to_number(c, kinds[c])}, {stand_in.get(c, '')}0.0D)" for c in names]


@dataclass(frozen=True)
class ForestModel:
    """A fitted forest. ``trees`` is None where a table cannot be scored."""

    names: tuple[str, ...]
    medians: DataFrame | None
    trees: Trees | None
    sample_size: int

    def raw(self, df: DataFrame, out: str = RAW) -> DataFrame:
        """Add the anomaly score of the paper, between 0 and 1.

        Only the numeric columns travel to Python; the rest stays in the JVM.
        """
        df, inputs = with_numbers(df, self.names, self.medians)
        shared = df.sparkSession.sparkContext.broadcast(self.trees)
        normal = float(mean_path(self.sample_size))

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            # With a single input column a batch is that column itself.
            trees = shared.value
            for batch in batches:
                columns = (batch,) if isinstance(batch, pd.Series) else batch
                values = np.column_stack([s.to_numpy(dtype=float) for s in columns])
                yield pd.Series(np.exp2(-trees.mean_length(values) / normal))

        return df.withColumn(out, score(*[F.expr(e) for e in inputs])).drop(MEDIANS)

    def score(
        self, df: DataFrame, out: str = "isolation_score", numbers: DataFrame | None = None
    ) -> DataFrame:
        """Add the score scaled to 0..100 by the table's own extremes.

        Rows walk the forest once: their raw scores are written, and the extremes
        read from there. With ``numbers`` (the same rows, number columns only)
        the extremes come from a walk over those, and ``df`` stays lazy.
        """
        if self.trees is None:
            return assign(df, {out: "0.0D"})
        if numbers is None:
            scored = staged(self.raw(df))
            limits = aggregate(scored, {"low": f"min({RAW})", "high": f"max({RAW})"})
        else:
            scored = self.raw(df)
            limits = aggregate(self.raw(numbers), {"low": f"min({RAW})", "high": f"max({RAW})"})
        scored = scored.withColumn(LIMITS, one_row(limits))
        spread = f"({LIMITS}.high - {LIMITS}.low)"
        scaled = f"rint(1000.0D * ({RAW} - {LIMITS}.low) / {spread}) / 10.0D"
        return assign(scored, {out: f"CASE WHEN {spread} > 0 THEN {scaled} ELSE 0.0D END"},
                      drop=(RAW, LIMITS))


@dataclass(frozen=True)
class IsolationForest:
    trees: int = 100
    sample_size: int = 256
    seed: int = 42
    minimum_rows: int = 10

    def fit(self, df: DataFrame, names: Sequence[str], row_key: Sequence[str]) -> ForestModel:
        """Grow the trees. The driver receives nodes only, at most 511 per tree."""
        if not names:
            return ForestModel((), None, None, self.sample_size)
        kinds = types_of(df)
        counted = aggregate(df, {"__rows": "count(1)"} | {
            c: f"count({to_number(c, kinds[c])})" for c in names}).first().asDict()
        rows = counted["__rows"]
        if rows < self.minimum_rows:
            return ForestModel(tuple(names), None, None, self.sample_size)
        # Medians stand in for missing numbers; after cleaning there are none.
        gaps = [c for c in names if counted[c] < rows]
        medians = quantile_row(df, gaps, (0.5,)).selectExpr(
            *[f"{q('q0_' + c)} AS {q(c)}" for c in gaps]) if gaps else None
        sample = self.sampled(df, names, row_key, rows, medians)
        size, seed = min(self.sample_size, rows), self.seed
        limit, width = depth_limit(size), len(names)

        def train(group: pd.DataFrame) -> pd.DataFrame:
            tree = int(group["tree"].iloc[0])
            ordered = group.sort_values("__order")
            values = np.array(ordered["values"].tolist(), dtype=float).reshape(-1, width)
            grown = grow(values, limit, np.random.default_rng([seed, tree]))
            return grown.assign(tree=tree)[["tree", "node", "feature", "cut", "length"]]

        nodes = sample.groupBy("tree").applyInPandas(train, NODE_SCHEMA).toPandas()
        if nodes["tree"].nunique() < self.trees:
            raise ValueError("a tree got no rows: too few rows differ in key or numbers")
        nodes = nodes.sort_values(["tree", "node"])
        shape = (nodes["tree"].nunique(), -1)
        grown = Trees(*[nodes[c].to_numpy().reshape(shape) for c in ("feature", "cut", "length")], limit)
        return ForestModel(tuple(names), medians, grown, size)

    def sampled(
        self, df: DataFrame, names: Sequence[str], row_key: Sequence[str], rows: int,
        medians: DataFrame | None,
    ) -> DataFrame:
        """``tree, values`` with at most ``sample_size`` random rows per tree.

        Everything is decided by hashes of the row key and the numbers, in
        parallel and alike at every size. A first hash thins the table to the
        pool (the whole table, where that is no larger); for every tree, a second
        one keeps a few pool rows per wanted row, of which the tree takes those of
        lowest hash. Rows that agree in key and numbers are the same point.
        """
        spare = 4 * self.sample_size
        wanted = self.trees * spare
        df, values = with_numbers(df, names, medians)
        hashed = f"xxhash64({', '.join([*(q(c) for c in row_key), *values])}, {self.seed})"
        pool = df.selectExpr(f"{hashed} AS __hash", f"array({', '.join(values)}) AS `values`")
        pool = pool.filter(f"pmod(__hash, {rows}) < {wanted}")
        drawn = pool.selectExpr("`values`", "__hash", f"explode(sequence(0, {self.trees - 1})) AS tree")
        drawn = drawn.selectExpr("tree", "`values`", "xxhash64(__hash, tree) AS __order").filter(
            f"pmod(__order, {min(rows, wanted)}) < {spare}")
        return drawn.withColumn("__place", F.expr(
            "row_number() OVER (PARTITION BY tree ORDER BY __order)"
        )).filter(f"__place <= {self.sample_size}")
