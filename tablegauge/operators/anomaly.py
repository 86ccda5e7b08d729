"""Anomalies: quartile fences, isolation-forest risk and the combined flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.config import Roles
from tablegauge.functions.quantiles import quantile_row
from tablegauge.functions.scalars import (
    add_all, aggregate, assign, flag, half_even, lit, one_row, percent, pick, q, to_number, types_of,
)
from tablegauge.operators.forest import IsolationForest
from tablegauge.sources.staging import staged

FENCES = "__fences"
FENCE_WIDTH = 1.5


def fence_row(df: DataFrame, names: Sequence[str], approximate: bool = False) -> DataFrame:
    """Lower and upper quartile fence of each column, as one row.

    Null fences where a column has fewer than 4 values or no spread.
    """
    quartiles = quantile_row(df, names, (0.25, 0.75), approximate)
    out = []
    for c in names:
        first, third = q(f"q0_{c}"), q(f"q1_{c}")
        usable = f"{q('n_' + c)} >= 4 AND {third} <> {first}"
        reach = f"{FENCE_WIDTH}D * ({third} - {first})"
        out.append(f"CASE WHEN {usable} THEN {first} - {reach} END AS {q('low_' + c)}")
        out.append(f"CASE WHEN {usable} THEN {third} + {reach} END AS {q('high_' + c)}")
    return quartiles.selectExpr(*out)


def _outside(c: str, number: str) -> str:
    return f"({number} < {FENCES}.{q('low_' + c)} OR {number} > {FENCES}.{q('high_' + c)})"


def count_outside_fences(
    df: DataFrame, names: Sequence[str], approximate: bool = False, numbers: DataFrame | None = None
) -> DataFrame:
    """Add ``iqr_outlier_count``: columns in which the row is beyond a fence.

    The fences take several scans; where ``df`` is costly to compute, pass its
    number columns as a staged table in ``numbers``.
    """
    kinds = types_of(df)
    names = [c for c in names if c in kinds]
    if not names:
        return assign(df, {"iqr_outlier_count": "0"})
    fences = fence_row(df if numbers is None else numbers, names, approximate)
    df = df.withColumn(FENCES, one_row(fences))
    hits = [flag(_outside(c, to_number(c, kinds[c]))) for c in names]
    return assign(df, {"iqr_outlier_count": add_all(hits)}, drop=(FENCES,))


def detect_anomalies(
    df: DataFrame, roles: Roles, row_key: Sequence[str], approximate: bool = False,
    numbers: DataFrame | None = None,
) -> DataFrame:
    """Add ``iqr_outlier_count``, ``isolation_score`` and ``is_anomaly``.

    Fences and forest are fitted on the number columns alone, which are staged
    first (unless given), so ``df`` itself is computed twice, not ten times.
    """
    names = [c for c in roles.numerics if c in df.columns]
    if numbers is None:
        numbers = staged(pick(df, list(dict.fromkeys([*row_key, *names]))))
    out = count_outside_fences(df, names, approximate, numbers)
    out = IsolationForest().fit(numbers, names, row_key).score(out, numbers=numbers)
    return flag_anomalies(out)


def flag_anomalies(df: DataFrame) -> DataFrame:
    return assign(df, {"is_anomaly": "isolation_score >= 70 OR iqr_outlier_count >= 2"})


def fence_hits_by_column(df: DataFrame, names: Sequence[str], approximate: bool = False) -> DataFrame:
    """``column, outlier_rows`` for every usable column, most first."""
    kinds = types_of(df)
    names = [c for c in names if c in kinds]
    counted = aggregate(
        df.withColumn(FENCES, one_row(fence_row(df, names, approximate))),
        {c: f"CASE WHEN max({FENCES}.{q('low_' + c)}) IS NOT NULL THEN "
            f"count_if({_outside(c, to_number(c, kinds[c]))}) END" for c in names},
    )
    pairs = ", ".join(f"{lit(c)}, {q(c)}" for c in names)
    return counted.selectExpr(f"stack({len(names)}, {pairs}) AS (`column`, outlier_rows)").filter(
        "outlier_rows IS NOT NULL").orderBy(F.desc("outlier_rows"), F.asc("column"))


def anomaly_figures(df: DataFrame) -> DataFrame:
    """Flagged rows, their share, mean risk and most columns out of range."""
    return aggregate(df, {
        "flagged": "count_if(is_anomaly)",
        "flagged_pct": percent("count_if(is_anomaly)", "count(1)"),
        "mean_risk": half_even("avg(isolation_score)"),
        "max_iqr_count": "coalesce(max(iqr_outlier_count), 0)",
    })


def riskiest(df: DataFrame, n: int, tie: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows of highest isolation score."""
    top = df.orderBy(F.desc("isolation_score"), *[F.col(q(c)) for c in tie]).limit(n)
    return pick(top, columns) if columns else top
