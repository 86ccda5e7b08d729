"""Comparing sources: quality side by side and schema drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge import fixed
from tablegauge.functions.scalars import lit


def schema_drift(runs: DataFrame, baseline: str) -> DataFrame:
    """Columns added, removed and retyped in every run against a baseline.

    The baseline is the earliest run of that source; every other run is
    compared, later ones of the same source and unnamed ones too. A run is known
    by its source and time, and carries the baseline's column list, which is one
    schema and therefore small, as a scalar: runs are neither joined nor
    shuffled. A run without recorded columns is reported as not available.
    """
    first = runs.filter(F.col("dataset_name") == F.lit(baseline)).selectExpr(
        "min_by(struct(created_at, columns), created_at) AS b").scalar()
    both = runs.withColumn("__b", first).filter(
        f"NOT (dataset_name <=> {lit(baseline)} AND created_at <=> __b.created_at)")
    names, base = "transform(columns, c -> c.name)", "transform(__b.columns, c -> c.name)"
    theirs, ours = "map_from_entries(transform(columns, c -> struct(c.name, c.dtype)))", \
        "map_from_entries(transform(__b.columns, c -> struct(c.name, c.dtype)))"
    compared = both.selectExpr(
        "dataset_name AS source", "created_at", f"{lit(baseline)} AS baseline",
        "columns IS NOT NULL AND __b.columns IS NOT NULL AS available",
        f"array_sort(array_except({names}, {base})) AS added", f"array_sort(array_except({base}, {names})) AS removed",
        f"array_sort(array_intersect({names}, {base})) AS __shared", f"{theirs} AS __theirs", f"{ours} AS __ours")
    changed = "filter(__shared, n -> __theirs[n] <> __ours[n])"
    found = compared.selectExpr(
        "source", "created_at", "baseline", "coalesce(available, FALSE) AS available", "added", "removed",
        f"transform({changed}, n -> named_struct('column', n, 'from', __ours[n], 'to', __theirs[n])) AS type_changed",
        "CAST(size(filter(__shared, n -> __theirs[n] = __ours[n])) AS BIGINT) AS n_stable")
    whole = [c if c in ("source", "created_at", "baseline", "available") else f"CASE WHEN available THEN {c} END AS {c}"
             for c in found.columns]
    return found.selectExpr(*whole).withColumn(
        "has_drift", F.expr("size(added) + size(removed) + size(type_changed) > 0"))


def drift_summary(drift: DataFrame) -> DataFrame:
    """One line per source."""
    # --- fixed values: summary texts
    return drift.selectExpr("source", """CASE
        WHEN NOT available THEN 'schema not available (older manifest)'
        WHEN NOT has_drift THEN 'no schema drift — columns match the baseline'
        ELSE concat('drift: ', concat_ws(', ',
            CASE WHEN size(added) > 0 THEN concat('+', size(added), ' added') END,
            CASE WHEN size(removed) > 0 THEN concat('-', size(removed), ' removed') END,
            CASE WHEN size(type_changed) > 0 THEN concat(size(type_changed), ' type-changed') END))
        END AS summary""")


def compare_sources(runs: DataFrame) -> DataFrame:
    """One row per source: size, scores and shape."""
    return runs.selectExpr(
        "coalesce(dataset_name, '?') AS source", "row_count AS `rows`", "overall_dq_score AS overall_dq",
        "critical_count AS critical", *[f"dimensions.{d} AS {d}" for d in fixed.DIMENSIONS],
        "column_count AS columns", "dataset_signature AS signature")
