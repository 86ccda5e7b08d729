"""Figures over a scored table. All are small aggregates with a map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge import fixed
from tablegauge.config import Roles
from tablegauge.functions.quantiles import group_quantiles, quantile_row
from tablegauge.functions.scalars import (
    aggregate, bucket, half_even, lit, percent, q, text, to_date, types_of, words,
)

AGGREGATES = {
    "count": "count({})", "mean": "avg({})", "sum": "sum({})", "min": "min({})", "max": "max({})",
}


def quality_by_group(df: DataFrame, group: str, limit: int | None = None) -> DataFrame:
    """Mean score, critical rows and rows per group value, worst first."""
    out = aggregate(df.withColumn("__group", F.expr(text(q(group)))), {
        "avg_score": half_even("avg(dq_score)"),
        "critical": "count_if(dq_severity = 'CRITICAL')",
        "records": "count(1)",
    }, ["__group"]).withColumnRenamed("__group", "value")
    out = out.orderBy(F.asc("avg_score"), F.asc("value"))
    return out.limit(limit) if limit else out


def top_groups(df: DataFrame, group: str, n: int, by: str = "score", metric: str | None = None) -> DataFrame:
    """``n`` groups: most rows (``count``), highest mean of ``metric``
    (``metric``) or lowest mean score (``score``)."""
    measured = metric if by == "metric" else "dq_score"
    out = aggregate(df, {
        "records": f"count({q(measured)})",
        "avg_metric": half_even(f"avg({q(measured)})"),
        "avg_score": "avg(dq_score)",
        "critical": "count_if(dq_severity = 'CRITICAL')",
        "__rank": f"avg({q(measured)})",
    }, [group]).withColumnRenamed(group, "value")
    order = {"count": F.desc("records"), "metric": F.desc("__rank"), "score": F.asc("__rank")}[by]
    return out.orderBy(order, F.asc("value")).limit(n).drop("__rank")


def group_aggregate(df: DataFrame, group: str, function: str, column: str) -> DataFrame:
    """``value, result`` with a declared aggregate of ``column`` per group."""
    if function == "median":
        found = group_quantiles(df, text(q(group)), q(column), (0.5,)).selectExpr("`group` AS __group", "`value` AS result")
        every = aggregate(df.selectExpr(f"{text(q(group))} AS `value`"), {"__n": "count(1)"}, ["value"])
        return every.join(found, F.expr("`value` <=> __group"), "left").select("value", "result")
    if function not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {function!r}")
    keyed = df.selectExpr(f"{text(q(group))} AS `value`", f"{q(column)} AS __x")
    return aggregate(keyed, {"result": AGGREGATES[function].format("__x")}, ["value"])


def label_counts(df: DataFrame, column: str, labels: Sequence[str], out: str) -> DataFrame:
    """Rows per label in fixed order, 0 where there is none, with percentage."""
    counted = aggregate(
        df, {"__rows": "count(1)"} | {x: f"count_if({q(column)} = {lit(x)})" for x in labels})
    triples = ", ".join(f"{i}, {lit(x)}, {q(x)}" for i, x in enumerate(labels))
    return counted.selectExpr(
        "__rows", f"stack({len(labels)}, {triples}) AS (position, {out}, n)"
    ).selectExpr("position", out, "n", f"{percent('n', '__rows')} AS pct")


def severity_counts(df: DataFrame) -> DataFrame:
    return label_counts(df, "dq_severity", fixed.SEVERITIES, "severity")


def grade_counts(df: DataFrame) -> DataFrame:
    return label_counts(df, "dq_grade", fixed.GRADES, "grade")


def histogram(df: DataFrame, column: str, bins: int, low: float = 0, high: float = 100) -> DataFrame:
    """Rows per equal-width bin, 0 where there are none."""
    binned = df.selectExpr(f"CAST({bucket(q(column), low, high, bins)} AS INT) AS bin").filter("bin IS NOT NULL")
    counted = aggregate(binned, {"n": "count(1)"}, ["bin"])
    every = df.sparkSession.range(1, bins + 1).selectExpr("CAST(id AS INT) AS bin")
    return every.join(F.broadcast(counted), "bin", "left").selectExpr(
        "bin", f"{lit(float(low))} + (bin - 1) * {lit((high - low) / bins)} AS bin_start", "coalesce(n, 0) AS n")


def dimension_means(df: DataFrame) -> DataFrame:
    """Mean of each dimension, worst first, with weight and status."""
    means = aggregate(df, {d: f"avg(dq_score_{d})" for d in fixed.DIMENSIONS})
    rows = ", ".join(
        f"{lit(fixed.DIMENSION_TITLES[d])}, {d}, {fixed.WEIGHT_PERCENT[d]}" for d in fixed.DIMENSIONS)
    return means.selectExpr(f"stack(5, {rows}) AS (dimension, mean, weight_pct)").selectExpr(
        "dimension", f"{half_even('mean')} AS score", "weight_pct",
        "CASE WHEN mean >= 80 THEN 'Good' WHEN mean >= 60 THEN 'Needs work' ELSE 'Critical' END AS status",
    ).orderBy("score", "dimension")


def _weakest(field: str) -> str:
    """Name or mean of the lowest dimension; the first one on a tie."""
    pairs = ", ".join(
        f"struct(avg(dq_score_{d}) AS mean, {i} AS place, {lit(fixed.DIMENSION_TITLES[d])} AS name)"
        for i, d in enumerate(fixed.DIMENSIONS))
    return f"array_min(array({pairs})).{field}"


def headline_figures(df: DataFrame) -> DataFrame:
    return aggregate(df, {
        "records": "count(1)",
        "avg_score": half_even("avg(dq_score)"),
        "ready": "count_if(dq_score >= 99)",
        "critical": "count_if(dq_severity = 'CRITICAL')",
        "weakest_dimension": _weakest("name"),
        "weakest_score": half_even(_weakest("mean")),
    })


def failing_checks(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent issues, with dimension and bare label."""
    issues = df.selectExpr("explode(split(dq_issues, ' [|] ')) AS issue").filter("issue <> ''")
    counted = aggregate(issues, {"n": "count(1)"}, ["issue"])
    return counted.orderBy(F.desc("n"), F.asc("issue")).limit(n).selectExpr(
        "issue", "n", r"regexp_extract(issue, '\\[(\\w+)\\]', 1) AS dimension",
        r"regexp_replace(issue, '\\[\\w+\\] ', '') AS label")


def narrative_figures(df: DataFrame) -> DataFrame:
    """Counts and the health band that a summary is written from."""
    anomalies = "count_if(is_anomaly)" if "is_anomaly" in df.columns else "CAST(0 AS BIGINT)"
    return aggregate(df, {
        "records": "count(1)",
        "critical": "count_if(dq_severity = 'CRITICAL')",
        "high": "count_if(dq_severity = 'HIGH')",
        "anomalies": anomalies,
        "clean": "count_if(dq_severity = 'CLEAN')",
        "clean_pct": percent("count_if(dq_severity = 'CLEAN')", "count(1)", 0),
        "weakest_dimension": f"CASE WHEN {_weakest('mean')} < 80 THEN {_weakest('name')} END",
        "weakest_score": f"CASE WHEN {_weakest('mean')} < 80 THEN {half_even(_weakest('mean'), 0)} END",
        "health": "CASE WHEN avg(dq_score) >= 85 THEN 'healthy' "
                  "WHEN avg(dq_score) >= 65 THEN 'mostly reliable' "
                  "WHEN count(1) > 0 THEN 'significant issues' END",
    })


def extract_figures(df: DataFrame) -> DataFrame:
    return aggregate(df, {
        "records": "count(1)",
        "avg_score": half_even("avg(dq_score)"),
        "grades_ab": f"count_if(dq_grade IN {words(('A', 'B'))})",
        "grades_df": f"count_if(dq_grade IN {words(('D', 'F'))})",
    })


def result_figures(result: DataFrame, table: DataFrame) -> DataFrame:
    """Figures of a filtered result, with its share of the whole table."""
    anomalies = "count_if(is_anomaly)" if "is_anomaly" in result.columns else "CAST(0 AS BIGINT)"
    out = aggregate(result, {
        "records": "count(1)",
        "avg_score": f"coalesce({half_even('avg(dq_score)')}, 0.0D)",
        "critical": "count_if(dq_severity = 'CRITICAL')",
        "anomalies": anomalies,
    }).withColumn("__total", table.selectExpr("count(1)").scalar())
    return out.selectExpr("records", f"{percent('records', '__total')} AS pct_of_total",
                          "avg_score", "critical", "anomalies")


def quantile_hints(df: DataFrame, roles: Roles, formats: Sequence[str] = ("yyyy-MM-dd",)) -> DataFrame:
    """Upper quartile of each number column and median year of each date column."""
    kinds = types_of(df)
    parts: list[DataFrame] = []
    names = [c for c in roles.numerics if c in kinds]
    if names:
        row = quantile_row(df, names, (0.75,))
        cells = ", ".join(f"{lit(c)}, 'p75', {q('q0_' + c)}, {q('n_' + c)}" for c in names)
        parts.append(row.selectExpr(f"stack({len(names)}, {cells}) AS (`column`, hint, `value`, n)"))
    dates = [c for c in roles.dates if c in kinds]
    if dates:
        # A year has few distinct values, so the exact percentile stays small.
        years = {c: f"percentile(year({to_date(c, kinds[c], formats)}), 0.5)" for c in dates}
        counts = {f"n_{c}": f"count({to_date(c, kinds[c], formats)})" for c in dates}
        row = aggregate(df, years | counts)
        cells = ", ".join(f"{lit(c)}, 'median_year', {q(c)}, {q('n_' + c)}" for c in dates)
        parts.append(row.selectExpr(f"stack({len(dates)}, {cells}) AS (`column`, hint, `value`, n)"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter("n > 5").selectExpr(
        "`column`", "hint", "CASE WHEN hint = 'median_year' THEN floor(`value`) ELSE `value` END AS `value`")


def hotspots(df: DataFrame, n: int = 5) -> DataFrame:
    """Columns with the most outlier and range flags."""
    pairs = [
        (c, c[: -len(suffix)], label) for c in df.columns
        for suffix, label in fixed.HOTSPOT_SUFFIXES if c.endswith(suffix)
    ]
    schema = "position int, `column` string, label string, n bigint"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    sums = aggregate(df, {c: f"CAST(coalesce(sum({q(c)}), 0) AS BIGINT)" for c, _, _ in pairs})
    # One row holds all sums, so they are ranked inside it.
    cells = ", ".join(
        f"named_struct('n', {q(c)}, 'column', {lit(base)}, 'label', {lit(label)})" for c, base, label in pairs)
    ranked = f"slice(reverse(array_sort(filter(array({cells}), s -> s.n > 0))), 1, {n})"
    return sums.selectExpr(f"posexplode({ranked}) AS (position, spot)").selectExpr(
        "position", "spot.`column`", "spot.label", "spot.n")
