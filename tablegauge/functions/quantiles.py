"""Exact quantiles without sorting the table or holding its values.

The built-in exact percentile keeps every distinct value in one task, which
does not survive a large table. Here a sketch brackets the wanted ranks, one
pass counts how many values fall in the cells of each bracket, and a last pass
looks only at the one or two cells that hold the wanted ranks. The counts are
exact, so the result does not depend on the quality of the sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.scalars import aggregate, lit, q, to_number, types_of

ACCURACY = 10_000
SLACK = 2.0 / ACCURACY
CELLS = 1024
SALTS = 16


def long_numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Non-null numbers of several columns as ``column, value`` rows."""
    kinds = types_of(df)
    pairs = ", ".join(f"{lit(c)}, {to_number(c, kinds[c])}" for c in names)
    rows = df.selectExpr(f"stack({len(names)}, {pairs}) AS (`column`, `value`)")
    return rows.filter("`value` IS NOT NULL AND NOT isnan(`value`)")


def quantiles(df: DataFrame, names: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """``column, share, n, value`` with linear interpolation between ranks.

    Three scans of the named columns. What is broadcast has at most
    ``columns * shares * CELLS`` rows, and the final ranking sees only the
    values of the chosen cells.
    """
    return rank_quantiles(long_numbers(df, names), shares, few_groups=True)


def group_quantiles(df: DataFrame, group: str, number: str, shares: Sequence[float]) -> DataFrame:
    """``group, share, n, value`` for any number of groups of any size.

    ``group`` and ``number`` are SQL expressions. Nothing is broadcast by
    hand: each group's bracket is repeated once per salt and the group's rows
    are spread over the salts, so one large group does not land in one task.
    """
    keyed = df.selectExpr(f"coalesce(concat('=', CAST({group} AS STRING)), '') AS `column`",
                          f"CAST({number} AS DOUBLE) AS `value`")
    found = rank_quantiles(keyed.filter("`value` IS NOT NULL AND NOT isnan(`value`)"), shares, few_groups=False)
    return found.selectExpr("CASE WHEN `column` <> '' THEN substr(`column`, 2) END AS `group`",
                            "share", "n", "`value`")


def rank_quantiles(rows: DataFrame, shares: Sequence[float], few_groups: bool) -> DataFrame:
    """Quantiles of ``value`` per ``column``; see the module text."""
    brackets = _brackets(rows, shares)
    many = "1" if few_groups else "value_rows"
    if few_groups:
        keys, brackets = ["column"], F.broadcast(brackets)
    else:
        keys = ["column", "salt"]
        # Equal values become one row with a count before any join, so a group that
        # is mostly one value is small; the rest spreads by value.
        rows = aggregate(rows, {"value_rows": "count(1)"}, ["column", "value"])
        rows = rows.withColumn("salt", F.expr(f"CAST(pmod(xxhash64(`value`), {SALTS}) AS INT)"))
        brackets = brackets.withColumn("salt", F.expr(f"explode(sequence(0, {SALTS - 1}))"))
    cell = (
        f"CASE WHEN `value` < low THEN 0 WHEN `value` > high THEN {CELLS + 1} "
        f"WHEN low = high THEN 1 ELSE 1 + least({CELLS - 1}, "
        f"CAST(floor((`value` - low) / (high - low) * {CELLS}) AS INT)) END"
    )
    placed = rows.join(brackets, keys).withColumn("cell", F.expr(cell))
    counts = aggregate(placed, {"cell_rows": f"sum({many})"},
                       ["column", "share", "n", "position", "low", "high", "cell"])
    chosen = counts.withColumn("before", F.expr(
        "sum(cell_rows) OVER (PARTITION BY `column`, share ORDER BY cell) - cell_rows"
    )).filter("before <= floor(position) + 1 AND before + cell_rows > floor(position)")
    marks = chosen.selectExpr("`column`", "share", "cell", "before")
    hits = placed.join(F.broadcast(marks) if few_groups else marks, ["column", "share", "cell"])
    values = aggregate(hits, {"value_rows": f"sum({many})", "before": "min(before)"},
                       ["column", "share", "n", "position", "value"])
    ranked = values.withColumn("upto", F.expr(
        "min(before) OVER (PARTITION BY `column`, share) + "
        "sum(value_rows) OVER (PARTITION BY `column`, share ORDER BY `value`)"
    ))
    ends = aggregate(ranked, {
        "lower": "min(CASE WHEN upto > floor(position) THEN `value` END)",
        "upper": "min(CASE WHEN upto > floor(position) + 1 THEN `value` END)",
    }, ["column", "share", "n", "position"])
    return ends.selectExpr(
        "`column`", "share", "n",
        "lower + coalesce((position - floor(position)) * (upper - lower), 0.0D) AS `value`",
    )


def _brackets(rows: DataFrame, shares: Sequence[float]) -> DataFrame:
    points: list[str] = []
    for p in shares:
        points += [lit(max(0.0, p - SLACK)), lit(min(1.0, p + SLACK))]
    sketch = aggregate(rows, {
        "n": "count(1)",
        "points": f"percentile_approx(`value`, array({', '.join(points)}), {ACCURACY})",
    }, ["column"])
    brackets = ", ".join(
        f"struct({lit(float(p))} AS share, points[{2 * i}] AS low, points[{2 * i + 1}] AS high)"
        for i, p in enumerate(shares)
    )
    return sketch.selectExpr("`column`", "n", f"inline(array({brackets}))").selectExpr(
        "`column`", "n", "share", "low", "high", "(n - 1) * share AS position"
    )


def quantile_row(
    df: DataFrame, names: Sequence[str], shares: Sequence[float], approximate: bool = False
) -> DataFrame:
    """One row with ``n_<column>`` and ``q<i>_<column>`` for share number i."""
    out: dict[str, str] = {}
    if approximate:
        kinds = types_of(df)
        for c in names:
            number = to_number(c, kinds[c])
            out[f"n_{c}"] = f"count({number})"
            for i, p in enumerate(shares):
                out[f"q{i}_{c}"] = f"percentile_approx({number}, {lit(float(p))}, {ACCURACY})"
        return aggregate(df, out)
    for c in names:
        here = f"`column` = {lit(c)}"
        out[f"n_{c}"] = f"coalesce(max(n) FILTER (WHERE {here}), 0)"
        for i, p in enumerate(shares):
            out[f"q{i}_{c}"] = f"max(`value`) FILTER (WHERE {here} AND share = {lit(float(p))})"
    return aggregate(quantiles(df, names, shares), out)
