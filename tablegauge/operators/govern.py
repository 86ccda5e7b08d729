"""SLAs, policy gates, verdicts and remediation, as set operations on runs.

A run is one row, and all its gates fit in an array on that row, so verdicts
for any number of runs need no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge import fixed
from tablegauge.config import CleanConfig, Policy
from tablegauge.functions.scalars import aggregate, assign, half_even, lit, q
from tablegauge.operators.clean import Cleaned
from tablegauge.operators.predicates import business_view
from tablegauge.operators.reports import hotspots
from tablegauge.operators.runs import MEASURES, RUN_KEY, long_measures


# --- service levels ---------------------------------------------------------------

def evaluate_slas(runs: DataFrame, targets: Mapping[str, float], keys: Sequence[str] = RUN_KEY) -> DataFrame:
    """One row per run and target: ``metric, target, actual, passed``.

    The targets are a handful of settings, hence the broadcast.
    """
    rows = [(m, float(t)) for m, t in targets.items()]
    wanted = runs.sparkSession.createDataFrame(rows, "metric string, target double")
    met = long_measures(runs, keys).join(F.broadcast(wanted), "metric")
    labels = " ".join(f"WHEN {lit(m)} THEN {lit(x)}" for m, x in fixed.SCORECARD_LABELS.items())
    weights = " ".join(f"WHEN {lit(m)} THEN {w}" for m, w in fixed.WEIGHT_PERCENT.items())
    return met.selectExpr(
        *keys, "metric", f"CASE metric {labels} END AS label", f"CASE metric {weights} END AS weight",
        "target", f"{half_even('actual', 2)} AS actual", "actual >= target AS passed",
    )


def scorecard(runs: DataFrame, targets: Mapping[str, float], keys: Sequence[str] = RUN_KEY) -> DataFrame:
    """PASS if nothing fails; FAIL if overall or three targets fail; else AT RISK."""
    counted = aggregate(evaluate_slas(runs, targets, keys), {
        "passed": "count_if(passed)",
        "failed": "count_if(NOT passed)",
        "total": "count(1)",
        "overall_failed": "coalesce(bool_or(metric = 'overall' AND NOT passed), FALSE)",
    }, keys)
    return counted.selectExpr(
        *keys, "passed", "failed", "total",
        "CASE WHEN failed = 0 THEN 'PASS' WHEN overall_failed OR failed >= 3 THEN 'FAIL' "
        "ELSE 'AT RISK' END AS status",
    )


# --- policy gates and verdict -------------------------------------------------------

def _gate(key: str, kind: str, target: float, actual: str, digits: int, present: str,
          count: str = "CAST(NULL AS BIGINT)") -> str:
    goal = lit(float(target))
    spare = f"({actual}) - {goal}" if kind == "min" else f"{goal} - ({actual})"
    passed = f"({actual}) >= {goal}" if kind == "min" else f"({actual}) <= {goal}"
    weight = fixed.WEIGHT_PERCENT.get(key)
    return f"""CASE WHEN {present} THEN named_struct(
        'gate', {lit(key)}, 'label', {lit(fixed.GATE_LABELS[key])}, 'kind', {lit(kind)},
        'target', {half_even(goal, digits)}, 'actual', {half_even(actual, digits)},
        'passed', {passed}, 'margin', {half_even(spare, digits)},
        'weight', {'CAST(NULL AS INT)' if weight is None else weight}, 'n', {count}) END"""


def with_gates(runs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Add ``gates``: one struct per policy gate that applies to the run."""
    targets = policy.targets()
    rows = "coalesce(row_count, 0)"
    gates = []
    for m in MEASURES:
        actual = "overall_dq_score" if m == "overall" else f"dimensions.{m}"
        if f"min_{m}" in targets:
            gates.append(_gate(m, "min", targets[f"min_{m}"], actual, 1, f"{actual} IS NOT NULL"))
    critical = "coalesce(critical_count, 0)"
    share = f"CASE WHEN {rows} > 0 THEN 100.0D * {critical} / {rows} ELSE 0.0D END"
    gates.append(_gate("critical_pct", "max", targets["max_critical_pct"], share, 2, "TRUE", critical))
    gates.append(_gate("anomaly_pct", "max", targets["max_anomaly_pct"],
                       f"100.0D * anomaly_count / {rows}", 2,
                       f"anomaly_count IS NOT NULL AND {rows} > 0", "anomaly_count"))
    return assign(runs, {"gates": f"filter(array({', '.join(gates)}), g -> g IS NOT NULL)"})


def gate_rows(gated: DataFrame, keys: Sequence[str] = RUN_KEY) -> DataFrame:
    """One row per run and gate, with whether the gate blocks publication."""
    rows = gated.selectExpr(*keys, "inline(gates)")
    return rows.selectExpr("*", f"{_blocks('gate', 'passed', 'margin')} AS blocking")


def gate_table(gated: DataFrame, keys: Sequence[str] = RUN_KEY) -> DataFrame:
    """Gates as text, for display or export."""
    sign = "CASE kind WHEN 'max' THEN '≤ ' ELSE '≥ ' END"
    unit = "CASE kind WHEN 'max' THEN '%' ELSE '' END"
    short = "regexp_replace(CAST({} AS STRING), '[.]0$', '')"
    return gated.selectExpr(*keys, "inline(gates)").selectExpr(
        *keys, "label AS gate", f"concat({sign}, {short.format('target')}, {unit}) AS target",
        f"concat({short.format('actual')}, {unit}) AS actual",
        "CASE WHEN passed THEN 'Pass' ELSE 'Fail' END AS status")


def _blocks(gate: str, passed: str, margin: str) -> str:
    hard = ", ".join(lit(g) for g in fixed.HARD_GATES)
    return (f"(NOT {passed} AND ({gate} = 'critical_pct' OR "
            f"({gate} IN ({hard}) AND {margin} <= {lit(float(-fixed.HARD_MARGIN))})))")


def decide(gated: DataFrame, keys: Sequence[str] = RUN_KEY) -> DataFrame:
    """Verdict, confidence, gate counts and reasons, one row per run."""
    blocked = _blocks("g.gate", "g.passed", "g.margin")
    df = assign(gated, {
        "__blockers": f"filter(gates, g -> {blocked})",
        "__failed": "filter(gates, g -> NOT g.passed)",
        "__passed": "filter(gates, g -> g.passed)",
        "__distance": "aggregate(gates, 0.0D, (s, g) -> s + abs(g.margin) * "
                      "CASE WHEN g.gate LIKE '%pct' THEN 3.0D ELSE 1.0D END)",
    })
    df = assign(df, {
        "verdict": "CASE WHEN size(__blockers) > 0 THEN 'QUARANTINE' "
                   "WHEN size(__failed) = 0 THEN 'APPROVE' ELSE 'REMEDIATE' END",
        "__drivers": "CASE WHEN size(__blockers) > 0 THEN __blockers ELSE __failed END",
        "confidence": "CASE WHEN size(gates) = 0 THEN 60 ELSE CAST(rint(greatest(55.0D, least(99.0D, "
                      "55.0D + __distance / size(gates) * 3.0D))) AS INT) END",
    })
    best = ("array_sort(filter(__passed, g -> g.kind = 'min'), "
            "(a, b) -> CASE WHEN a.margin > b.margin THEN -1 WHEN a.margin < b.margin THEN 1 "
            "ELSE 0 END)[0]")
    # --- fixed values: reason sentences
    approve = f"""filter(array(
        concat('All ', size(gates), ' quality gates passed.'),
        concat('Strongest area: ', __best.label, ' (', CAST(CAST(rint(__best.actual) AS INT) AS STRING),
               ' vs target ', CAST(CAST(rint(__best.target) AS INT) AS STRING), ').')),
        r -> r IS NOT NULL)"""
    driver = """transform(__drivers, g -> CASE WHEN g.kind = 'min'
        THEN concat(g.label, ' is ', CAST(CAST(rint(g.actual) AS INT) AS STRING),
                    ', below the target of ', CAST(CAST(rint(g.target) AS INT) AS STRING), '.')
        ELSE concat(g.label, ' is ', CAST(CAST(g.actual AS DECIMAL(20,2)) AS STRING), '%, above the ',
                    CAST(CAST(g.target AS DECIMAL(20,2)) AS STRING), '% limit',
                    coalesce(concat(' (', format_number(g.n, 0), ' rows)'), ''), '.') END)"""
    still = """CASE WHEN size(__passed) > 0 THEN
        array(concat(size(__passed), ' of ', size(gates), ' gates still passed.'))
        ELSE CAST(array() AS ARRAY<STRING>) END"""
    df = assign(df, {"__best": best})
    return df.selectExpr(
        *keys, "verdict", "confidence",
        "size(gates) AS gates_total", "size(__passed) AS gates_passed", "size(__failed) AS gates_failed",
        "transform(__drivers, g -> g.gate) AS drivers",
        f"CASE WHEN verdict = 'APPROVE' THEN {approve} ELSE concat({driver}, {still}) END AS reasons",
        "coalesce(row_count, 0) AS row_count", "coalesce(critical_count, 0) AS critical_count",
        "anomaly_count", "overall_dq_score",
    )


def cleaned_export(scored: DataFrame, decision: DataFrame, keep_scores: bool = True,
                   added: Sequence[str] | None = None) -> DataFrame:
    """The business view, or no rows while the run's verdict is QUARANTINE.

    ``decision`` is the one decision row of the run.
    """
    verdict = decision.selectExpr("max(verdict)").scalar()
    return business_view(scored, keep_scores, added).filter(verdict != F.lit("QUARANTINE"))


# --- remediation ------------------------------------------------------------------------

def remediation_log(cleaned: Cleaned, config: CleanConfig = CleanConfig()) -> DataFrame:
    """What cleaning fixed and what it flagged, counts above zero only."""
    stats = cleaned.stats()
    names = {
        "categorical_fixed": ("categorical_fixed", "vendor_names_normalized"),
        "negative_amount_flags": ("negative_amount_flags", "amount_negative_flags"),
    }
    cells = []
    for i, (stat, action, kind, detail) in enumerate(fixed.REMEDIATION_ACTIONS):
        column = next((c for c in names.get(stat, (stat,)) if c in stats.columns), None)
        told = detail.format(text=config.fill_text, number=config.fill_number)
        cells.append(f"{i}, {lit(action)}, {lit(kind)}, {column or 'CAST(0 AS BIGINT)'}, {lit(told)}")
    return stats.selectExpr(
        f"stack({len(cells)}, {', '.join(cells)}) AS (position, action, `type`, n, detail)"
    ).filter("n > 0")


def remediation_totals(log: DataFrame) -> DataFrame:
    return aggregate(log, {
        "total_fixed": "coalesce(sum(n) FILTER (WHERE `type` = 'fixed'), 0)",
        "total_flagged": "coalesce(sum(n) FILTER (WHERE `type` = 'flagged'), 0)",
    })


def suggested_actions(df: DataFrame) -> DataFrame:
    """Prioritised next steps: severity, anomalies, grades, then hotspots."""
    have = set(df.columns)
    counts = {
        "critical": "count_if(dq_severity = 'CRITICAL')" if "dq_severity" in have else None,
        "high": "count_if(dq_severity = 'HIGH')" if "dq_severity" in have else None,
        "anomalies": "count_if(is_anomaly)" if "is_anomaly" in have else None,
        "low_grade": "count_if(dq_grade IN ('D', 'F'))" if "dq_grade" in have else None,
    }
    row = aggregate(df, {n: e or "CAST(0 AS BIGINT)" for n, e in counts.items()})
    cells = ", ".join(
        f"{i}, {lit(priority)}, {lit(issue)}, {n}, {lit(advice)}"
        for i, (n, priority, issue, advice) in enumerate(fixed.SUGGESTED_ACTIONS))
    first = row.selectExpr(
        f"stack({len(counts)}, {cells}) AS (position, priority, issue, n, recommendation)")
    issue = fixed.HOTSPOT_ISSUE.split("{}")
    advice = fixed.HOTSPOT_ADVICE.split("{}")
    spots = hotspots(df).selectExpr(
        f"{len(counts)} + position AS position",
        "'Low' AS priority",
        f"concat({lit(issue[0])}, `column`, {lit(issue[1])}, label) AS issue", "n",
        f"concat({lit(advice[0])}, `column`, {lit(advice[1])}) AS recommendation")
    return first.unionByName(spots).filter("n > 0")


def stats_table(stats: DataFrame) -> DataFrame:
    """A one-row statistics frame as ``metric, value`` rows."""
    cells = ", ".join(f"{lit(c)}, CAST({q(c)} AS DOUBLE)" for c in stats.columns)
    return stats.selectExpr(f"stack({len(stats.columns)}, {cells}) AS (metric, `value`)")


