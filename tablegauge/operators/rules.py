"""Row rules: a dimension score and an issue log are folds over one list."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from tablegauge import fixed
from tablegauge.functions.scalars import assign, clamp, flag, lit

HIT = "__hit_"


@dataclass(frozen=True)
class Rule:
    """``penalty`` points off ``dimension`` where the SQL ``condition`` holds.

    A rule without a label does not appear in the issue log, one without a
    penalty only there. Callers may append their own rules.
    """

    dimension: str
    condition: str
    penalty: float = 0.0
    label: str | None = None


def evaluate(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, list[Rule]]:
    """Evaluate every condition once, into hidden 0/1 columns the folds read."""
    df = assign(df, {f"{HIT}{i}": flag(r.condition) for i, r in enumerate(rules)})
    return df, [replace(r, condition=f"{HIT}{i}") for i, r in enumerate(rules)]


def dimension_score(rules: Sequence[Rule], dimension: str) -> str:
    """100 less the penalties of the (evaluated) rules that hold, within 0..100."""
    score = "100.0D"
    for rule in rules:
        if rule.dimension == dimension and rule.penalty:
            score = f"{score} - {rule.condition} * {lit(float(rule.penalty))}"
    return clamp(score)


def issue_log(rules: Sequence[Rule]) -> str:
    """Labels of the (evaluated) rules that hold, in rule order, joined with a bar.

    The array form also splits the generated stage in two, which keeps each
    method small enough for the JVM to compile.
    """
    labels = [f"CASE WHEN {r.condition} = 1 THEN {lit(r.label)} END" for r in rules if r.label]
    return f"array_join(array_compact(array({', '.join(labels)})), ' | ')" if labels else "''"


def weighted(prefix: str) -> str:
    """Composite of the five dimension columns, within 0..100."""
    return clamp(" + ".join(f"{prefix}{d} * {lit(fixed.WEIGHTS[d])}" for d in fixed.DIMENSIONS))


def grade(overall: str) -> str:
    bands = " ".join(f"WHEN {overall} >= {low} THEN {lit(letter)}" for low, letter in fixed.GRADE_BANDS)
    return f"CASE {bands} ELSE 'F' END"


def severity(prefix: str, score: str) -> str:
    """Severity from the rounded dimensions and the truncated score."""
    accuracy, consistency = f"{prefix}accuracy", f"{prefix}consistency"
    validity, completeness = f"{prefix}validity", f"{prefix}completeness"
    return f"""CASE
        WHEN {accuracy} < 30 OR {consistency} < 40 THEN 'CRITICAL'
        WHEN {accuracy} < 60 OR {validity} < 40 OR {score} < 50 THEN 'HIGH'
        WHEN {score} < 70 OR least({accuracy}, {consistency}, {validity}, {completeness}) < 60
            THEN 'MEDIUM'
        WHEN {score} < 85 THEN 'LOW'
        ELSE 'CLEAN' END"""
