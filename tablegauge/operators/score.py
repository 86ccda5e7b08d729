"""Scoring: five dimensions, composite, grade, severity and issue log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablegauge import fixed
from tablegauge.config import CleanConfig, Roles
from tablegauge.functions.scalars import (
    aggregate, assign, half_even, is_placeholder, one_row, q, text, to_date, to_number, types_of,
    words,
)
from tablegauge.operators import rules as R
from tablegauge.operators.clean import PARSED, visible
from tablegauge.operators.dedup import flag_all_repeats, flag_repeats
from tablegauge.operators.rules import Rule

OVERALL = "__overall"
EXACT = "__exact_"
REPEATED = "__repeated_"
RATES = "__rates"
ISSUES = "__issues"


@dataclass(frozen=True)
class Scored:
    """A scored table; ``frame`` also holds the hidden columns."""

    frame: DataFrame
    fixed_schema: bool

    def rows(self) -> DataFrame:
        return visible(self.frame)

    def stats(self) -> DataFrame:
        """One row of score statistics."""
        return score_stats(self)


def parsed_date(df: DataFrame, name: str, formats: Sequence[str]) -> str:
    """The date kept by cleaning, or a fresh parse if there is none."""
    kinds = types_of(df)
    if PARSED + name in kinds:
        return q(PARSED + name)
    return to_date(name, kinds[name], ("yyyy-MM-dd", *formats))


def _placeholders(listed: Sequence[str], config: CleanConfig) -> tuple[str, ...]:
    return (*listed, config.fill_text.upper()) if config.fill_is_placeholder else tuple(listed)


# --- fixed-schema rules ------------------------------------------------------

def invoice_completeness(df: DataFrame, config: CleanConfig = CleanConfig()) -> list[Rule]:
    present = [f for f in fixed.INVOICE_CRITICAL_FIELDS if f in df.columns]
    listed, kinds = _placeholders(fixed.PLACEHOLDERS_INVOICE_SCORE, config), types_of(df)
    return [
        Rule("completeness", is_placeholder(f, listed, kinds[f]), 100.0 / len(present),
             fixed.INVOICE_MISSING_LABEL.format(f))
        for f in present
    ]


def _flag_rules(df: DataFrame, dimension: str, table: Sequence[tuple[str, float, str]]) -> list[Rule]:
    return [Rule(dimension, f"{c} = 1", p, label) for c, p, label in table if c in df.columns]


def invoice_validity(df: DataFrame) -> list[Rule]:
    return _flag_rules(df, "validity", fixed.INVOICE_VALIDITY_RULES)


def invoice_accuracy(df: DataFrame) -> list[Rule]:
    return _flag_rules(df, "accuracy", fixed.INVOICE_ACCURACY_RULES)


def invoice_consistency(df: DataFrame, config: CleanConfig = CleanConfig()) -> list[Rule]:
    """Paid without a date, total that does not add up, due before invoiced."""
    out: list[Rule] = []
    kinds = types_of(df)
    have = set(kinds)
    if {"status", "payment_date"} <= have:
        undated = is_placeholder("payment_date", fixed.PLACEHOLDERS_INVOICE_SCORE)
        out.append(Rule("consistency", f"upper({text('status')}) = 'PAID' AND {undated}",
                        *fixed.PAID_WITHOUT_DATE))
    if {"amount", "tax_amount", "total_amount"} <= have:
        amount, tax, total = (
            to_number(c, kinds[c]) for c in ("amount", "tax_amount", "total_amount"))
        gap = f"abs({total} - ({amount} + coalesce({tax}, 0.0D)))"
        out.append(Rule("consistency", f"{gap} > {fixed.RECONCILE_TOLERANCE}D", *fixed.TOTAL_MISMATCH))
    if {"invoice_date", "due_date"} <= have:
        due = parsed_date(df, "due_date", config.date_formats)
        invoiced = parsed_date(df, "invoice_date", config.date_formats)
        out.append(Rule("consistency", f"{due} < {invoiced}", *fixed.DUE_BEFORE_INVOICE))
    return out


def score_invoices(
    df: DataFrame, order_by: Sequence[str], config: CleanConfig = CleanConfig(),
    extra: Sequence[Rule] = (),
) -> Scored:
    """Score cleaned invoices; composite from the unrounded dimensions."""
    rules = invoice_completeness(df, config) + invoice_validity(df) + invoice_accuracy(df)
    rules += invoice_consistency(df, config)
    if "invoice_number" in df.columns:
        mark = REPEATED + "invoice_number"
        df = flag_repeats(df, "invoice_number", mark, order_by)
        rules.append(Rule("uniqueness", mark, *fixed.DUPLICATE_INVOICE))
    df, rules = R.evaluate(df, rules + list(extra))
    df = assign(df, {ISSUES: R.issue_log(rules)} | {
        EXACT + d: R.dimension_score(rules, d) for d in fixed.DIMENSIONS
    }, drop=[r.condition for r in rules])
    df = assign(df, {f"dq_score_{d}": half_even(EXACT + d) for d in fixed.DIMENSIONS})
    return Scored(_finish(df, R.weighted(EXACT)), True)


# --- inferred-schema rules -----------------------------------------------------

def general_completeness(df: DataFrame, roles: Roles, config: CleanConfig = CleanConfig()) -> list[Rule]:
    critical = roles.critical
    listed, kinds = _placeholders(fixed.PLACEHOLDERS_GENERAL, config), types_of(df)
    return [
        Rule("completeness", is_placeholder(q(c), listed, kinds[c]), 100.0 / len(critical))
        for c in critical if c in df.columns
    ]


def date_error_penalty(roles: Roles) -> int:
    return max(10, int(60 / max(len(roles.dates), 1)))


def placeholder_rates(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Share of placeholder words in each column, as one row."""
    listed = words(fixed.PLACEHOLDERS_GENERAL)
    return aggregate(df, {
        c: f"avg(CASE WHEN upper({text(q(c))}) IN {listed} THEN 1.0D ELSE 0.0D END)" for c in names
    })


def general_validity(df: DataFrame, roles: Roles) -> tuple[DataFrame, list[Rule]]:
    """Date errors, and a light penalty on every row per placeholder-heavy category."""
    have = set(df.columns)
    out = [
        Rule("validity", f"{q(c + '_parse_error')} = 1", date_error_penalty(roles),
             fixed.DATE_ERROR_LABEL.format(c))
        for c in roles.dates if f"{c}_parse_error" in have
    ]
    heavy = [c for c in roles.categories[:5] if c in have]
    if heavy:
        df = df.withColumn(RATES, one_row(placeholder_rates(df, heavy)))
        out += [
            Rule("validity", f"{RATES}.{q(c)} > 0.5D", fixed.PLACEHOLDER_HEAVY_PENALTY)
            for c in heavy
        ]
    return df, out


def general_accuracy(df: DataFrame, roles: Roles) -> list[Rule]:
    count = max(len(roles.numerics), 1)
    have = set(df.columns)
    kinds = (
        ("negative", max(20, int(70 / count)), fixed.NEGATIVE_LABEL),
        ("above_max", max(10, int(30 / count)), fixed.ABOVE_MAX_LABEL),
        ("outlier", max(10, int(30 / count)), fixed.OUTLIER_LABEL),
    )
    return [
        Rule("accuracy", f"{q(f'{c}_{suffix}')} = 1", penalty, label.format(c))
        for suffix, penalty, label in kinds
        for c in roles.numerics if f"{c}_{suffix}" in have
    ]


def _has_hint(name: str, hints: Sequence[str], whole_words: bool) -> bool:
    lowered = name.lower()
    if whole_words:
        return bool(set(hints) & set(lowered.replace("-", "_").split("_")))
    return any(h in lowered for h in hints)


def date_pairs(dates: Sequence[str], whole_words: bool = False) -> list[tuple[str, str]]:
    """First three (start, end) pairs of date columns, by their names."""
    pairs = [
        (a, b) for a in dates for b in dates
        if a != b and _has_hint(a, fixed.START_HINTS, whole_words)
        and _has_hint(b, fixed.END_HINTS, whole_words)
    ]
    return pairs[:3]


def general_consistency(df: DataFrame, roles: Roles, config: CleanConfig = CleanConfig()) -> list[Rule]:
    have = set(df.columns)
    return [
        Rule("consistency",
             f"{parsed_date(df, b, config.date_formats)} < {parsed_date(df, a, config.date_formats)}",
             fixed.DATE_ORDER_PENALTY, fixed.DATE_ORDER_LABEL.format(b, a))
        for a, b in date_pairs([c for c in roles.dates if c in have])
    ]


def score_table(
    df: DataFrame, roles: Roles, order_by: Sequence[str], config: CleanConfig = CleanConfig(),
    extra: Sequence[Rule] = (),
) -> Scored:
    """Score a cleaned table; composite from the rounded dimensions."""
    completeness = general_completeness(df, roles, config)
    if "had_nulls" in df.columns:
        completeness.append(Rule("completeness", "had_nulls = 1", 0, fixed.HAD_NULLS_LABEL))
    accuracy = general_accuracy(df, roles)
    consistency = general_consistency(df, roles, config)
    df, validity = general_validity(df, roles)
    uniqueness: list[Rule] = []
    marks = {c: REPEATED + c for c in roles.ids[:2] if c in df.columns}
    df = flag_all_repeats(df, marks, order_by)
    for c in marks:
        uniqueness.append(Rule("uniqueness", q(REPEATED + c), 50.0 / min(len(roles.ids), 2)))
    rules = validity + accuracy + completeness + consistency + uniqueness
    df, rules = R.evaluate(df, rules + list(extra))
    df = assign(df, {ISSUES: R.issue_log(rules)} | {
        f"dq_score_{d}": half_even(R.dimension_score(rules, d)) for d in fixed.DIMENSIONS
    }, drop=[RATES, *[r.condition for r in rules]])
    return Scored(_finish(df, R.weighted("dq_score_")), False)


# --- shared -----------------------------------------------------------------

def _finish(df: DataFrame, composite: str) -> DataFrame:
    """Composite, integer score, grade and severity; the issue log comes last."""
    df = assign(df, {OVERALL: half_even(composite)})
    df = assign(df, {"dq_score": f"CAST({OVERALL} AS INT)", "dq_grade": R.grade(OVERALL)})
    return assign(df, {
        "dq_severity": R.severity("dq_score_", "dq_score"), "dq_issues": ISSUES,
    }, drop=(ISSUES,))


def mean_tenths(e: str) -> str:
    """Mean of values with one decimal, summed as whole tenths.

    A sum of doubles depends on the order in which tasks finish, and a mean
    may lie exactly between two rounded values; a sum of integers does not.
    """
    return f"CAST(sum(CAST(rint({e} * 10) AS BIGINT)) AS DOUBLE) / (10.0D * count({e}))"


def dimension_mean(scored: Scored, dimension: str) -> str:
    """Mean of a dimension: unrounded for the fixed-schema rules."""
    if scored.fixed_schema:
        return f"avg({EXACT}{dimension})"
    return mean_tenths(f"dq_score_{dimension}")


def score_stats(scored: Scored) -> DataFrame:
    """Mean, median, minimum, perfect rows, dimension means, counts.

    The fixed-schema rules average the unrounded dimensions. The exact median
    is safe: a score has at most 1,001 distinct values, so the state of the
    aggregate stays small.
    """
    out = {
        "mean_score": half_even(mean_tenths(OVERALL)),
        "median_score": half_even(f"percentile({OVERALL}, 0.5)"),
        "min_score": f"CAST(min({OVERALL}) AS INT)",
        "perfect_rows": f"count_if({OVERALL} >= 99)",
    }
    out |= {f"avg_{d}": half_even(dimension_mean(scored, d)) for d in fixed.DIMENSIONS}
    out |= {f"grade_{g}": f"count_if(dq_grade = '{g}')" for g in fixed.GRADES}
    out |= {f"sev_{s.lower()}": f"count_if(dq_severity = '{s}')" for s in fixed.SEVERITIES}
    return aggregate(scored.frame, out)
