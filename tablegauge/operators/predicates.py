"""Row conditions over scored tables. Every one is a never-null Column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge import fixed
from tablegauge.config import Roles
from tablegauge.functions.scalars import (
    aggregate, holds, is_number, lit, pick, q, strip, text, to_date, to_number, types_of, words,
)
from tablegauge.operators.dedup import flag_repeats
from tablegauge.operators.profile import has_missing
from tablegauge.sources.staging import staged


class PlanError(ValueError):
    """A condition or plan that does not fit the table."""


class Conditions:
    """Conditions bound to the columns and types of one table."""

    def __init__(self, df: DataFrame, roles: Roles = Roles(), formats: Sequence[str] = ("yyyy-MM-dd",)):
        self.df = df
        self.kinds = types_of(df)
        self.dates = set(roles.dates)
        self.formats = tuple(formats)

    # --- operands -----------------------------------------------------------------

    def kind(self, column: str) -> str:
        if column not in self.kinds:
            raise PlanError(f"unknown column: {column!r}")
        if column in self.dates:
            return "date"
        return "number" if is_number(self.kinds[column]) else "text"

    def operand(self, column: str) -> str:
        kind = self.kind(column)
        if kind == "date":
            return f"({to_date(column, self.kinds[column], self.formats)})"
        return f"({to_number(column, self.kinds[column])})" if kind == "number" else strip(q(column))

    def value(self, column: str, value: object) -> str:
        kind = self.kind(column)
        if kind == "date":
            return f"try_cast({lit(str(value))} AS DATE)"
        if kind == "number":
            try:
                return lit(float(value))
            except (TypeError, ValueError):
                raise PlanError(f"{column!r} is a number, {value!r} is not") from None
        return lit(str(value).strip())

    # --- comparisons ----------------------------------------------------------------

    def equals(self, column: str, value: object) -> Column:
        return F.expr(holds(self._equal(column, value)))

    def differs(self, column: str, value: object) -> Column:
        """Negation of ``equals``; a missing value differs from everything."""
        return F.expr(f"NOT {holds(self._equal(column, value))}")

    def _equal(self, column: str, value: object) -> str:
        if self.kind(column) == "text":
            return f"lower({self.operand(column)}) = {lit(str(value).strip().lower())}"
        return f"{self.operand(column)} = {self.value(column, value)}"

    def compare(self, column: str, op: str, value: object) -> Column:
        """``>``, ``>=``, ``<`` or ``<=``; a missing value never matches."""
        if op not in (">", ">=", "<", "<="):
            raise PlanError(f"unknown comparison: {op!r}")
        return F.expr(holds(f"{self.operand(column)} {op} {self.value(column, value)}"))

    def between(self, column: str, first: object, second: object) -> Column:
        """Inclusive; the bounds may come in either order."""
        a, b = self.value(column, first), self.value(column, second)
        return F.expr(holds(
            f"{self.operand(column)} BETWEEN "
            f"CASE WHEN {a} > {b} THEN {b} ELSE {a} END AND CASE WHEN {a} > {b} THEN {a} ELSE {b} END"
        ))

    def one_of(self, column: str, values: Sequence[object]) -> Column:
        if self.kind(column) == "number":
            listed = ", ".join(self.value(column, v) for v in values)
            return F.expr(holds(f"{self.operand(column)} IN ({listed})"))
        listed = words(str(v).strip().lower() for v in values)
        return F.expr(holds(f"lower({strip(q(column))}) IN {listed}"))

    def contains(
        self, column: str, pattern: str, regex: bool = True, skip_if_empty: bool = False
    ) -> Column:
        """Case-insensitive match anywhere in the value.

        ``skip_if_empty`` makes the condition true for all rows when it would
        hold for none, so that a mistaken word does not empty a result.
        """
        self.kind(column)
        if regex:
            condition = holds(f"{text(q(column))} RLIKE {lit('(?i)' + str(pattern))}")
        else:
            condition = holds(f"contains(lower({text(q(column))}), {lit(str(pattern).lower())})")
        if not skip_if_empty:
            return F.expr(condition)
        found = self.df.selectExpr(f"coalesce(bool_or({condition}), FALSE)").scalar()
        return F.expr(condition) | ~found

    def is_missing(self, column: str) -> Column:
        self.kind(column)
        return F.expr(holds(f"({q(column)} IS NULL OR {strip(q(column))} IN {words(fixed.NULL_TEXT)})"))

    def is_present(self, column: str) -> Column:
        return ~self.is_missing(column)

    # --- dates --------------------------------------------------------------------------

    def on_or_after(self, column: str, day: str) -> Column:
        return self._date(column, f">= try_cast({lit(day)} AS DATE)")

    def on_or_before(self, column: str, day: str) -> Column:
        return self._date(column, f"<= try_cast({lit(day)} AS DATE)")

    def date_between(self, column: str, first: str, second: str) -> Column:
        days = ", ".join(f"try_cast({lit(day)} AS DATE)" for day in (first, second))
        return self._date(column, f"BETWEEN least({days}) AND greatest({days})")

    def in_month(self, column: str, year: int, month: int) -> Column:
        """A whole month, as a range on the date rather than on its parts."""
        return self._date(
            column, f">= make_date({year}, {month}, 1) AND {self._day(column)} "
                    f"< add_months(make_date({year}, {month}, 1), 1)")

    def in_year(self, column: str, year: int) -> Column:
        return self._date(
            column, f">= make_date({year}, 1, 1) AND {self._day(column)} < make_date({year + 1}, 1, 1)")

    def _day(self, column: str) -> str:
        if column not in self.kinds:
            raise PlanError(f"unknown column: {column!r}")
        return f"({to_date(column, self.kinds[column], self.formats)})"

    def _date(self, column: str, rest: str) -> Column:
        return F.expr(holds(f"{self._day(column)} {rest}"))

    # --- quality columns ----------------------------------------------------------------

    def severity_in(self, labels: Sequence[str]) -> Column:
        return F.expr(holds(f"dq_severity IN {words(labels)}"))

    def grade_is(self, letter: str) -> Column:
        return F.expr(holds(f"dq_grade = {lit(letter.upper())}"))

    def score(self, op: str, value: float, upper: float | None = None) -> Column:
        if op == "between":
            return F.expr(holds(f"dq_score BETWEEN {lit(float(value))} AND {lit(float(upper))}"))
        return self.compare("dq_score", op, value)

    def anomalous(self) -> Column:
        """The anomaly flag, or a high isolation score where there is no flag."""
        if "is_anomaly" in self.kinds:
            return F.expr(holds("is_anomaly"))
        if "isolation_score" in self.kinds:
            return F.expr(holds("isolation_score >= 70"))
        return F.lit(True)

    def has_missing(self, source: bool = False) -> Column:
        """Some column is missing now or, with ``source``, was before the fill."""
        return F.expr(holds("had_nulls = 1") if source else has_missing(self.df))

    def weak(self, dimension: str, threshold: float = 70.0) -> Column:
        return F.expr(holds(f"{q('dq_score_' + dimension)} < {lit(float(threshold))}"))

    def number(self, hint: str, op: str, value: float) -> Column:
        """Compare the number column whose name fits ``hint``."""
        column = match_column(hint, [c for c, t in self.kinds.items() if is_number(t)])
        if column is None:
            raise PlanError(f"no number column fits {hint!r}")
        if op in ("=", "=="):
            return self.equals(column, value)
        return self.compare(column, op, value)


def bare(name: str) -> str:
    """A name's words in lower case, parted by single blanks."""
    return " ".join(name.lower().replace("_", " ").split())


def match_column(hint: str, columns: Sequence[str]) -> str | None:
    """The first of ``columns`` whose words hold the hint's, or are held by them; a
    hint without words fits none."""
    wanted = bare(hint)
    names = ((bare(c), c) for c in columns) if wanted else ()
    return next((c for name, c in names if name.find(wanted) >= 0 or wanted.find(name) >= 0), None)


def combine(conditions: Sequence[tuple[str, Column]]) -> Column:
    """Join conditions strictly left to right, without precedence.

    Each entry is ``("and" | "or", condition)``; the first word is ignored.
    """
    out: Column | None = None
    for word, condition in conditions:
        if out is None:
            out = condition
        else:
            out = (out | condition) if word == "or" else (out & condition)
    return F.lit(True) if out is None else out


def duplicate_rows(df: DataFrame, roles: Roles, spread_by: Sequence[str]) -> DataFrame:
    """Rows whose first id occurs more than once in the whole table, else rows
    of low uniqueness."""
    ids = [c for c in roles.ids if c in df.columns]
    if ids:
        return pick(flag_repeats(df, ids[0], "__dup", spread_by).filter("__dup"), df.columns)
    return df.filter("dq_score_uniqueness < 50") if "dq_score_uniqueness" in df.columns else df


def filter_results(
    df: DataFrame, severities: Sequence[str], grades: Sequence[str], low: float = 0, high: float = 100
) -> DataFrame:
    """Severity set, grade set and score range together."""
    return df.filter(
        f"dq_severity IN {words(severities)} AND dq_grade IN {words(grades)} "
        f"AND dq_score BETWEEN {lit(low)} AND {lit(high)}")


def extract(
    df: DataFrame, severity: str = "ALL", flagged_only: bool = False, columns: Sequence[str] = ()
) -> DataFrame:
    """One severity (or all), optionally flagged rows only, chosen columns."""
    if severity != "ALL":
        df = df.filter(F.col("dq_severity") == severity)
    if flagged_only and "is_anomaly" in df.columns:
        df = df.filter("is_anomaly")
    chosen = [c for c in columns if c in df.columns]
    return pick(df, chosen) if chosen else df


def display_columns(df: DataFrame, roles: Roles, ids: int = 2, dates: int = 0, numerics: int = 2,
                    categories: int = 2, extra: Sequence[str] = (), limit: int | None = None) -> list[str]:
    """First columns of each role, then ``extra``; each once, those present."""
    wanted = [*roles.ids[:ids], *roles.dates[:dates], *roles.numerics[:numerics],
              *roles.categories[:categories], *extra]
    return [c for c in dict.fromkeys(wanted) if c in df.columns][:limit]


def lookup(df: DataFrame, column: str, value: object, tie: Sequence[str]) -> DataFrame:
    """The first row whose ``column`` equals ``value``."""
    return df.filter(F.col(q(column)) == F.lit(value)).orderBy(*[F.col(q(c)) for c in tie]).limit(1)


def sort_rows(df: DataFrame, column: str, ascending: bool, tie: Sequence[str]) -> DataFrame:
    order = F.col(q(column)).asc() if ascending else F.col(q(column)).desc()
    return df.orderBy(order, *[F.col(q(c)) for c in tie])


def top_rows(df: DataFrame, n: int, tie: Sequence[str], column: str | None = None) -> DataFrame:
    """Highest ``column`` first, or worst score first when none is named."""
    return sort_rows(df, column or "dq_score", column is None, tie).limit(n)


def sort_by_hint(df: DataFrame, hint: str, tie: Sequence[str]) -> DataFrame:
    """``worst``, ``best`` or ``risk`` first."""
    if hint == "risk" and "isolation_score" in df.columns:
        return sort_rows(df, "isolation_score", False, tie)
    if hint not in ("worst", "best"):
        raise PlanError(f"unknown sort hint: {hint!r}")
    return sort_rows(df, "dq_score", hint == "worst", tie)


def row_at(df: DataFrame, column: str, ascending: bool, tie: Sequence[str], k: int) -> DataFrame:
    """Row number ``k`` (from 0) of the sorted table.

    Rows are range-partitioned by the order and written; the sizes of the parts
    say which part holds the rank, and only that part is ranked.
    """
    order = [F.col(q(column)).asc() if ascending else F.col(q(column)).desc(), *[F.col(q(c)).asc() for c in tie]]
    parts = staged(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = aggregate(parts, {"n": "count(1)"}, ["__part"]).selectExpr(
        "__part", "sum(n) OVER (ORDER BY __part) - n AS before", "n")
    chosen = sizes.filter(f"before <= {int(k)} AND before + n > {int(k)}").selectExpr("__part", f"{int(k)} - before AS skip").first()
    if chosen is None:
        return df.limit(0)
    here = parts.filter(F.col("__part") == chosen["__part"]).drop("__part")
    return here.orderBy(*order).offset(chosen["skip"]).limit(1)


def business_columns(df: DataFrame, keep_scores: bool = True, added: Sequence[str] | None = None) -> list[str]:
    """Columns of a business export.

    With ``added``, the engineered columns are the ones listed there; without,
    they are recognised by their suffixes.
    """
    if added is None:
        engineered = {c for c in df.columns if c.endswith(fixed.ENGINEERED_SUFFIXES)}
    else:
        engineered = {c for c in added if c.endswith(fixed.ENGINEERED_SUFFIXES)}
    engineered |= set(fixed.EXPORT_DROPPED_EXACT)
    if not keep_scores:
        engineered |= {c for c in df.columns if c.startswith("dq_")} | {"is_anomaly"}
    return [c for c in df.columns if c not in engineered]


def business_view(df: DataFrame, keep_scores: bool = True, added: Sequence[str] | None = None) -> DataFrame:
    return pick(df, business_columns(df, keep_scores, added))


def source_columns(df: DataFrame) -> list[tuple[str, str]]:
    """Name and type of the user's own columns."""
    return [
        (c, t.simpleString()) for c, t in types_of(df).items()
        if not c.startswith(("dq_", "__")) and c not in fixed.ENGINEERED_EXACT
        and not c.endswith(fixed.ENGINEERED_SUFFIXES)
    ]
