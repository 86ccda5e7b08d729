"""SQL expression text shared by the operators.

Operators build their projections as SQL text and hand a whole projection to
Spark at once; a wide table then costs one call to the JVM per step instead
of several per column.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that count as white space at the ends of a value.
WHITESPACE = " \t\n\r\x0b\x0c" + "".join(
    chr(code) for code in (
        0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"

#: Date patterns with a time of day, and what stands between date and time.
ISO_TIMES = {"yyyy-MM-dd HH:mm:ss": " ", "yyyy-MM-dd'T'HH:mm:ss": "T"}

FLOAT_TYPES = (T.FloatType, T.DoubleType)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


# --- names and literals --------------------------------------------------------

def q(name: str) -> str:
    """A column name as SQL, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def lit(value: object) -> str:
    """A literal as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def words(values: Iterable[object]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


# --- projections ----------------------------------------------------------------

def assign(df: DataFrame, exprs: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """Add or replace columns; all expressions read the input columns."""
    if not exprs and not drop:
        return df
    kept = [c for c in df.columns if c not in drop]
    out = [f"{exprs[c]} AS {q(c)}" if c in exprs else q(c) for c in kept]
    out += [f"{e} AS {q(c)}" for c, e in exprs.items() if c not in kept]
    return df.selectExpr(*out)


def pick(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.selectExpr(*[q(c) for c in names])


def aggregate(df: DataFrame, exprs: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Aggregate with SQL expressions; ``by`` columns come first."""
    columns = [F.expr(f"{e} AS {q(n)}") for n, e in exprs.items()]
    return df.groupBy(*[F.col(q(c)) for c in by]).agg(*columns)


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct that row expressions can read.

    Becomes a scalar subquery: it runs once, its value is sent to the tasks,
    and no join is planned.
    """
    fields = ", ".join(q(c) for c in df.columns)
    return df.selectExpr(f"struct({fields}) AS `row`").scalar()


# --- column types ---------------------------------------------------------------

def types_of(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.VarcharType, T.CharType))


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, INTEGER_TYPES)


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, FLOAT_TYPES)


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, TIME_TYPES)


# --- text -------------------------------------------------------------------------

def text(e: str) -> str:
    return f"CAST({e} AS STRING)"


def strip(e: str) -> str:
    return f"btrim({text(e)}, {lit(WHITESPACE)})"


def title_case(e: str) -> str:
    """Upper-case every letter that follows a non-letter, lower-case the rest.

    Words of ASCII letters and numbers between blanks take the built-in function, which
    agrees there; other texts are cut at their non-letters.
    """
    pieces = f"split(lower({e}), {lit('(?<=[^' + chr(92) + 'p{L}])')})"
    titled = "concat(upper(substr(piece, 1, 1)), substr(piece, 2))"
    return (f"CASE WHEN {e} RLIKE '[^A-Za-z0-9 ]|[0-9][A-Za-z]' "
            f"THEN array_join(transform({pieces}, piece -> {titled}), '') ELSE initcap({e}) END")


def is_placeholder(e: str, placeholders: Iterable[str], kind: T.DataType | None = None) -> str:
    """Null, or a placeholder word once trimmed and upper-cased.

    Looked up in a constant array: an IN list would be unrolled into the
    generated code, which then grows past what the JVM compiles. A column of a number
    ``kind`` is rendered as text only where a placeholder could be one.
    """
    words_of_numbers = [w for w in placeholders if any(c.isdigit() for c in w) or "INF" in w.upper()]
    if kind is not None and is_number(kind) and not words_of_numbers:
        none = f"isnan({e})" if is_float(kind) and "NAN" in placeholders else "FALSE"
        return f"({e} IS NULL OR {none})"
    listed = f"array{words(placeholders)}"
    return f"({e} IS NULL OR array_contains({listed}, upper({strip(e)})))"


# --- numbers and dates ----------------------------------------------------------

def to_number(name: str, kind: T.DataType) -> str:
    """Number or null; text such as ``nan`` or ``1d`` is not a number."""
    if is_number(kind) or isinstance(kind, T.BooleanType):
        return f"CAST({q(name)} AS DOUBLE)"
    if is_text(kind):
        return f"CASE WHEN {q(name)} RLIKE {lit(NUMBER)} THEN try_cast({q(name)} AS DOUBLE) END"
    return "CAST(NULL AS DOUBLE)"


def to_date(name: str, kind: T.DataType, formats: Sequence[str]) -> str:
    """Date or null, from the first pattern that fits."""
    if is_time(kind):
        return f"CAST({q(name)} AS DATE)"
    if not is_text(kind):
        return "CAST(NULL AS DATE)"
    return "coalesce(" + ", ".join(_parse_date(q(name), f) for f in formats) + ")"


def _parse_date(e: str, pattern: str) -> str:
    """One pattern or date form. Fixed-width year, month and day are cut out and
    cast, which is much cheaper than a formatter that throws on every bad value."""
    from tablegauge.functions import dates

    if pattern in dates.FORMS:
        return dates.parse_form(e, pattern)
    if pattern in ISO_TIMES:
        shape = f"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{ISO_TIMES[pattern]}[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]+)?$"
        return f"CASE WHEN {e} RLIKE {lit(shape)} THEN CAST(try_cast({e} AS TIMESTAMP_NTZ) AS DATE) END"
    if sorted(re.findall(r"[A-Za-z]+", pattern)) != ["MM", "dd", "yyyy"]:
        return f"try_to_date({e}, {lit(pattern)})"
    shape = "^" + re.sub(r"yyyy|MM|dd", lambda m: f"[0-9]{{{len(m[0])}}}", re.escape(pattern)) + "$"
    year, month, day = (
        f"substr({e}, {pattern.index(part) + 1}, {len(part)})" for part in ("yyyy", "MM", "dd"))
    iso = e if pattern == "yyyy-MM-dd" else f"concat({year}, '-', {month}, '-', {day})"
    return f"CASE WHEN {e} RLIKE {lit(shape)} THEN try_cast({iso} AS DATE) END"


def half_even(e: str, digits: int = 1) -> str:
    """Round to ``digits`` decimals by scaling, ties to the even digit."""
    scale = lit(float(10**digits))
    return f"(rint(({e}) * {scale}) / {scale})"


def clamp(e: str, low: float = 0.0, high: float = 100.0) -> str:
    return f"greatest({lit(low)}, least({lit(high)}, {e}))"


def percent(part: str, whole: str, digits: int = 1) -> str:
    """``part`` as a rounded percentage of ``whole``; 0 for an empty table."""
    share = half_even(f"100.0D * {part} / {whole}", digits)
    return f"CASE WHEN {whole} > 0 THEN {share} ELSE 0.0D END"


def bucket(e: str, low: float, high: float, bins: int) -> str:
    """1-based equal-width bin; the top edge falls in the last bin."""
    width = f"({e} - {lit(float(low))}) / {lit(float(high - low))} * {bins}"
    return f"CAST(least({bins}, 1 + CAST(floor({width}) AS INT)) AS INT)"


# --- conditions -------------------------------------------------------------------

def flag(condition: str) -> str:
    """0/1 integer; null counts as 0."""
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def holds(condition: str) -> str:
    """A condition that is never null."""
    return f"coalesce({condition}, FALSE)"


def any_of(conditions: Sequence[str]) -> str:
    return "(" + " OR ".join(conditions) + ")" if conditions else "FALSE"


def add_all(terms: Sequence[str]) -> str:
    return "(" + " + ".join(terms) + ")" if terms else "0"


def missing(name: str, kind: T.DataType) -> str:
    """Null, or NaN in a floating-point column."""
    if is_float(kind):
        return f"({q(name)} IS NULL OR isnan({q(name)}))"
    return f"({q(name)} IS NULL)"
