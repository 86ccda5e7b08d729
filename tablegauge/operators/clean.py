"""Cleaning steps and the two fixed step orders.

Every step is ``DataFrame -> DataFrame`` and keeps values it only flags.
Columns whose name starts with ``__`` are counters for the statistics row;
``Cleaned.rows()`` leaves them out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablegauge import fixed
from tablegauge.config import CleanConfig, InvoiceConfig, Roles
from tablegauge.functions.dates import date_patterns
from tablegauge.functions.scalars import (
    add_all, aggregate, any_of, assign, flag, is_float, is_number, is_placeholder, is_text,
    lit, missing, one_row, pick, q, strip, text, title_case, to_date, to_number, types_of, words,
)
from tablegauge.operators.dedup import ROWS_IN, distinct_rows, keep_first

NULL_CELLS = "__null_cells"
NULL_ROWS = "__null_rows"
CHANGED = "__changed_"
PARSED = "__date_"
MOMENTS = "__moments"
COLLAPSED = "__collapsed"


@dataclass(frozen=True)
class Cleaned:
    """A cleaned table with what is needed to report on the cleaning."""

    frame: DataFrame
    added: tuple[str, ...]
    dates: tuple[str, ...]
    numerics: tuple[str, ...]
    categories: tuple[str, ...]
    fixed_schema: bool

    def rows(self) -> DataFrame:
        return visible(self.frame)

    def stats(self) -> DataFrame:
        """One row of cleaning statistics."""
        return cleaning_stats(self)


def visible(df: DataFrame) -> DataFrame:
    return pick(df, [c for c in df.columns if not c.startswith("__")])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Make NaN null in floating-point columns, so that one null rule holds."""
    return assign(df, {
        c: f"CASE WHEN NOT isnan({q(c)}) THEN {q(c)} END"
        for c, kind in types_of(df).items() if is_float(kind)
    })


def flag_nulls(df: DataFrame) -> DataFrame:
    """Add ``had_nulls``: 1 if any column of the row is null."""
    return assign(df, {"had_nulls": flag(any_of([missing(c, t) for c, t in types_of(df).items()]))})


def fill_words(df: DataFrame, config: CleanConfig) -> dict[str, str]:
    """Fill value of each column that takes one; dates and booleans do not."""
    out: dict[str, str] = {}
    for c, kind in types_of(df).items():
        if c.startswith("__") or c == "had_nulls":
            continue
        if is_text(kind):
            out[c] = lit(config.fill_text)
        elif is_number(kind) and config.fill_number is not None:
            out[c] = f"CAST({lit(float(config.fill_number))} AS {kind.simpleString()})"
    return out


def fill_nulls(df: DataFrame, config: CleanConfig) -> DataFrame:
    """Fill missing text and numbers."""
    return assign(df, {c: f"coalesce({q(c)}, {w})" for c, w in fill_words(df, config).items()})


def flag_and_fill(df: DataFrame, config: CleanConfig) -> DataFrame:
    """``had_nulls`` and the fill, with hidden counters of cells and rows."""
    df = nan_to_null(df)
    fills = fill_words(df, config)
    had = flag(any_of([f"{q(c)} IS NULL" for c in df.columns]))
    return assign(df, {c: f"coalesce({q(c)}, {w})" for c, w in fills.items()} | {
        "had_nulls": had,
        NULL_CELLS: add_all([f"CAST({q(c)} IS NULL AS INT)" for c in fills]),
        NULL_ROWS: had,
    })


def drop_duplicates(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], rare: bool = False
) -> DataFrame:
    """Keep the first row per key; with no keys, one of each distinct row. ``rare`` as
    in ``keep_first``."""
    carry = [c for c in (NULL_CELLS, NULL_ROWS) if c in df.columns]
    return keep_first(df, keys, order_by, carry, rare) if keys else distinct_rows(df, carry, rare)


def invoice_keys(df: DataFrame, config: CleanConfig) -> list[str]:
    return [k for k in config.duplicate_keys if k in df.columns]


def general_keys(df: DataFrame, config: CleanConfig, roles: Roles) -> list[str]:
    """Configured keys, else all id columns, else none (the whole row)."""
    if not config.duplicate_keys:
        return [c for c in roles.ids if c in df.columns]
    keys = [k for k in config.duplicate_keys if k in df.columns]
    if not keys:
        raise ValueError(f"none of the duplicate keys exist: {list(config.duplicate_keys)}")
    return keys


def normalise_dates(
    df: DataFrame, names: Sequence[str], formats: Sequence[str] | Mapping[str, Sequence[str]], fill: str,
    ignore: Sequence[str],
) -> DataFrame:
    """Render dates as ``yyyy-MM-dd`` text and flag what is not a date.

    ``formats`` are the patterns of all columns, or those of each; a column that
    has none is given the form that most of its values have, by one scan. The
    parsed date is kept in a hidden column, so later rules need not parse again.
    Values in ``ignore`` are not errors.
    """
    kinds = types_of(df)
    names = [c for c in names if c in kinds]
    given = formats if isinstance(formats, Mapping) else {c: formats for c in names}
    open_ = [c for c in names if not given.get(c)]
    given = {**given, **date_patterns(df, open_)}
    df = assign(df, {PARSED + c: to_date(c, kinds[c], given[c]) for c in names})
    out: dict[str, str] = {}
    for c in names:
        date = q(PARSED + c)
        out[c] = f"coalesce(CAST({date} AS STRING), {lit(fill)})"
        out[f"{c}_parse_error"] = flag(
            f"{date} IS NULL AND {q(c)} IS NOT NULL AND {text(q(c))} NOT IN {words(ignore)}"
        )
    return assign(df, out)


def flag_ranges(
    df: DataFrame, names: Sequence[str], low: float, high: float, fill: float | None = None
) -> DataFrame:
    """Coerce to numbers and flag negative, below-minimum, above-maximum."""
    kinds = types_of(df)
    names = [c for c in names if c in kinds]
    numbers = {c: to_number(c, kinds[c]) for c in names}
    if fill is not None:
        numbers = {c: f"coalesce({n}, {lit(float(fill))})" for c, n in numbers.items()}
    flags: dict[str, str] = {}
    for c in names:
        flags[f"{c}_negative"] = flag(f"{q(c)} < 0")
        flags[f"{c}_below_min"] = flag(f"{q(c)} < {lit(float(low))}")
        flags[f"{c}_above_max"] = flag(f"{q(c)} > {lit(float(high))}")
    return assign(assign(df, numbers), flags)


def standardise_currency(df: DataFrame, accepted: Sequence[str]) -> DataFrame:
    """Trim and upper-case; codes outside ``accepted`` are flagged and replaced."""
    if "currency" not in df.columns:
        return df
    df = assign(df, {"currency": f"upper({strip('currency')})"})
    valid = f"coalesce(currency IN {words(accepted)}, FALSE)"
    return assign(df, {
        "currency": f"CASE WHEN {valid} THEN currency ELSE {lit(fixed.UNKNOWN)} END",
        "currency_invalid": flag(f"NOT {valid}"),
    })


def normalise_vendors(df: DataFrame, fill: str) -> DataFrame:
    """Trim, collapse white space, title-case; placeholders become ``fill``."""
    if "vendor_name" not in df.columns:
        return df
    # In a column of their own, as the next step reads them several times.
    df = assign(df, {COLLAPSED: f"regexp_replace({strip('vendor_name')}, {lit(chr(92) + 's+')}, ' ')"})
    df = _replace_counting(df, {"vendor_name": title_case(COLLAPSED)}, {
        "vendor_name": lambda e: f"lower({e}) IN {words(fixed.PLACEHOLDERS_VENDOR)}"
    }, fill)
    return assign(df, {}, drop=(COLLAPSED,))


def normalise_status(df: DataFrame, accepted: Sequence[str], fill: str) -> DataFrame:
    """Trim and upper-case; anything outside ``accepted`` is flagged and replaced."""
    if "status" not in df.columns:
        return df
    df = assign(df, {"status": f"upper({strip('status')})"})
    df = assign(df, {"status": f"CASE WHEN status IN ('', 'NAN') THEN {lit(fill)} ELSE status END"})
    valid = f"coalesce(status IN {words(accepted)}, FALSE)"
    return assign(df, {
        "status": f"CASE WHEN {valid} THEN status ELSE {lit(fill)} END",
        "status_invalid": flag(f"NOT {valid}"),
    })


def standardise_categories(df: DataFrame, names: Sequence[str], fill: str) -> DataFrame:
    """Trim and upper-case; null words become ``fill``."""
    names = [c for c in names if c in df.columns]
    empty = {c: lambda e: f"{e} IN {words(fixed.PLACEHOLDERS_CATEGORY)}" for c in names}
    return _replace_counting(df, {c: f"upper({strip(q(c))})" for c in names}, empty, fill)


def clean_ids_and_texts(df: DataFrame, names: Sequence[str], fill: str) -> DataFrame:
    """Render as trimmed text; placeholders become ``fill``."""
    return assign(df, {
        c: f"CASE WHEN {is_placeholder(q(c), fixed.PLACEHOLDERS_GENERAL)} THEN {lit(fill)} "
           f"ELSE {strip(q(c))} END"
        for c in names if c in df.columns
    })


def _replace_counting(df: DataFrame, tidy: dict[str, str], empty: dict, fill: str) -> DataFrame:
    """Replace columns, noting in hidden 0/1 columns which values changed."""
    df = assign(df, {CHANGED + c: e for c, e in tidy.items()})
    df = assign(df, {
        CHANGED + c: f"CASE WHEN {empty[c](q(CHANGED + c))} THEN {lit(fill)} ELSE {q(CHANGED + c)} END"
        for c in tidy
    })
    out: dict[str, str] = {}
    for c in tidy:
        out[c] = q(CHANGED + c)
        out[CHANGED + c] = flag(f"NOT ({text(q(c))} <=> {q(CHANGED + c)})")
    return assign(df, out)


def outlier_moments(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each column, as one row."""
    kinds = types_of(df)
    out: dict[str, str] = {}
    for c in names:
        out[f"mean_{c}"] = f"avg({to_number(c, kinds[c])})"
        out[f"deviation_{c}"] = f"stddev_samp({to_number(c, kinds[c])})"
    return aggregate(df, out)


def flag_outliers(df: DataFrame, names: Sequence[str], threshold: float) -> DataFrame:
    """Flag values whose z-score is beyond ``threshold``; none if all are equal."""
    kinds = types_of(df)
    names = [c for c in names if c in kinds]
    if not names:
        return df
    df = df.withColumn(MOMENTS, one_row(outlier_moments(df, names)))
    flags: dict[str, str] = {}
    for c in names:
        mean, deviation = f"{MOMENTS}.{q('mean_' + c)}", f"{MOMENTS}.{q('deviation_' + c)}"
        flags[f"{c}_outlier"] = flag(
            f"{deviation} > 0 AND abs(({to_number(c, kinds[c])} - {mean}) / {deviation}) "
            f"> {lit(float(threshold))}"
        )
    return assign(df, flags, drop=(MOMENTS,))


def clean_invoices(
    df: DataFrame, order_by: Sequence[str], config: InvoiceConfig = InvoiceConfig()
) -> Cleaned:
    """All cleaning steps of the fixed-schema rule set, in order."""
    before = list(df.columns)
    dates = [c for c in config.date_columns if c in before]
    amounts = [c for c in config.amount_columns if c in before]
    # Voted on as they came: a scan of the date columns, before any shuffle.
    patterns = {c: config.date_formats for c in dates} if config.date_formats else date_patterns(df, dates)
    df = flag_and_fill(df, config)
    df = drop_duplicates(df, invoice_keys(df, config), order_by, config.rare_duplicates)
    df = normalise_dates(df, dates, patterns, fixed.UNKNOWN, ("", fixed.UNKNOWN))
    df = flag_ranges(df, amounts, config.min_amount, config.max_amount)
    df = standardise_currency(df, config.currencies)
    df = normalise_vendors(df, config.fill_text)
    df = normalise_status(df, config.statuses, config.fill_text)
    df = flag_outliers(df, amounts, config.outlier_threshold)
    return Cleaned(df, _added(df, before), tuple(dates), tuple(amounts),
                   tuple(c for c in ("vendor_name",) if c in before), True)


def clean_table(
    df: DataFrame, roles: Roles, order_by: Sequence[str], config: CleanConfig = CleanConfig()
) -> Cleaned:
    """All cleaning steps of the inferred-schema rule set, in order."""
    before = list(df.columns)
    if config.date_formats:
        patterns = {c: config.date_formats for c in roles.dates}
    else:
        unseen = [c for c in roles.dates if c not in roles.forms]
        patterns = {**roles.forms, **date_patterns(df, unseen)}
    df = flag_and_fill(df, config)
    df = drop_duplicates(df, general_keys(df, config, roles), order_by, config.rare_duplicates)
    df = normalise_dates(df, roles.dates, patterns, config.fill_text,
                         ("", config.fill_text, "nan", "None"))
    df = flag_ranges(df, roles.numerics, config.min_amount, config.max_amount, config.fill_number)
    df = standardise_categories(df, roles.categories, config.fill_text)
    df = clean_ids_and_texts(df, roles.ids + roles.texts, config.fill_text)
    df = flag_outliers(df, roles.numerics, config.outlier_threshold)
    return Cleaned(df, _added(df, before), tuple(roles.dates), tuple(roles.numerics),
                   tuple(roles.categories), False)


def _added(df: DataFrame, before: Sequence[str]) -> tuple[str, ...]:
    return tuple(c for c in df.columns if c not in before and not c.startswith("__"))


def cleaning_stats(cleaned: Cleaned) -> DataFrame:
    """One row of counters, from one pass over the cleaned table.

    Rows and null cells that de-duplication merged away are counted through
    the hidden sums it carries along, so the source is not read again.
    """
    df = cleaned.frame
    have = set(df.columns)

    def total(names: Sequence[str]) -> str:
        present = [q(n) for n in names if n in have]
        return f"CAST(coalesce(sum({add_all(present)}), 0) AS BIGINT)"

    rows_in, rows_out = total([ROWS_IN]), "count(1)"
    # The fixed-schema rules count rows with nulls before de-duplication, the
    # inferred ones after it.
    out = {
        "rows_input": rows_in,
        "rows_output": rows_out,
        "duplicates_removed": f"{rows_in} - {rows_out}",
        "nulls_filled": total([NULL_CELLS]),
        "rows_with_nulls": total([NULL_ROWS] if cleaned.fixed_schema else ["had_nulls"]),
        "date_parse_errors": total([f"{c}_parse_error" for c in cleaned.dates]),
    }
    negative = total([f"{c}_negative" for c in cleaned.numerics])
    changed = total([CHANGED + c for c in cleaned.categories])
    outliers = total([f"{c}_outlier" for c in cleaned.numerics])
    if cleaned.fixed_schema:
        out |= {
            "date_columns_processed": lit(len(cleaned.dates)),
            "amount_negative_flags": negative,
            "amount_below_min_flags": total([f"{c}_below_min" for c in cleaned.numerics]),
            "amount_above_max_flags": total([f"{c}_above_max" for c in cleaned.numerics]),
            "currency_invalid": total(["currency_invalid"]),
            "vendor_names_normalized": changed,
            "status_invalid": total(["status_invalid"]),
            "outliers_flagged": outliers,
        }
    else:
        out |= {
            "negative_amount_flags": negative,
            "categorical_fixed": changed,
            "outliers_flagged": outliers,
            "date_cols_processed": lit(len(cleaned.dates)),
            "numeric_cols_processed": lit(len(cleaned.numerics)),
            "cat_cols_processed": lit(len(cleaned.categories)),
        }
    return aggregate(df, out)
