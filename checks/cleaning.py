"""Cleaning and scoring queries (C and Q rows of the inventory)."""

from checks.context import KEY, query
from checks.oracle_parts import DATES, DIMS, MONEY, half, mean_tenths
from tablegauge import fixed
from tablegauge.config import CleanConfig, InvoiceConfig
from tablegauge.functions.scalars import pick
from tablegauge.operators import clean as C
from tablegauge.operators.score import (
    OVERALL, date_error_penalty, date_pairs, placeholder_rates,
)

F_CONFIG, CONFIG = InvoiceConfig(), CleanConfig()
FLAGS = [f"{c}_{s}" for c in MONEY for s in ("negative", "below_min", "above_max")]
OUTLIERS = [f"{c}_outlier" for c in MONEY]
CLEAN_F = ["invoice_id", "invoice_number", "vendor_name", *DATES, *MONEY, "currency", "status", "had_nulls",
           *[f"{c}_parse_error" for c in DATES], *FLAGS, "currency_invalid", "status_invalid", *OUTLIERS]
CLEAN_U = [c for c in CLEAN_F if c not in ("currency_invalid", "status_invalid")]
SCORES = [*[f"dq_score_{d}" for d in DIMS], "dq_score", "dq_grade", "dq_severity", "dq_issues"]


def cols(names):
    return ", ".join(names)


@query("c1_had_nulls", "SELECT invoice_id, had_nulls FROM f_fill")
def _(x):
    return pick(C.flag_nulls(x.invoices), ["invoice_id", "had_nulls"])


FILLED = ["invoice_id", "invoice_number", "vendor_name", *DATES, *MONEY, "currency", "status"]


@query("c2_null_fill", f"SELECT {cols(FILLED)} FROM f_fill")
def _(x):
    return C.fill_nulls(x.invoices, CONFIG)


@query("c3_dedup_keep_first", "SELECT invoice_id, vendor_name, invoice_number FROM f_dedup")
def _(x):
    filled = C.flag_and_fill(x.invoices, F_CONFIG)
    kept = C.drop_duplicates(filled, C.invoice_keys(filled, F_CONFIG), KEY)
    return pick(kept, ["invoice_id", "vendor_name", "invoice_number"])


@query("c3_dedup_rare", "SELECT invoice_id, vendor_name, invoice_number FROM f_dedup")
def _(x):
    filled = C.flag_and_fill(x.invoices, F_CONFIG)
    kept = C.drop_duplicates(filled, C.invoice_keys(filled, F_CONFIG), KEY, rare=True)
    return pick(kept, ["invoice_id", "vendor_name", "invoice_number"])


@query("c4_dedup_inferred_ids", "SELECT invoice_id, invoice_number, had_nulls, total_amount FROM u_dedup")
def _(x):
    filled = C.flag_and_fill(x.ledger, CONFIG)
    kept = C.drop_duplicates(filled, C.general_keys(filled, CONFIG, x.roles), KEY)
    return pick(kept, ["invoice_id", "invoice_number", "had_nulls", "total_amount"])


@query("c4_dedup_whole_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(x):
    return C.visible(C.drop_duplicates(
        x.table("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"), [], []))


DATED = ["invoice_id", *DATES, *[f"{c}_parse_error" for c in DATES]]


@query("c5_date_normalise", f"SELECT {cols(DATED)} FROM f_clean")
def _(x):
    filled = C.drop_duplicates(C.fill_nulls(x.invoices, F_CONFIG), F_CONFIG.duplicate_keys, KEY)
    return pick(C.normalise_dates(filled, DATES, F_CONFIG.date_formats, fixed.UNKNOWN,
                                  ("", fixed.UNKNOWN)), DATED)


@query("c5_date_formats", """SELECT invoice_id, coalesce(strftime(coalesce(
    try_strptime(invoice_date, '%Y-%m-%d'), try_strptime(invoice_date, '%d/%m/%Y')), '%Y-%m-%d'), 'UNKNOWN')
    AS invoice_date FROM inv""")
def _(x):
    return pick(C.normalise_dates(x.invoices, ["invoice_date"], ("yyyy-MM-dd", "dd/MM/yyyy"), fixed.UNKNOWN,
                                  ("", fixed.UNKNOWN)), ["invoice_id", "invoice_date"])


def _rendered():
    """Orders' dates in six forms, every 11th written otherwise or not at all; both
    engines run this text. ``doubtful`` has no day past 12, so either order fits."""
    y, m, day = "substr(d, 1, 4)", "substr(d, 6, 2)", "substr(d, 9, 2)"
    short = "CAST(CAST({} AS INT) AS VARCHAR(4))".format
    name = f"substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * CAST({m} AS INT) - 2, 3)"
    slashed = f"concat({m}, '/', {day}, '/', {y})"
    european = f"concat({day}, '/', {m}, '/', {y})"
    small = "CAST(1 + o_orderkey % 12 AS VARCHAR(4))"
    forms = {
        "unpadded": f"concat({y}, '-', {short(m)}, '-', {short(day)})",
        "month_first": slashed, "day_first": european,
        "named": f"concat({name}, ' ', {short(day)}, ', ', {y})",
        "zoned": "concat(d, 'T10:00:00Z')",
        "doubtful": f"concat({short(m)}, '.', {small}, '.', {y})",
    }
    other = {"month_first": european, "day_first": slashed, "named": "d", "doubtful": "'soon'"}
    cells = [f"CASE WHEN o_orderkey % 11 = 0 THEN {other[c]} WHEN o_orderkey % 13 = 0 THEN NULL ELSE {e} END AS {c}"
             if c in other else f"{e} AS {c}" for c, e in forms.items()]
    return forms, (f"SELECT o_orderkey, {', '.join(cells)} FROM "
                   "(SELECT o_orderkey, substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) AS d FROM orders) AS o")


FORMS, RENDERED = _rendered()
READ = {"unpadded": "%Y-%m-%d", "month_first": "%m/%d/%Y", "day_first": "%d/%m/%Y", "named": "%b %d, %Y",
        "zoned": "%Y-%m-%dT%H:%M:%SZ", "doubtful": "%m.%d.%Y"}


def _read_sql():
    out = ["o_orderkey"]
    for c, form in READ.items():
        out.append(f"coalesce(strftime(try_strptime({c}, '{form}'), '%Y-%m-%d'), 'UNKNOWN') AS {c}")
        out.append(f"CASE WHEN {c} IS NOT NULL AND try_strptime({c}, '{form}') IS NULL THEN 1 ELSE 0 END AS {c}_parse_error")
    return f"SELECT {', '.join(out)} FROM ({RENDERED}) AS r"


def rendered(x):
    x.table("orders").createOrReplaceTempView("orders")
    return x.spark.sql(RENDERED)


@query("c6_date_forms", _read_sql())
def _(x):
    """The form of each column by a vote of its values."""
    return C.visible(C.normalise_dates(rendered(x), list(FORMS), CONFIG.date_formats, fixed.UNKNOWN, ("",)))


@query("p1_types_of_date_forms", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', 'date')" for c in READ) +
       ") AS t(\"column\", \"type\") WHERE (SELECT count(*) FROM orders) > 0")
def _(x):
    from tablegauge.operators.profile import infer_roles, type_table

    dates = pick(rendered(x), list(FORMS))
    return type_table(dates, infer_roles(dates))


@query("c6_date_normalise_inferred",
       f"SELECT raw_id AS invoice_id, {cols(DATED[1:])} FROM u_clean")
def _(x):
    filled = C.fill_nulls(x.invoices, CONFIG)
    return pick(C.normalise_dates(filled, x.roles.dates, CONFIG.date_formats, CONFIG.fill_text,
                                  ("", CONFIG.fill_text, "nan", "None")), DATED)


@query("c7_amount_validate", f"""SELECT invoice_id, {', '.join(
    f'''CASE WHEN {c} < 0 THEN 1 ELSE 0 END AS {c}_negative,
        CASE WHEN {c} < 0 THEN 1 ELSE 0 END AS {c}_below_min,
        CASE WHEN {c} > 10000000 THEN 1 ELSE 0 END AS {c}_above_max''' for c in MONEY)},
    amount IS NULL AS amount_missing FROM inv""")
def _(x):
    flagged = C.flag_ranges(x.invoices, MONEY, F_CONFIG.min_amount, F_CONFIG.max_amount)
    return flagged.selectExpr("invoice_id", *FLAGS, "amount IS NULL AS amount_missing")


@query("c8_numeric_validate", f"SELECT raw_id AS invoice_id, {cols(MONEY)}, {cols(FLAGS)} FROM u_clean")
def _(x):
    flagged = C.flag_ranges(x.invoices, x.roles.numerics, CONFIG.min_amount, CONFIG.max_amount, 0.0)
    return pick(flagged, ["invoice_id", *MONEY, *FLAGS])


@query("c9_currency_standardise", "SELECT invoice_id, currency, currency_invalid FROM f_clean")
def _(x):
    return pick(x.f.cleaned.frame, ["invoice_id", "currency", "currency_invalid"])


@query("c10_vendor_normalise", "SELECT invoice_id, vendor_name FROM f_clean")
def _(x):
    return pick(x.f.cleaned.frame, ["invoice_id", "vendor_name"])


@query("c11_status_normalise", "SELECT invoice_id, status, status_invalid FROM f_clean")
def _(x):
    return pick(x.f.cleaned.frame, ["invoice_id", "status", "status_invalid"])


@query("c12_category_standardise", "SELECT raw_id AS invoice_id, vendor_name, currency, status FROM u_clean")
def _(x):
    tidy = C.standardise_categories(C.fill_nulls(x.invoices, CONFIG), x.roles.categories, CONFIG.fill_text)
    return pick(tidy, ["invoice_id", "vendor_name", "currency", "status"])


@query("c13_id_text_clean", "SELECT invoice_id, invoice_number FROM u_clean")
def _(x):
    tidy = C.clean_ids_and_texts(C.fill_nulls(x.invoices, CONFIG), x.roles.ids, CONFIG.fill_text)
    return pick(tidy, ["invoice_id", "invoice_number"])


@query("c14_outlier_flag", f"SELECT invoice_id, {cols(OUTLIERS)} FROM f_clean")
def _(x):
    return pick(x.f.cleaned.frame, ["invoice_id", *OUTLIERS])


@query("c14_outlier_lineitem", """SELECT l_orderkey, l_linenumber,
    CASE WHEN abs((l_extendedprice - m) / s) > 2 THEN 1 ELSE 0 END AS l_extendedprice_outlier
    FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem)""")
def _(x):
    lines = x.table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return C.flag_outliers(lines, ["l_extendedprice"], 2.0).drop("l_extendedprice")


def _sum(names):
    return "CAST(sum(" + " + ".join(names) + ") AS BIGINT)"


COMMON = f"""CAST((SELECT sum(null_cells) FROM {{p}}_fill) AS BIGINT) AS nulls_filled,
    CAST((SELECT count(*) FROM {{p}}_fill) AS BIGINT) AS rows_input, count(*) AS rows_output,
    CAST((SELECT count(*) FROM {{p}}_fill) - count(*) AS BIGINT) AS duplicates_removed,
    {_sum([f'{c}_parse_error' for c in DATES])} AS date_parse_errors,
    {_sum(OUTLIERS)} AS outliers_flagged"""


@query("c15_cleaning_stats", f"""SELECT {COMMON.format(p='f')},
    CAST((SELECT sum(had_nulls) FROM f_fill) AS BIGINT) AS rows_with_nulls, 3 AS date_columns_processed,
    {_sum([f'{c}_negative' for c in MONEY])} AS amount_negative_flags,
    {_sum([f'{c}_below_min' for c in MONEY])} AS amount_below_min_flags,
    {_sum([f'{c}_above_max' for c in MONEY])} AS amount_above_max_flags,
    CAST(sum(currency_invalid) AS BIGINT) AS currency_invalid,
    CAST(sum(CASE WHEN vendor_name <> vendor_before THEN 1 ELSE 0 END) AS BIGINT) AS vendor_names_normalized,
    CAST(sum(status_invalid) AS BIGINT) AS status_invalid FROM f_clean""")
def _(x):
    return x.f.cleaned.stats()


@query("c15_cleaning_stats_inferred", f"""SELECT {COMMON.format(p='u')},
    CAST(sum(had_nulls) AS BIGINT) AS rows_with_nulls,
    {_sum([f'{c}_negative' for c in MONEY])} AS negative_amount_flags,
    CAST(sum(categories_changed) AS BIGINT) AS categorical_fixed,
    3 AS date_cols_processed, 3 AS numeric_cols_processed, 3 AS cat_cols_processed FROM u_clean""")
def _(x):
    return x.u.cleaned.stats()


@query("c16_clean_invoices", f"SELECT {cols(CLEAN_F)} FROM f_clean")
def _(x):
    return x.f.cleaned.rows()


@query("c16_clean_inferred", f"SELECT {cols(CLEAN_U)} FROM u_clean")
def _(x):
    return x.u.cleaned.rows()


# --- scoring ---------------------------------------------------------------------

def dimension(name, key, profile, d):
    source = {"f": "f_score", "u": "u_score"}[profile]

    @query(name, f"SELECT invoice_id, dq_score_{d} FROM {source}")
    def _(x):
        return pick(getattr(x, profile).scored.frame, ["invoice_id", f"dq_score_{d}"])


for number, (profile, d) in {
    1: ("f", "completeness"), 2: ("u", "completeness"), 3: ("f", "validity"), 4: ("u", "validity"),
    5: ("f", "accuracy"), 6: ("u", "accuracy"), 11: ("f", "uniqueness"), 12: ("u", "uniqueness"),
}.items():
    kind = "invoices" if profile == "f" else "inferred"
    dimension(f"q{number}_{d}_{kind}", KEY, profile, d)


@query("q4_placeholder_rates", "SELECT rate_vendor_name AS vendor_name, rate_currency AS currency, "
                               "rate_status AS status FROM u_rates")
def _(x):
    return placeholder_rates(x.u.cleaned.frame, x.roles.categories[:5])


def _labelled(name, label):
    @query(name, f"SELECT invoice_id FROM f_score WHERE contains(dq_issues, '{label}')")
    def _(x):
        return x.f_rows.filter(f"contains(dq_issues, '{label}')").select("invoice_id")


_labelled("q7_paid_without_date", fixed.PAID_WITHOUT_DATE[1])
_labelled("q8_total_reconciliation", fixed.TOTAL_MISMATCH[1])
_labelled("q9_due_before_invoice", fixed.DUE_BEFORE_INVOICE[1])


@query("q10_date_order_inferred", "SELECT invoice_id, dq_score_consistency, 1 AS pairs FROM u_score")
def _(x):
    pairs = len(date_pairs(x.roles.dates))
    return x.u_rows.selectExpr("invoice_id", "dq_score_consistency", f"{pairs} AS pairs")


@query("q13_composite_invoices", "SELECT invoice_id, overall FROM f_score")
def _(x):
    return x.f.scored.frame.selectExpr("invoice_id", f"{OVERALL} AS overall")


@query("q14_composite_inferred", "SELECT invoice_id, overall FROM u_score")
def _(x):
    return x.u.scored.frame.selectExpr("invoice_id", f"{OVERALL} AS overall")


@query("q15_integer_score", "SELECT invoice_id, dq_score FROM f_score")
def _(x):
    return x.f_rows.select("invoice_id", "dq_score")


@query("q16_grade", "SELECT invoice_id, dq_grade FROM f_score")
def _(x):
    return x.f_rows.select("invoice_id", "dq_grade")


@query("q17_severity", "SELECT invoice_id, dq_severity FROM f_score")
def _(x):
    return x.f_rows.select("invoice_id", "dq_severity")


@query("q18_issue_log_invoices", "SELECT invoice_id, dq_issues FROM f_score")
def _(x):
    return x.f_rows.select("invoice_id", "dq_issues")


@query("q19_issue_log_inferred", "SELECT invoice_id, dq_issues FROM u_score")
def _(x):
    return x.u_rows.select("invoice_id", "dq_issues")


def _stats_sql(table, prefix):
    mean = "avg({})".format if prefix == "x_" else mean_tenths
    means = ", ".join(f"{half(mean(prefix + d))} AS avg_{d}" for d in DIMS)
    grades = ", ".join(f"count(*) FILTER (WHERE dq_grade = '{g}') AS grade_{g}" for g in fixed.GRADES)
    levels = ", ".join(
        f"count(*) FILTER (WHERE dq_severity = '{s}') AS sev_{s.lower()}" for s in fixed.SEVERITIES)
    return f"""SELECT {half(mean_tenths('overall'))} AS mean_score, {half('quantile_cont(overall, 0.5)')} AS median_score,
        CAST(trunc(min(overall)) AS INTEGER) AS min_score, count(*) FILTER (WHERE overall >= 99) AS perfect_rows,
        {means}, {grades}, {levels} FROM {table}"""


@query("q20_score_stats", _stats_sql("f_score", "x_"))
def _(x):
    return x.f.scored.stats()


@query("q20_score_stats_inferred", _stats_sql("u_score", "dq_score_"))
def _(x):
    return x.u.scored.stats()


@query("q21_score_invoices", f"SELECT {cols(CLEAN_F)}, {cols(SCORES)} FROM f_score")
def _(x):
    return x.f_rows


@query("q21_score_inferred", f"SELECT {cols(CLEAN_U)}, {cols(SCORES)} FROM u_score")
def _(x):
    assert date_error_penalty(x.roles) == 20
    return x.u_rows


