"""Row conditions, query plans, order and set queries (R, O and U rows)."""

from checks.context import KEY, query
from checks.oracle_parts import DATES, MONEY
from tablegauge.functions.scalars import pick
from tablegauge.operators import predicates as R
from tablegauge.operators.predicates import Conditions, combine
from tablegauge.operators.runs import signature_count, unique_runs
from tablegauge.plans.query_plan import run_plan
from tablegauge.sources.readers import tag_source, union_all


def rows_where(name, build, sql_condition, table="f", source="f_score"):
    """Ids of the rows a condition keeps."""
    @query(name, f"SELECT invoice_id FROM {source} WHERE {sql_condition}")
    def _(x):
        df = {"f": x.f_rows, "inv": x.invoices}[table] if table != "anomaly" else x.fenced
        return df.filter(build(Conditions(df, x.roles), x)).select("invoice_id")


STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
NAME = STRIPPED.format("vendor_name")
DAY = "CAST(try_strptime(invoice_date, '%Y-%m-%d') AS DATE)"

rows_where("r1_equal_text", lambda c, x: c.equals("vendor_name", "USB-C HUB ltd"), "lower(vendor_name) = 'usb-c hub ltd'")
rows_where("r1_equal_number", lambda c, x: c.equals("dq_score", 100), "dq_score = 100")
rows_where("r1_equal_date", lambda c, x: c.equals("due_date", "1990-01-01"), "due_date = '1990-01-01'")
rows_where("r2_not_equal", lambda c, x: c.differs("vendor_name", "n/a"),
           f"NOT coalesce(lower({NAME}) = 'n/a', FALSE)", "inv", "inv")
rows_where("r3_compare_number", lambda c, x: c.compare("amount", ">", 200000), "coalesce(amount > 200000, FALSE)", "inv", "inv")
rows_where("r3_compare_text", lambda c, x: c.compare("vendor_name", "<=", "Vendor 2"),
           f"coalesce({NAME} <= 'Vendor 2', FALSE)", "inv", "inv")
rows_where("r3_compare_date", lambda c, x: c.compare("invoice_date", ">=", "1997-01-01"),
           f"coalesce({DAY} >= DATE '1997-01-01', FALSE)", "inv", "inv")
rows_where("r4_between_swapped", lambda c, x: c.between("total_amount", 300000, 100000),
           "coalesce(total_amount BETWEEN 100000 AND 300000, FALSE)", "inv", "inv")
rows_where("r5_in_text", lambda c, x: c.one_of("currency", ["eur", "USD"]),
           f"coalesce(lower({STRIPPED.format('currency')}) IN ('eur', 'usd'), FALSE)", "inv", "inv")
rows_where("r5_in_number", lambda c, x: c.one_of("dq_score", [93, 100]), "dq_score IN (93, 100)")
rows_where("r6_contains_regex", lambda c, x: c.contains("vendor_name", "kpmg|hub"),
           "coalesce(regexp_matches(lower(vendor_name), 'kpmg|hub'), FALSE)", "inv", "inv")
rows_where("r6_contains_plain", lambda c, x: c.contains("vendor_name", "OR 4", regex=False),
           "coalesce(contains(lower(vendor_name), 'or 4'), FALSE)", "inv", "inv")
rows_where("r6_contains_skip_if_empty",
           lambda c, x: c.contains("vendor_name", "no such vendor", regex=False, skip_if_empty=True),
           "TRUE", "inv", "inv")
rows_where("r7_is_null", lambda c, x: c.is_missing("vendor_name"),
           f"(vendor_name IS NULL OR {NAME} IN ('', 'nan', 'None'))", "inv", "inv")
rows_where("r7_not_null", lambda c, x: c.is_present("payment_date"), "payment_date IS NOT NULL", "inv", "inv")
rows_where("r8_date_after", lambda c, x: c.on_or_after("invoice_date", "1996-06-01"),
           f"coalesce({DAY} >= DATE '1996-06-01', FALSE)", "inv", "inv")
rows_where("r8_date_before", lambda c, x: c.on_or_before("invoice_date", "1996-06-01"),
           f"coalesce({DAY} <= DATE '1996-06-01', FALSE)", "inv", "inv")
rows_where("r8_date_between", lambda c, x: c.date_between("invoice_date", "1998-01-01", "1996-06-01"),
           f"coalesce({DAY} BETWEEN DATE '1996-06-01' AND DATE '1998-01-01', FALSE)", "inv", "inv")
rows_where("r8_date_month", lambda c, x: c.in_month("invoice_date", 1996, 12),
           f"coalesce(year({DAY}) = 1996 AND month({DAY}) = 12, FALSE)", "inv", "inv")
rows_where("r8_date_year", lambda c, x: c.in_year("invoice_date", 1997), f"coalesce(year({DAY}) = 1997, FALSE)", "inv", "inv")
rows_where("r9_severity", lambda c, x: c.severity_in(["CRITICAL", "HIGH"]), "dq_severity IN ('CRITICAL', 'HIGH')")
rows_where("r10_grade", lambda c, x: c.grade_is("c"), "dq_grade = 'C'")
rows_where("r11_score_below", lambda c, x: c.score("<", 60), "dq_score < 60")
rows_where("r11_score_between", lambda c, x: c.score("between", 60, 80), "dq_score BETWEEN 60 AND 80")
rows_where("r14_has_missing_source", lambda c, x: c.has_missing(source=True), "had_nulls = 1")
rows_where("r14_has_missing", lambda c, x: c.has_missing(),
           "(" + " OR ".join(f"{c} IS NULL" for c in ("invoice_number", "vendor_name", *DATES, *MONEY, "currency", "status"))
           + ")", "inv", "inv")
rows_where("r15_weak_dimension", lambda c, x: c.weak("accuracy"), "dq_score_accuracy < 70")
rows_where("r16_number_threshold", lambda c, x: c.number("tax", ">=", 20000), "coalesce(tax_amount >= 20000, FALSE)", "inv", "inv")
rows_where("r17_and_or_left_to_right",
           lambda c, x: combine([("", c.severity_in(["HIGH"])), ("or", c.grade_is("B")), ("and", c.compare("amount", "<", 100000))]),
           "((dq_severity = 'HIGH' OR dq_grade = 'B') AND amount < 100000)")


@query("r12_anomalous_rows")
def _(x):
    return x.anomalies.filter(Conditions(x.anomalies).anomalous()).select("invoice_id", "isolation_score")


@query("r13_duplicate_rows", "SELECT invoice_id FROM f_score WHERE invoice_number IN (SELECT rep_number FROM f_repeat)")
def _(x):
    from tablegauge.config import Roles
    return R.duplicate_rows(x.f_rows, Roles({"invoice_number": "id"}), KEY).select("invoice_id")


@query("r20_plan_filter", """SELECT invoice_id, dq_score, vendor_name FROM f_score
    WHERE lower(dq_severity) = 'high' AND total_amount BETWEEN 50000 AND 400000
    ORDER BY total_amount DESC, invoice_id LIMIT 40""")
def _(x):
    plan = {"intent": "filter", "logic": "and", "sort_by": "total_amount", "sort_dir": "desc", "limit": 40,
            "filters": [{"column": "severity", "op": "==", "value": "high"},
                        {"column": "TOTAL_AMOUNT", "op": "between", "value": 400000, "value2": 50000}]}
    return pick(run_plan(x.f_rows, plan, x.roles, KEY).rows, ["invoice_id", "dq_score", "vendor_name"])


@query("r20_plan_count", "SELECT count(*) AS n FROM f_score WHERE dq_grade = 'D' OR dq_score < 60")
def _(x):
    plan = {"logic": "or", "filters": [{"column": "grade", "op": "in", "value": ["d"]},
                                       {"column": "score", "op": "<", "value": 60}]}
    return run_plan(x.f_rows, plan, x.roles, KEY).count()


@query("r20_plan_aggregate", """SELECT status AS value, sum(CAST(tax_amount AS BIGINT)) / 1e0 AS result FROM f_score
    WHERE currency <> 'UNKNOWN' GROUP BY status""")
def _(x):
    plan = {"intent": "aggregate", "group_by": "status", "aggregate": "sum", "agg_column": "tax_amount",
            "filters": [{"column": "currency", "op": "!=", "value": "unknown"}]}
    return run_plan(x.f_rows, plan, x.roles, KEY).rows


@query("r21_result_filter", """SELECT invoice_id FROM f_score WHERE dq_severity IN ('MEDIUM', 'HIGH')
    AND dq_grade IN ('B', 'C') AND dq_score BETWEEN 60 AND 85""")
def _(x):
    return R.filter_results(x.f_rows, ["MEDIUM", "HIGH"], ["B", "C"], 60, 85).select("invoice_id")


@query("r22_extract", "SELECT invoice_id, dq_score, dq_issues FROM f_score WHERE dq_severity = 'CRITICAL'")
def _(x):
    return R.extract(x.f_rows, "CRITICAL", columns=["invoice_id", "dq_score", "dq_issues", "not there"])


@query("r23_projection", """SELECT invoice_id, invoice_number, amount, tax_amount, vendor_name, currency,
    dq_score, dq_grade, dq_severity FROM f_score""")
def _(x):
    names = R.display_columns(x.f_rows, x.roles, extra=("dq_score", "dq_grade", "dq_severity", "dq_score"))
    return pick(x.f_rows, names)


@query("r24_point_lookup", "SELECT invoice_id, vendor_name, dq_score FROM f_score WHERE invoice_number = 'UNKNOWN' "
                           "ORDER BY invoice_id LIMIT 1")
def _(x):
    return pick(R.lookup(x.f_rows, "invoice_number", "UNKNOWN", KEY), ["invoice_id", "vendor_name", "dq_score"])


@query("r25_business_view", "SELECT invoice_id, invoice_number, vendor_name, invoice_date, due_date, payment_date, "
                            "amount, tax_amount, total_amount, currency, status, currency_invalid, status_invalid FROM f_score")
def _(x):
    return R.business_view(x.f_rows, keep_scores=False)


# --- order ---------------------------------------------------------------------------

@query("o1_sort_desc", "SELECT invoice_id, dq_score_validity FROM f_score ORDER BY dq_score_validity DESC, invoice_id")
def _(x):
    return R.sort_rows(x.f_rows, "dq_score_validity", False, KEY).select("invoice_id", "dq_score_validity")


@query("o2_top_by_number", "SELECT invoice_id, amount FROM f_score ORDER BY amount DESC, invoice_id LIMIT 25")
def _(x):
    return R.top_rows(x.f_rows, 25, KEY, "amount").select("invoice_id", "amount")


@query("o2_top_worst", "SELECT invoice_id, dq_score FROM f_score ORDER BY dq_score, invoice_id LIMIT 20")
def _(x):
    return R.top_rows(x.f_rows, 20, KEY).select("invoice_id", "dq_score")


@query("o3_best_first", "SELECT invoice_id, dq_score FROM f_score ORDER BY dq_score DESC, invoice_id LIMIT 30")
def _(x):
    return R.sort_by_hint(x.f_rows, "best", KEY).limit(30).select("invoice_id", "dq_score")


@query("o4_head", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10")
def _(x):
    from tablegauge.operators.profile import preview
    return preview(x.table("customer"), ["c_custkey"], 10).select("c_custkey", "c_name")


@query("o5_row_at", "SELECT invoice_id, total_amount FROM f_score ORDER BY total_amount DESC, invoice_id LIMIT 1 OFFSET 7")
def _(x):
    return R.row_at(x.f_rows, "total_amount", False, KEY, 7).select("invoice_id", "total_amount")


# --- sets --------------------------------------------------------------------------------

@query("u1_union_all", "SELECT source, count(*) AS n FROM (SELECT 'a' AS source FROM inv UNION ALL "
                       "SELECT 'b' FROM inv) GROUP BY source")
def _(x):
    both = union_all([tag_source(x.invoices, "a"), tag_source(x.invoices, "b")])
    return both.groupBy("source").count().withColumnRenamed("count", "n")


@query("u2_unique_runs", "SELECT created_at, row_count FROM runs")
def _(x):
    return unique_runs(x.runs.unionByName(x.runs)).select("created_at", "row_count")


@query("u3_distinct_signatures", "SELECT CAST(4 AS BIGINT) AS signatures, TRUE AS mixed FROM (SELECT count(*) FROM runs)")
def _(x):
    return signature_count(x.runs.unionByName(x.source_runs))
