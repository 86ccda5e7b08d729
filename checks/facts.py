"""What must hold of results that no other engine can repeat: random trees, sketches.

Each query states facts as counts and truth values; the SQL takes row counts and
planted rows from the tables.
"""

from checks.context import KEY, LINE_KEY, query
from checks.profiling import LINE_NUMBERS
from tablegauge.functions.scalars import aggregate, one_row, pick
from tablegauge.operators import anomaly as A
from tablegauge.operators import profile as P
from tablegauge.operators import reports as G
from tablegauge.operators.forest import IsolationForest
from tablegauge.operators.predicates import Conditions
from tablegauge.operators.runs import unique_runs
from tablegauge.sources.readers import union_all


@query("a2_score_facts", """SELECT count(*) AS n, 0e0 AS lowest, 100e0 AS highest,
    count(*) AS in_range FROM u_score""")
def _(x):
    return x.anomalies.selectExpr("count(1) AS n", "min(isolation_score) AS lowest", "max(isolation_score) AS highest",
                                  "count_if(isolation_score BETWEEN 0 AND 100) AS in_range")


#: Of so many orders, the lines of one are moved: enough for every tree to meet some.
PLANTED_EVERY = 200


@query("a2_planted_lines", f"""SELECT l_orderkey, l_linenumber, TRUE AS among_the_riskiest FROM lineitem
    WHERE l_orderkey % {PLANTED_EVERY} = 0""")
def _(x):
    """Lines moved far outside in every number: none of the others is riskier."""
    lines = x.table("lineitem").select(*LINE_KEY, *LINE_NUMBERS)
    moved = [f"CAST({c} AS DOUBLE) + CASE WHEN __moved THEN 1e7D ELSE 0D END AS {c}" for c in LINE_NUMBERS]
    planted = lines.withColumn("__moved", lines["l_orderkey"] % PLANTED_EVERY == 0).selectExpr(*LINE_KEY, *moved, "__moved")
    scored = IsolationForest().fit(planted, LINE_NUMBERS, LINE_KEY).score(planted)
    limit = scored.selectExpr("max(isolation_score) FILTER (WHERE NOT __moved)").scalar()
    return scored.filter("__moved").withColumn("__limit", limit).selectExpr(*LINE_KEY, "isolation_score >= __limit AS among_the_riskiest")


@query("a2_fits_agree", "SELECT count(*) AS n, count(*) AS equal FROM lineitem")
def _(x):
    """Two fits, the second on the rows in another order, give every row the same score."""
    lines = x.table("lineitem").select(*LINE_KEY, *LINE_NUMBERS)
    other = lines.repartition("l_linenumber")
    scored = [IsolationForest().fit(df, LINE_NUMBERS, LINE_KEY).score(df).selectExpr("*", f"{i} AS fit") for i, df in enumerate((lines, other))]
    same = aggregate(union_all(scored), {"n": "count_if(fit = 0)", "same": "min(isolation_score) = max(isolation_score)"}, [*LINE_KEY, *LINE_NUMBERS])
    return same.selectExpr("sum(n) AS n", "sum(CASE WHEN same THEN n END) AS equal")


@query("a3_flag_facts", "SELECT count(*) AS n, count(*) AS agree FROM u_score")
def _(x):
    return x.anomalies.selectExpr("count(1) AS n", "count_if(is_anomaly = (isolation_score >= 70 OR iqr_outlier_count >= 2)) AS agree")


@query("a5_figure_facts", "SELECT TRUE AS flagged, TRUE AS share, TRUE AS risk, TRUE AS most, count(*) AS n FROM u_score")
def _(x):
    whole = x.anomalies.selectExpr("count(1) AS n", "count_if(is_anomaly) AS k", "avg(isolation_score) AS r", "max(iqr_outlier_count) AS m")
    return A.anomaly_figures(x.anomalies).withColumn("w", one_row(whole)).selectExpr(
        "flagged = w.k AS flagged", "abs(flagged_pct - 100.0D * w.k / w.n) <= 0.0500001D AS share",
        "abs(mean_risk - w.r) <= 0.0500001D AS risk", "max_iqr_count = w.m AS most", "w.n AS n")


@query("a6_riskiest_facts", "SELECT least(50, count(*)) AS n, TRUE AS none_above FROM u_score")
def _(x):
    top = A.riskiest(x.anomalies, 50, KEY, ["invoice_id", "isolation_score"])
    ids = top.selectExpr("count(1) AS n", "min(isolation_score) AS lowest")
    above = x.anomalies.join(top.select("invoice_id"), "invoice_id", "left_anti").selectExpr("coalesce(max(isolation_score), 0D) AS rest")
    return ids.withColumn("w", one_row(above)).selectExpr("n", "lowest >= w.rest AS none_above")


@query("r12_anomalous_facts", "SELECT TRUE AS every_flagged, count(*) AS n FROM u_score")
def _(x):
    kept = x.anomalies.filter(Conditions(x.anomalies).anomalous()).selectExpr("count(1) AS kept", "count_if(is_anomaly) AS right")
    whole = x.anomalies.selectExpr("count_if(is_anomaly) AS flagged", "count(1) AS n")
    return kept.withColumn("w", one_row(whole)).selectExpr("kept = w.flagged AND right = w.flagged AS every_flagged", "w.n AS n")


@query("g11_g13_with_anomalies", """SELECT count(*) AS records, TRUE AS narrative, TRUE AS result FROM u_score""")
def _(x):
    """Both reports count the anomalies that the frame holds."""
    flagged = x.anomalies.selectExpr("count(1) AS records", "count_if(is_anomaly) AS k")
    narrative = G.narrative_figures(x.anomalies).selectExpr("anomalies").scalar()
    result = G.result_figures(x.anomalies, x.anomalies).selectExpr("anomalies").scalar()
    return flagged.withColumns({"a": narrative, "b": result}).selectExpr("records", "a = k AS narrative", "b = k AS result")


@query("p3_sketch_facts", """SELECT TRUE AS near, count(*) AS "rows" FROM lineitem""")
def _(x):
    """Sketched distinct counts lie within 3 % of exact ones."""
    table = x.table("lineitem")
    sketched = P.profile(table, x.line_roles, exact=False).selectExpr("`column`", "unique_count AS about")
    exact = P.profile(table, x.line_roles).selectExpr("`column`", "unique_count AS n")
    near = sketched.join(exact, "column").selectExpr("bool_and(abs(about - n) <= 0.03D * n) AS near")
    return near.withColumn("rows", table.selectExpr("count(1)").scalar())


@query("r8_unpadded_bounds", """SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-06-01' AND DATE '1996-12-01'""")
def _(x):
    dated = x.table("orders").selectExpr("o_orderkey", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS day")
    return dated.filter(Conditions(dated).date_between("day", "1996-6-1", "1996-12-01")).select("o_orderkey")


@query("g4_median_with_an_empty_group", """SELECT CAST(o_orderstatus AS VARCHAR) AS value, CASE WHEN o_orderstatus <> 'P' THEN
    quantile_cont(o_totalprice, 0.5) END AS result FROM orders GROUP BY o_orderstatus""")
def _(x):
    orders = x.table("orders").selectExpr("o_orderstatus", "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price")
    return G.group_aggregate(orders, "o_orderstatus", "median", "price")


@query("u2_first_of_equal_runs", "SELECT created_at, row_count FROM runs")
def _(x):
    """Runs of one signature and time that differ: the first by row count stays."""
    later = x.runs.withColumn("row_count", x.runs["row_count"] + 1)
    return unique_runs(union_all([later, x.runs]), ["row_count"]).select("created_at", "row_count")


@query("p1_iso_timestamps", """SELECT TRUE AS dated, count(*) AS n, count(*) AS parsed FROM orders""")
def _(x):
    """Text dates with a time of day, with a blank and with a T, are dates."""
    from tablegauge.config import CleanConfig
    from tablegauge.operators.clean import normalise_dates

    day = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
    stamped = x.table("orders").selectExpr(
        f"concat({day}, CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE 'T' END, '10:20:30') AS stamp", f"{day} AS day")
    dated = P.infer_roles(pick(stamped, ["stamp"])).types["stamp"] == "date"
    clean = normalise_dates(stamped, ["stamp"], CleanConfig().date_formats, "UNKNOWN", ("UNKNOWN",))
    return clean.selectExpr(f"{str(dated).upper()} AS dated", "count(1) AS n", "count_if(stamp = day AND stamp_parse_error = 0) AS parsed")
