"""Inference, profile, anomaly and report queries (P, A and G rows)."""

from checks.context import KEY, LINE_KEY, query
from checks.oracle_parts import CATEGORIES, DATES, DIMS, MONEY, half, text
from tablegauge import fixed
from tablegauge.functions.scalars import pick
from tablegauge.operators import anomaly as A
from tablegauge.operators import profile as P
from tablegauge.operators import reports as G
from tablegauge.operators.forest import IsolationForest
from tablegauge.operators.profile import infer_roles
from tablegauge.sources.staging import staged

# --- inference ------------------------------------------------------------------------


def _type_sql(table, columns):
    """Semantic type of each column, straight from the rules."""
    parts = []
    for c, kind in columns:
        if kind == "date":
            parts.append(f"SELECT '{c}' AS \"column\", 'date' AS \"type\"")
        elif kind in ("int", "float"):
            whole = f"count({c}) = count(*) AND count(DISTINCT {c}) > 0.9 * count(*)" if kind == "int" else "FALSE"
            parts.append(f"""SELECT '{c}', CASE WHEN coalesce(bool_and({c} IN (0, 1)), TRUE) THEN 'boolean'
                WHEN {whole} THEN 'id' ELSE 'numeric' END FROM {table}""")
        else:
            parts.append(f"""SELECT '{c}', CASE WHEN count({c}) = 0 THEN 'text'
                WHEN bool_and(lower(trim({c})) IN ('true','false','yes','no','1','0','y','n','t','f')) THEN 'boolean'
                WHEN avg(CASE WHEN {c} IS NOT NULL THEN CASE WHEN try_strptime({c}, '%Y-%m-%d') IS NOT NULL
                    THEN 1e0 ELSE 0e0 END END) > 0.7 THEN 'date'
                WHEN count(DISTINCT {c}) > 0.85 * count(*) AND avg(length({c})) < 40 THEN 'id'
                WHEN count(DISTINCT {c}) <= greatest(30, 0.05 * count(*)) THEN 'categorical'
                WHEN avg(length({c})) > 60 THEN 'text' ELSE 'categorical' END FROM {table}""")
    first = "SELECT \"column\", \"type\" FROM (" + " UNION ALL ".join(parts) + ")"
    return first.replace(f"SELECT '{columns[0][0]}',", f"SELECT '{columns[0][0]}' AS \"column\",", 1).replace(
        "END FROM", "END AS \"type\" FROM", 1) if columns[0][1] != "date" else first


INVOICE_TYPES = [("invoice_id", "int"), ("invoice_number", "text"), ("vendor_name", "text"),
                 *[(c, "text") for c in DATES], *[(c, "float") for c in MONEY],
                 ("currency", "text"), ("status", "text")]
TABLES = {
    "customer": [("c_custkey", "int"), ("c_name", "text"), ("c_nationkey", "int"), ("c_acctbal", "float"),
                 ("c_mktsegment", "text")],
    "lineitem": [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
                 ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"),
                 ("l_tax", "float"), ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "date")],
    "documents": [("doc_id", "int"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "int")],
    "labels": [("doc_id", "int"), ("quality", "int"), ("toxic", "int")],
}


@query("p1_types_invoices", _type_sql("inv", INVOICE_TYPES))
def _(x):
    return P.type_table(x.invoices, x.roles)


def _types_of(name):
    @query(f"p1_types_{name}", _type_sql(name, TABLES[name]))
    def _(x):
        return P.type_table(x.table(name), infer_roles(x.table(name)))


for _name in TABLES:
    _types_of(_name)



def _profile_sql(table, columns):
    parts = []
    for i, (c, kind) in enumerate(columns):
        if kind in ("int", "float"):
            extra = (f"{half(f'min({c})', 2)}, {half(f'max({c})', 2)}, {half(f'avg({c})', 2)}, "
                     f"{half(f'100e0 * count(*) FILTER (WHERE {c} = 0) / count(*)')}, "
                     f"{half(f'100e0 * count(*) FILTER (WHERE {c} < 0) / count(*)')}")
        else:
            extra = "NULL, NULL, NULL, NULL, NULL"
        parts.append(f"""SELECT {i} AS position, '{c}' AS "column",
            {half(f'100e0 * (count(*) - count({c})) / count(*)')} AS null_pct, count(*) - count({c}) AS null_count,
            count(DISTINCT {c}) AS unique_count, {half(f'100e0 * count(DISTINCT {c}) / count(*)')} AS unique_pct,
            {extra} FROM {table}""")
    first = parts[0]
    if columns[0][1] in ("int", "float"):
        head = f"SELECT * FROM ({first}) t(position, \"column\", null_pct, null_count, unique_count, unique_pct, " \
               "\"min\", \"max\", \"mean\", zero_pct, neg_pct)"
        parts[0] = head
    return " UNION ALL ".join(parts)


FIGURES = ["position", "column", "null_pct", "null_count", "unique_count", "unique_pct", "min", "max", "mean",
           "zero_pct", "neg_pct"]


@query("p3_profile_lineitem", _profile_sql("lineitem", TABLES["lineitem"]))
def _(x):
    return pick(P.profile(x.table("lineitem"), x.line_roles), FIGURES)


@query("p3_profile_invoices", _profile_sql("inv", INVOICE_TYPES))
def _(x):
    return pick(P.profile(x.invoices, x.roles), FIGURES)


@query("p3_profile_samples", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (SELECT coalesce(string_agg(v, ' · ' ORDER BY v), '') FROM
        (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM inv WHERE {c} IS NOT NULL ORDER BY v LIMIT 4)) AS sample"""
    for c in ("vendor_name", "invoice_date", "due_date", "payment_date", "currency", "status", "invoice_number")))
def _(x):
    names = ["invoice_number", "vendor_name", *DATES, "currency", "status"]
    return pick(P.profile(pick(x.invoices, names), x.roles), ["column", "sample"])


@query("p3_profile_sketched")
def _(x):
    return P.profile(x.table("lineitem"), x.line_roles, exact=False)


@query("p4_type_counts", "SELECT t AS \"type\", (SELECT count(*) FROM (" + _type_sql("inv", INVOICE_TYPES)
       + ") d WHERE d.\"type\" = t) AS columns FROM (VALUES "
       + ", ".join(f"('{t}')" for t in fixed.SEMANTIC_TYPES) + ") v(t)")
def _(x):
    return P.type_counts(P.type_table(x.invoices, x.roles))


@query("p4_role_rows")
def _(x):
    return P.role_table(x.invoices, x.roles)


@query("p5_missing_ranking",
       f"SELECT \"column\", null_pct, null_count FROM ({_profile_sql('inv', INVOICE_TYPES)}) p WHERE null_pct > 0")
def _(x):
    return P.missing_ranking(P.profile(x.invoices, x.roles))


_cells = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c, _ in INVOICE_TYPES)


@query("p6_table_totals", f"SELECT count(*) AS \"rows\", 11 AS columns, "
                          f"CAST(sum({_cells}) AS BIGINT) AS missing_values FROM inv")
def _(x):
    return P.table_totals(x.invoices)


@query("p6_preview", "SELECT * FROM inv ORDER BY invoice_id LIMIT 20")
def _(x):
    return P.preview(x.invoices, KEY)


@query("p7_profile_by_type", "SELECT \"column\", unique_count FROM ("
       + _profile_sql("inv", INVOICE_TYPES) + ") p WHERE \"column\" IN ('vendor_name', 'currency', 'status')")
def _(x):
    return pick(P.columns_of_type(P.profile(x.invoices, x.roles), "categorical"), ["column", "unique_count"])


# --- anomalies ----------------------------------------------------------------------

def _fence_ctes(table, names):
    quart = ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in names)
    hits = [f"(b_{c} <> a_{c} AND ({c} < a_{c} - 1.5e0 * (b_{c} - a_{c}) OR {c} > b_{c} + 1.5e0 * (b_{c} - a_{c})))"
            for c in names]
    return f"(SELECT {quart} FROM {table})", hits


_quart, _hits = _fence_ctes("u_score", MONEY)
_count = " + ".join(f"CASE WHEN {h} THEN 1 ELSE 0 END" for h in _hits)


@query("a1_iqr_count", f"SELECT invoice_id, {_count} AS iqr_outlier_count FROM u_score, {_quart}")
def _(x):
    return x.fenced.select("invoice_id", "iqr_outlier_count")


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_lquart, _lhits = _fence_ctes("lineitem", LINE_NUMBERS)
_lcount = " + ".join(f"CASE WHEN {h} THEN 1 ELSE 0 END" for h in _lhits)


@query("a1_iqr_lineitem", f"SELECT l_orderkey, l_linenumber, {_lcount} AS iqr_outlier_count FROM lineitem, {_lquart}")
def _(x):
    lines = x.table("lineitem").select(*LINE_KEY, *LINE_NUMBERS)
    return A.count_outside_fences(lines, LINE_NUMBERS).select(*LINE_KEY, "iqr_outlier_count")


@query("a2_isolation_score")
def _(x):
    return x.anomalies.select("invoice_id", "isolation_score")


@query("a2_isolation_lineitem")
def _(x):
    lines = x.table("lineitem").select(*LINE_KEY, *LINE_NUMBERS)
    return IsolationForest().fit(lines, LINE_NUMBERS, LINE_KEY).score(lines)


@query("a3_anomaly_flag")
def _(x):
    return x.anomalies.select("invoice_id", "iqr_outlier_count", "isolation_score", "is_anomaly")


@query("a4_iqr_rows_by_column", "SELECT \"column\", outlier_rows FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {h}) AS outlier_rows FROM flt, q{i}" for i, (c, h) in
    enumerate(zip(MONEY, _hits))).join(["WITH flt AS (SELECT * FROM u_score WHERE dq_severity <> 'CLEAN'), " + ", ".join(
        f"q{i} AS (SELECT quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c} FROM flt)"
        for i, c in enumerate(MONEY)) + " ", ""]) + ")")
def _(x):
    shown = pick(x.u_rows.filter("dq_severity <> 'CLEAN'"), x.roles.numerics)
    return A.fence_hits_by_column(staged(shown), x.roles.numerics)


@query("a5_anomaly_figures")
def _(x):
    return A.anomaly_figures(x.anomalies)


@query("a6_riskiest_rows")
def _(x):
    return A.riskiest(x.anomalies, 50, KEY, ["invoice_id", *MONEY, "isolation_score", "iqr_outlier_count",
                                             "is_anomaly", "dq_score", "dq_severity"])


# --- reports ---------------------------------------------------------------------------

def _by_group(table):
    return f"""SELECT vendor_name AS value, {half('avg(dq_score)')} AS avg_score,
        count(*) FILTER (WHERE dq_severity = 'CRITICAL') AS critical, count(*) AS records
        FROM {table} GROUP BY vendor_name"""


@query("g1_quality_by_group", _by_group("f_score"))
def _(x):
    return G.quality_by_group(x.f_rows, "vendor_name")


@query("g2_quality_by_group_limited", _by_group("f_score") + " ORDER BY avg_score, value LIMIT 5")
def _(x):
    return G.quality_by_group(x.f_rows, "vendor_name", 5)


def _top(name, by, metric, measured, order):
    @query(name, f"""SELECT value, records, avg_metric, avg_score, critical FROM (SELECT vendor_name AS value,
        count({measured}) AS records, {half(f'avg({measured})')} AS avg_metric, avg(dq_score) AS avg_score,
        count(*) FILTER (WHERE dq_severity = 'CRITICAL') AS critical, avg({measured}) AS r
        FROM f_score GROUP BY vendor_name ORDER BY {order}, value LIMIT 7)""")
    def _(x):
        return G.top_groups(x.f_rows, "vendor_name", 7, by, metric)


_top("g3_top_groups_count", "count", None, "dq_score", "records DESC")
_top("g3_top_groups_metric", "metric", "tax_amount", "tax_amount", "r DESC")
_top("g3_top_groups_score", "score", None, "dq_score", "r")

for _fn, _sql in {"count": "count({})", "sum": "sum({})", "min": "min({})", "max": "max({})",
                  "median": "quantile_cont({}, 0.5)", "mean": "avg({})"}.items():
    def _register(fn, sql):
        @query(f"g4_aggregate_{fn}",
               f"SELECT status AS value, {sql.format('tax_amount')} AS result FROM f_score GROUP BY status")
        def _(x):
            return G.group_aggregate(x.f_rows, "status", fn, "tax_amount")
    _register(_fn, _sql)


@query("g4_median_by_part", "SELECT CAST(l_suppkey AS VARCHAR) AS value, quantile_cont(l_quantity, 0.5) AS result "
                            "FROM lineitem GROUP BY 1")
def _(x):
    return G.group_aggregate(x.table("lineitem"), "l_suppkey", "median", "l_quantity")


def _label_sql(column, labels, out):
    values = ", ".join(f"({i}, '{v}')" for i, v in enumerate(labels))
    return f"""SELECT position, {out}, n, {half('100e0 * n / (SELECT count(*) FROM f_score)')} AS pct FROM
        (SELECT position, {out}, (SELECT count(*) FROM f_score WHERE {column} = {out}) AS n
         FROM (VALUES {values}) v(position, {out}))"""


@query("g5_severity_counts", _label_sql("dq_severity", fixed.SEVERITIES, "severity"))
def _(x):
    return G.severity_counts(x.f_rows)


@query("g6_grade_counts", _label_sql("dq_grade", fixed.GRADES, "grade"))
def _(x):
    return G.grade_counts(x.f_rows)


for _bins in (10, 20, 25, 40):
    def _histogram(bins):
        @query(f"g7_histogram_{bins}", f"""SELECT bin, (bin - 1) * {100 / bins}e0 AS bin_start, count(dq_score) AS n FROM
            (SELECT CAST(unnest(range(1, {bins} + 1)) AS INTEGER) AS bin) LEFT JOIN
            (SELECT dq_score, CAST(least({bins}, 1 + floor(dq_score / 100e0 * {bins})) AS INTEGER) AS bin FROM f_score) USING (bin)
            GROUP BY bin""")
        def _(x):
            return G.histogram(x.f_rows, "dq_score", bins)
    _histogram(_bins)

_means = " UNION ALL ".join(
    f"SELECT '{fixed.DIMENSION_TITLES[d]}' AS dimension, {i} AS place, avg(dq_score_{d}) AS mean, "
    f"{fixed.WEIGHT_PERCENT[d]} AS weight_pct FROM f_score" for i, d in enumerate(DIMS))


@query("g8_dimension_means", f"""SELECT dimension, {half('mean')} AS score, weight_pct, CASE WHEN mean >= 80 THEN 'Good'
    WHEN mean >= 60 THEN 'Needs work' ELSE 'Critical' END AS status FROM ({_means})""")
def _(x):
    return G.dimension_means(x.f_rows)


_weakest = f"(SELECT dimension, mean FROM ({_means}) ORDER BY mean, place LIMIT 1)"


@query("g9_headline_figures", f"""SELECT count(*) AS records, {half('avg(dq_score)')} AS avg_score,
    count(*) FILTER (WHERE dq_score >= 99) AS ready, count(*) FILTER (WHERE dq_severity = 'CRITICAL') AS critical,
    any_value(w.dimension) AS weakest_dimension, {half('any_value(w.mean)')} AS weakest_score
    FROM f_score, {_weakest} w""")
def _(x):
    return G.headline_figures(x.f_rows)


@query("g10_failing_checks", """SELECT issue, n, regexp_extract(issue, '\\[(\\w+)\\]', 1) AS dimension,
    regexp_replace(issue, '\\[\\w+\\] ', '') AS label FROM (SELECT issue, count(*) AS n FROM
    (SELECT unnest(string_split(dq_issues, ' | ')) AS issue FROM f_score) WHERE issue <> ''
    GROUP BY issue ORDER BY n DESC, issue LIMIT 10)""")
def _(x):
    return G.failing_checks(x.f_rows)


@query("g11_narrative_figures", f"""SELECT count(*) AS records, count(*) FILTER (WHERE dq_severity = 'CRITICAL') AS critical,
    count(*) FILTER (WHERE dq_severity = 'HIGH') AS high, CAST(0 AS BIGINT) AS anomalies,
    count(*) FILTER (WHERE dq_severity = 'CLEAN') AS clean,
    {half("100e0 * count(*) FILTER (WHERE dq_severity = 'CLEAN') / count(*)", 0)} AS clean_pct,
    CASE WHEN any_value(w.mean) < 80 THEN any_value(w.dimension) END AS weakest_dimension,
    CASE WHEN any_value(w.mean) < 80 THEN {half('any_value(w.mean)', 0)} END AS weakest_score,
    CASE WHEN avg(dq_score) >= 85 THEN 'healthy' WHEN avg(dq_score) >= 65 THEN 'mostly reliable'
         ELSE 'significant issues' END AS health FROM f_score, {_weakest} w""")
def _(x):
    return G.narrative_figures(x.f_rows)


@query("g12_extract_figures", f"""SELECT count(*) AS records, {half('avg(dq_score)')} AS avg_score,
    count(*) FILTER (WHERE dq_grade IN ('A', 'B')) AS grades_ab, count(*) FILTER (WHERE dq_grade IN ('D', 'F')) AS grades_df
    FROM f_score WHERE dq_severity = 'HIGH'""")
def _(x):
    return G.extract_figures(x.f_rows.filter("dq_severity = 'HIGH'"))


@query("g13_result_figures", f"""SELECT count(*) AS records,
    {half('100e0 * count(*) / (SELECT count(*) FROM f_score)')} AS pct_of_total, {half('avg(dq_score)')} AS avg_score,
    count(*) FILTER (WHERE dq_severity = 'CRITICAL') AS critical, CAST(0 AS BIGINT) AS anomalies
    FROM f_score WHERE dq_score < 70""")
def _(x):
    return G.result_figures(x.f_rows.filter("dq_score < 70"), x.f_rows)


@query("g14_top_values", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS place, value, n FROM
        (SELECT {c} AS value, count(*) AS n FROM inv WHERE {c} IS NOT NULL GROUP BY 1) QUALIFY place <= 8"""
    for c in CATEGORIES))
def _(x):
    return P.top_values(x.invoices, x.roles.categories)


@query("g15_quantile_hints", " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", 'p75' AS hint, quantile_cont({c}, 0.75) AS value FROM u_score" for c in MONEY]
    + [f"SELECT '{c}', 'median_year', floor(quantile_cont(year(d_{c}), 0.5)) FROM u_score" for c in DATES]))
def _(x):
    return G.quantile_hints(staged(pick(x.u_rows, [*x.roles.numerics, *x.roles.dates])), x.roles)


@query("g16_hotspots", "SELECT \"column\", label, n FROM (" + " UNION ALL ".join(
    f"SELECT {text(c)} AS \"column\", '{label}' AS label, CAST(sum({c}{suffix}) AS BIGINT) AS n FROM f_score"
    for c in MONEY for suffix, label in fixed.HOTSPOT_SUFFIXES) + ") WHERE n > 0 "
    "ORDER BY n DESC, \"column\" DESC, label DESC LIMIT 5")
def _(x):
    return G.hotspots(x.f_rows).drop("position")


