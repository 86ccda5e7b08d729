"""Sources, sinks, runs, decisions and drift (S and M rows)."""

from checks.cleaning import CLEAN_F, SCORES, cols
from checks.context import KEY, query
from checks.oracle_parts import DIMS, half, mean_tenths, text
from tablegauge.config import Policy
from tablegauge.functions.scalars import pick
from tablegauge.operators import drift as D
from tablegauge.operators import govern as V
from tablegauge.operators import runs as M
from tablegauge.plans.batch import run_batch
from tablegauge.sources import readers, runstore, writers
from tablegauge.sources.staging import staged

MEASURES = ("overall", *DIMS)
TARGETS = {"overall": 80, "completeness": 80, "validity": 80, "accuracy": 85, "consistency": 80, "uniqueness": 90}

# --- sources and sinks -------------------------------------------------------------

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


@query("s1_table_scan", f"SELECT {cols(ORDER_COLUMNS)} FROM orders")
def _(x):
    return pick(readers.read_parquet(x.spark, f"{x.folder}/orders.parquet"), ORDER_COLUMNS)


NULLED = "CASE WHEN vendor_name NOT IN ('N/A') THEN vendor_name END AS vendor_name"


@query("s3_csv_scan", f"""SELECT invoice_id, invoice_number, {NULLED}, invoice_date, amount, currency FROM inv""")
def _(x):
    path = x.scratch("invoices")
    writers.write_csv(x.invoices.select("invoice_id", "invoice_number", "vendor_name", "invoice_date", "amount",
                                        "currency"), path)
    return readers.read_csv(x.spark, path)


@query("s4_multi_source_scan", """SELECT 'customer' AS source, (SELECT count(*) FROM customer) AS n, NULL AS failed
    UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier), NULL
    UNION ALL SELECT 'missing', CAST(NULL AS BIGINT), 'AnalysisException'""")
def _(x):
    paths = {}
    for name in ("customer", "supplier"):
        paths[name] = x.scratch(name)
        writers.write_csv(x.table(name), paths[name])
    found = readers.read_sources(x.spark, {**paths, "missing": x.scratch("missing")})
    parts = [df.selectExpr(f"{text(n)} AS source", "count(1) AS n", "CAST(NULL AS STRING) AS failed")
             for n, df in found.tables.items()]
    parts += [x.table("region").selectExpr(f"{text(n)} AS source", "CAST(NULL AS BIGINT) AS n", f"{text(r)} AS failed").limit(1)
              for n, r in found.failed.items()]
    return readers.union_all(parts)


@query("s5_csv_sink", "SELECT invoice_id, dq_score, dq_issues FROM f_score WHERE dq_severity = 'CRITICAL' AND dq_issues <> ''")
def _(x):
    path = x.scratch("extract")
    writers.write_csv(x.f_rows.filter("dq_severity = 'CRITICAL'").select("invoice_id", "dq_score", "dq_issues"), path)
    back = readers.read_csv(x.spark, path)
    return back.selectExpr("invoice_id", "CAST(dq_score AS INT) AS dq_score", "dq_issues")


@query("s6_table_sink", "SELECT c_custkey, c_name, TRUE AS present FROM customer")
def _(x):
    name = "tablegauge_customer_copy"
    writers.write_table(x.table("customer").limit(5), name, x.scratch("table"))
    writers.write_table(x.table("customer").select("c_custkey", "c_name"), name, x.scratch("table"))
    there = writers.table_exists(x.spark, name)
    return readers.read_table(x.spark, name).selectExpr("c_custkey", "c_name", f"{there} AS present")


@query("s7_run_log", """SELECT 'orders' AS source_table, CAST((SELECT count(*) FROM inv) AS BIGINT) AS rows_input,
    count(*) AS rows_output, CAST((SELECT count(*) FROM inv) - count(*) AS DOUBLE) AS duplicates,
    CAST(count(*) FILTER (WHERE dq_severity = 'CRITICAL') AS DOUBLE) AS critical FROM f_score""")
def _(x):
    path = x.scratch("log")
    row = writers.log_row(x.f.cleaned.stats(), x.f.scored.stats(), "2024-01-01 00:00:00", "orders", "scored")
    writers.append_log(row, path)
    return x.spark.read.schema(writers.LOG_SCHEMA).parquet(path).selectExpr(
        "source_table", "rows_input", "rows_output", "stats['duplicates_removed'] AS duplicates",
        "stats['sev_critical'] AS critical")


def _stored(x):
    path = x.scratch("runs")
    runstore.save_runs(x.runs, path)
    newer = x.runs.withColumn("schema_version", x.runs["schema_version"] + 1)
    runstore.save_runs(newer, path)
    return path


@query("s8_s9_run_store", f"SELECT created_at, row_count, overall, {cols(DIMS)} FROM runs")
def _(x):
    path = _stored(x)
    signature = x.runs.select("dataset_signature").first()[0]
    loaded = runstore.load_runs(x.spark, path, signature)
    return loaded.selectExpr("created_at", "row_count", "overall_dq_score AS overall",
                             *[f"dimensions.{d} AS {d}" for d in DIMS])


@query("s10_rejected_runs", "SELECT created_at, 'newer schema_version' AS reason FROM runs")
def _(x):
    return runstore.rejected_runs(x.spark, _stored(x)).select("created_at", "reason")


# --- runs -------------------------------------------------------------------------------

@query("m1_build_runs", f"""SELECT 2 AS schema_version, dataset_name, created_at, row_count, overall AS overall_dq_score,
    {cols(DIMS)}, critical_count FROM runs""")
def _(x):
    return x.runs.selectExpr("schema_version", "dataset_name", "created_at", "row_count", "overall_dq_score",
                             *[f"dimensions.{d} AS {d}" for d in DIMS], "critical_count")


@query("m1_grade_counts", """SELECT run_month || '-01T00:00:00' AS created_at, dq_grade AS grade, count(*) AS n
    FROM months GROUP BY ALL""")
def _(x):
    return x.runs.selectExpr("created_at", "explode(grade_counts) AS (grade, n)")


CUSTOMER = "c_custkey:bigint|c_name:string|c_nationkey:int|c_acctbal:double|c_mktsegment:string"


@query("m2_dataset_signature", f"""SELECT substr(sha1('{CUSTOMER}'), 1, 16) AS signature,
    substr(sha1('{CUSTOMER}'), 1, 16) AS business_signature, count(*) AS row_count FROM customer""")
def _(x):
    return M.run_signature(x.table("customer"))


@query("m3_trend", f"""SELECT CAST(CAST(created_at AS TIMESTAMP) AS VARCHAR) AS created_at, dataset_name, overall,
    {cols(DIMS)}, row_count AS "rows", critical_count AS critical FROM runs""")
def _(x):
    return M.trend(x.runs).drop("dataset_signature").withColumn(
        "created_at", M.F.col("created_at").cast("string"))


def _delta_sql(latest):
    deltas = ", ".join(f"{half(f'{m} - lag({m}) OVER w', 2)} AS {m}_delta" for m in MEASURES)
    keep = "QUALIFY row_number() OVER (ORDER BY created_at DESC) = 1" if latest else ""
    return f"""SELECT * FROM (SELECT lag(created_at) OVER w AS from_time, created_at AS to_time, {deltas} FROM runs
        WINDOW w AS (ORDER BY created_at) {keep}) WHERE from_time IS NOT NULL"""


def _deltas(x, latest):
    out = M.run_deltas(M.trend(x.runs), latest_only=latest).drop("dataset_signature")
    shape = "yyyy-MM-dd'T'HH:mm:ss"
    return out.withColumns({c: M.F.date_format(c, shape) for c in ("from_time", "to_time")})


@query("m4_run_deltas", _delta_sql(True))
def _(x):
    return _deltas(x, True)


@query("m4_run_deltas_all", _delta_sql(False))
def _(x):
    return _deltas(x, False)


@query("m5_sla_evaluation", f"""SELECT created_at, metric, target, {half('actual', 2)} AS actual, actual >= target AS passed
    FROM measures JOIN targets USING (metric)""")
def _(x):
    return V.evaluate_slas(x.runs, TARGETS, ["created_at"]).select("created_at", "metric", "target", "actual", "passed")


@query("m6_scorecard", """SELECT created_at, passed, failed, total, CASE WHEN failed = 0 THEN 'PASS'
    WHEN overall_failed OR failed >= 3 THEN 'FAIL' ELSE 'AT RISK' END AS status FROM (
    SELECT created_at, count(*) FILTER (WHERE actual >= target) AS passed, count(*) FILTER (WHERE actual < target) AS failed,
    count(*) AS total, bool_or(metric = 'overall' AND actual < target) AS overall_failed
    FROM measures JOIN targets USING (metric) GROUP BY created_at)""")
def _(x):
    return V.scorecard(x.runs, TARGETS, ["created_at"])


# --- drift --------------------------------------------------------------------------------

def _compared(x):
    return staged(M.build_runs(x.f.scored, "'invoices'", "'2024-01-01T00:00:00'").unionByName(
        M.build_runs(x.u.scored, "'ledger'", "'2024-01-01T00:00:00'")))


@query("m7_schema_drift", """SELECT 'ledger' AS source, 'invoices' AS baseline, TRUE AS available, '' AS added,
    'currency_invalid,status_invalid' AS removed, 'invoice_id:bigint>string' AS type_changed,
    CAST(10 AS BIGINT) AS n_stable, TRUE AS has_drift FROM (SELECT count(*) FROM ledger)""")
def _(x):
    return D.schema_drift(_compared(x), "invoices").selectExpr(
        "source", "baseline", "available", "array_join(added, ',') AS added", "array_join(removed, ',') AS removed",
        "array_join(transform(type_changed, t -> concat(t.`column`, ':', t.`from`, '>', t.`to`)), ',') AS type_changed",
        "n_stable", "has_drift")


@query("m10_drift_summary", """SELECT 'ledger' AS source, 'drift: -2 removed, 1 type-changed' AS summary
    FROM (SELECT count(*) FROM ledger)""")
def _(x):
    return D.drift_summary(D.schema_drift(_compared(x), "invoices"))


@query("m8_drift_report", """SELECT 'part' AS source, TRUE AS available,
      CAST((SELECT count(*) FROM (DESCRIBE part)) AS INTEGER) AS added,
      CAST((SELECT count(*) FROM (DESCRIBE customer)) AS INTEGER) AS removed
    UNION ALL SELECT 'supplier', TRUE, CAST((SELECT count(*) FROM (DESCRIBE supplier)) AS INTEGER),
      CAST((SELECT count(*) FROM (DESCRIBE customer)) AS INTEGER)""")
def _(x):
    report = D.schema_drift(staged(x.source_runs), "customer")
    return report.selectExpr("source", "available", "size(added) AS added", "size(removed) AS removed")


def _described(table):
    return f"(SELECT column_name FROM (DESCRIBE {table}))"


@query("m8_drift_every_run", " UNION ALL ".join(f"""SELECT {name} AS source, '{at}' AS created_at,
    CAST((SELECT count(*) FROM {_described(table)} WHERE column_name NOT IN {_described('customer')}) AS INTEGER) AS added,
    CAST((SELECT count(*) FROM {_described('customer')} WHERE column_name NOT IN {_described(table)}) AS INTEGER) AS removed,
    (SELECT count(*) FROM {_described(table)} WHERE column_name IN {_described('customer')}) AS n_stable"""
    for name, table, at in (("'customer'", "customer", "2024-01-02"), ("'part'", "part", "2024-01-01"), ("'part'", "part", "2024-01-02"),
                            ("CAST(NULL AS VARCHAR)", "customer", "2024-01-03"))))
def _(x):
    """Two runs of a source, a later one of the baseline and an unnamed one; tables as they are."""
    parts = []
    for name, table, at in (("customer", "customer", "2024-01-01"), ("customer", "customer", "2024-01-02"), ("part", "part", "2024-01-01"),
                            ("part", "part", "2024-01-02"), (None, "customer", "2024-01-03")):
        df = x.table(table)
        shape = ", ".join(f"named_struct('name', '{c}', 'dtype', '{t}')" for c, t in df.dtypes)
        parts.append(df.selectExpr("count(1) AS row_count").selectExpr(
            f"{'CAST(NULL AS STRING)' if name is None else text(name)} AS dataset_name", f"'{at}' AS created_at", f"array({shape}) AS columns"))
    drift = D.schema_drift(readers.union_all(parts), "customer")
    return drift.selectExpr("source", "created_at", "size(added) AS added", "size(removed) AS removed", "n_stable")


@query("s3_csv_round_trip", """SELECT o_orderkey + 1234567890123456789 AS long_id, 'a "quoted"' || chr(10) || 'line, ' || o_clerk AS note,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1234567890123456789 END AS some_id FROM (SELECT *, 'clerk' || o_custkey AS o_clerk FROM orders)""")
def _(x):
    """Line breaks and quotes in values, and neighbouring ids of 19 digits, with gaps too."""
    path = x.scratch("notes")
    writers.write_csv(x.table("orders").selectExpr(
        "o_orderkey + 1234567890123456789 AS long_id", """concat('a "quoted"', chr(10), 'line, clerk', o_custkey) AS note""",
        "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1234567890123456789 END AS some_id"), path)
    return readers.read_csv(x.spark, path)


@query("m9_source_comparison", f"""SELECT 'invoices' AS source, count(*) AS "rows", {half(mean_tenths('overall'))} AS overall_dq,
      count(*) FILTER (WHERE dq_severity = 'CRITICAL') AS critical,
      {', '.join(f"{half('avg(x_' + d + ')')} AS {d}" for d in DIMS)} FROM f_score
    UNION ALL SELECT 'ledger', count(*), {half(mean_tenths('overall'))}, count(*) FILTER (WHERE dq_severity = 'CRITICAL'),
      {', '.join(half(mean_tenths('dq_score_' + d)) for d in DIMS)} FROM u_score""")
def _(x):
    return D.compare_sources(_compared(x)).drop("columns", "signature")


# --- decisions ------------------------------------------------------------------------------

GATES = "created_at, gate, kind, target, actual, passed, margin, n"


@query("m12_policy_gates", f"SELECT {GATES} FROM gates")
def _(x):
    return V.gate_rows(V.with_gates(x.runs), ["created_at"]).selectExpr(*GATES.split(", "))


@query("m12_gate_table", """SELECT created_at, CASE kind WHEN 'max' THEN '≤ ' ELSE '≥ ' END ||
    regexp_replace(CAST(target AS VARCHAR), '[.]0$', '') || CASE kind WHEN 'max' THEN '%' ELSE '' END AS target,
    CASE WHEN passed THEN 'Pass' ELSE 'Fail' END AS status FROM gates""")
def _(x):
    return V.gate_table(V.with_gates(x.runs), ["created_at"]).select("created_at", "target", "status")


@query("m13_blocking_gates", "SELECT created_at, gate, blocking FROM blocks")
def _(x):
    return V.gate_rows(V.with_gates(x.runs), ["created_at"]).select("created_at", "gate", "blocking")


@query("m14_verdict", "SELECT created_at, verdict FROM verdicts")
def _(x):
    return V.decide(V.with_gates(x.runs), ["created_at"]).select("created_at", "verdict")


LENIENT = {"max_critical_pct": 10.0, "min_overall": 70, "min_accuracy": 95}


@query("m14_verdict_policy", f"""SELECT created_at, CASE
      WHEN 100e0 * critical_count / row_count > 10 OR {half('overall - 70')} <= -15 OR {half('accuracy - 95')} <= -15
        OR {half('consistency - 80')} <= -15 THEN 'QUARANTINE'
      WHEN overall >= 70 AND completeness >= 80 AND validity >= 80 AND accuracy >= 95 AND consistency >= 80
        AND uniqueness >= 90 THEN 'APPROVE' ELSE 'REMEDIATE' END AS verdict FROM runs""")
def _(x):
    gated = V.with_gates(x.runs, Policy(LENIENT))
    return V.decide(gated, ["created_at"]).select("created_at", "verdict")


@query("m15_confidence", "SELECT created_at, confidence FROM verdicts")
def _(x):
    return V.decide(V.with_gates(x.runs), ["created_at"]).select("created_at", "confidence")


@query("m16_decisions", f"""SELECT created_at, verdict, confidence, gates_total, gates_passed, gates_failed,
    row_count, critical_count, overall AS overall_dq_score,
    coalesce((SELECT string_agg(gate, ',' ORDER BY place) FROM drivers d WHERE d.created_at = v.created_at), '') AS drivers
    FROM verdicts v JOIN runs USING (created_at)""")
def _(x):
    out = V.decide(V.with_gates(x.runs), ["created_at"])
    return out.drop("reasons", "anomaly_count").withColumn("drivers", M.F.expr("array_join(drivers, ',')"))


@query("m16_decision_reasons", """SELECT created_at, string_agg(reason, '; ' ORDER BY place) AS reasons FROM (
    SELECT created_at, place, CASE WHEN kind = 'min'
      THEN label || ' is ' || CAST(CAST(round_even(actual, 0) AS INTEGER) AS VARCHAR) || ', below the target of '
           || CAST(CAST(round_even(target, 0) AS INTEGER) AS VARCHAR) || '.'
      ELSE label || ' is ' || printf('%.2f', actual) || '%, above the ' || printf('%.2f', target) || '% limit ('
           || n || ' rows).' END AS reason
    FROM drivers JOIN labelled USING (gate)
    UNION ALL SELECT created_at, 99, gates_passed || ' of ' || gates_total || ' gates still passed.' FROM verdicts
      WHERE gates_passed > 0 AND verdict <> 'APPROVE'
    UNION ALL SELECT created_at, 0, 'All ' || gates_total || ' quality gates passed.' FROM verdicts WHERE verdict = 'APPROVE'
    UNION ALL SELECT created_at, 1, 'Strongest area: ' || label || ' (' || CAST(CAST(round_even(actual, 0) AS INTEGER) AS VARCHAR)
      || ' vs target ' || CAST(CAST(round_even(target, 0) AS INTEGER) AS VARCHAR) || ').'
      FROM (SELECT * FROM gates JOIN verdicts USING (created_at) WHERE verdict = 'APPROVE' AND kind = 'min'
        QUALIFY row_number() OVER (PARTITION BY created_at ORDER BY margin DESC, place) = 1) JOIN labelled USING (gate)
    ) GROUP BY created_at""")
def _(x):
    return V.decide(V.with_gates(x.runs), ["created_at"]).selectExpr("created_at", "array_join(reasons, '; ') AS reasons")


@query("m18_remediation_log", """SELECT position, n FROM (
    SELECT 0 AS position, CAST((SELECT sum(null_cells) FROM u_fill) AS BIGINT) AS n
    UNION ALL SELECT 1, CAST((SELECT count(*) FROM u_fill) - (SELECT count(*) FROM u_clean) AS BIGINT)
    UNION ALL SELECT 2, CAST(sum(categories_changed) AS BIGINT) FROM u_clean
    UNION ALL SELECT 3, CAST(sum(invoice_date_parse_error + due_date_parse_error + payment_date_parse_error) AS BIGINT) FROM u_clean
    UNION ALL SELECT 4, CAST(sum(amount_negative + tax_amount_negative + total_amount_negative) AS BIGINT) FROM u_clean
    UNION ALL SELECT 5, CAST(sum(amount_outlier + tax_amount_outlier + total_amount_outlier) AS BIGINT) FROM u_clean) WHERE n > 0""")
def _(x):
    return V.remediation_log(x.u.cleaned).select("position", "n")


@query("m18_remediation_totals", """SELECT
    CAST((SELECT sum(null_cells) FROM u_fill) + (SELECT count(*) FROM u_fill) - count(*) + sum(categories_changed) AS BIGINT) AS total_fixed,
    CAST(sum(invoice_date_parse_error + due_date_parse_error + payment_date_parse_error + amount_negative
      + tax_amount_negative + total_amount_negative + amount_outlier + tax_amount_outlier + total_amount_outlier) AS BIGINT)
      AS total_flagged FROM u_clean""")
def _(x):
    return V.remediation_totals(V.remediation_log(x.u.cleaned))


@query("m19_suggested_actions", """SELECT priority, n FROM (
    SELECT 'High' AS priority, count(*) AS n FROM f_score WHERE dq_severity = 'CRITICAL'
    UNION ALL SELECT 'Medium', count(*) FROM f_score WHERE dq_severity = 'HIGH'
    UNION ALL SELECT 'Medium', count(*) FROM f_score WHERE dq_grade IN ('D', 'F')
    UNION ALL SELECT 'Low', CAST(n AS BIGINT) FROM (SELECT unnest([sum(amount_outlier), sum(tax_amount_outlier), sum(total_amount_outlier),
      sum(amount_above_max), sum(tax_amount_above_max), sum(total_amount_above_max), sum(amount_below_min),
      sum(tax_amount_below_min), sum(total_amount_below_min)]) AS n FROM f_score) WHERE n > 0) WHERE n > 0""")
def _(x):
    return V.suggested_actions(x.f_rows).select("priority", "n")


@query("m20_cleaned_export_blocked", "SELECT invoice_id, dq_score FROM f_score WHERE FALSE")
def _(x):
    decision = V.decide(V.with_gates(M.build_runs(x.f.scored, "'invoices'", "'2024-01-01T00:00:00'")))
    return V.cleaned_export(x.f_rows, decision).select("invoice_id", "dq_score")


@query("m20_cleaned_export_by_policy", " UNION ALL ".join(f"""SELECT CAST({limit}e0 AS DOUBLE) AS limit_pct, CASE WHEN
    100e0 * count(*) FILTER (WHERE dq_severity = 'CRITICAL') / count(*) > {limit} THEN 0 ELSE count(*) END AS exported
    FROM f_score""" for limit in (1, 100)))
def _(x):
    """The same run under a policy that blocks it and under one that does not."""
    run = M.build_runs(x.f.scored, "'invoices'", "'2024-01-01T00:00:00'")
    parts = []
    for limit in (1.0, 100.0):
        decision = V.decide(V.with_gates(run, Policy({"max_critical_pct": limit})))
        parts.append(V.cleaned_export(x.f_rows, decision).selectExpr(f"{limit}D AS limit_pct", "count(1) AS exported"))
    return readers.union_all(parts)


@query("m20_cleaned_export_allowed", "SELECT invoice_id, dq_score FROM f_score")
def _(x):
    run = M.build_runs(x.f.scored, "'invoices'", "'2024-01-01T00:00:00'")
    decision = V.decide(V.with_gates(run, Policy({"max_critical_pct": 100.0})))
    return V.cleaned_export(x.f_rows, decision).select("invoice_id", "dq_score")


@query("m21_multi_source_runs", """SELECT 'customer' AS dataset_name, count(*) AS row_count, TRUE AS scored FROM customer
    UNION ALL SELECT 'supplier', count(*), TRUE FROM supplier UNION ALL SELECT 'part', count(*), TRUE FROM part""")
def _(x):
    return x.source_runs.selectExpr("dataset_name", "row_count", "overall_dq_score BETWEEN 0 AND 100 AS scored")


@query("m22_batch_run", f"SELECT {cols(CLEAN_F)}, {cols(SCORES)} FROM f_score")
def _(x):
    return run_batch(x.spark, x.invoices, KEY, x.scratch("batch"), "2024-01-01 00:00:00")
