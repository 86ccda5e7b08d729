import json

import pytest

from tablegauge.config import Policy, Roles
from tablegauge.operators import drift as D
from tablegauge.operators import govern as V
from tablegauge.operators import runs as M
from tablegauge.operators.predicates import Conditions, PlanError, business_columns, combine, match_column
from tablegauge.plans.batch import run_batch
from tablegauge.plans.query_plan import run_plan
from tablegauge.sources import readers, runstore, writers
from tests.test_clean import by_id, invoice, invoices


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, " Paid ", 10.0, "2024-01-05", 95, "A"), (2, "open", None, "bad", 60, "C"), (3, None, -2.0, "2024-02-01", 40, "D"),
            (4, "nan", 30.0, None, 85, "B")]
    return spark.createDataFrame(rows, "id long, state string, amount double, day string, dq_score int, dq_grade string")


ROLES = Roles({"id": "id", "state": "categorical", "amount": "numeric", "day": "date"})


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_conditions_and_nulls(table):
    c = Conditions(table, ROLES)
    assert ids(table.filter(c.equals("state", "PAID"))) == [1]
    assert ids(table.filter(c.differs("state", "paid"))) == [2, 3, 4]
    assert ids(table.filter(c.differs("amount", 10))) == [2, 3, 4]
    assert ids(table.filter(c.compare("amount", "<", 11))) == [1, 3]
    assert ids(table.filter(c.between("amount", 30, -2))) == [1, 3, 4]
    assert ids(table.filter(c.is_missing("state"))) == [3, 4]
    assert ids(table.filter(c.one_of("amount", ["10", 30]))) == [1, 4]
    assert ids(table.filter(c.on_or_after("day", "2024-01-06"))) == [3]
    assert ids(table.filter(c.in_month("day", 2024, 1))) == [1]
    assert ids(table.filter(c.in_year("day", 2024))) == [1, 3]
    assert ids(table.filter(c.contains("state", "zzz", skip_if_empty=True))) == [1, 2, 3, 4]
    assert ids(table.filter(c.contains("state", "a.d"))) == [1]
    assert ids(table.filter(c.contains("state", "a.d", regex=False))) == []
    assert ids(table.filter(c.has_missing())) == [2, 3, 4]


def test_combine_has_no_precedence(table):
    c = Conditions(table, ROLES)
    joined = combine([("", c.equals("id", 1)), ("or", c.equals("id", 2)), ("and", c.compare("dq_score", "<", 70))])
    assert ids(table.filter(joined)) == [2]


def test_match_column():
    assert match_column("tax amount", ["amount", "tax_amount"]) == "amount"
    assert match_column("net", ["amount", "net_total"]) == "net_total"
    assert match_column("", ["a"]) is None


@pytest.mark.parametrize("plan", [
    {}, {"intent": "join"}, {"filters": [{"column": "nope", "op": "=="}]}, {"filters": [{"column": "id", "op": "~"}]},
    {"intent": "aggregate"}, {"filters": [{"column": "amount", "op": ">", "value": "many"}]},
    {"intent": "aggregate", "group_by": "state", "aggregate": "sum", "agg_column": "day"},
])
def test_bad_plans(table, plan):
    with pytest.raises(PlanError):
        run_plan(table, plan, ROLES)


def test_plan(table):
    out = run_plan(table, {"filters": [{"column": "Score", "op": ">=", "value": 60}], "sort_by": "dq_score",
                           "sort_dir": "desc", "limit": 2}, ROLES, ["id"])
    assert [r["id"] for r in out.rows.collect()] == [1, 4] and out.count().first()["n"] == 3
    med = run_plan(table, {"intent": "aggregate", "group_by": "grade", "aggregate": "median", "agg_column": "amount"}, ROLES)
    assert {r["value"]: r["result"] for r in med.rows.collect()} == {"A": 10.0, "B": 30.0, "C": None, "D": -2.0}


def test_business_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "x_negative int, amount_negative int, dq_score int, had_nulls int")
    assert business_columns(df) == ["dq_score"]
    assert business_columns(df, added=["amount_negative"]) == ["x_negative", "dq_score"]
    assert business_columns(df, keep_scores=False) == []


def run(name="d", at="2024-01-01T00:00:00", overall=90.0, rows=1000, critical=0, anomalies=None, sig="s", columns=None, **dims):
    scores = {d: 95.0 for d in M.MEASURES[1:]} | dims
    return (2, name, sig, at, rows, 3, columns, overall, tuple(scores.values()), None, {}, {}, critical, anomalies)


def runs(spark, *rows):
    return spark.createDataFrame(list(rows), M.RUN_SCHEMA)


def test_verdicts(spark):
    df = runs(
        spark, run("fine", anomalies=10), run("weak", uniqueness=50.0), run("critical", critical=11), run("low", overall=65.0),
        run("nearly", overall=65.1), run("odd", anomalies=51), run("empty", rows=0, critical=0), run("none", overall=None))
    got = {r["dataset_name"]: r for r in V.decide(V.with_gates(df)).collect()}
    verdicts = {n: r["verdict"] for n, r in got.items()}
    assert verdicts == {"fine": "APPROVE", "weak": "REMEDIATE", "critical": "QUARANTINE", "low": "QUARANTINE",
                        "nearly": "REMEDIATE", "odd": "REMEDIATE", "empty": "APPROVE", "none": "APPROVE"}
    assert got["fine"]["gates_total"] == 8 and got["weak"]["gates_total"] == 7 and got["none"]["gates_total"] == 6
    assert got["fine"]["reasons"][0] == "All 8 quality gates passed."
    assert got["fine"]["reasons"][1] == "Strongest area: Completeness (missing data) (95 vs target 80)."
    assert got["critical"]["reasons"][0] == "Critical rows % is 1.10%, above the 1.00% limit (11 rows)."
    assert 55 <= got["fine"]["confidence"] <= 99
    open_policy = V.decide(V.with_gates(df, Policy({"max_critical_pct": 5})))
    assert {r["dataset_name"]: r["verdict"] for r in open_policy.collect()}["critical"] == "APPROVE"


def test_scorecard(spark):
    df = runs(spark, run("a"), run("b", accuracy=10.0), run("c", overall=1.0), run("d", accuracy=1.0, validity=1.0, uniqueness=1.0))
    goals = {"overall": 80, "accuracy": 85, "validity": 80, "uniqueness": 90}
    got = {r["dataset_name"]: (r["status"], r["failed"]) for r in V.scorecard(df, goals).collect()}
    assert got == {"a": ("PASS", 0), "b": ("AT RISK", 1), "c": ("FAIL", 1), "d": ("FAIL", 3)}


def test_deltas(spark):
    df = runs(spark, run(at="2024-01-01T00:00:00", overall=80.0), run(at="2024-03-01T00:00:00", overall=85.5, accuracy=None),
              run(at="2024-02-01T00:00:00", overall=70.0), run(sig="other"))
    rows = M.run_deltas(M.trend(df)).collect()
    assert len(rows) == 1 and rows[0]["overall_delta"] == 15.5 and rows[0]["accuracy_delta"] is None
    assert M.run_deltas(M.trend(df), latest_only=False).count() == 2
    assert M.unique_runs(df.unionByName(df)).count() == 4


def test_drift(spark):
    def columns(**kinds):
        return list(kinds.items())

    df = runs(spark, run("base", columns=columns(a="int", b="string")), run("same", columns=columns(b="string", a="int")),
              run("new", columns=columns(a="string", c="int")), run("old"))
    drift = D.schema_drift(df, "base")
    got = {r["source"]: r for r in drift.collect()}
    assert not got["same"]["has_drift"] and got["same"]["n_stable"] == 2
    assert got["new"]["added"] == ["c"] and got["new"]["removed"] == ["b"]
    assert [tuple(x) for x in got["new"]["type_changed"]] == [("a", "int", "string")]
    assert got["old"]["available"] is False
    lines = {r["source"]: r["summary"] for r in D.drift_summary(drift).collect()}
    assert lines["new"] == "drift: +1 added, -1 removed, 1 type-changed"
    assert lines["same"].startswith("no schema drift") and lines["old"].startswith("schema not available")


def test_run_store(spark, tmp_path):
    path = str(tmp_path / "runs")
    runstore.save_runs(runs(spark, run("a", sig="s1"), run("b", sig="s2")), path)
    folder = tmp_path / "runs" / "dataset_signature=s1"
    (folder / "broken.json").write_text("{not json\n")
    (folder / "future.json").write_text(json.dumps({"schema_version": 3, "created_at": "x", "overall_dq_score": 1.0,
                                                    "dimensions": {"validity": 1.0}}) + "\n")
    (folder / "short.json").write_text(json.dumps({"schema_version": 2, "created_at": "x"}) + "\n")
    assert [r["dataset_name"] for r in runstore.load_runs(spark, path, "s2").collect()] == ["b"]
    assert runstore.load_runs(spark, path).count() == 2
    reasons = sorted(r["reason"] for r in runstore.rejected_runs(spark, path).collect())
    assert reasons == ["missing overall_dq_score", "newer schema_version", "not valid JSON"]
    plan = runstore.load_runs(spark, path, "s2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dataset_signature" in plan


def test_run_store_appends_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "runs")
    first = runs(spark, run("a", sig="s1"), run("b", sig="s2"))

    def names(at=path):
        return sorted(r["dataset_name"] for r in runstore.load_runs(spark, at).collect())

    for _ in range(2):  # equal rows are one append
        runstore.save_runs(first, path)
        assert names() == ["a", "b"]
    with monkeypatch.context() as broken:
        broken.setattr(runstore, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            runstore.save_runs(runs(spark, run("c", sig="s1")), path, batch="c1")
    assert names() == ["a", "b"]
    for _ in range(2):
        runstore.save_runs(runs(spark, run("c", sig="s1")), path, batch="c1")
        assert names() == ["a", "b", "c"]
    # Two writers commit the same batch.
    monkeypatch.setattr(runstore, "commits", lambda *_: spark.createDataFrame([], "batch string, attempt string"))
    runstore.save_runs(runs(spark, run("c", sig="s1")), path, batch="c1")
    monkeypatch.undo()
    assert names() == ["a", "b", "c"]
    for _ in range(2):
        runstore.compact_runs(spark, path, str(tmp_path / "small"))
        assert names(str(tmp_path / "small")) == ["a", "b", "c"]
    twice = runs(spark, run("d", sig="s3"), run("d", sig="s3"))  # repeated rows of one append stay
    runstore.save_runs(twice, path)
    assert names() == ["a", "b", "c", "d", "d"]
    with pytest.raises(ValueError):
        runstore.compact_runs(spark, path, str(tmp_path / "small"))


def test_csv_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,x,name,flag\n1,1.5,N/A,True\n2,NULL,  pad ,False\n3,nan,b,True\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"n": "bigint", "x": "double", "name": "string", "flag": "boolean"}
    assert [tuple(r) for r in df.orderBy("n").collect()] == [(1, 1.5, None, True), (2, None, "  pad ", False), (3, None, "b", True)]
    found = readers.read_sources(spark, {"good": str(tmp_path / "a.csv"), "bad": str(tmp_path / "none.csv")})
    assert list(found.tables) == ["good"] and list(found.failed) == ["bad"]


def test_jdbc_options():
    got = readers.jdbc_options("jdbc:x", "t", schema="dbo", partition_column="id", lower=1, upper=9, partitions=4)
    assert got == {"url": "jdbc:x", "dbtable": "dbo.t", "partitionColumn": "id", "lowerBound": "1", "upperBound": "9",
                   "numPartitions": "4"}


def test_table_sink_and_batch(spark, tmp_path):
    df = invoices(spark, [invoice(1), invoice(2, vendor_name=None), invoice(3, vendor_name=None, invoice_number="INV-2")])
    writers.write_table(df, "batch_input")
    writers.write_table(df, "batch_input")
    assert writers.table_exists(spark, "batch_input") and not writers.table_exists(spark, "no_such_table")
    for _ in range(2):
        out = run_batch(spark, readers.read_table(spark, "batch_input"), ["invoice_id"], str(tmp_path), "2024-01-01 00:00:00")
    assert sorted(by_id(out)) == [1, 2]
    log = spark.read.parquet(str(tmp_path / "run_log")).collect()
    assert len(log) == 2 and log[0]["stats"]["duplicates_removed"] == 1.0 and log[0]["rows_output"] == 2
    back = readers.read_csv(spark, str(tmp_path / "invoices_cleaned_csv"))
    assert back.count() == 2 and "dq_issues" in back.columns
