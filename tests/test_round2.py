"""Cases that were wrong once: ids, line breaks, drift, medians, repeats, forest."""

import pytest

from tablegauge.functions.quantiles import group_quantiles
from tablegauge.operators import dedup, drift, predicates
from tablegauge.operators.forest import IsolationForest
from tablegauge.plans.query_plan import run_plan
from tablegauge.sources import readers, staging


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_plans_grow_by_the_same_for_every_key(spark, tmp_path):
    spark.range(300).selectExpr("id", "id % 7 AS a", "id % 11 AS b", "id % 200 AS c").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    sizes = [scans(dedup.flag_all_repeats(df, {k: f"r_{k}" for k in keys}, ["id"])) for keys in ("a", "ab", "abc")]
    assert sizes[1] - sizes[0] == sizes[2] - sizes[1] <= 4
    got = dedup.flag_all_repeats(df, {"a": "ra", "c": "rc"}, ["id"]).collect()
    assert all(r["ra"] for r in got) and all(r["rc"] == (r["id"] % 200 < 100) for r in got)


def test_long_ids_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,gap,huge,note\n1234567890123456789,1234567890123456789,99999999999999999999,"a\nb"\n1234567890123456790,,99999999999999999998,"c ""d"""\n')
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "gap": "bigint", "huge": "string", "note": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1234567890123456789, 1234567890123456789, "99999999999999999999", "a\nb"), (1234567890123456790, None, "99999999999999999998", 'c "d"')]


def test_drift_of_every_run(spark):
    schema = "dataset_name string, created_at string, columns array<struct<name: string, dtype: string>>"
    df = spark.createDataFrame([
        ("base", "2024-01-02", [("a", "int"), ("x", "int")]), ("base", "2024-01-01", [("a", "int"), ("c", "int")]),
        ("s", "2024-01-01", [("a", "int"), ("b", "int")]), ("s", "2024-01-02", [("a", "bigint"), ("b", "int")]), (None, "2024-01-01", None)], schema)
    got = {(r["source"], r["created_at"]): r for r in drift.schema_drift(df, "base").collect()}
    assert set(got) == {("base", "2024-01-02"), ("s", "2024-01-01"), ("s", "2024-01-02"), (None, "2024-01-01")}
    assert got[("s", "2024-01-01")]["added"] == ["b"] and got[("s", "2024-01-01")]["n_stable"] == 1
    assert got[("s", "2024-01-02")]["type_changed"][0]["to"] == "bigint" and got[("base", "2024-01-02")]["removed"] == ["c"]
    assert not got[(None, "2024-01-01")]["available"]


def test_quantile_of_a_group_with_one_value(spark):
    rows = [("hot", 0.0)] * 900 + [("hot", float(i)) for i in range(1, 100)] + [("tail", 10.0 ** i) for i in range(-9, 10)]
    got = {r["group"]: r["value"] for r in group_quantiles(spark.createDataFrame(rows, "g string, x double"), "g", "x", (0.5,)).collect()}
    assert got == {"hot": 0.0, "tail": 1.0}


def test_row_at_any_rank(spark):
    df = spark.range(500).selectExpr("id", "id % 10 AS v").repartition(7)
    order = sorted(range(500), key=lambda i: (-(i % 10), i))
    for k in (0, 1, 250, 499):
        assert predicates.row_at(df, "v", False, ["id"], k).first()["id"] == order[k]
    assert predicates.row_at(df, "v", False, ["id"], 500).count() == 0


def test_forest_with_repeating_keys(spark):
    df = spark.range(120_000).selectExpr("id % 3 AS key", "CAST(xxhash64(id) % 1000 AS DOUBLE) AS a")
    scored = IsolationForest(trees=10).fit(df, ["a"], ["key"]).score(df)
    assert scored.filter("isolation_score BETWEEN 0 AND 100").count() == 120_000


def test_plan_skips_what_is_no_filter_and_sorts_groups(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 5.0), ("c", 3.0)], "g string, x double")
    plan = {"intent": "aggregate", "group_by": "g", "aggregate": "sum", "agg_column": "x", "sort_by": "g", "filters": ["nothing", None]}
    assert [r["value"] for r in run_plan(df, plan).rows.collect()] == ["a", "b", "c"]


def test_no_shared_folder_is_an_error(monkeypatch):
    class Bare:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(Bare)


def test_staged_folders_can_be_dropped(spark):
    df = staging.staged(spark.range(3).toDF("id"))
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 3 and staging.drop_staged(spark) >= 1
    import os
    assert not os.path.exists(path)
