import numpy as np
import pytest

from tablegauge.config import Roles
from tablegauge.functions.quantiles import group_quantiles, quantiles
from tablegauge.operators import anomaly as A
from tablegauge.operators import profile as P
from tablegauge.operators.forest import IsolationForest, grow, mean_path


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [1.0, 2.0, 3.0, 10.0], [7.0] * 50, [0.0] * 90 + [1.0] * 10,
    list(np.random.default_rng(0).normal(size=3000)), list(np.random.default_rng(1).lognormal(0, 4, 5000)),
    list(np.random.default_rng(2).integers(0, 5, 4001).astype(float)),
])
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(5)
    shares = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = {r["share"]: r["value"] for r in quantiles(df, ["x"], shares).collect()}
    for p in shares:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_group_quantiles_with_a_hot_and_a_null_group(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in rng.normal(size=900)] + [(None, 1.0), (None, 4.0), ("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["group"]: r["value"] for r in group_quantiles(df, "g", "x", (0.5,)).collect()}
    assert got[None] == 2.5 and got["one"] == 3.0 and "none" not in got
    assert got["hot"] == pytest.approx(np.median([v for g, v in rows if g == "hot"]))


def test_inference(spark):
    n = 400
    rows = [(i, i % 2, i % 7, float(i) / 3, None, "yes" if i % 2 else "No ", f"2024-01-{i % 28 + 1:02d}" if i % 5 else "x",
             f"code{i}", f"c{i % 6}", "word " * 20 + str(i), None) for i in range(n)]
    df = spark.createDataFrame(rows, "i long, bit int, few int, x double, gone double, yn string, day string, "
                                     "code string, cat string, note string, nothing string")
    assert P.infer_roles(df).types == {
        "i": "id", "bit": "boolean", "few": "numeric", "x": "numeric", "gone": "boolean", "yn": "boolean",
        "day": "date", "code": "id", "cat": "categorical", "note": "text", "nothing": "text"}


def test_integer_id_needs_every_value(spark):
    df = spark.createDataFrame([(i if i else None,) for i in range(100)], "i long")
    assert P.infer_roles(df).types == {"i": "numeric"}


def test_near_limits_are_counted_exactly(spark):
    rows = [(i if i < 9_001 else 0,) for i in range(10_000)]
    assert P.infer_roles(spark.createDataFrame(rows, "i long")).types["i"] == "id"
    rows = [(i if i < 9_000 else 0,) for i in range(10_000)]
    assert P.infer_roles(spark.createDataFrame(rows, "i long")).types["i"] == "numeric"


def test_profile_percentages_are_over_all_rows(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (None,), (3.0,)], "x double")
    row = P.profile(df, Roles({"x": "numeric"})).first()
    assert (row["null_pct"], row["zero_pct"], row["neg_pct"], row["mean"]) == (25.0, 25.0, 25.0, 0.67)


def test_fences(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v, 1.0, None) for v in values], "x double, flat double, few double")
    got = A.count_outside_fences(df, ["x", "flat", "few"]).collect()
    assert [r["iqr_outlier_count"] for r in sorted(got)] == [0, 0, 0, 0, 1]
    assert [tuple(r) for r in A.fence_hits_by_column(df, ["x", "flat", "few"]).collect()] == [("x", 1)]


def points(spark, n=600, partitions=3):
    rng = np.random.default_rng(9)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    rows[17], rows[200] = (17, 25.0, -30.0), (200, -40.0, 40.0)
    return spark.createDataFrame(rows, "id long, a double, b double").repartition(partitions)


def test_forest_finds_planted_outliers(spark):
    df = points(spark)
    got = {r["id"]: r["isolation_score"] for r in IsolationForest().fit(df, ["a", "b"], ["id"]).score(df).collect()}
    assert set(sorted(got, key=got.get)[-2:]) == {17, 200}
    assert min(got.values()) == 0.0 and max(got.values()) == 100.0
    other = points(spark, partitions=7)
    again = {r["id"]: r["isolation_score"] for r in IsolationForest().fit(other, ["a", "b"], ["id"]).score(other).collect()}
    assert got == again


def test_forest_samples_a_large_table(spark):
    df = spark.range(150_000).selectExpr("id", "CAST(xxhash64(id) % 1000 AS DOUBLE) AS a")
    sample = IsolationForest().sampled(df, ["a"], ["id"], 150_000, None)
    sizes = [r["count"] for r in sample.groupBy("tree").count().collect()]
    assert len(sizes) == 100 and set(sizes) == {256}


def test_forest_degenerate_tables(spark):
    few = points(spark, 400).filter("id < 9")
    assert {r["isolation_score"] for r in IsolationForest().fit(few, ["a"], ["id"]).score(few).collect()} == {0.0}
    flat = spark.createDataFrame([(i, 1.0) for i in range(50)], "id long, a double")
    assert {r["isolation_score"] for r in IsolationForest().fit(flat, ["a"], ["id"]).score(flat).collect()} == {0.0}
    assert IsolationForest().fit(few, [], ["id"]).score(few).first()["isolation_score"] == 0.0
    gaps = spark.createDataFrame([(i, None if i % 3 else float(i)) for i in range(60)], "id long, a double")
    assert IsolationForest().fit(gaps, ["a"], ["id"]).score(gaps).filter("isolation_score IS NULL").count() == 0


def test_tree_layout():
    assert mean_path(2) == 1.0 and mean_path(1) == 0.0
    assert mean_path(256) == pytest.approx(2 * (np.log(255) + np.euler_gamma) - 2 * 255 / 256)
    tree = grow(np.array([[0.0], [10.0]]), 3, np.random.default_rng(0))
    assert len(tree) == 15 and 0 <= tree["cut"][0] < 10
    # Both values are alone after one cut; each waits at the bottom of its side.
    assert tree["length"][7] == 1.0 and tree["length"][11] == 1.0


def test_anomaly_flag(spark):
    df = spark.createDataFrame([(70.0, 0), (69.9, 1), (0.0, 2)], "isolation_score double, iqr_outlier_count int")
    assert [r["is_anomaly"] for r in A.flag_anomalies(df).collect()] == [True, False, True]
