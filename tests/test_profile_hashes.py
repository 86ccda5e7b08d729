"""The exact profile exchanges hashes and a few samples, never all values."""

import random

from tablegauge.operators import profile as P


def test_same_as_plain_counts(spark):
    rng = random.Random(4)
    texts = ["", " ", "z", "\u00e9", "\U0001f600", "\uffff", "a" * 50_000, None] + [f"v{i}" for i in range(300)]
    rows = [(rng.choice(texts), rng.choice([1.5, -0.0, None, 3e300]), None, rng.randrange(10**6)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "t string, `a.b` double, gone string, n long").repartition(6)
    shown = df.selectExpr("t", "CAST(`a.b` AS STRING) AS `a.b`", "gone", "CAST(n AS STRING) AS n").collect()
    counts = {r["column"]: r["n_values"] for r in P.distinct_counts(df, df.columns).collect()}
    firsts = {r["column"]: r["first_values"] for r in P.first_values(df, df.columns, 4).collect()}
    for c in ("t", "a.b", "n"):
        values = {r[c] for r in shown} - {None}
        assert counts[c] == len(values)
        assert firsts[c] == sorted(values, key=lambda v: v.encode())[:4]
    assert "gone" not in counts and "gone" not in firsts


def test_empty_tables_and_one_column(spark):
    empty = spark.createDataFrame([], "a string, b long")
    assert P.distinct_counts(empty, ["a", "b"]).count() == 0 and P.first_values(empty, ["a", "b"], 4).count() == 0
    one = spark.createDataFrame([("x",), ("x",)], "a string")
    assert P.first_values(one, ["a"], 4).first()["first_values"] == ["x"]
    assert P.distinct_counts(one, ["a"]).first()["n_values"] == 1


def test_only_hashes_are_exchanged(spark):
    df = spark.range(50).selectExpr("concat('v', id) AS a", "id AS b")
    plan = P.distinct_counts(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and all("hashpartitioning(i#" in line for line in exchanged)


def test_borderline_columns_are_counted_in_one_pass(spark, monkeypatch):
    n = 2000
    df = spark.range(n).selectExpr(
        "id AS all_ids", f"id % {int(n * 0.9)} AS at_limit", f"id % {int(n * 0.9) + 1} AS above_limit",
        f"concat('k', id % {int(n * 0.85)}) AS text_at_limit", f"concat('k', id % {int(n * 0.85) + 1}) AS text_above",
        "concat('a long text that no one would take for a key, as it has more than sixty letters ', id % 100) AS few_texts",
        "concat('a long text that no one would take for a key, as it has more than sixty letters ', id % 101) AS more_texts",
        "CAST(NULL AS STRING) AS nothing")
    calls, real = [], P.distinct_counts
    monkeypatch.setattr(P, "distinct_counts", lambda d, names: calls.append(list(names)) or real(d, names))
    assert P.infer_roles(df).types == {
        "all_ids": "id", "at_limit": "numeric", "above_limit": "id", "text_at_limit": "categorical", "text_above": "id",
        "few_texts": "categorical", "more_texts": "text", "nothing": "text"}
    assert calls == [["at_limit", "above_limit", "text_at_limit", "text_above", "few_texts", "more_texts"]]
