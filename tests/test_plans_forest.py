"""Plans that cannot run, column names, and the forest against a walk by hand."""

import numpy as np
import pytest

from tablegauge.operators.forest import IsolationForest, mean_path
from tablegauge.operators.predicates import PlanError, match_column
from tablegauge.plans.query_plan import check_plan, spellings


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(1, "a", 5.0, 80, "LOW")], "id long, Kind string, amount double, dq_score int, dq_severity string")


@pytest.mark.parametrize("plan, said", [
    ("sort", ["mapping"]),
    ({}, ["neither filters nor sorts nor limits"]),
    ({"filters": ["not a mapping"]}, ["neither filters"]),
    ({"filters": [{"column": "nope", "op": "=="}]}, ["no column is called 'nope'"]),
    ({"filters": [{"op": "=="}]}, ["no column is called None"]),
    ({"filters": [{"column": "id", "op": "~"}]}, ["no operator is called '~'"]),
    ({"intent": "draw", "limit": 3}, ["intent 'draw'"]),
    ({"intent": None, "limit": 3}, ["intent None"]),
    ({"intent": "aggregate"}, ["has to group"]),
    ({"intent": "aggregate", "group_by": "nope"}, ["has to group"]),
    ({"limit": 0}, ["neither"]), ({"limit": "5"}, ["neither"]), ({"sort_by": "nope"}, ["neither"]),
    # All that is wrong is said at once.
    ({"intent": "aggregate", "filters": [{"column": "nope", "op": "~"}]}, ["'nope'", "'~'", "has to group"]),
])
def test_plans_that_cannot_run(table, plan, said):
    with pytest.raises(PlanError) as problem:
        check_plan(table, plan)
    assert all(s in str(problem.value) for s in said)


def test_plans_are_bound_to_columns(table):
    bound = check_plan(table, {"filters": [{"column": " KIND ", "op": "==", "value": "a"}, 7], "logic": "xor", "sort_by": "severity", "sort_dir": "up", "limit": 2.9, "aggregate": "magic"})
    assert bound["filters"] == [("Kind", "==", "a", None)]
    assert (bound["logic"], bound["sort_by"], bound["sort_dir"], bound["limit"], bound["aggregate"]) == ("and", "dq_severity", "asc", 2, None)
    assert check_plan(table, {"limit": 1, "sort_dir": "desc", "logic": "or"})["sort_dir"] == "desc"


def test_spellings():
    find = spellings(["Amount", "amount", "dq_severity", "Severity"])
    assert find("Amount") == "Amount" and find("amount") == "amount"
    assert find("Severity") == "Severity"  # as spelled, before an alias
    assert find(" severity ") == "dq_severity"  # an alias, before another case
    assert find(None) is None and find("x") is None and find(5) is None


@pytest.mark.parametrize("hint, columns, fits", [
    ("net", ["amount", "net_total"], "net_total"),
    ("tax amount", ["rate", "tax_amount"], "tax_amount"),
    ("Total Tax_Amount ", ["rate", "tax_amount"], "tax_amount"),
    ("amount", ["net_amount", "amount"], "net_amount"),  # the first that fits
    ("_", ["a"], None), ("  ", ["a"], None), ("zzz", ["a", "b"], None), ("a", [], None),
])
def test_match_column(hint, columns, fits):
    assert match_column(hint, columns) == fits


def test_scores_equal_a_walk_through_the_nodes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(400)]
    rows[7] = (7, 50.0, -50.0, 50.0)
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    model = IsolationForest(trees=20, sample_size=64).fit(df, ["a", "b", "c"], ["id"])
    trees = model.trees

    def walked(values):
        lengths = []
        for feature, cut, length in zip(trees.feature, trees.cut, trees.length):
            node = 0
            while 2 * node + 2 < len(cut):
                node = 2 * node + (2 if values[feature[node]] > cut[node] else 1)
            lengths.append(length[node])
        return 2 ** (-np.mean(lengths) / mean_path(model.sample_size))

    raw = {r.id: r["__isolation_raw"] for r in model.raw(df).collect()}
    assert all(abs(raw[i] - walked(v)) < 1e-12 for i, *v in rows)
    assert max(raw, key=raw.get) == 7
