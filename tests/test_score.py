import pytest

from tablegauge.config import CleanConfig, Roles
from tablegauge.operators import rules as R
from tablegauge.operators.clean import clean_invoices
from tablegauge.operators.rules import Rule
from tablegauge.operators.score import date_pairs, score_invoices
from tablegauge.plans.batch import assess_invoices, assess_table
from tests.test_clean import by_id, invoice, invoices

KEY = ["invoice_id"]


def scored(spark, rows, **how):
    return by_id(assess_invoices(invoices(spark, rows, **how), KEY).rows())


def test_perfect_row(spark):
    row = scored(spark, [invoice(1)])[1]
    assert row["dq_score"] == 100 and row["dq_grade"] == "A" and row["dq_severity"] == "CLEAN" and row["dq_issues"] == ""


def test_each_rule(spark):
    got = scored(spark, [
        invoice(1, amount=-5.0, total_amount=5.0),
        invoice(2, payment_date=None),
        invoice(3, total_amount=110.02),
        invoice(4, total_amount=110.03),
        invoice(5, due_date="2023-12-31"),
        invoice(6, invoice_number="SAME"), invoice(7, invoice_number="SAME"),
        invoice(8, currency="zzz", status="nope"),
        invoice(9, vendor_name=" none "),
        invoice(10, invoice_date="soon"),
    ])
    assert got[1]["dq_score_accuracy"] == 30.0
    assert got[2]["dq_score_consistency"] == 40.0
    assert got[3]["dq_score_consistency"] == 100.0 and got[4]["dq_score_consistency"] == 40.0
    assert got[5]["dq_score_consistency"] == 60.0
    assert got[6]["dq_score_uniqueness"] == got[7]["dq_score_uniqueness"] == 0.0
    assert got[8]["dq_score_validity"] == 0.0 and got[8]["dq_score_completeness"] == 66.7
    assert got[9]["dq_score_completeness"] == 83.3
    assert got[10]["dq_score_validity"] == 70.0
    assert got[8]["dq_issues"].split(" | ")[0].startswith("[Completeness]")


@pytest.mark.parametrize("overall, letter", [(90.0, "A"), (89.9, "B"), (75.0, "B"), (74.9, "C"), (60.0, "C"),
                                             (40.0, "D"), (39.9, "F"), (0.0, "F")])
def test_grade_uses_the_untruncated_score(spark, overall, letter):
    assert spark.sql(f"SELECT {R.grade('x')} AS g FROM (SELECT {overall}D AS x)").first()["g"] == letter


@pytest.mark.parametrize("acc, cons, val, comp, score, want", [
    (29, 100, 100, 100, 90, "CRITICAL"), (100, 39, 100, 100, 90, "CRITICAL"), (59, 100, 100, 100, 90, "HIGH"),
    (100, 100, 39, 100, 90, "HIGH"), (100, 100, 100, 100, 49, "HIGH"), (100, 100, 100, 100, 69, "MEDIUM"),
    (100, 100, 100, 59, 90, "MEDIUM"), (100, 100, 100, 100, 84, "LOW"), (60, 60, 60, 60, 85, "CLEAN")])
def test_severity(spark, acc, cons, val, comp, score, want):
    row = f"SELECT {acc} AS d_accuracy, {cons} AS d_consistency, {val} AS d_validity, {comp} AS d_completeness, {score} AS s"
    assert spark.sql(f"SELECT {R.severity('d_', 's')} AS v FROM ({row})").first()["v"] == want


def test_half_even_rounding(spark):
    from tablegauge.functions.scalars import half_even
    got = spark.sql(f"SELECT {half_even('93.25D')} AS a, {half_even('93.75D')} AS b").first()
    assert (got["a"], got["b"]) == (93.2, 93.8)


def mixed_rows(n=120):
    return [invoice(
        i, vendor_name=None if i % 11 == 0 else f" v {i % 5}", amount=-3.0 if i % 7 == 0 else 100.0,
        currency="zz" if i % 4 == 0 else "usd", payment_date=None if i % 3 == 0 else "2024-03-01",
        invoice_number=None if i % 9 == 0 else f"N{i % 50}", due_date="1999-01-01" if i % 13 == 0 else "2024-02-10")
        for i in range(n)]


def test_ranges_and_layout(spark):
    one = scored(spark, mixed_rows(), partitions=1)
    many = scored(spark, mixed_rows(), partitions=8)
    assert one == many
    for row in one.values():
        for name, value in row.items():
            if name.startswith("dq_score"):
                assert 0 <= value <= 100


def test_a_defect_never_raises_a_score(spark):
    base = scored(spark, [invoice(1), invoice(2)])[1]["dq_score"]
    for change in ({"vendor_name": None}, {"currency": "zz"}, {"amount": -1.0}, {"payment_date": None},
                   {"due_date": "1990-01-01"}, {"invoice_number": "INV-2"}, {"invoice_date": "?"}):
        assert scored(spark, [invoice(1, **change), invoice(2)])[1]["dq_score"] <= base


def test_own_rule(spark):
    cleaned = clean_invoices(invoices(spark, [invoice(1), invoice(2, amount=50.0, total_amount=60.0)]), KEY)
    extra = [Rule("accuracy", "amount < 80", 25, "[Accuracy] small amount")]
    got = by_id(score_invoices(cleaned.frame, KEY, extra=extra).rows())
    assert got[2]["dq_score_accuracy"] == 75.0 and got[2]["dq_issues"] == "[Accuracy] small amount"
    assert got[1]["dq_score_accuracy"] == 100.0


def test_stats_of_empty_table(spark):
    done = assess_invoices(invoices(spark, [invoice(1)]).filter("invoice_id < 0"), KEY)
    row = done.scored.stats().first()
    assert row["mean_score"] is None and row["perfect_rows"] == 0


def test_date_pairs():
    assert date_pairs(["invoice_date", "due_date", "payment_date"]) == [("invoice_date", "due_date")]
    assert date_pairs(["order_date", "customer_date"]) == [("order_date", "customer_date")]
    assert date_pairs(["order_date", "customer_date"], whole_words=True) == []
    assert len(date_pairs(["start_a", "start_b", "end_a", "end_b"])) == 3


def test_placeholder_heavy_category_costs_every_row(spark):
    rows = [(i, "N/A" if i < 6 else "x", "y") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    roles = Roles({"id": "id", "a": "categorical", "b": "categorical"})
    got = assess_table(df, ["id"], roles=roles).rows().collect()
    assert {r["dq_score_validity"] for r in got} == {80.0}


def test_custom_fill_word_as_placeholder(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, a string")
    roles = Roles({"id": "id", "a": "categorical"})
    plain = CleanConfig(fill_text="GONE")
    strict = CleanConfig(fill_text="GONE", fill_is_placeholder=True)
    scores = [{r["id"]: r["dq_score_completeness"] for r in assess_table(df, ["id"], c, roles).rows().collect()}
              for c in (plain, strict)]
    assert scores[0]["1"] == 100.0 and scores[1]["1"] == 50.0


def test_general_uniqueness_bottoms_at_fifty_per_id(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, code string")
    roles = Roles({"id": "id", "code": "id"})
    got = {r["id"]: r["dq_score_uniqueness"] for r in assess_table(df, ["id"], roles=roles).rows().collect()}
    assert got == {"1": 75.0, "2": 75.0, "3": 100.0} or got == {"1": 50.0, "2": 50.0, "3": 100.0}
    assert got["1"] == 100.0 - 50.0 / 2
