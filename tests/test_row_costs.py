"""Expressions that read every value: the same results as the plain form, in little code."""

import pytest

from tablegauge import fixed
from tablegauge.config import CleanConfig, Roles
from tablegauge.functions import dates as D
from tablegauge.functions import scalars as S
from tablegauge.operators.clean import normalise_vendors
from tablegauge.operators.profile import inference_row
from tablegauge.operators.score import general_completeness, invoice_completeness

ENDS = ["", " ", "\n", "T", "T10:00:00", " 10:00:00Z", "5", "x", "é", "١"]
STARTS = ["2024-01-05", "2024-02-30", "2024-1-5", "2024-01-", "20240-1-05", "0000-01-01", "+202-01-05", " 024-01-05",
          "2024-1T-05", "2024-01- 5", "2024/01/06", "1/2/2024", "25/1/2024", "1/25/2024", "13.2.2024", "Jan 5, 2024", "SEPT. 30 2024",
          "february 1st, 2024", "5 Jan 2024", "31-dec-2023", "1st may 2024", "bad-date", "INV-12", "12", "2024"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_form_bits_are_those_of_the_expressions(spark):
    values = [s + e for s in STARTS for e in ENDS] + [e + s for s in STARTS for e in ENDS] + [None]

    def valid(form):
        return f"CAST({D._cut('v', *D.FORMS[form])} IS NOT NULL AS INT)"

    plain = f"""CASE
        WHEN v RLIKE {S.lit(D._YEAR)} THEN {valid('year-first')} * CASE WHEN v RLIKE {S.lit(D._ISO)} THEN 32 ELSE 1 END
        WHEN v RLIKE {S.lit(D._NUMERIC)} THEN 2 * {valid('month-first')} + 4 * {valid('day-first')}
        WHEN v RLIKE {S.lit(D._NAMED_MONTH)} THEN 8 * {valid('named month')}
        WHEN v RLIKE {S.lit(D._NAMED_DAY)} THEN 16 * {valid('named day')} ELSE 0 END"""
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.selectExpr("v", f"{plain} AS a", f"{D.all_form_bits(['v', 'v'])} AS b").collect()
    assert [(r["v"], [r["a"], r["a"]]) for r in rows] == [(r["v"], r["b"]) for r in rows]
    assert {r["a"] for r in rows} >= {0, 1, 2, 4, 6, 8, 16, 32}


@pytest.mark.parametrize("formats", [(), ("yyyy-MM-dd",)])
def test_inference_of_many_texts_is_little_code(spark, formats):
    """The date expressions stand once in the plan, however many columns there are, and
    the sketches read projected hashes."""
    def planned(n):
        return plan(inference_row(spark.range(3).selectExpr(*[f"CAST(id AS STRING) AS c{i}" for i in range(n)]), formats))

    if not formats:
        assert planned(8).count("RLIKE") == planned(1).count("RLIKE") > 0
    sketched = [line for line in planned(2).splitlines() if "hll_sketch_agg" in line]
    assert sketched and not any("xxhash64" in line for line in sketched)


def test_inference_figures(spark):
    words = ["true", " YES\n", "0", "f", None, "truest", "1      ", "no but longer", " n", " t"]
    df = spark.createDataFrame([(w, w if w and len(w) < 3 else None, 1.0) for w in words], "a string, b string, c double")
    row = inference_row(df, ()).first()
    assert (row["filled_a"], row["binary_a"], row["filled_b"], row["binary_b"]) == (9, False, 4, True)
    assert row["binary_c"] and row["rows"] == 10 and round(row["distinct_a"]) == 9
    assert row["length_a"] == sum(len(w) for w in words if w) / 9


def test_vendors_are_collapsed_once(spark):
    words = ["  kpmg   advisory ", "usb-c hub LTD", "Vendor 12", "3rd o'neil", "école x1y 7", "n/a", "A", "ab\tCD", "straße"]
    df = spark.createDataFrame([(w,) for w in words], "vendor_name string")
    out = normalise_vendors(df, "UNKNOWN")
    assert [r["vendor_name"] for r in out.collect()] == [
        "Kpmg Advisory", "Usb-C Hub Ltd", "Vendor 12", "3Rd O'Neil", "École X1Y 7", "UNKNOWN", "A", "Ab Cd", "Straße"]
    assert plan(out).count("regexp_replace") == 1 and out.columns == ["vendor_name", "__changed_vendor_name"]


def test_placeholders_of_numbers(spark):
    """Numbers are not rendered as text, unless a placeholder is a number's text."""
    df = spark.sql("SELECT * FROM VALUES (1D, 1L), (double('NaN'), 0L), (NULL, NULL) AS t(x, n)")
    for words in (fixed.PLACEHOLDERS_GENERAL, fixed.PLACEHOLDERS_INVOICE_SCORE, ("0", "NAN"), ("INFINITY",)):
        for c, kind in S.types_of(df).items():
            plain, quick = S.is_placeholder(c, words), S.is_placeholder(c, words, kind)
            assert df.filter(f"NOT ({plain} <=> {quick})").count() == 0
    bills = spark.sql("SELECT 1D AS amount, 2D AS total_amount, 'x' AS vendor_name")
    costly = {r.condition for r in invoice_completeness(bills) if "btrim" in r.condition}
    assert len(costly) == 1
    roles = Roles({"amount": "numeric", "vendor_name": "categorical"})
    assert "btrim" in general_completeness(bills, roles, CleanConfig(fill_text="0", fill_is_placeholder=True))[0].condition
