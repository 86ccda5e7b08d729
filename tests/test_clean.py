import numpy as np
import pytest

from tablegauge.config import CleanConfig, InvoiceConfig, Roles
from tablegauge.operators import clean as C
from tablegauge.operators import dedup

INVOICE = ("invoice_id long, invoice_number string, vendor_name string, invoice_date string, due_date string, "
           "payment_date string, amount double, tax_amount double, total_amount double, currency string, status string")


def invoice(i, **changes):
    row = dict(invoice_id=i, invoice_number=f"INV-{i}", vendor_name=f"Vendor {i}", invoice_date="2024-01-10",
               due_date="2024-02-10", payment_date="2024-02-01", amount=100.0, tax_amount=10.0, total_amount=110.0,
               currency="USD", status="PAID")
    return {**row, **changes}


def invoices(spark, rows, partitions=None):
    df = spark.createDataFrame(rows, INVOICE)
    return df.repartition(partitions) if partitions else df


def by_id(df):
    return {r["invoice_id"]: r.asDict() for r in df.collect()}


def test_vendor_names(spark):
    names = ["  kpmg   advisory ", "usb-c hub", "o'brien & co", " \tunknown vendor\n", "N/A", None, "É cole"]
    rows = [invoice(i, vendor_name=n) for i, n in enumerate(names)]
    cleaned = C.clean_invoices(invoices(spark, rows), ["invoice_id"])
    got = by_id(cleaned.rows())
    assert [got[i]["vendor_name"] for i in range(len(names))] == [
        "Kpmg Advisory", "Usb-C Hub", "O'Brien & Co", "UNKNOWN", "UNKNOWN", "UNKNOWN", "É Cole"]
    # The filled null was already UNKNOWN when the names were cleaned.
    assert cleaned.stats().first()["vendor_names_normalized"] == 6


def test_currency_and_status_ignore_case_and_space(spark):
    rows = [invoice(1, currency=" eur ", status=" paid"), invoice(2, currency="XYZ", status="VOID"),
            invoice(3, currency=None, status="")]
    got = by_id(C.clean_invoices(invoices(spark, rows), ["invoice_id"]).rows())
    assert (got[1]["currency"], got[1]["currency_invalid"], got[1]["status"], got[1]["status_invalid"]) == (
        "EUR", 0, "PAID", 0)
    for i in (2, 3):
        assert (got[i]["currency"], got[i]["currency_invalid"], got[i]["status"], got[i]["status_invalid"]) == (
            "UNKNOWN", 1, "UNKNOWN", 1)


def test_dates(spark):
    dates = ["2024-02-29", "2023-02-29", "29/02/2024", "2024-1-5", "", None, "junk", "UNKNOWN"]
    rows = [invoice(i, invoice_date=d) for i, d in enumerate(dates)]
    df = invoices(spark, rows)
    got = by_id(C.clean_invoices(df, ["invoice_id"]).rows())
    assert [got[i]["invoice_date"] for i in range(8)] == ["2024-02-29"] + ["UNKNOWN"] * 7
    assert [got[i]["invoice_date_parse_error"] for i in range(8)] == [0, 1, 1, 1, 0, 0, 1, 0]
    more = InvoiceConfig(date_formats=("yyyy-MM-dd", "dd/MM/yyyy", "MMM d yyyy"))
    got = by_id(C.clean_invoices(df, ["invoice_id"], more).rows())
    assert got[2]["invoice_date"] == "2024-02-29" and got[2]["invoice_date_parse_error"] == 0


def test_numbers_and_nan(spark):
    rows = [invoice(1, amount=float("nan")), invoice(2, amount=None), invoice(3, amount=-1.0),
            invoice(4, amount=20_000_000.0)]
    cleaned = C.clean_invoices(invoices(spark, rows), ["invoice_id"])
    got = by_id(cleaned.rows())
    assert [got[i]["amount"] for i in (1, 2, 3, 4)] == [0.0, 0.0, -1.0, 20_000_000.0]
    assert [got[i]["had_nulls"] for i in (1, 2, 3, 4)] == [1, 1, 0, 0]
    assert [got[i]["amount_negative"] for i in (1, 2, 3, 4)] == [0, 0, 1, 0]
    assert [got[i]["amount_above_max"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    stats = cleaned.stats().first()
    assert stats["nulls_filled"] == 2 and stats["rows_with_nulls"] == 2
    kept = by_id(C.clean_invoices(invoices(spark, rows), ["invoice_id"], InvoiceConfig(fill_number=None)).rows())
    assert kept[2]["amount"] is None


def test_text_numbers_are_guarded(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("1d",), (" 7 ",), ("1e3",), (None,), ("",)], "x string")
    got = [r["x"] for r in C.flag_ranges(df, ["x"], 0, 10).collect()]
    assert got == [1.5, None, None, 7.0, 1000.0, None, None]


def test_outliers_without_spread(spark):
    rows = [invoice(i) for i in range(5)]
    assert sum(r["amount_outlier"] for r in C.clean_invoices(invoices(spark, rows), ["invoice_id"]).rows().collect()) == 0
    one = C.clean_invoices(invoices(spark, rows[:1]), ["invoice_id"])
    assert one.rows().first()["amount_outlier"] == 0
    empty = C.clean_invoices(invoices(spark, rows).filter("invoice_id < 0"), ["invoice_id"])
    assert empty.rows().count() == 0 and empty.stats().first()["rows_output"] == 0


@pytest.mark.parametrize("partitions", [1, 8])
def test_keep_first_does_not_depend_on_layout(spark, partitions):
    rows = [invoice(i, invoice_number=None if i % 3 == 0 else f"N{i % 7}", vendor_name=None if i % 2 else "a")
            for i in range(200)]
    cleaned = C.clean_invoices(invoices(spark, rows, partitions), ["invoice_id"])
    first = {}
    for r in rows:
        first.setdefault((r["vendor_name"], r["invoice_number"]), r["invoice_id"])
    assert sorted(by_id(cleaned.rows())) == sorted(first.values())
    stats = cleaned.stats().first()
    assert stats["rows_input"] == 200 and stats["duplicates_removed"] == 200 - len(first)
    assert stats["rows_with_nulls"] == sum(r["invoice_number"] is None or r["vendor_name"] is None for r in rows)


def test_missing_columns_are_skipped(spark):
    df = spark.createDataFrame([(1, " x "), (2, None), (2, None)], "invoice_id long, vendor_name string")
    cleaned = C.clean_invoices(df, ["invoice_id"], InvoiceConfig(duplicate_keys=("nope",)))
    assert sorted(r["vendor_name"] for r in cleaned.rows().collect()) == ["UNKNOWN", "X"]


def test_unknown_configured_keys_raise(spark):
    df = spark.createDataFrame([(1,)], "a long")
    with pytest.raises(ValueError):
        C.clean_table(df, Roles({"a": "id"}), ["a"], CleanConfig(duplicate_keys=("b",)))


def test_cleaning_again_changes_no_value(spark):
    rows = [invoice(i, vendor_name=n, currency=c, invoice_date=d) for i, (n, c, d) in enumerate(
        [("  a  b", " usd", "2024-01-01"), (None, "zz", "bad"), ("N/A", None, None)])]
    once = C.clean_invoices(invoices(spark, rows), ["invoice_id"]).rows().select(*[f.split()[0] for f in INVOICE.split(", ")])
    again = C.clean_invoices(once, ["invoice_id"]).rows().select(*once.columns)
    assert sorted(once.collect()) == sorted(again.collect())


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, " a ", 5.0), (2, None, None)], "id long, `the. name` string, `a b` double")
    roles = Roles({"id": "id", "the. name": "categorical", "a b": "numeric"})
    got = {r["id"]: r for r in C.clean_table(df, roles, ["id"]).rows().collect()}
    assert got["1"]["the. name"] == "A" and got["2"]["a b"] == 0.0 and got["2"]["a b_negative"] == 0


@pytest.mark.parametrize("hot", [0, 2, 1000])
def test_repeats_under_skew(spark, monkeypatch, hot):
    """A third of all rows share one key; several keys are repeated."""
    monkeypatch.setattr(dedup, "HOT_KEYS", max(hot, 1))
    rng = np.random.default_rng(3)
    keys = ["hot"] * 700 + [None] * 300 + [f"k{v}" for v in rng.integers(0, 800, 1100)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k string").repartition(6)
    got = {r["id"]: r["again"] for r in dedup.flag_repeats(df, "k", "again", ["id"]).collect()}
    assert len(got) == len(keys)
    assert got == {i: keys.count(k) > 1 for i, k in enumerate(keys)}
