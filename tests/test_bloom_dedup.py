"""Filters of repeated keys: they spare exchanges and change no result."""

import pytest

from tablegauge.config import InvoiceConfig
from tablegauge.functions import bloom
from tablegauge.operators import dedup
from tablegauge.operators.clean import clean_invoices
from tests.test_clean import invoice, invoices


@pytest.fixture
def small_filter(monkeypatch):
    monkeypatch.setattr(bloom, "WORDS", 64)


def test_a_filter_forgets_no_member(spark, small_filter):
    members = spark.range(0, 600, 3).selectExpr("xxhash64(id) AS h")
    hit = spark.range(600).filter(bloom.may_hold(bloom.bloom(members), "xxhash64(id)"))
    found = {r["id"] for r in hit.collect()}
    assert set(range(0, 600, 3)) <= found and len(found) < 350
    none = bloom.bloom(members.limit(0))
    assert spark.range(600).filter(bloom.may_hold(none, "xxhash64(id)")).count() == 0
    full = bloom.bloom(spark.range(20_000).selectExpr("xxhash64(id) AS h"))
    assert spark.range(600).filter(bloom.may_hold(full, "xxhash64(id)")).count() == 600


def test_keep_first_of_rare_duplicates(spark, small_filter):
    rows = [(None if i % 50 == 0 else f"k{i if i % 9 else i % 27}", i, i % 2) for i in range(400)] + [("hot", 900 + i, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, id long, n int").repartition(5)
    plain = dedup.keep_first(df, ["k"], ["id"], ["n"])
    rare = dedup.keep_first(df, ["k"], ["id"], ["n"], rare=True)
    assert rare.columns == plain.columns and dict(rare.dtypes) == dict(plain.dtypes)
    assert sorted(rare.collect(), key=str) == sorted(plain.collect(), key=str)
    assert sum(r[dedup.ROWS_IN] for r in rare.collect()) == len(rows)
    again = df.unionByName(df)
    whole = dedup.distinct_rows(again, rare=True)
    assert whole.count() == len(rows) and {r[dedup.ROWS_IN] for r in whole.collect()} == {2}
    assert dedup.keep_first(df.limit(0), ["k"], ["id"], rare=True).count() == 0


def test_zeros_nans_nulls_and_maps(spark):
    df = spark.createDataFrame([(0.0, 1), (-0.0, 2), (float("nan"), 3), (float("nan"), 4), (None, 5), (None, 6), (1.0, 7)], "k double, id long")
    kept = dedup.keep_first(df, ["k"], ["id"], rare=True)
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 5, 7]
    maps = df.selectExpr("map('a', id % 2) AS k", "id")
    assert sorted(r["id"] for r in dedup.keep_first(maps, ["k"], ["id"], rare=True).collect()) == [1, 2]


def test_cleaning_is_the_same(spark):
    rows = [invoice(i, invoice_number=f"N{i % 70}", vendor_name="a") for i in range(90)]
    usual, rare = (clean_invoices(invoices(spark, rows, 4), ["invoice_id"], InvoiceConfig(rare_duplicates=r)) for r in (False, True))
    assert sorted(usual.rows().collect()) == sorted(rare.rows().collect())
    assert usual.stats().first() == rare.stats().first()


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_marks_by_broadcast_and_by_filter(spark, monkeypatch, small_filter, limit):
    """Below and beyond the broadcast limit; null keys, a hot key, two marks."""
    monkeypatch.setattr(dedup, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(dedup, "HOT_KEYS", 2)
    rows = [(i, "hot" if i < 300 else None if i < 320 else f"a{i}" if i % 3 else f"b{i % 90}", i if i % 40 else 7) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, k string, n long").repartition(6)
    got = dedup.flag_all_repeats(df, {"k": "rk", "n": "rn"}, ["id"])
    assert got.columns == ["id", "k", "n", "rk", "rn"]
    ks, ns = [r[1] for r in rows], [r[2] for r in rows]
    assert {r["id"]: (r["rk"], r["rn"]) for r in got.collect()} == {i: (ks.count(k) > 1, ns.count(n) > 1) for i, k, n in rows}
    assert dedup.flag_all_repeats(df.limit(0), {"k": "rk"}, ["id"]).count() == 0
