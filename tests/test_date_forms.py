"""Date forms are found per column by a vote."""

import pytest

from tablegauge.config import CleanConfig
from tablegauge.functions.dates import ISO_FORMATS, date_patterns
from tablegauge.functions.scalars import to_date, types_of
from tablegauge.operators.clean import clean_table
from tablegauge.operators.profile import infer_roles


def column(spark, values, partitions=1):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, d string").repartition(partitions)


def parsed(df, patterns):
    rows = df.selectExpr("id", f"CAST({to_date('d', types_of(df)['d'], patterns)} AS STRING) AS day").collect()
    return [r["day"] for r in sorted(rows)]


@pytest.mark.parametrize("values, form, days", [
    (["2024-1-5", "2024/01/06", "2024.1.07 3:04", "2024-01-08", "2024-02-30"], "year-first",
     ["2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08", None]),
    (["1/2/2024", "1-25-2024", "13/2/2024", None], "month-first", ["2024-01-02", "2024-01-25", None, None]),
    (["1/2/2024", "25/1/2024", "13.2.2024 10:00", "1/25/2024"], "day-first", ["2024-02-01", "2024-01-25", "2024-02-13", None]),
    (["Jan 5, 2024", "SEPT. 30 2024", "february 1st, 2024", "Foo 1, 2024"], "named month",
     ["2024-01-05", "2024-09-30", "2024-02-01", None]),
    (["5 Jan 2024", "31-dec-2023", "30 Feb 2024"], "named day", ["2024-01-05", "2023-12-31", None]),
    (["2024-01-05T10:00:00Z", "2024-01-06T23:30:00.5+05:30", "2024-01-07T25:00:00Z"], "year-first",
     ["2024-01-05", "2024-01-06", None]),
])
def test_forms(spark, values, form, days):
    df = column(spark, values)
    patterns = date_patterns(df, ["d"])["d"]
    assert patterns == (form,) and parsed(df, patterns) == days


def test_ties_and_doubt(spark):
    assert date_patterns(column(spark, ["1/2/2024", "3/4/2024"]), ["d"])["d"] == ("month-first",)
    assert date_patterns(column(spark, ["1/2/2024", "25/1/2024", "1/25/2024"]), ["d"])["d"] == ("month-first",)
    assert date_patterns(column(spark, ["2024-01-01", "2024-1-1", "1/2/2024"]), ["d"])["d"] == ISO_FORMATS
    assert date_patterns(column(spark, ["5 Jan 2024", "1/13/2024"]), ["d"])["d"] == ("month-first",)
    assert date_patterns(column(spark, ["junk", "", None, "9" * 100_000]), ["d"])["d"] == ISO_FORMATS
    assert date_patterns(column(spark, ["x"]).limit(0), ["d", "absent"]) == {"d": ISO_FORMATS, "absent": ISO_FORMATS}


def test_order_and_layout_play_no_part(spark):
    values = ["25/1/2024"] * 5 + ["1/25/2024"] * 4 + ["1/2/2024"] * 50 + [None] * 3
    found = {date_patterns(column(spark, v, n), ["d"])["d"] for v in (values, values[::-1]) for n in (1, 7)}
    assert found == {("day-first",)}


def test_cleaning_uses_the_form_that_inference_saw(spark):
    df = spark.createDataFrame([(i, f"{i % 28 + 1}/{i % 12 + 1}/2024") for i in range(1, 60)] + [(60, "2024-01-01")],
                               "id long, d string")
    roles = infer_roles(df)
    assert roles.types["d"] == "date" and roles.forms == {"d": ("day-first",)}
    rows = {int(r["id"]): r for r in clean_table(df, roles, ["id"]).rows().collect()}
    assert rows[30]["d"] == "2024-07-03" and rows[60]["d"] == "UNKNOWN" and rows[60]["d_parse_error"] == 1
    strict = clean_table(df, roles, ["id"], CleanConfig(date_formats=("yyyy-MM-dd",))).rows()
    assert {r["d"] for r in strict.collect()} == {"UNKNOWN", "2024-01-01"}
