"""CSV files cut into byte ranges, against a reader that gives a file to one task."""

import random

import pytest

from tablegauge.sources import csvlines, readers


def value(rng):
    k = rng.random()
    if k < 0.6:
        return rng.choice([str(rng.randrange(1000)), "", '""', '5" pipe', " a b "])
    return '"' + "".join(rng.choice(["a", "b,", '""', "\n", "\r\n", "é", " ", "\n\n"]) for _ in range(rng.randrange(12))) + '"'


def whole(spark, path):
    return sorted(map(tuple, spark.read.options(header=True, escape='"', multiLine=True).csv(path).collect()), key=repr)


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed", range(6))
def test_ranges_give_the_records_of_whole_files(spark, tmp_path, small_ranges, seed):
    rng, end = random.Random(seed), "\r\n" if seed % 2 else "\n"
    for f in range(2):
        rows = ["x,y,z"] + [",".join(value(rng) for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(120)]
        if seed < 3:  # one record over many ranges
            rows.insert(5, '"' + "\n".join(['a line with "" quotes, and'] * 150) + '",b,c')
        rows.insert(9, "")
        (tmp_path / f"f{f}.csv").write_bytes((end.join(rows) + end * (seed % 3)).encode())
    want = whole(spark, str(tmp_path))
    small_ranges(rng.choice([90, 200, 333]))
    assert csvlines.physical_lines(spark, str(tmp_path)).rdd.getNumPartitions() >= 8
    assert sorted(map(tuple, csvlines.read_quoted(spark, str(tmp_path)).collect()), key=repr) == want


@pytest.mark.parametrize("text, rows", [
    ("a,b\n", []), ("a,b", []), ("a,b\n1,2", [("1", "2")]), ("a,b\n\n\n1,\n", [("1", None)]), ('a,b\n"",2\n', [(None, "2")]),
    ('"a\nx",b\n1,"2\n\n3"\n', [("1", "2\n\n3")]),
])
def test_small_files(spark, tmp_path, small_ranges, text, rows):
    (tmp_path / "a.csv").write_bytes(text.encode())
    for size in (3, 10_000):
        small_ranges(size)
        assert sorted(map(tuple, csvlines.read_quoted(spark, str(tmp_path / "a.csv")).collect())) == rows


def test_empty_files_have_no_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    assert csvlines.read_quoted(spark, str(tmp_path / "a.csv")).columns == []
    found = readers.read_sources(spark, {"empty": str(tmp_path / "a.csv"), "gone": str(tmp_path / "b.csv")})
    assert found.tables == {} and found.failed == {"empty": "ValueError", "gone": "AnalysisException"}


@pytest.mark.parametrize("line, outside, inside", [
    ("a,b", False, True), ('"a,b', True, False), ('a",b', False, False), ('"a""b",c', False, False), ('"', True, False), ('""', False, True),
    ('x,"y', True, False), ('"a"b,c', False, False), ("", False, True),
])
def test_states_after_a_line(line, outside, inside):
    assert csvlines.ends_inside(line, False) is outside
    assert csvlines.ends_inside(line, True) is inside
