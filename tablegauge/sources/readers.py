"""Scans: tables, files, databases and sets of CSV files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge import fixed
from tablegauge.functions.scalars import NUMBER, aggregate, assign, lit, q, words
from tablegauge.sources.csvlines import read_quoted

#: Text that is a whole number; it is one only if a bigint can hold it.
WHOLE = r"^\s*[+-]?\d+\s*$"


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def jdbc_options(
    url: str, table: str, schema: str | None = None, partition_column: str | None = None,
    lower: object = None, upper: object = None, partitions: int = 1,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options of a database scan. With a partition column the scan runs as
    ``partitions`` range queries instead of one."""
    options = {"url": url, "dbtable": f"{schema}.{table}" if schema else table, **(properties or {})}
    if partition_column is not None:
        options |= {
            "partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, **how) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**how)).load()


def null_tokens(df: DataFrame) -> DataFrame:
    """Make the usual null words null in every column of a text table."""
    listed = words(fixed.CSV_NULL_TOKENS)
    return assign(df, {c: f"CASE WHEN {q(c)} NOT IN {listed} THEN {q(c)} END" for c in df.columns})


def read_csv_text(spark: SparkSession, path: str | Sequence[str], line_breaks: bool = True) -> DataFrame:
    """``line_breaks``: values in quotes may hold some. Then lines are scanned twice more,
    by as many tasks as a file has ranges; switch it off where there are none."""
    if line_breaks:
        return read_quoted(spark, path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


def type_columns(df: DataFrame) -> DataFrame:
    """Give text columns the narrowest of bigint, double, boolean, text.

    One aggregate over the whole table decides; a column that is entirely
    missing becomes a number, as a CSV reader would have it. Whole numbers that
    no bigint can hold stay text: a double would merge neighbouring ids.
    """
    if not df.columns:
        return df
    out: dict[str, str] = {}
    for c in df.columns:
        out[f"whole_{c}"] = (
            f"bool_and(CASE WHEN {q(c)} IS NOT NULL THEN {q(c)} RLIKE {lit(WHOLE)} "
            f"AND try_cast(trim({q(c)}) AS BIGINT) IS NOT NULL END)")
        out[f"long_{c}"] = (
            f"bool_or({q(c)} RLIKE {lit(WHOLE)} AND abs(try_cast({q(c)} AS DOUBLE)) >= 9007199254740992D)")
        out[f"number_{c}"] = f"bool_and({q(c)} RLIKE {lit(NUMBER)})"
        out[f"boolean_{c}"] = f"bool_and({q(c)} IN ('True', 'False', 'TRUE', 'FALSE', 'true', 'false'))"
        out[f"gaps_{c}"] = f"count_if({q(c)} IS NULL)"
    row = aggregate(df, out).first().asDict()
    exprs: dict[str, str] = {}
    for c in df.columns:
        if row[f"whole_{c}"] and (row[f"gaps_{c}"] == 0 or row[f"long_{c}"]):
            exprs[c] = f"try_cast(trim({q(c)}) AS BIGINT)"
        elif row[f"long_{c}"]:
            continue
        elif row[f"number_{c}"] or row[f"number_{c}"] is None:
            exprs[c] = f"try_cast({q(c)} AS DOUBLE)"
        elif row[f"boolean_{c}"] and row[f"gaps_{c}"] == 0:
            exprs[c] = f"try_cast({q(c)} AS BOOLEAN)"
    return assign(df, exprs)


def read_csv(spark: SparkSession, path: str | Sequence[str], line_breaks: bool = True) -> DataFrame:
    """A CSV file with a header: null words to null, then typed columns."""
    return type_columns(null_tokens(read_csv_text(spark, path, line_breaks)))


@dataclass(frozen=True)
class Sources:
    """Readable sources by name, and the reason for each unreadable one."""

    tables: dict[str, DataFrame]
    failed: dict[str, str]


def read_sources(spark: SparkSession, paths: Mapping[str, str]) -> Sources:
    """Many CSV files, each its own source; a bad one is reported, not fatal."""
    tables: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for name, path in paths.items():
        try:
            table = read_csv(spark, path)
            if not table.columns:
                raise ValueError("no columns")
            tables[name] = table
        except (PySparkException, ValueError, OSError) as problem:
            failed[name] = type(problem).__name__
    return Sources(tables, failed)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of tables with the same columns, in any order."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def tag_source(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("source", F.lit(name))
