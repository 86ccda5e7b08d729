"""Sinks: CSV extracts, table replacement and the audit log."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.functions.scalars import lit

LOG_SCHEMA = (
    "run_timestamp string, source_table string, cleaned_table string, rows_input bigint, "
    "rows_output bigint, stats map<string,double>"
)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV files with headers, one per task; values as they are."""
    df.write.mode(mode).options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_table(df: DataFrame, name: str, location: str | None = None) -> None:
    """Create or replace a table of the catalog, at ``location`` if given."""
    writer = df.write.mode("overwrite")
    (writer.option("path", location) if location else writer).saveAsTable(name)


def write_jdbc(df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None,
               batch: int = 500) -> None:
    df.write.format("jdbc").mode("overwrite").options(
        url=url, dbtable=table, batchsize=str(batch), **(properties or {})).save()


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def log_row(
    cleaning: DataFrame, scoring: DataFrame, timestamp: str, source_table: str, cleaned_table: str
) -> DataFrame:
    """One audit row from the two statistics rows, with a fixed schema."""
    def as_map(df: DataFrame) -> str:
        return "map(" + ", ".join(f"{lit(c)}, CAST(`{c}` AS DOUBLE)" for c in df.columns) + ")"

    scores = scoring.selectExpr(f"{as_map(scoring)} AS m").scalar()
    row = cleaning.selectExpr(
        f"{lit(timestamp)} AS run_timestamp", f"{lit(source_table)} AS source_table",
        f"{lit(cleaned_table)} AS cleaned_table", "rows_input", "rows_output", f"{as_map(cleaning)} AS m")
    return row.withColumn("stats", F.map_concat("m", scores)).drop("m")


def append_log(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)
