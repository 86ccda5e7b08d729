"""Run rows kept as JSON, partitioned by dataset shape.

An append writes its rows under an attempt of its own and then one row into the
commits beside the store: (batch, attempt). Rows of an attempt without a commit are
not read, and of several committed attempts of a batch only the first one is, so a
broken append shows nothing and a repeated one changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge import fixed
from tablegauge.functions.scalars import aggregate, lit
from tablegauge.operators.runs import RUN_SCHEMA

BROKEN = "_broken"
ATTEMPT = "_attempt"
COMMIT_SCHEMA = "batch string, attempt string, committed_at timestamp"
STORED = T.StructType([*RUN_SCHEMA.fields, T.StructField(ATTEMPT, T.StringType()), T.StructField(BROKEN, T.StringType())])


def save_runs(runs: DataFrame, path: str, batch: str | None = None) -> None:
    """Append run rows; one folder per dataset signature.

    ``batch`` names the append: a batch that is committed already is not written
    again. Without it the rows themselves name it, so equal rows count once; they are
    computed once and hashed where they were written.
    """
    spark = runs.sparkSession
    if batch is not None and not commits(spark, path).filter(F.col("batch") == batch).isEmpty():
        return
    attempt = uuid.uuid4().hex
    rows = runs.withColumn(ATTEMPT, F.lit(attempt))
    rows.write.mode("append").partitionBy("dataset_signature").json(path)
    if batch is None:
        written = spark.read.schema(STORED).json(path).filter(F.col(ATTEMPT) == attempt)
        batch = batch_of(written.select(*[f.name for f in RUN_SCHEMA.fields]))
    commit(spark, path, batch, attempt)


def batch_of(rows: DataFrame) -> str:
    """A name for a set of rows that does not depend on their order."""
    hashes = rows.selectExpr("xxhash64(to_json(struct(*))) AS h")
    return aggregate(hashes, {
        "batch": "concat_ws('-', count(1), hex(bit_xor(h)), CAST(sum(CAST(h AS DECIMAL(38, 0))) AS STRING))",
    }).first()["batch"]


def commit(spark: SparkSession, path: str, batch: str, attempt: str) -> None:
    """Make the rows of ``attempt`` visible: one file, so all of them or none."""
    row = spark.range(1).select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("committed_at"))
    row.coalesce(1).write.mode("append").json(commits_path(path))


def commits_path(path: str) -> str:
    return path.rstrip("/") + "_commits"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``batch, attempt``: the attempt that counts for each committed batch, the one
    committed first (ties to the smaller attempt). Empty for a store without commits."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(commits_path(path))
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "batch string, attempt string")
    rows = spark.read.schema(COMMIT_SCHEMA).json(commits_path(path))
    return aggregate(rows, {"attempt": "min(struct(committed_at, attempt)).attempt"}, ["batch"])


def compact_runs(spark: SparkSession, path: str, into: str) -> None:
    """Write the usable rows of a store as a new store of few files, in one append.
    Files follow the data: large folders get several. ``into`` is a new folder, or
    one into which the same rows were compacted before, which changes nothing."""
    rows = load_runs(spark, path)
    batch = batch_of(rows)
    if not commits(spark, into).filter(F.col("batch") != batch).isEmpty():
        raise ValueError(f"{into} holds other runs")
    save_runs(rows.hint("rebalance", "dataset_signature"), into, batch)


def check_runs(runs: DataFrame) -> DataFrame:
    """Add ``reason``: why a run row cannot be used, or null."""
    broken = f"{BROKEN} IS NOT NULL" if BROKEN in runs.columns else "FALSE"
    gaps = " ".join(f"WHEN {c} IS NULL THEN {lit('missing ' + c)}" for c in fixed.MANIFEST_REQUIRED)
    return runs.withColumn("reason", F.expr(
        f"CASE WHEN {broken} THEN 'not valid JSON' {gaps} "
        f"WHEN schema_version > {fixed.MANIFEST_VERSION} THEN 'newer schema_version' END"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Every stored row, usable or not, but those of appends that were not committed.
    Rows that others put there, without an attempt, are read as they are."""
    reader = spark.read.schema(STORED).option("mode", "PERMISSIVE")
    rows = reader.option("columnNameOfCorruptRecord", BROKEN).json(path)
    counted = commits(spark, path).select(F.col("attempt").alias(ATTEMPT), F.lit(True).alias("committed"))
    return rows.join(counted, ATTEMPT, "left").filter(f"{ATTEMPT} IS NULL OR committed").select(
        *[f.name for f in RUN_SCHEMA.fields], BROKEN)


def load_runs(spark: SparkSession, path: str, signature: str | None = None) -> DataFrame:
    """Usable rows, of one dataset if ``signature`` is given. Only the folder
    of that dataset is read."""
    rows = read_runs(spark, path)
    if signature is not None:
        rows = rows.filter(F.col("dataset_signature") == signature)
    return check_runs(rows).filter("reason IS NULL").select(*[f.name for f in RUN_SCHEMA.fields])


def rejected_runs(spark: SparkSession, path: str) -> DataFrame:
    """Unusable rows with the reason."""
    return check_runs(read_runs(spark, path)).filter("reason IS NOT NULL")
