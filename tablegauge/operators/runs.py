"""The runs table: one row per scored run of a dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge import fixed
from tablegauge.functions.scalars import aggregate, half_even, lit, q, types_of
from tablegauge.operators.dedup import ROWS_IN, keep_first
from tablegauge.operators.predicates import source_columns
from tablegauge.operators.score import OVERALL, Scored, dimension_mean, mean_tenths

RUN_KEY = ("dataset_signature", "dataset_name", "created_at")
MEASURES = ("overall", *fixed.DIMENSIONS)

_scores = T.StructType([T.StructField(d, T.DoubleType()) for d in fixed.DIMENSIONS])
_weights = T.StructType([T.StructField(d, T.IntegerType()) for d in fixed.DIMENSIONS])
_counts = T.MapType(T.StringType(), T.LongType())
_column = T.StructType([T.StructField("name", T.StringType()), T.StructField("dtype", T.StringType())])
RUN_SCHEMA = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("dataset_signature", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("column_count", T.IntegerType()),
    T.StructField("columns", T.ArrayType(_column)),
    T.StructField("overall_dq_score", T.DoubleType()),
    T.StructField("dimensions", _scores),
    T.StructField("dimension_weights", _weights),
    T.StructField("grade_counts", _counts),
    T.StructField("severity_counts", _counts),
    T.StructField("critical_count", T.LongType()),
    T.StructField("anomaly_count", T.LongType()),
])


def schema_signature(columns: Sequence[tuple[str, str]]) -> str:
    """SQL for the id of a table's shape: equal names and types, equal id."""
    shape = "|".join(f"{name}:{kind}" for name, kind in columns)
    return f"substr(sha1({lit(shape)}), 1, 16)"


def _seen_counts(column: str, labels: Sequence[str]) -> str:
    pairs = ", ".join(f"struct({lit(x)}, count_if({column} = {lit(x)}))" for x in labels)
    return f"map_filter(map_from_entries(array({pairs})), (k, v) -> v > 0)"


def build_runs(
    scored: Scored, dataset_name: str, created_at: str, by: Sequence[str] = (),
) -> DataFrame:
    """One run row for the table or, with ``by``, one per group of rows.

    ``dataset_name`` and ``created_at`` are SQL expressions over ``by``.
    """
    public = [c for c in scored.frame.columns if not c.startswith("__") and c not in by]
    kinds = types_of(scored.frame)
    shape = [(c, kinds[c].simpleString()) for c in public]
    own = [(c, t) for c, t in source_columns(scored.frame) if c not in by]
    out = {
        "row_count": "count(1)",
        "overall_dq_score": half_even(mean_tenths(OVERALL)),
        "grade_counts": _seen_counts("dq_grade", fixed.GRADES),
        "severity_counts": _seen_counts("dq_severity", fixed.SEVERITIES),
        "critical_count": "count_if(dq_severity = 'CRITICAL')",
        "anomaly_count": "count_if(is_anomaly)" if "is_anomaly" in kinds else "CAST(NULL AS BIGINT)",
    }
    out |= {f"__mean_{d}": half_even(dimension_mean(scored, d)) for d in fixed.DIMENSIONS}
    columns = ", ".join(f"named_struct('name', {lit(c)}, 'dtype', {lit(t)})" for c, t in own)
    dims = ", ".join(f"{lit(d)}, __mean_{d}" for d in fixed.DIMENSIONS)
    weights = ", ".join(f"{lit(d)}, {fixed.WEIGHT_PERCENT[d]}" for d in fixed.DIMENSIONS)
    exprs = {
        "schema_version": lit(fixed.MANIFEST_VERSION),
        "dataset_name": dataset_name,
        "dataset_signature": schema_signature(shape),
        "created_at": created_at,
        "row_count": "row_count",
        "column_count": lit(len(public)),
        "columns": f"array({columns})",
        "overall_dq_score": "overall_dq_score",
        "dimensions": f"named_struct({dims})",
        "dimension_weights": f"named_struct({weights})",
        "grade_counts": "grade_counts",
        "severity_counts": "severity_counts",
        "critical_count": "critical_count",
        "anomaly_count": "anomaly_count",
    }
    rows = aggregate(scored.frame, out, by)
    return rows.selectExpr(*[f"{e} AS {n}" for n, e in exprs.items()])


def run_signature(df: DataFrame) -> DataFrame:
    """The shape id of a table and of its own columns only, with its row count."""
    shape = [(c, t.simpleString()) for c, t in types_of(df).items()]
    return aggregate(df, {
        "signature": schema_signature(shape),
        "business_signature": schema_signature(source_columns(df)),
        "row_count": "count(1)",
    })


def unique_runs(runs: DataFrame, order_by: Sequence[str] = ("run_id", "dataset_name", "row_count")) -> DataFrame:
    """One row per (signature, time): the first by those of ``order_by`` that exist."""
    order = [c for c in order_by if c in runs.columns]
    return keep_first(runs, ["dataset_signature", "created_at"], order).drop(ROWS_IN)


def signature_count(runs: DataFrame) -> DataFrame:
    """Distinct shapes, and whether runs of different tables are mixed."""
    return aggregate(runs, {
        "signatures": "count(DISTINCT dataset_signature)",
        "mixed": "count(DISTINCT dataset_signature) > 1",
    })


def trend(runs: DataFrame) -> DataFrame:
    """Flat rows over time."""
    flat = runs.selectExpr(
        "try_cast(created_at AS TIMESTAMP) AS created_at", "coalesce(dataset_name, 'dataset') AS dataset_name",
        "coalesce(dataset_signature, '') AS dataset_signature", "overall_dq_score AS overall",
        *[f"dimensions.{d} AS {d}" for d in fixed.DIMENSIONS],
        "row_count AS `rows`", "critical_count AS critical",
    )
    return flat.orderBy("created_at", "dataset_signature", "dataset_name")


def run_deltas(trend: DataFrame, by: Sequence[str] = ("dataset_signature",), latest_only: bool = True) -> DataFrame:
    """Change of every measure against the run before, per dataset.

    Null where either run lacks the measure; no row for a first run.
    """
    keys = ", ".join(q(c) for c in by)
    order = f"OVER (PARTITION BY {keys} ORDER BY created_at, dataset_name)"
    back = f"OVER (PARTITION BY {keys} ORDER BY created_at DESC, dataset_name DESC)"
    df = trend
    if latest_only:
        # Two rows per dataset pass; each task limits its own rows first.
        df = df.withColumn("__age", F.expr(f"row_number() {back}")).filter("__age <= 2")
    df = df.selectExpr(
        *[q(c) for c in by], f"lag(created_at) {order} AS from_time", "created_at AS to_time",
        *[f"{half_even(f'{m} - lag({m}) {order}', 2)} AS {m}_delta" for m in MEASURES],
    )
    return df.filter("from_time IS NOT NULL")


def long_measures(runs: DataFrame, keys: Sequence[str] = RUN_KEY) -> DataFrame:
    """``metric, actual`` rows of every run; missing measures are left out."""
    cells = ", ".join(
        f"{lit(m)}, " + ("overall_dq_score" if m == "overall" else f"dimensions.{m}") for m in MEASURES)
    return runs.selectExpr(
        *keys, f"stack({len(MEASURES)}, {cells}) AS (metric, actual)").filter("actual IS NOT NULL")
