"""Batch flows: one table from raw to published, and many sources at once."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from tablegauge.config import CleanConfig, InvoiceConfig, Roles
from tablegauge.operators.clean import Cleaned, clean_invoices, clean_table
from tablegauge.operators.profile import infer_roles
from tablegauge.operators.runs import build_runs
from tablegauge.operators.score import Scored, score_invoices, score_table
from tablegauge.functions.scalars import lit
from tablegauge.sources.readers import union_all
from tablegauge.sources.staging import shared_folder
from tablegauge.sources.writers import append_log, log_row, write_csv, write_table


@dataclass(frozen=True)
class Assessment:
    """A table cleaned and scored, still lazy."""

    cleaned: Cleaned
    scored: Scored
    roles: Roles

    def rows(self) -> DataFrame:
        return self.scored.rows()

    def publish(self, path: str) -> Assessment:
        """Write the scored rows with their counters once, and return the
        assessment that reads them: every report then starts from there."""
        self.scored.frame.write.mode("overwrite").parquet(path)
        stored = self.scored.frame.sparkSession.read.schema(self.scored.frame.schema).parquet(path)
        return Assessment(replace(self.cleaned, frame=stored), replace(self.scored, frame=stored), self.roles)

    def run_row(self, name: str, created_at: str) -> DataFrame:
        return build_runs(self.scored, lit(name), lit(created_at))


def assess_invoices(
    df: DataFrame, order_by: Sequence[str], config: InvoiceConfig = InvoiceConfig()
) -> Assessment:
    """Clean and score with the fixed-schema rules."""
    cleaned = clean_invoices(df, order_by, config)
    return Assessment(cleaned, score_invoices(cleaned.frame, order_by, config), Roles())


def assess_table(
    df: DataFrame, order_by: Sequence[str], config: CleanConfig = CleanConfig(), roles: Roles | None = None
) -> Assessment:
    """Infer roles (unless given), clean and score with the general rules."""
    roles = roles or infer_roles(df, config)
    cleaned = clean_table(df, roles, order_by, config)
    return Assessment(cleaned, score_table(cleaned.frame, roles, order_by, config), roles)


def run_rows(sources: Mapping[str, tuple[DataFrame, Sequence[str]]], created_at: str,
             config: CleanConfig = CleanConfig()) -> DataFrame:
    """One run row per source. Each entry is ``(table, order_by)``; all plans
    stay lazy and run as one job."""
    parts = [
        assess_table(df, order_by, config).run_row(name, created_at)
        for name, (df, order_by) in sources.items()
    ]
    return union_all(parts)


def run_batch(
    spark: SparkSession, df: DataFrame, order_by: Sequence[str], folder: str, timestamp: str,
    config: InvoiceConfig = InvoiceConfig(), source_table: str = "invoices",
    cleaned_table: str = "invoices_cleaned",
) -> DataFrame:
    """Clean, score, replace the cleaned table, write its CSV extract, append the
    audit row.

    Rows and counters are written once below the shared folder; the table, the
    extract and both statistics rows read them back, so cleaning runs a single
    time and a lost executor costs its own tasks only. The table is one of the
    catalog, stored in ``folder``, and holds the visible columns. Returns it.
    """
    done = assess_invoices(df, order_by, config).publish(f"{shared_folder(spark)}/batch-{uuid.uuid4().hex}")
    written = f"{folder.rstrip('/')}/{cleaned_table}"
    write_table(done.rows(), cleaned_table, written)
    write_csv(done.rows(), f"{written}_csv")
    append_log(log_row(done.cleaned.stats(), done.scored.stats(), timestamp, source_table, cleaned_table),
               f"{folder.rstrip('/')}/run_log")
    return spark.read.table(cleaned_table)
