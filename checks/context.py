"""Tables and lazy plans that several queries share."""

from __future__ import annotations

import uuid
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession

from checks.fixture import INVOICES
from tablegauge.config import Roles
from tablegauge.functions.scalars import assign, pick
from tablegauge.operators.anomaly import count_outside_fences, detect_anomalies
from tablegauge.operators.clean import visible
from tablegauge.operators.profile import infer_roles
from tablegauge.operators.runs import build_runs
from tablegauge.operators.score import Scored
from tablegauge.sources.staging import shared_folder, staged
from tablegauge.plans.batch import Assessment, assess_invoices, assess_table

KEY = ["invoice_id"]
LINE_KEY = ["l_orderkey", "l_linenumber"]


class Context:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def invoices(self) -> DataFrame:
        path = f"{self.folder}/orders.parquet"
        return self.spark.sql(INVOICES.replace("FROM orders", f"FROM parquet.`{path}`"))

    @cached_property
    def ledger(self) -> DataFrame:
        """Every invoice twice."""
        return self.invoices.unionByName(self.invoices)

    @cached_property
    def roles(self) -> Roles:
        return infer_roles(self.invoices)

    @cached_property
    def line_roles(self) -> Roles:
        return infer_roles(self.table("lineitem"))

    @cached_property
    def f(self) -> Assessment:
        """Invoices by the fixed-schema rules."""
        return assess_invoices(self.invoices, KEY)

    @cached_property
    def f_rows(self) -> DataFrame:
        return self.f.rows()

    @cached_property
    def u(self) -> Assessment:
        """The ledger by the inferred-schema rules."""
        return assess_table(self.ledger, KEY, roles=self.roles)

    @cached_property
    def u_rows(self) -> DataFrame:
        return self.u.rows()

    @cached_property
    def fenced(self) -> DataFrame:
        """Scored ledger with the number of columns beyond a quartile fence."""
        return count_outside_fences(self.u_rows, self.roles.numerics, numbers=self.numbers)

    @cached_property
    def numbers(self) -> DataFrame:
        """Number columns of the cleaned ledger, written once."""
        return staged(pick(self.u.cleaned.frame, [*KEY, *self.roles.numerics]))

    @cached_property
    def anomalies(self) -> DataFrame:
        return detect_anomalies(self.u_rows, self.roles, KEY, numbers=self.numbers)

    @cached_property
    def monthly(self) -> Scored:
        frame = assign(self.f.scored.frame, {
            "run_month": "CASE WHEN invoice_date = 'UNKNOWN' THEN '1970-01' ELSE substr(invoice_date, 1, 7) END"})
        return Scored(frame, True)

    @cached_property
    def runs(self) -> DataFrame:
        """One run per month of invoice date."""
        return build_runs(self.monthly, "'invoices'", "concat(run_month, '-01T00:00:00')", ["run_month"])

    @cached_property
    def source_runs(self) -> DataFrame:
        """One run per source table, scored with inferred types."""
        parts = None
        for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey")):
            run = assess_table(self.table(name), [key]).run_row(name, "2024-01-01T00:00:00")
            parts = run if parts is None else parts.unionByName(run)
        return parts

    def scratch(self, name: str) -> str:
        """A fresh folder that every executor reaches."""
        return f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"

    def visible(self, df: DataFrame) -> DataFrame:
        return visible(df)


@lru_cache(maxsize=8)
def _context(_application: str, spark: SparkSession, folder: str) -> Context:
    return Context(spark, folder)


def context(spark: SparkSession, folder: str) -> Context:
    return _context(spark.sparkContext.applicationId, spark, folder)


def forget_contexts() -> None:
    """The next query infers, writes and scores anew what earlier ones shared."""
    _context.cache_clear()


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(context)`` under ``name``, with its SQL if there is one."""
    from checks.oracle_parts import with_parts

    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(context(spark, folder))
        if sql is not None:
            ORACLES[name] = with_parts(sql)
        return fn

    return register
