"""Data quality on Spark: infer, profile, clean, score, explain, decide."""

from tablegauge.config import CleanConfig, InvoiceConfig, Policy, Roles
from tablegauge.plans.batch import Assessment, assess_invoices, assess_table, run_batch, run_rows
from tablegauge.plans.query_plan import PlanResult, run_plan

__all__ = [
    "Assessment", "CleanConfig", "InvoiceConfig", "PlanResult", "Policy", "Roles",
    "assess_invoices", "assess_table", "run_batch", "run_plan", "run_rows",
]
