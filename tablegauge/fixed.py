"""Word lists, labels, penalties, bands and targets.

Everything here is a value that results must agree on; the logic that uses
it lives in the other modules.
"""

# --- fixed values: placeholder words, one set per use -----------------------
PLACEHOLDERS_INVOICE_SCORE = ("UNKNOWN", "N/A", "NA", "NONE", "")
PLACEHOLDERS_VENDOR = ("n/a", "na", "unknown", "unknown vendor", "none", "")
PLACEHOLDERS_GENERAL = ("UNKNOWN", "N/A", "NA", "NONE", "", "NULL", "NAN", "-")
PLACEHOLDERS_CATEGORY = ("NAN", "NONE", "", "NULL")
NULL_TEXT = ("", "nan", "None")

# --- fixed values: text that a CSV reader takes as null ----------------------
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- fixed values: type inference --------------------------------------------
BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0", "y", "n", "t", "f")
SEMANTIC_TYPES = ("numeric", "date", "categorical", "id", "text", "boolean")

# --- fixed values: literal fill word used by date and currency cleaning -------
UNKNOWN = "UNKNOWN"

# --- fixed values: invoice (fixed-schema) columns ----------------------------
INVOICE_CRITICAL_FIELDS = (
    "vendor_name", "invoice_number", "amount", "total_amount", "currency", "status",
)

# --- fixed values: invoice rules (flag column, penalty, issue label) ----------
INVOICE_VALIDITY_RULES = (
    ("currency_invalid", 60, "[Validity] Invalid currency code — blocks payment processing"),
    ("status_invalid", 50, "[Validity] Invalid invoice status — breaks workflow routing"),
    ("invoice_date_parse_error", 30, "[Validity] Invoice date unparseable — can't age or schedule"),
    ("due_date_parse_error", 25, "[Validity] Due date unparseable — SLA tracking broken"),
    ("payment_date_parse_error", 20, "[Validity] Payment date unparseable — reconciliation risk"),
)
INVOICE_ACCURACY_RULES = (
    ("amount_negative", 70, "[Accuracy] Negative invoice amount — financially impossible"),
    ("total_amount_negative", 70, "[Accuracy] Negative total amount — financially impossible"),
    ("tax_amount_negative", 40, "[Accuracy] Negative tax amount — accounting error"),
    ("amount_above_max", 40, "[Accuracy] Amount exceeds max threshold — fraud/entry risk"),
    ("total_amount_above_max", 40, "[Accuracy] Total exceeds max threshold — fraud/entry risk"),
    ("amount_outlier", 20, "[Accuracy] Amount is a statistical outlier (z-score)"),
    ("total_amount_outlier", 20, "[Accuracy] Total is a statistical outlier (z-score)"),
    ("tax_amount_outlier", 10, "[Accuracy] Tax amount is a statistical outlier"),
)
INVOICE_MISSING_LABEL = "[Completeness] Missing critical field: {}"
PAID_WITHOUT_DATE = (60, "[Consistency] Status=PAID but payment_date is missing")
TOTAL_MISMATCH = (60, "[Consistency] total_amount ≠ amount + tax_amount (reconciliation failure)")
DUE_BEFORE_INVOICE = (40, "[Consistency] due_date is before invoice_date (chronology impossible)")
DUPLICATE_INVOICE = (100, "[Uniqueness] invoice_number appears on multiple rows (near-duplicate risk)")
RECONCILE_TOLERANCE = 0.02

# --- fixed values: general (inferred-schema) labels and date-pair hints -------
DATE_ERROR_LABEL = "[Validity] {}: date unparseable"
NEGATIVE_LABEL = "[Accuracy] {}: negative value"
ABOVE_MAX_LABEL = "[Accuracy] {}: exceeds max threshold"
OUTLIER_LABEL = "[Accuracy] {}: statistical outlier"
HAD_NULLS_LABEL = "[Completeness] Row had missing values"
DATE_ORDER_LABEL = "[Consistency] {} is before {}"
DATE_ORDER_PENALTY = 40
PLACEHOLDER_HEAVY_PENALTY = 20
START_HINTS = ("start", "created", "invoice", "hire", "open", "from", "begin", "order")
END_HINTS = ("end", "due", "close", "term", "closed", "to", "expire", "delivery", "ship")

# --- fixed values: dimensions, weights, grades, severities --------------------
DIMENSIONS = ("completeness", "validity", "accuracy", "consistency", "uniqueness")
WEIGHTS = {
    "completeness": 0.20,
    "validity": 0.25,
    "accuracy": 0.35,
    "consistency": 0.15,
    "uniqueness": 0.05,
}
WEIGHT_PERCENT = {
    "completeness": 20, "validity": 25, "accuracy": 35, "consistency": 15, "uniqueness": 5,
}
DIMENSION_TITLES = {
    "completeness": "Missing Data",
    "validity": "Format Accuracy",
    "accuracy": "Value Accuracy",
    "consistency": "Data Consistency",
    "uniqueness": "Duplicate Check",
}
GRADES = ("A", "B", "C", "D", "F")
GRADE_BANDS = ((90, "A"), (75, "B"), (60, "C"), (40, "D"))
SEVERITIES = ("CLEAN", "LOW", "MEDIUM", "HIGH", "CRITICAL")

# --- fixed values: engineered columns -----------------------------------------
ENGINEERED_SUFFIXES = ("_parse_error", "_negative", "_below_min", "_above_max", "_outlier")
ENGINEERED_EXACT = ("had_nulls", "isolation_score", "iqr_outlier_count", "is_anomaly", "dq_issues")
EXPORT_DROPPED_EXACT = ("had_nulls", "isolation_score", "iqr_outlier_count")

# --- fixed values: query plans --------------------------------------------------
PLAN_OPS = ("==", "!=", ">", ">=", "<", "<=", "between", "in", "contains", "is_null", "not_null")
PLAN_AGGREGATES = ("count", "mean", "sum", "min", "max", "median")
PLAN_ALIASES = {
    "severity": "dq_severity",
    "grade": "dq_grade",
    "score": "dq_score",
    "quality": "dq_score",
    "quality_score": "dq_score",
    "dq": "dq_score",
    "anomaly": "is_anomaly",
    "is_anomaly": "is_anomaly",
}

# --- fixed values: runs and decisions -------------------------------------------
MANIFEST_VERSION = 2
MANIFEST_REQUIRED = ("schema_version", "created_at", "overall_dq_score", "dimensions")
DEFAULT_POLICY = {
    "min_overall": 80,
    "min_completeness": 80,
    "min_validity": 80,
    "min_accuracy": 85,
    "min_consistency": 80,
    "min_uniqueness": 90,
    "max_critical_pct": 1.0,
    "max_anomaly_pct": 5.0,
}
HARD_MARGIN = 15
HARD_GATES = ("overall", "accuracy", "consistency")
GATE_LABELS = {
    "overall": "Overall quality",
    "completeness": "Completeness (missing data)",
    "validity": "Validity (format)",
    "accuracy": "Accuracy (values)",
    "consistency": "Consistency",
    "uniqueness": "Uniqueness (duplicates)",
    "critical_pct": "Critical rows %",
    "anomaly_pct": "Anomaly rows %",
}
SCORECARD_LABELS = {
    "overall": "Overall Quality",
    "completeness": "Completeness (missing data)",
    "validity": "Validity (format)",
    "accuracy": "Accuracy (values)",
    "consistency": "Consistency",
    "uniqueness": "Uniqueness (duplicates)",
}

# --- fixed values: remediation (statistic, action, type, detail) ----------------
REMEDIATION_ACTIONS = (
    ("nulls_filled", "Filled blank cells", "fixed",
     "Empty text -> '{text}', empty numbers -> {number}"),
    ("duplicates_removed", "Removed duplicate rows", "fixed",
     "Exact / key duplicates dropped (first occurrence kept)"),
    ("categorical_fixed", "Standardised category labels", "fixed",
     "Trimmed spaces, unified case, mapped blanks/placeholders"),
    ("date_parse_errors", "Flagged unparseable dates", "flagged",
     "Values that are not valid dates, marked for review"),
    ("negative_amount_flags", "Flagged negative numbers", "flagged",
     "Numeric values below zero, marked for review"),
    ("outliers_flagged", "Flagged statistical outliers", "flagged",
     "Values far from the column norm (z-score), marked for review"),
)
SUGGESTED_ACTIONS = (
    ("critical", "High", "Critical-severity rows",
     "Review before using this data for decisions."),
    ("high", "Medium", "High-severity rows",
     "Schedule a review; usually fixable at the source."),
    ("anomalies", "High", "Statistical anomalies",
     "Verify these unusual rows — errors or genuine edge cases."),
    ("low_grade", "Medium", "Low-grade rows (D/F)",
     "Multiple issues per row; start with the column hotspots below."),
)
HOTSPOT_SUFFIXES = (
    ("_outlier", "outliers"), ("_above_max", "above max"), ("_below_min", "below min"),
)
HOTSPOT_ISSUE = "'{}' — {}"
HOTSPOT_ADVICE = "Inspect '{}'; adjust the valid range/threshold or fix source values."
