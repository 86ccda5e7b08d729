"""DuckDB building blocks: the invoice fixture, cleaned and scored in SQL.

Written on its own, from the rules, so that it can disagree with the library.
"""

import re

from checks.fixture import INVOICES
from tablegauge import fixed

TEXTS = ("invoice_number", "vendor_name", "invoice_date", "due_date", "payment_date", "currency", "status")
MONEY = ("amount", "tax_amount", "total_amount")
DATES = ("invoice_date", "due_date", "payment_date")
COLUMNS = ("invoice_id", *TEXTS[:5], *MONEY, *TEXTS[5:])
DIMS = ("completeness", "validity", "accuracy", "consistency", "uniqueness")
PH_F = "('UNKNOWN','N/A','NA','NONE','')"
PH_U = "('UNKNOWN','N/A','NA','NONE','','NULL','NAN','-')"
PH_VENDOR = "('n/a','na','unknown','unknown vendor','none','')"
CURRENCIES = "('USD','EUR','GBP','AUD','CAD','INR','SGD')"
STATUSES = "('PAID','PENDING','OVERDUE','CANCELLED','DRAFT')"


def text(value):
    return "'" + value.replace("'", "''") + "'"


def strip(e):
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def half(e, digits=1):
    scale = f"{10 ** digits}e0"
    return f"(round_even(({e}) * {scale}, 0) / {scale})"


def mean_tenths(e):
    return f"(CAST(sum(CAST(round_even({e} * 10e0, 0) AS BIGINT)) AS DOUBLE) / (10e0 * count({e})))"


def flag(e):
    return f"CASE WHEN {e} THEN 1 ELSE 0 END"


def title(e):
    return (f"array_to_string(list_transform(regexp_extract_all(lower({e}), '[a-z]+|[^a-z]+'), "
            f"lambda w: upper(w[1]) || w[2:]), '')")


def fill_select(source):
    filled = ["invoice_id"]
    filled += [f"coalesce({c}, 'UNKNOWN') AS {c}" for c in TEXTS]
    filled += [f"coalesce({c}, 0e0) AS {c}" for c in MONEY]
    nulls = [f"{c} IS NULL" for c in COLUMNS]
    cells = " + ".join(flag(x) for x in nulls)
    return (f"SELECT {', '.join(filled)}, {flag(' OR '.join(nulls))} AS had_nulls, "
            f"{cells} AS null_cells FROM {source}")


def date_columns(ignored):
    out = []
    for c in DATES:
        d = f"CAST(try_strptime({c}, '%Y-%m-%d') AS DATE)"
        out.append(f"{d} AS d_{c}")
        out.append(f"coalesce(strftime({d}, '%Y-%m-%d'), 'UNKNOWN') AS {c}")
        out.append(f"{flag(f'{d} IS NULL AND {c} NOT IN {ignored}')} AS {c}_parse_error")
    return out


def range_flags():
    out = []
    for c in MONEY:
        out += [f"{flag(f'{c} < 0')} AS {c}_negative", f"{flag(f'{c} < 0e0')} AS {c}_below_min",
                f"{flag(f'{c} > 10000000e0')} AS {c}_above_max"]
    return out


def outlier_flags():
    return [
        flag(f"sd_{c} > 0 AND abs(({c} - mean_{c}) / sd_{c}) > 3e0") + f" AS {c}_outlier" for c in MONEY
    ]


MOMENTS = ", ".join(f"avg({c}) AS mean_{c}, stddev_samp({c}) AS sd_{c}" for c in MONEY)
_tidy = strip("vendor_name")
_title = title("regexp_replace(" + _tidy + ", '\\s+', ' ', 'g')")


def less(parts):
    """100 less penalties, clamped."""
    steps = " - ".join(f"(CASE WHEN {c} THEN {p} ELSE 0e0 END)" for c, p in parts)
    return f"greatest(0e0, least(100e0, 100e0 - {steps}))"


CRITICAL_F = ("vendor_name", "invoice_number", "amount", "total_amount", "currency", "status")


def missing_f(c):
    return f"upper({strip(f'CAST({c} AS VARCHAR)')}) IN {PH_F}"


def missing_u(c):
    return f"upper({strip(f'CAST({c} AS VARCHAR)')}) IN {PH_U}"


SEVERITY = """CASE WHEN {p}accuracy < 30 OR {p}consistency < 40 THEN 'CRITICAL'
  WHEN {p}accuracy < 60 OR {p}validity < 40 OR dq_score < 50 THEN 'HIGH'
  WHEN dq_score < 70 OR least({p}accuracy, {p}consistency, {p}validity, {p}completeness) < 60 THEN 'MEDIUM'
  WHEN dq_score < 85 THEN 'LOW' ELSE 'CLEAN' END""".format(p="dq_score_")
GRADE = ("CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 75 THEN 'B' WHEN overall >= 60 THEN 'C' "
         "WHEN overall >= 40 THEN 'D' ELSE 'F' END")


def weighted(prefix):
    terms = zip(DIMS, ("0.2e0", "0.25e0", "0.35e0", "0.15e0", "0.05e0"))
    return "greatest(0e0, least(100e0, " + " + ".join(f"{prefix}{d} * {w}" for d, w in terms) + "))"


def issues(pairs):
    return "concat_ws(' | ', " + ", ".join(f"CASE WHEN {c} THEN {text(label)} END" for c, label in pairs) + ")"


PAID_UNDATED = f"(upper(status) = 'PAID' AND {missing_f('payment_date')})"
MISMATCH = "(abs(total_amount - (amount + coalesce(tax_amount, 0e0))) > 0.02e0)"
EARLY = "coalesce(d_due_date < d_invoice_date, FALSE)"
VALIDITY_F = [(f"{c} = 1", f"{p}e0", label) for c, p, label in fixed.INVOICE_VALIDITY_RULES]
ACCURACY_F = [(f"{c} = 1", f"{p}e0", label) for c, p, label in fixed.INVOICE_ACCURACY_RULES]
ISSUES_F = (
    [(missing_f(c), f"[Completeness] Missing critical field: {c}") for c in CRITICAL_F]
    + [(c, label) for c, _, label in VALIDITY_F] + [(c, label) for c, _, label in ACCURACY_F]
    + [(PAID_UNDATED, fixed.PAID_WITHOUT_DATE[1]), (MISMATCH, fixed.TOTAL_MISMATCH[1]),
       (EARLY, fixed.DUE_BEFORE_INVOICE[1]), ("repeated", fixed.DUPLICATE_INVOICE[1])]
)
ISSUES_U = (
    [(f"{c}_parse_error = 1", f"[Validity] {c}: date unparseable") for c in DATES]
    + [(f"{c}_negative = 1", f"[Accuracy] {c}: negative value") for c in MONEY]
    + [(f"{c}_above_max = 1", f"[Accuracy] {c}: exceeds max threshold") for c in MONEY]
    + [(f"{c}_outlier = 1", f"[Accuracy] {c}: statistical outlier") for c in MONEY]
    + [("had_nulls = 1", "[Completeness] Row had missing values"),
       (EARLY, "[Consistency] due_date is before invoice_date")]
)
CATEGORIES = ("vendor_name", "currency", "status")
CRITICAL_U = ("invoice_id", "invoice_number", *MONEY, *CATEGORIES)


def category(c):
    word = f"upper({strip(c)})"
    return f"CASE WHEN {word} IN ('NAN','NONE','','NULL') THEN 'UNKNOWN' ELSE {word} END"


def id_text(c):
    word = strip(f"CAST({c} AS VARCHAR)")
    return f"CASE WHEN upper({word}) IN {PH_U} THEN 'UNKNOWN' ELSE {word} END"


CTES = {
    "inv": INVOICES,
    # fixed-schema rules
    "f_fill": fill_select("inv"),
    "f_first": "SELECT *, row_number() OVER (PARTITION BY vendor_name, invoice_number ORDER BY invoice_id) AS rn FROM f_fill",
    "f_dedup": "SELECT * EXCLUDE (rn) FROM f_first WHERE rn = 1",
    "f_moments": f"SELECT {MOMENTS} FROM f_dedup",
    "f_clean": f"""SELECT invoice_id, invoice_number, {', '.join(MONEY)},
      {', '.join(date_columns("('', 'UNKNOWN')"))}, had_nulls, null_cells,
      {', '.join(range_flags())},
      CASE WHEN upper({strip('currency')}) IN {CURRENCIES} THEN upper({strip('currency')}) ELSE 'UNKNOWN' END AS currency,
      {flag(f"upper({strip('currency')}) NOT IN {CURRENCIES}")} AS currency_invalid,
      CASE WHEN lower({_title}) IN {PH_VENDOR} THEN 'UNKNOWN' ELSE {_title} END AS vendor_name,
      vendor_name AS vendor_before,
      CASE WHEN upper({strip('status')}) IN {STATUSES} THEN upper({strip('status')}) ELSE 'UNKNOWN' END AS status,
      {flag(f"upper({strip('status')}) NOT IN {STATUSES}")} AS status_invalid,
      {', '.join(outlier_flags())}
      FROM f_dedup, f_moments""",
    "f_repeat": "SELECT invoice_number AS rep_number FROM f_clean GROUP BY 1 HAVING count(*) > 1",
    "f_rules": f"""SELECT f_clean.*, rep_number IS NOT NULL AS repeated,
      {less([(missing_f(c), '(100e0 / 6e0)') for c in CRITICAL_F])} AS x_completeness,
      {less([(c, p) for c, p, _ in VALIDITY_F])} AS x_validity,
      {less([(c, p) for c, p, _ in ACCURACY_F])} AS x_accuracy,
      {less([(PAID_UNDATED, '60e0'), (MISMATCH, '60e0'), (EARLY, '40e0')])} AS x_consistency,
      {less([('rep_number IS NOT NULL', '100e0')])} AS x_uniqueness
      FROM f_clean LEFT JOIN f_repeat ON invoice_number = rep_number""",
    "f_dims": f"""SELECT *, {', '.join(f"{half('x_' + d)} AS dq_score_{d}" for d in DIMS)},
      {half(weighted('x_'))} AS overall FROM f_rules""",
    "f_int": f"SELECT *, CAST(trunc(overall) AS INTEGER) AS dq_score, {GRADE} AS dq_grade FROM f_dims",
    "f_score": f"SELECT *, {SEVERITY} AS dq_severity, {issues(ISSUES_F)} AS dq_issues FROM f_int",
    # inferred-schema rules on a ledger that holds every invoice twice
    "ledger": "SELECT * FROM inv UNION ALL SELECT * FROM inv",
    "u_fill": fill_select("ledger"),
    "u_first": "SELECT *, row_number() OVER (PARTITION BY invoice_id, invoice_number ORDER BY invoice_id) AS rn FROM u_fill",
    "u_dedup": "SELECT * EXCLUDE (rn) FROM u_first WHERE rn = 1",
    "u_moments": f"SELECT {MOMENTS} FROM u_dedup",
    "u_clean": f"""SELECT {', '.join(f'{id_text(c)} AS {c}' for c in ('invoice_id', 'invoice_number'))},
      invoice_id AS raw_id, {', '.join(MONEY)},
      {', '.join(date_columns("('', 'UNKNOWN', 'nan', 'None')"))}, had_nulls, null_cells,
      {', '.join(range_flags())},
      {', '.join(f'{category(c)} AS {c}' for c in CATEGORIES)},
      {' + '.join(flag(f'{c} <> {category(c)}') for c in CATEGORIES)} AS categories_changed,
      {', '.join(outlier_flags())}
      FROM u_dedup, u_moments""",
    "u_rates": "SELECT " + ", ".join(
        f"avg(CASE WHEN upper({c}) IN {PH_U} THEN 1e0 ELSE 0e0 END) AS rate_{c}" for c in CATEGORIES) + " FROM u_clean",
    "u_rep1": "SELECT invoice_id AS rep_id FROM u_clean GROUP BY 1 HAVING count(*) > 1",
    "u_rep2": "SELECT invoice_number AS rep_number FROM u_clean GROUP BY 1 HAVING count(*) > 1",
    "u_dims": f"""SELECT u_clean.*,
      {half(less([(missing_u(c), '(100e0 / 8e0)') for c in CRITICAL_U]))} AS dq_score_completeness,
      {half(less([(f'{c}_parse_error = 1', '20e0') for c in DATES]
                 + [(f'rate_{c} > 0.5e0', '20e0') for c in CATEGORIES]))} AS dq_score_validity,
      {half(less([(f'{c}_negative = 1', '23e0') for c in MONEY] + [(f'{c}_above_max = 1', '10e0') for c in MONEY]
                 + [(f'{c}_outlier = 1', '10e0') for c in MONEY]))} AS dq_score_accuracy,
      {half(less([(EARLY, '40e0')]))} AS dq_score_consistency,
      {half(less([('rep_id IS NOT NULL', '25e0'), ('rep_number IS NOT NULL', '25e0')]))} AS dq_score_uniqueness
      FROM u_clean CROSS JOIN u_rates LEFT JOIN u_rep1 ON invoice_id = rep_id
      LEFT JOIN u_rep2 ON invoice_number = rep_number""",
    "u_over": f"SELECT *, {half(weighted('dq_score_'))} AS overall FROM u_dims",
    "u_int": f"SELECT *, CAST(trunc(overall) AS INTEGER) AS dq_score, {GRADE} AS dq_grade FROM u_over",
    "u_score": f"SELECT *, {SEVERITY} AS dq_severity, {issues(ISSUES_U)} AS dq_issues FROM u_int",
    # runs: one per month of invoice date
    "months": """SELECT *, CASE WHEN invoice_date = 'UNKNOWN' THEN '1970-01' ELSE substr(invoice_date, 1, 7) END
      AS run_month FROM f_score""",
    "runs": f"""SELECT 'invoices' AS dataset_name, run_month || '-01T00:00:00' AS created_at,
      count(*) AS row_count, {half(mean_tenths('overall'))} AS overall,
      {', '.join(f"{half('avg(x_' + d + ')')} AS {d}" for d in DIMS)},
      count(*) FILTER (WHERE dq_severity = 'CRITICAL') AS critical_count FROM months GROUP BY run_month""",
    "measures": " UNION ALL ".join(
        f"SELECT created_at, row_count, critical_count, {i} AS place, '{m}' AS metric, {m} AS actual FROM runs"
        for i, m in enumerate(("overall", *DIMS))),
    "targets": "SELECT * FROM (VALUES ('overall', 80e0, 15), ('completeness', 80e0, NULL), ('validity', 80e0, NULL), "
               "('accuracy', 85e0, 15), ('consistency', 80e0, 15), ('uniqueness', 90e0, NULL)) t(metric, target, hard)",
    "gates": f"""SELECT created_at, metric AS gate, 'min' AS kind, {half('target')} AS target,
        {half('actual')} AS actual, actual >= target AS passed, {half('actual - target')} AS margin, place, hard,
        CAST(NULL AS BIGINT) AS n
      FROM measures JOIN targets USING (metric)
      UNION ALL
      SELECT created_at, 'critical_pct', 'max', 1e0, {half('pct', 2)}, pct <= 1e0, {half('1e0 - pct', 2)}, 6, 0,
        critical_count FROM (SELECT *, 100e0 * critical_count / row_count AS pct FROM runs)""",
    "blocks": """SELECT *, (NOT passed AND (gate = 'critical_pct' OR (hard IS NOT NULL AND hard > 0
      AND margin <= -15e0))) AS blocking FROM gates""",
    "verdicts": """SELECT created_at, CASE WHEN bool_or(blocking) THEN 'QUARANTINE' WHEN bool_and(passed)
        THEN 'APPROVE' ELSE 'REMEDIATE' END AS verdict,
      CAST(round_even(greatest(55e0, least(99e0, 55e0 + avg(abs(margin) * CASE WHEN gate = 'critical_pct'
        THEN 3e0 ELSE 1e0 END) * 3e0)), 0) AS INTEGER) AS confidence,
      CAST(count(*) AS INTEGER) AS gates_total,
      CAST(count(*) FILTER (WHERE passed) AS INTEGER) AS gates_passed,
      CAST(count(*) FILTER (WHERE NOT passed) AS INTEGER) AS gates_failed
      FROM blocks GROUP BY created_at""",
    # blocking gates of a quarantined run, failed gates of one to remediate
    "drivers": """SELECT b.*, v.verdict FROM blocks b JOIN verdicts v USING (created_at)
      WHERE CASE verdict WHEN 'QUARANTINE' THEN blocking WHEN 'REMEDIATE' THEN NOT passed ELSE FALSE END""",
    "labelled": "SELECT * FROM (VALUES " + ", ".join(
        f"({text(k)}, {text(v)})" for k, v in fixed.GATE_LABELS.items()) + ") l(gate, label)",
}


def with_parts(select):
    """``select`` after the building blocks it uses, in order."""
    def used(sql):
        return [n for n in CTES if re.search(rf"\b{n}\b", sql)]

    wanted, queue = set(), used(select)
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            queue += [n for n in used(CTES[name]) if n != name]
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in CTES if n in wanted]
    return (f"WITH {', '.join(parts)} " if parts else "") + select
