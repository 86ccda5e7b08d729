"""Type inference and per-column profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge import fixed
from tablegauge.config import CleanConfig, Roles
from tablegauge.functions.dates import all_form_bits, vote_exprs, winner
from tablegauge.functions.scalars import (
    aggregate, any_of, assign, half_even, is_integer, is_number, is_text, is_time, lit, missing, percent, q,
    strip, text, to_date, to_number, types_of, words,
)

#: Size of the distinct sketch (its error is below 1 %), and how near a limit
#: its estimate has to be for an exact count to be made.
SKETCH_SIZE = 14
#: Hashed before a value for the second half of its 128-bit hash.
HASH_SALT = 1
RECHECK_WITHIN = 0.05


# --- type inference ----------------------------------------------------------------

BITS = "__forms"


def inference_row(df: DataFrame, formats: Sequence[str]) -> DataFrame:
    """All figures that type inference needs, as one row from one scan. Without
    ``formats``, text columns count the votes for each date form.

    What the aggregates read is projected first: a hash per column, and what is asked of
    texts. The sketches then take whole numbers, and no expression runs inside them.
    """
    kinds = types_of(df)
    texts = [c for c, kind in kinds.items() if is_text(kind)]
    seen, out = {}, {"rows": "count(1)"}
    if texts and not formats:
        seen[BITS] = all_form_bits(texts)
    for i, (c, kind) in enumerate(kinds.items()):
        if is_time(kind) or isinstance(kind, T.BooleanType):
            continue
        seen[f"hash{i}"] = _hash(c, kind)
        out[f"filled_{c}"] = f"count(hash{i})"
        out[f"distinct_{c}"] = _sketch(f"hash{i}")
        if is_number(kind):
            seen[f"binary{i}"] = f"{q(c)} IN (0, 1)"
            out[f"binary_{c}"] = f"coalesce(bool_and(binary{i}), TRUE)"
        elif is_text(kind):
            seen[f"binary{i}"] = _is_boolean_word(q(c))
            seen[f"length{i}"] = f"length({q(c)})"
            out[f"binary_{c}"] = f"bool_and(binary{i})"
            if formats:
                seen[f"dated{i}"] = f"CASE WHEN {q(c)} IS NOT NULL THEN CAST(({to_date(c, kind, formats)}) IS NOT NULL AS INT) END"
                out[f"dated_{c}"] = f"avg(dated{i})"
            else:
                out |= vote_exprs(c, f"{BITS}[{texts.index(c)}]")
            out[f"length_{c}"] = f"avg(length{i})"
    return aggregate(df.selectExpr(*[f"{e} AS {n}" for n, e in seen.items()]), out)


def _is_boolean_word(e: str) -> str:
    """Whether a text is a boolean word once stripped. One that starts visibly and has a
    visible character past the longest word is none, which saves stripping it."""
    after = 1 + max(len(w) for w in fixed.BOOLEAN_WORDS)
    longer = f"ascii({e}) BETWEEN 33 AND 126 AND ascii(substr({e}, {after}, 1)) BETWEEN 33 AND 126"
    return f"CASE WHEN {longer} THEN FALSE ELSE lower({strip(e)}) IN {words(fixed.BOOLEAN_WORDS)} END"


def _hash(name: str, kind: T.DataType) -> str:
    """64-bit hash of a value, null where it is null."""
    simple = is_number(kind) or is_text(kind) or is_time(kind)
    hashed = f"xxhash64({q(name)})" if simple else f"xxhash64(to_json(struct({q(name)})))"
    return f"CASE WHEN {q(name)} IS NOT NULL THEN {hashed} END"


def _sketch(hashed: str) -> str:
    return f"coalesce(hll_sketch_estimate(hll_sketch_agg({hashed}, {SKETCH_SIZE})), 0)"


def infer_roles(df: DataFrame, config: CleanConfig = CleanConfig()) -> Roles:
    """Semantic type of every column, from one aggregate over the whole table.

    Distinct counts come from a sketch; the columns where its estimate is close to a
    limit are counted exactly, all in one more job. The driver sees a single row, and
    one count per such column.
    """
    row = inference_row(df, config.date_formats).first().asDict()
    forms: dict[str, tuple[str, ...]] = {}
    for c in df.columns:
        if f"form0_{c}" in row:
            forms[c], fits = winner(c, row)
            row[f"dated_{c}"] = fits / max(row[f"filled_{c}"], 1)
    near = [c for c, kind in types_of(df).items() if _is_borderline(c, kind, row)]
    if near:
        counted = {r["column"]: r["n_values"] for r in distinct_counts(df, near).collect()}
        row |= {f"distinct_{c}": counted.get(c, 0) for c in near}
    found: dict[str, str] = {}
    for c, kind in types_of(df).items():
        if is_time(kind):
            found[c] = "date"
        elif isinstance(kind, T.BooleanType):
            found[c] = "boolean"
        elif is_number(kind):
            found[c] = _number_type(c, kind, row)
        else:
            found[c] = _text_type(c, row)
    return Roles(found, {c: forms[c] for c in forms if found[c] == "date"})


def _is_whole(c: str, kind: T.DataType, row: dict) -> bool:
    return is_integer(kind) and row[f"filled_{c}"] == row["rows"]


def _few(row: dict) -> float:
    return max(30, max(row["rows"], 1) * 0.05)


def _is_borderline(c: str, kind: T.DataType, row: dict) -> bool:
    """Whether the sketched distinct count is so near a limit that its error decides."""
    rows = max(row["rows"], 1)
    if f"distinct_{c}" not in row or row.get(f"binary_{c}"):
        return False
    if is_number(kind):
        limits = [0.90 * rows] if _is_whole(c, kind, row) else []
    elif row[f"filled_{c}"] and f"length_{c}" in row and row[f"dated_{c}"] <= 0.70:
        limits = [0.85 * rows, _few(row)]
    else:
        limits = []
    return any(abs(row[f"distinct_{c}"] - limit) <= RECHECK_WITHIN * limit for limit in limits)


def _number_type(c: str, kind: T.DataType, row: dict) -> str:
    if row[f"binary_{c}"]:
        return "boolean"
    if _is_whole(c, kind, row) and row[f"distinct_{c}"] / max(row["rows"], 1) > 0.90:
        return "id"
    return "numeric"


def _text_type(c: str, row: dict) -> str:
    if row[f"filled_{c}"] == 0 or f"length_{c}" not in row:
        return "text"
    if row[f"binary_{c}"]:
        return "boolean"
    if row[f"dated_{c}"] > 0.70:
        return "date"
    distinct, length = row[f"distinct_{c}"], row[f"length_{c}"]
    if distinct / max(row["rows"], 1) > 0.85 and length < 40:
        return "id"
    if distinct <= _few(row):
        return "categorical"
    return "text" if length > 60 else "categorical"


def type_table(df: DataFrame, roles: Roles) -> DataFrame:
    """``column, type`` rows, one per column of the table."""
    rows = [(c, roles.types[c]) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "`column` string, `type` string")


def role_table(df: DataFrame, roles: Roles) -> DataFrame:
    """``role, column, type`` rows; a column may have several roles."""
    rows = [(r, c, roles.types[c]) for r, names in roles.by_role().items() for c in names]
    return df.sparkSession.createDataFrame(rows, "role string, `column` string, `type` string")


def type_counts(profile: DataFrame) -> DataFrame:
    """Number of columns per semantic type, 0 where there is none."""
    counted = profile.selectExpr(*[f"count_if(`type` = {lit(t)}) AS {t}" for t in fixed.SEMANTIC_TYPES])
    pairs = ", ".join(f"{lit(t)}, {t}" for t in fixed.SEMANTIC_TYPES)
    return counted.selectExpr(f"stack({len(fixed.SEMANTIC_TYPES)}, {pairs}) AS (`type`, columns)")


# --- profile ---------------------------------------------------------------------------

def long_values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Non-null values of several columns as ``column, value`` text rows."""
    pairs = ", ".join(f"{lit(c)}, {text(q(c))}" for c in names)
    return df.selectExpr(f"stack({len(names)}, {pairs}) AS (`column`, `value`)").filter("`value` IS NOT NULL")


def value_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``column, value, n``: how often each value occurs, combined map-side."""
    return aggregate(long_values(df, names), {"n": "count(1)"}, ["column", "value"])


def first_per_column(counts: DataFrame, order: str, k: int) -> DataFrame:
    """At most ``k`` rows per column. Spark limits each task's rows before the
    shuffle, so a column with many values does not reach one task whole."""
    ranked = counts.withColumn("place", F.expr(
        f"row_number() OVER (PARTITION BY `column` ORDER BY {order})"))
    return ranked.filter(f"place <= {k}")


def distinct_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``column, n_values``: distinct non-null values as text, all columns in one pass.

    Values are told apart by two 64-bit hashes, so what is exchanged is of fixed
    width however long they are; each task combines its own first. Two of 10^12 values
    meet by chance with 1e-15. A column without values has no row.
    """
    cells = ", ".join(
        f"{i}, nvl2({q(c)}, xxhash64({text(q(c))}), NULL), xxhash64({HASH_SALT}, {text(q(c))})"
        for i, c in enumerate(names))
    hashes = df.selectExpr(f"stack({len(names)}, {cells}) AS (i, h, h2)").filter("h IS NOT NULL").distinct()
    named = f"element_at(array{words(names)}, i + 1) AS `column`"
    return aggregate(hashes, {"n_values": "count(1)"}, ["i"]).selectExpr(named, "n_values")


def smallest_per_task(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: the ``k`` smallest distinct values (by UTF-8 bytes, like
    Spark's order) of each text column of a task, as ``i, value`` rows. Holds ``k``
    values a column; values that are not below the largest of them are dropped at once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, pa.Array] = {}
        for batch in batches:
            for i, column in enumerate(batch.columns):
                held = best.get(i)
                if held is not None and len(held) == k:
                    column = column.filter(pc.less(column, held[k - 1]))
                found = pc.unique(column).drop_null()
                if held is None or len(found):
                    found = found if held is None else pc.unique(pa.concat_arrays([held, found]))
                    best[i] = found.take(pc.array_sort_indices(found)[:k])
        for i, held in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(held), pa.int32()), held.cast(pa.string())], ["i", "value"])

    return run


def first_values(df: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """``column, first_values``: the ``k`` smallest distinct non-null values as text, in
    order. A task sends at most ``k`` values a column. A column without values has no
    row."""
    texts = df.selectExpr(*[f"{text(q(c))} AS c{i}" for i, c in enumerate(names)])
    found = texts.mapInArrow(smallest_per_task(k), "i int, value string").distinct()
    named = f"element_at(array{words(names)}, i + 1) AS `column`"
    ordered = first_per_column(found.selectExpr(named, "`value`"), "`value`", k)
    return aggregate(ordered, {
        "first_values": "transform(array_sort(collect_list(struct(place, `value`))), x -> x.`value`)"}, ["column"])


def profile(df: DataFrame, roles: Roles, exact: bool = True) -> DataFrame:
    """One row per column: nulls, distinct values, samples, number summary.

    Three scans and no exchange of values but the samples. ``exact=False``
    replaces the distinct counts and samples by sketches from a single scan, which
    avoids the shuffle of the values' hashes.
    """
    kinds = types_of(df)
    names = list(kinds)
    numeric = [c for c in names if is_number(kinds[c]) or roles.types[c] in ("numeric", "id")]
    out = {"rows": "count(1)"}
    for c in names:
        out[f"nulls_{c}"] = f"count_if({missing(c, kinds[c])})"
        if not exact:
            out[f"distinct_{c}"] = _sketch(_hash(c, kinds[c]))
            out[f"sample_{c}"] = f"transform(approx_top_k({text(q(c))}, 4), x -> x.item)"
    for c in numeric:
        number = to_number(c, kinds[c])
        number = f"nullif({number}, double('NaN'))"
        out |= {
            f"min_{c}": f"min({number})", f"max_{c}": f"max({number})", f"mean_{c}": f"avg({number})",
            f"zero_{c}": f"count_if({number} = 0)", f"neg_{c}": f"count_if({number} < 0)",
        }
    structs = []
    for i, c in enumerate(names):
        have = c in numeric
        structs.append(f"""named_struct(
            'position', {i}, 'column', {lit(c)}, 'type', {lit(roles.types[c])}, 'rows', `rows`,
            'null_count', {q('nulls_' + c)},
            'distinct', {'CAST(NULL AS BIGINT)' if exact else q('distinct_' + c)},
            'samples', {'CAST(NULL AS ARRAY<STRING>)' if exact else q('sample_' + c)},
            'lowest', {q('min_' + c) if have else 'CAST(NULL AS DOUBLE)'},
            'highest', {q('max_' + c) if have else 'CAST(NULL AS DOUBLE)'},
            'average', {q('mean_' + c) if have else 'CAST(NULL AS DOUBLE)'},
            'zeros', {q('zero_' + c) if have else 'CAST(NULL AS BIGINT)'},
            'negatives', {q('neg_' + c) if have else 'CAST(NULL AS BIGINT)'})""")
    table = aggregate(df, out).selectExpr(f"inline(array({', '.join(structs)}))")
    if exact:
        distinct, samples = distinct_counts(df, names), first_values(df, names, 4)
        # Both sides have one row per column of the table.
        table = table.join(F.broadcast(distinct), "column", "left").join(
            F.broadcast(samples), "column", "left")
        count, sample = "coalesce(n_values, 0)", "first_values"
    else:
        count, sample = "`distinct`", "samples"
    some = "average IS NOT NULL"
    return table.selectExpr(
        "position", "`column`", "`type`",
        f"{percent('null_count', '`rows`')} AS null_pct", "null_count",
        f"{count} AS unique_count", f"{percent(count, '`rows`')} AS unique_pct",
        f"coalesce(array_join({sample}, ' · '), '') AS sample",
        f"{half_even('lowest', 2)} AS `min`", f"{half_even('highest', 2)} AS `max`",
        f"{half_even('average', 2)} AS `mean`",
        f"CASE WHEN {some} THEN {percent('zeros', '`rows`')} END AS zero_pct",
        f"CASE WHEN {some} THEN {percent('negatives', '`rows`')} END AS neg_pct",
    )


def missing_ranking(profile: DataFrame) -> DataFrame:
    """Columns with missing values, worst first."""
    return profile.filter("null_pct > 0").selectExpr("`column`", "null_pct", "null_count").orderBy(
        F.desc("null_pct"), F.asc("column"))


def columns_of_type(profile: DataFrame, kind: str) -> DataFrame:
    return profile.filter(F.col("type") == kind)


def table_totals(df: DataFrame) -> DataFrame:
    """Rows, columns and missing cells of a table."""
    cells = " + ".join(f"CAST({missing(c, t)} AS BIGINT)" for c, t in types_of(df).items())
    return aggregate(df, {
        "rows": "count(1)", "columns": lit(len(df.columns)), "missing_values": f"coalesce(sum({cells}), 0)",
    })


def preview(df: DataFrame, order_by: Sequence[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows by ``order_by``."""
    return df.orderBy(*[F.col(q(c)) for c in order_by]).limit(n)


def has_missing(df: DataFrame) -> str:
    """Condition: some column of the row is missing."""
    return any_of([missing(c, t) for c, t in types_of(df).items()])


def top_values(df: DataFrame, names: Sequence[str], k: int = 8) -> DataFrame:
    """The ``k`` most frequent values of each column; ties by value."""
    ranked = first_per_column(value_counts(df, names), "n DESC, `value`", k)
    return ranked.selectExpr("`column`", "place", "`value`", "n")
