"""Keep-first de-duplication and repeated-key flags, safe under key skew."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.bloom import bloom, can_hash, may_hold
from tablegauge.functions.scalars import aggregate, assign, pick, q, text, types_of
from tablegauge.sources.staging import staged

ROWS_IN = "__rows_in"
#: Keys flagged through the broadcast side; the size of that side is fixed by
#: this limit, whatever the size of the table.
HOT_KEYS = 1000
#: Repeated keys that are broadcast, in bytes; further ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
ENTRY_BYTES = 64
#: Ways in which the rows of those keys are spread over the shuffle.
HOT_SPREAD = 64


def keep_first(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    carry: Sequence[str] = (),
    rare: bool = False,
) -> DataFrame:
    """One row per key: the first by ``order_by``; null keys are equal.

    An aggregation, not a window: each task first reduces its own rows to one
    per key, so a key that holds a third of the table sends one row per task.
    ``order_by`` has to identify a row, else ties are broken arbitrarily.
    ``carry`` names whole-number columns that are summed over the rows of a key;
    the number of rows merged is kept in a hidden column.

    ``rare`` says that few keys repeat; it changes the plan, not the result. A narrow
    pass over the hashes of the keys then makes a Bloom filter of those that repeat.
    Rows outside it have their key to themselves and are not exchanged; only the others
    take the aggregation. ``df`` is read three times and has to give the same rows each
    time. Keys of a type without a hash (maps) take the plan of all rows.
    """
    kinds = types_of(df)
    names = [c for c in df.columns if c not in carry] + [ROWS_IN, *carry]
    if not (rare and keys and all(can_hash(kinds[c]) for c in keys)):
        return pick(_first_of_groups(df, keys, order_by, carry), names)
    hashed = f"xxhash64({', '.join(q(c) for c in keys)})"
    twice = repeated_keys(df.selectExpr(f"{hashed} AS h"), "h")
    maybe = may_hold(bloom(twice.select("__key")), hashed)
    alone = assign(df.filter(~maybe), {ROWS_IN: "1L"} | {c: f"CAST({q(c)} AS BIGINT)" for c in carry})
    return pick(alone, names).unionByName(
        pick(_first_of_groups(df.filter(maybe), keys, order_by, carry), names))


def _first_of_groups(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], carry: Sequence[str]
) -> DataFrame:
    """The first row of each key, its rows counted and ``carry`` summed."""
    rest = [c for c in df.columns if c not in keys and c not in carry]
    out = {ROWS_IN: "count(1)"} | {c: f"sum({q(c)})" for c in carry}
    if rest:
        packed = "struct(" + ", ".join(q(c) for c in rest) + ")"
        order = "struct(" + ", ".join(q(c) for c in order_by) + ")"
        out = {"__first": f"min_by({packed}, {order})"} | out
    merged = aggregate(df, out, keys)
    return merged.selectExpr(
        *[q(c) for c in merged.columns if c != "__first"], *[f"`__first`.{q(c)} AS {q(c)}" for c in rest])


def distinct_rows(df: DataFrame, carry: Sequence[str] = (), rare: bool = False) -> DataFrame:
    """One row per distinct row."""
    return keep_first(df, [c for c in df.columns if c not in carry], [], carry, rare)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys (null included) found on more than one row, with their row count."""
    return (
        aggregate(df.selectExpr(f"{q(key)} AS `__key`"), {"__n": "count(1)"}, ["__key"])
        .filter("__n > 1")
    )


def flag_repeats(df: DataFrame, key: str, out: str, spread_by: Sequence[str]) -> DataFrame:
    """Add the boolean ``out``: the row's ``key`` occurs on several rows."""
    return flag_all_repeats(df, {key: out}, spread_by)


def flag_all_repeats(df: DataFrame, marks: Mapping[str, str], spread_by: Sequence[str]) -> DataFrame:
    """Add, for each (key, name) of ``marks``, the boolean ``name``: the row's key
    occurs on several rows.

    Every key is counted first, on its own column of ``df`` as it came, with a
    map-side combine; the repeated ones are written once. Plans therefore grow
    by one narrow scan per key. Where the repeated keys of all columns measure at most
    ``BROADCAST_BYTES``, they are broadcast and no row is exchanged. Beyond that, Bloom
    filters of them tell the rows that may hold one; only those rows are joined by a
    shuffle, the others are read once more and get ``FALSE``.
    """
    kinds = types_of(df)
    repeated = {key: staged(repeated_keys(df, key)) for key in marks}
    if all(_bytes_of(counts) <= BROADCAST_BYTES for counts in repeated.values()):
        for key, out in marks.items():
            names = list(df.columns)
            known = repeated[key].selectExpr("__key AS __known_key", "TRUE AS __known")
            df = df.join(F.broadcast(known), F.expr(f"{q(key)} <=> __known_key"), "left")
            df = assign(pick(df, [*names, "__known"]), {out: "coalesce(__known, FALSE)"}, drop=("__known",))
        return df
    if not all(can_hash(kinds[key]) for key in marks):
        return _join_repeats(df, marks, repeated, spread_by)
    maybe = F.lit(False)
    for key in marks:
        maybe = maybe | may_hold(bloom(repeated[key].selectExpr("xxhash64(__key) AS h")), f"xxhash64({q(key)})")
    alone = assign(df.filter(~maybe), {out: "FALSE" for out in marks.values()})
    return alone.unionByName(_join_repeats(df.filter(maybe), marks, repeated, spread_by))


def _bytes_of(counts: DataFrame) -> int:
    """Size of the repeated keys as text, with what each costs in a hash table."""
    size = f"coalesce(sum(coalesce(octet_length({text('__key')}), 0) + {ENTRY_BYTES}), 0)"
    return counts.selectExpr(f"{size} AS size").first()["size"]


def _join_repeats(
    df: DataFrame, marks: Mapping[str, str], repeated: Mapping[str, DataFrame], spread_by: Sequence[str]
) -> DataFrame:
    """The most frequent repeated keys (at most ``HOT_KEYS``, hence the safe broadcast)
    are matched without a shuffle, and their rows take part in the remaining join under
    a salt made of ``spread_by``, so they spread evenly. All other repeated keys are
    matched by an ordinary join, whose large partitions AQE splits."""
    names = list(df.columns)
    spread = f"xxhash64({', '.join(q(c) for c in spread_by)})"
    for key, out in marks.items():
        counts = repeated[key]
        hot = counts.orderBy(F.desc("__n"), F.asc("__key")).limit(HOT_KEYS).selectExpr("__key AS __hot_key", "TRUE AS __hot")
        rest = counts.join(F.broadcast(hot), F.expr("__key <=> __hot_key"), "left_anti").selectExpr(
            "__key AS __rest_key", "0 AS __rest_salt", "TRUE AS __rest"
        )
        df = df.join(F.broadcast(hot), F.expr(f"{q(key)} <=> __hot_key"), "left")
        df = assign(df, {
            "__salt": f"CASE WHEN __hot THEN CAST(1 + pmod({spread}, {HOT_SPREAD}) AS INT) ELSE 0 END"
        })
        df = df.join(rest, F.expr(f"{q(key)} <=> __rest_key AND __salt = __rest_salt"), "left")
        df = assign(
            pick(df, [*names, "__hot", "__rest"]),
            {out: "coalesce(__hot, __rest, FALSE)"}, drop=("__hot", "__rest"),
        )
        names.append(out)
    return df
