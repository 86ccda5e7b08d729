"""Secrets in texts, by a trigram index over the rules' mandatory trigrams.

From each rule's expression a Boolean query over trigrams is derived: strings that
every match must hold, as alternatives of trigram sets. An inverted index with the
posting lists of those trigrams is written; intersecting and joining lists gives
each rule's candidate rows, and only they are searched with the expression. A rule
without mandatory trigrams is searched in every row. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser  # type: ignore[attr-defined]

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import staged


@dataclass(frozen=True)
class Rule:
    """``group`` must have at least ``least`` characters, else a match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# --- fixed values: the base rules ---
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# --- end of fixed values ---
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE
#: Alternatives a derived query may have; beyond, strings are cut where they are.
MOST = 64
Query = tuple[tuple[frozenset[str], ...], ...]


def _strings(nodes: list) -> list[set[str] | None]:
    """The exact lower-case strings of each part of an expression; None where a part
    has none or too many."""
    out: list[set[str] | None] = []
    for op, value in nodes:
        name = str(op)
        if name == "LITERAL":
            out.append({chr(value).lower()})
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in value) and len(value) <= 8:
            out.append({chr(v).lower() for _, v in value})
        elif name == "SUBPATTERN":
            out += _strings(list(value[-1]))
        elif name == "BRANCH":
            every: set[str] | None = set()
            for branch in value[1]:
                whole = _joined(_strings(list(branch)))
                every = None if every is None or len(whole) != 1 or whole[0] is None else every | whole[0]
            out.append(every)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            whole = _joined(_strings(list(inner)))
            exact = whole[0] if len(whole) == 1 else None
            if exact is not None and (low, high) == (0, 1):
                out.append(exact | {""})
            elif exact is not None and low == high and low <= 8:
                out += [exact] * low
            else:
                out.append(None)
        else:
            out.append(None)
    return out


def _joined(parts: list[set[str] | None]) -> list[set[str] | None]:
    """Neighbouring exact parts as one set of strings each."""
    out: list[set[str] | None] = []
    for part in parts:
        if part is not None and out and out[-1] is not None and len(out[-1]) * len(part) <= MOST:
            out[-1] = {a + b for a, b in product(out[-1], part)}
        else:
            out.append(part)
    return out


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> Query:
    """What every match holds: all of the parts, each one of alternative sets of
    trigrams (in lower case). Empty where nothing is mandatory."""
    parts = _joined(_strings(list(_parser.parse(pattern))))
    return tuple(tuple(sorted((trigrams(s) for s in part), key=sorted)) for part in parts if part and min(map(len, part)) >= 3)


def index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (trigram, key) of the given trigrams over rows with key and text."""
    low = F.lower("text")
    held = F.array_compact(F.array(*(F.when(low.contains(g), F.lit(g)) for g in grams)))
    return docs.select("key", F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): the rules whose trigram query each row's postings meet."""

    def met(query: Query) -> Column:
        every = F.lit(True)
        for part in query:
            some = F.lit(False)
            for grams in part:
                some |= F.size(F.array_intersect("held", F.array(*map(F.lit, sorted(grams))))) == len(grams)
            every &= some
        return every

    lists = postings.groupBy("key").agg(F.collect_set("trigram").alias("held"))
    kinds = F.array_compact(F.array(*(F.when(met(q), F.lit(k)) for k, q in queries.items())))
    return lists.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def spans(rule: Rule, number: int) -> Column:
    """The rule's matches in ``text`` as structs (start, number, end), in order of start."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    between = F.split(text, rule.pattern, -1)  # what lies before, between and after the matches
    each = F.arrays_zip(
        F.transform(between, lambda p: F.length(p)).alias("gap"), F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m)).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m)).alias("held"))
    start = F.expr("named_struct('at', 0, 'out', CAST(array() AS array<struct<start: int, number: int, end: int>>))")

    def step(s: Column, m: Column) -> Column:
        first = s["at"] + m["gap"]
        last = first + F.coalesce(m["size"], F.lit(0))
        found = F.array(F.struct(first.alias("start"), F.lit(number).alias("number"), last.alias("end")))
        kept = m["size"].isNotNull() & (m["held"] >= rule.least)
        return F.struct(last.alias("at"), F.when(kept, F.concat(s["out"], found)).otherwise(s["out"]).alias("out"))

    return F.aggregate(each, start, step)["out"]


def listed(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end by start, then rule, joined by commas."""
    kind = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(
        ":", F.get(kind, s["number"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """Secrets of every row of ``docs``: doc_id, a count for each of the first
    ``base`` rules and a digest of their spans, and ``spans`` of all rules.

    A null or empty text has none. Offsets count code points. Rows repeat as in
    ``docs``, null doc_ids stay, other columns are ignored, no rows give none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for part in q for some in part for g in some})
    found = candidates(staged(index(rows, grams)), queries)
    searched = rows.join(found.withColumnRenamed("key", "own"), F.col("key") == F.col("own"), "left")
    none = F.expr("CAST(array() AS array<struct<start: int, number: int, end: int>>)")
    columns = []
    for i, rule in enumerate(rules):
        wanted = F.array_contains("kinds", rule.kind) if rule.kind in queries else F.lit(True)
        columns.append(F.when(F.coalesce(wanted, F.lit(False)), spans(rule, i)).otherwise(none).alias(rule.kind))
    each = searched.select("doc_id", *columns)
    first, every = F.concat(*(r.kind for r in rules[:base])), F.concat(*(r.kind for r in rules))
    return each.select("doc_id", *(F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in rules[:base]),
                       F.sha2(listed(first, rules), 256).alias("base_sha256"), listed(every, rules).alias("spans"))
