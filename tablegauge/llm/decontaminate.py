"""Benchmark passages in documents, by spaced seeds; DataFrame functions only.

A seed is a window of up to ``SPAN`` tokens of which a fixed mask looks at some and
ignores the others, so a substituted word at an ignored place does not hide a
passage. Every window of every document is hashed under each mask and joined with
the windows of the benchmark. A hit fixes a diagonal (document place minus item
place); along it the tokens are compared, and every best run under +1 for an equal
and -2 for a different token is kept if it is long and equal enough. A run ends where
its score falls to 0 or by ``DROP`` below its best.

An item of at most ``SHORT`` tokens also counts as a whole, if three quarters of
its tokens are equal at their places; under ``EXACT`` tokens, all. Such an item is
cut into one part more than tokens may differ, so that one part is always intact:
these parts are its seeds. Fewer than ``LINE`` tokens occur in any text by chance, so
such an item counts only where it is a whole line or the whole text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import staged

SPAN = 12
#: The token places each mask looks at; eight of twelve.
MASKS = ((0, 1, 2, 4, 6, 7, 9, 11), (0, 1, 3, 4, 5, 8, 10, 11), (0, 2, 3, 5, 6, 8, 9, 10), (1, 2, 3, 5, 7, 9, 10, 11))
#: Windows handled as one array, so that a long text is not one row of windows.
BLOCK = 4096
MIN_TOKENS, MIN_EQUAL, MIN_SHARE = 12, 10, 0.75
#: Items of up to so many tokens are judged as a whole too; shorter than ``EXACT``, only when repeated word by word.
SHORT, EXACT = 20, 8
#: Items of fewer tokens count only as a whole line or text.
LINE = 5
#: A run ends where its score is so much below its best.
DROP = 12
#: Benchmark seeds that are broadcast; a larger benchmark is joined by shuffle.
BROADCAST_SEEDS = 2_000_000
#: Hit texts (two numbers each) that are broadcast to find their words; more are joined by shuffle.
BROADCAST_TEXTS = 1_000_000
Places = tuple[int, ...]


def tokens(text: Column | str = "text") -> Column:
    """Hashes of the words of a text: letters and digits, in lower case."""
    return hashes(F.lower(F.coalesce(text, F.lit(""))))


def hashes(lower: Column) -> Column:
    return F.transform(F.filter(F.split(lower, r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def seeds(rows: DataFrame, *keys: str, masks: Sequence[Places] = MASKS) -> DataFrame:
    """(keys, at, mask, seed): every window under every mask, of rows with ``words``;
    one pass for all masks. A window has to reach the last place its mask looks at."""
    size, span = F.size("words"), max(m[-1] for m in masks) + 1
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(BLOCK)))
    blocks = rows.select(*keys, F.explode(F.transform(starts, lambda s: F.struct(
        s.alias("start"), F.slice(F.col("words"), s + 1, BLOCK).alias("own"), F.slice(F.col("words"), s + 1, BLOCK + span - 1).alias("with_next")))).alias("b")).select(*keys, "b.*")
    # Beyond the end of the text tokens are null, and masks that look there give no seed.
    columns = [F.col("own").alias("t0")] + [F.slice(F.col("with_next"), F.lit(i + 1), F.size("own")).alias(f"t{i}") for i in range(1, span)]
    windows = blocks.select(*keys, "start", F.posexplode(F.arrays_zip(*columns)).alias("at", "t")).select(
        *keys, (F.col("start") + F.col("at")).alias("at"), *(F.col(f"t.t{i}").alias(f"t{i}") for i in range(span)))
    hashed = F.array(*(F.when(F.col(f"t{mask[-1]}").isNotNull(), F.xxhash64(F.lit(m), *(f"t{i}" for i in mask)))
                       for m, mask in enumerate(masks)))
    return windows.select(*keys, "at", F.posexplode(hashed).alias("mask", "seed")).where(F.col("seed").isNotNull())


def differing(size: Column) -> Column:
    """How many tokens of a short item of ``size`` may differ."""
    return F.when(size < EXACT, F.lit(0)).otherwise(F.floor(size * (1 - MIN_SHARE))).cast("int")


def item_seeds(items: DataFrame) -> tuple[DataFrame, list[Places]]:
    """(item_id, item_at, seed) of ``items`` (item_id, words), and the masks used: those
    of whole windows, and one per width of the parts of short items."""
    size = F.size("words")
    is_short = (size >= LINE) & (size <= SHORT)
    cut = items.select("item_id", "words", F.when(is_short, F.floor(size / (differing(size) + 1)).cast("int")).alias("width"),
                       (differing(size) + 1).alias("parts"))
    widths = [r["width"] for r in cut.where("width IS NOT NULL").select("width").distinct().orderBy("width").collect()]
    masks = [*MASKS, *(tuple(range(w)) for w in widths)]
    found = seeds(cut, "item_id", "width", "parts", masks=masks)
    is_part = (F.col("at") % F.col("width") == 0) & (F.col("at") < F.col("width") * F.col("parts"))
    of_width = F.lit(False)
    for m, w in enumerate(widths, len(MASKS)):
        of_width = of_width | ((F.col("mask") == m) & (F.col("width") == w))
    kept = found.where((F.col("mask") < len(MASKS)) | (of_width & is_part))
    return kept.select("item_id", F.col("at").alias("item_at"), "seed").distinct(), masks


def runs(equal: Column) -> Column:
    """Every run (lo, hi, same) of an array of 0 and 1 that is long and equal enough:
    its first place, the place after its last, and its equal tokens."""
    start = F.expr("named_struct('at', 0, 'first', 0, 'score', 0, 'hit', 0, 'best', 0, 'hi', 0, 'same', 0, "
                   "'found', CAST(array() AS array<struct<lo:int,hi:int,same:int>>))")

    def closed(s: Column) -> Column:
        size = s["hi"] - s["first"]
        good = (size >= MIN_TOKENS) & (s["same"] >= MIN_EQUAL) & (s["same"] >= MIN_SHARE * size)
        own = F.struct(s["first"].alias("lo"), s["hi"].alias("hi"), s["same"].alias("same"))
        return F.when(good, F.concat(s["found"], F.array(own))).otherwise(s["found"])

    def step(s: Column, e: Column) -> Column:
        score = s["score"] + F.when(e == 1, 1).otherwise(-2)
        ends = (score <= 0) | (score <= s["best"] - DROP)
        better = score > s["best"]
        after = s["at"] + 1

        def kept(going: Column, fresh: Column | int = 0) -> Column:
            return F.when(ends, F.lit(fresh) if isinstance(fresh, int) else fresh).otherwise(going)

        return F.struct(
            after.alias("at"), kept(s["first"], after).alias("first"), kept(score).alias("score"), kept(s["hit"] + e).alias("hit"),
            kept(F.greatest(s["best"], score)).alias("best"), kept(F.when(better, after).otherwise(s["hi"])).alias("hi"),
            kept(F.when(better, s["hit"] + e).otherwise(s["same"])).alias("same"),
            F.when(ends, closed(s)).otherwise(s["found"]).alias("found"))

    return F.aggregate(equal, start, step, closed)


def line_hits(docs: DataFrame, tiny: DataFrame) -> DataFrame:
    """Rows of ``overlaps`` for items of fewer than ``LINE`` tokens (item_id, item_words):
    the lines of a text, and a text of several lines as a whole, that equal one."""
    lines = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), "[\n-\r]"), hashes)
    rows = docs.select("doc_id", "text_hash", F.filter(lines, lambda w: F.size(w) > 0).alias("lines"))
    whole = F.flatten("lines")
    units = F.when((F.size("lines") > 1) & (F.size(whole) < LINE), F.concat("lines", F.array(whole))).otherwise(F.col("lines"))
    sizes = F.transform("lines", F.size)
    found = rows.select("doc_id", "text_hash", sizes.alias("sizes"), F.posexplode(units).alias("place", "words"))
    found = found.where(F.size("words") < LINE)
    if tiny.count() <= BROADCAST_SEEDS:
        tiny = F.broadcast(tiny)
    found = found.join(tiny, F.col("words") == F.col("item_words"))
    before = F.when(F.col("place") < F.size("sizes"), F.aggregate(F.slice("sizes", F.lit(1), F.col("place")), F.lit(0), lambda s, n: s + n)).otherwise(0)
    size = F.size("words").cast("long")
    return found.select("doc_id", "text_hash", "item_id", before.cast("long").alias("doc_start"), F.lit(0).cast("long").alias("item_start"),
                        size.alias("n_tokens"), size.alias("n_equal"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every verified overlap of a row of ``docs`` with an item of ``benchmark``.

    Returns doc_id, text_hash, item_id, doc_start, item_start, n_tokens, n_equal
    (places count tokens from 0). A null or empty text has none. Of an item of
    fewer than twelve tokens only the whole counts; one of fewer than five only where
    it is a whole line or text. Several passages of one item, or one that occurs twice
    in a text, give a row each; equal rows of ``docs`` each give theirs; items with
    equal texts each match; empty tables give no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    items = staged(benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens().alias("item_words")))
    own, masks = item_seeds(items.withColumnRenamed("item_words", "words"))
    own = staged(own)
    if own.count() <= BROADCAST_SEEDS:
        own = F.broadcast(own)
    found = seeds(docs.select("doc_id", "text_hash", tokens().alias("words")), "doc_id", "text_hash", masks=masks).join(own, "seed")
    hits = staged(found.select("doc_id", "text_hash", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    met = staged(hits.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct())
    if met.count() <= BROADCAST_TEXTS:
        met = F.broadcast(met)
    rows = docs.join(met, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi")
    rows = rows.select("doc_id", "text_hash", tokens().alias("words"))
    pairs = hits.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "item_id", "shift").join(items, "item_id")
    both = rows.join(pairs, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    a, b = F.greatest(F.col("shift"), F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    length = F.least(F.size("words") - a, F.size("item_words") - b)
    equal = F.zip_with(F.slice("words", a + 1, length), F.slice("item_words", b + 1, length), lambda x, y: (x == y).cast("int"))
    along = both.select("doc_id", "text_hash", "item_id", F.size("item_words").alias("n"), length.alias("length"), a.alias("a"), b.alias("b"),
                        runs(equal).alias("runs"), F.aggregate(equal, F.lit(0), lambda s, e: s + e).alias("same"))
    n = F.col("n")
    whole = (n >= LINE) & (n <= SHORT) & (F.col("length") == n) & (n - F.col("same") <= differing(n))
    all_of_it = F.array(F.struct(F.lit(0).alias("lo"), n.alias("hi"), F.col("same").alias("same")))
    kept = F.when(F.size("runs") > 0, F.col("runs")).when(whole, all_of_it)
    long_hits = along.select("doc_id", "text_hash", "item_id", "a", "b", F.explode(kept).alias("r")).select(
        "doc_id", "text_hash", "item_id", (F.col("a") + F.col("r.lo")).cast("long").alias("doc_start"), (F.col("b") + F.col("r.lo")).cast("long").alias("item_start"),
        (F.col("r.hi") - F.col("r.lo")).cast("long").alias("n_tokens"), F.col("r.same").cast("long").alias("n_equal"))
    tiny = items.where((F.size("item_words") > 0) & (F.size("item_words") < LINE))
    return long_hits if tiny.isEmpty() else long_hits.union(line_hits(docs, tiny))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a verified overlap, columns unchanged.

    Null and empty texts are kept, as is every row where ``benchmark`` is empty; of
    equal rows all go or all stay; texts are compared whole; an empty table gives none.
    """
    bad = staged(overlaps(docs, benchmark).select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).distinct())
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__doc"]) & (text_hash() == bad["__hash"]), "left_anti")
