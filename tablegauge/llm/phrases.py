"""Collocations: phrases of two to four words that occur more often than chance.

Texts become sequences of word ids, gathered in shards of bounded size per language.
Over each shard stands an FM-index in both directions: the Burrows-Wheeler transform of
the sequence and of its reverse, sorted by as many words as a phrase may have. A phrase
is a pair of intervals, one in each; extending it by a word to the left narrows the one
by last-to-first mapping and the other by the counts of smaller words, to the right the
other way round. One step extends all phrases of a length at once.

A phrase counts only if its corpus-wide total reaches a bound, and then so do its parts.
Shards therefore ask, length by length, which of their phrases can reach it: they send
hashes and counts, dealt over ranges of the hash space, and get one bit back for each.
Colliding hashes can only let too many pass; the survivors are summed by their text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.common import BYTE_VALUES, RADIX, _powers, chunks, mixed, sliced, staged

LEAST, LONGEST, TOP = 30, 4, 2000
#: A candidate goes if a longer one has this share (in hundredths) of its occurrences.
COVERED = 80
UNNAMED = "und"
#: Symbols (words and ends of pieces) of a shard, and of all shards a task fills at once.
SHARD, HELD = 1 << 18, 1 << 20
#: Characters cut into words at once.
CHARS = 500_000
#: Hashes that one range of the hash space receives, about.
RANGE = 1 << 20
SEED = np.uint64(0xD6E8FEB86659FD93)

# --- fixed values: where texts are cut ---
BREAKS = np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
BLANKS = np.zeros(256, bool)
BLANKS[list(b" \t")] = True
# --- end of fixed values ---
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Sequence:
    """A growing sequence of word ids; 0 ends a piece, ids count from 1."""

    def __init__(self) -> None:
        self.place: dict[int, int] = {}  # of a word's hash
        self.words: list[bytes] = []
        self.parts: list[np.ndarray] = [np.zeros(1, np.int32)]
        self.symbols = 1

    def add(self, texts: list[str]) -> None:
        raw = LOWER[np.frombuffer("\n".join([*texts, ""]).encode("utf-8", "replace"), np.uint8)]
        inside = ~(BREAKS[raw] | BLANKS[raw])
        edges = np.flatnonzero(np.diff(inside, prepend=False))  # the text ends in a break
        first, last = edges[0::2], edges[1::2]
        if not len(first):
            return
        room = 1 << max(20, len(raw).bit_length())
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[raw] * _powers(room, RADIX)[:len(raw)], dtype=np.uint64)))
            hashes = mixed((sums[last] - sums[first]) * _powers(room, pow(RADIX, -1, 1 << 64))[first] + (last - first).astype(np.uint64) * SEED)
        codes, unique = pd.factorize(hashes)
        seen = np.zeros(len(unique), np.int64)
        seen[codes[::-1]] = np.arange(len(codes))[::-1]
        text, ids = raw.tobytes(), np.empty(len(unique), np.int32)
        for i, (value, a, b) in enumerate(zip(unique.tolist(), first[seen].tolist(), last[seen].tolist())):
            if (at := self.place.get(value)) is None:
                self.words.append(text[a:b])
                at = self.place[value] = len(self.words)
            ids[i] = at
        # A 0 goes where a break lies before a word.
        cut = np.cumsum(BREAKS[raw])
        ends = np.flatnonzero(np.diff(cut[first], append=cut[-1]))
        made = np.insert(ids[codes], ends + 1, 0)
        self.parts.append(made.astype(np.int32))
        self.symbols += len(made)


SHARDS = "shard long, lang string, words binary, ids binary, n long"


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """(shard, lang, words, ids, n): the sequences of word ids of all texts.

    Words are their bytes, ended by line breaks; ids little-endian 32-bit numbers. A text
    lies in one shard whole, so a longer one makes a larger shard.
    """

    def row(number: int, lang: str, of: Sequence) -> pa.RecordBatch:
        ids = np.concatenate(of.parts)
        return pa.RecordBatch.from_pydict({
            "shard": pa.array([number], pa.int64()), "lang": [lang], "words": pa.array([b"\n".join(of.words)], pa.binary()),
            "ids": pa.array([ids.astype("<u4").tobytes()], pa.binary()), "n": pa.array([int((ids > 0).sum())], pa.int64())})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, filling = TaskContext.get().partitionId() << 33, {}
        for batch in sliced(batches, 200):
            frame = batch.to_pandas()
            for lang, own in frame.groupby("lang", sort=False)["text"]:
                texts = own.tolist()
                for part in chunks(texts, CHARS):
                    of = filling.setdefault(lang, Sequence())
                    of.add(texts[part])
                    if of.symbols >= size:
                        yield row(number, lang, filling.pop(lang))
                        number += 1
            while sum(of.symbols for of in filling.values()) > HELD or len(filling) > 1000:
                lang = max(filling, key=lambda k: filling[k].symbols)
                yield row(number, lang, filling.pop(lang))
                number += 1
        for lang, of in filling.items():
            yield row(number, lang, of)
            number += 1

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNNAMED)).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.where("text <> ''").mapInArrow(work, SHARDS)


def _grouped(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of (a, b, place), and whether each begins a new (a, b)."""
    n = len(a)
    wide, low = int(a.max(initial=0)).bit_length(), int(b.max(initial=0)).bit_length()
    at = max(n - 1, 0).bit_length()
    if wide + low + at <= 64:  # one number holds all three, and sorts fast
        key = (a.astype(np.uint64) << np.uint64(low + at)) | (b.astype(np.uint64) << np.uint64(at)) | np.arange(n, dtype=np.uint64)
        key.sort()
        order = (key & np.uint64((1 << at) - 1)).astype(np.int64)
        key >>= np.uint64(at)
        return order, np.concatenate(([True], key[1:] != key[:-1])) if n else np.zeros(0, bool)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    return order, np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if n else np.zeros(0, bool)


class OneWay:
    """The transform of one reading direction, sorted by the next ``depth`` symbols, and
    the last-to-first mapping."""

    def __init__(self, ids: np.ndarray, depth: int):
        rank, reach = ids.astype(np.int64), 1
        while True:  # prefix doubling: ranks by one symbol, two, four
            order, new = _grouped(rank, np.roll(rank, -reach))
            reach *= 2
            if reach >= depth:
                break
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.cumsum(new) - 1
        self.bwt = np.roll(ids, 1)[order].astype(np.int32)  # the symbol before each suffix
        order, _ = _grouped(self.bwt, np.zeros(len(ids), np.int8))
        self.first = np.empty(len(ids), np.int32)
        self.first[order] = np.arange(len(ids))
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(ids))))  # of each symbol's suffixes


@dataclass
class Phrases:
    """All phrases of one length: their words, counts, and where their intervals begin in
    the index of what follows (``low``) and of what comes before (``back``)."""

    words: np.ndarray  # phrases x length
    count: np.ndarray
    low: np.ndarray
    back: np.ndarray

    def __len__(self) -> int:
        return len(self.count)

    def where(self, keep: np.ndarray) -> Phrases:
        return Phrases(self.words[keep], self.count[keep], self.low[keep], self.back[keep])


class Index:
    """An FM-index in both directions over a shard's word ids."""

    def __init__(self, ids: np.ndarray, depth: int = LONGEST):
        self.forward, self.reverse = OneWay(ids, depth), OneWay(ids[::-1], depth)
        self.symbols = len(self.forward.starts) - 1

    def single(self) -> Phrases:
        """The words."""
        words = np.arange(1, self.symbols)
        starts = self.forward.starts
        return Phrases(words[:, None], np.diff(starts)[1:], starts[words], starts[words])

    def extended(self, phrases: Phrases, left: bool) -> Phrases:
        """Every phrase with each word that stands before it (``left``) or after it."""
        way = self.forward if left else self.reverse
        narrowed, counted = (phrases.low, phrases.back) if left else (phrases.back, phrases.low)
        total = int(phrases.count.sum())
        ends = np.cumsum(phrases.count)
        owner = np.repeat(np.arange(len(phrases)), phrases.count)
        rows = np.arange(total) - np.repeat(ends - phrases.count - narrowed, phrases.count)
        symbol = way.bwt[rows]
        order, new = _grouped(owner, symbol)
        at = np.flatnonzero(new)
        count, chosen = np.diff(at, append=total), order[at]
        owner, symbol = owner[chosen], symbol[chosen]
        low = way.first[rows[chosen]]  # the first row of a word in an interval maps to the new one's first
        back = counted[owner] + at - (ends - phrases.count)[owner]  # after all smaller words
        real = symbol > 0
        owner, symbol, count, low, back = (x[real] for x in (owner, symbol, count, low, back))
        words = np.column_stack((symbol, phrases.words[owner]) if left else (phrases.words[owner], symbol))
        return Phrases(words, count, low, back) if left else Phrases(words, count, back, low)


class Shard:
    """A shard's index and the hashes of its phrases."""

    def __init__(self, lang: str, words: bytes, ids: bytes):
        self.lang, self.raw = lang, words
        self.index = Index(np.frombuffer(ids, "<u4").astype(np.int64))
        self.spelled = words.split(b"\n")
        by_word = pd.util.hash_array(np.array([w.decode("utf-8", "replace") for w in self.spelled], object), categorize=False)
        own = pd.util.hash_array(np.array([lang], object), categorize=False)[0]
        self.hashes = mixed(np.concatenate((np.zeros(1, np.uint64), by_word)) ^ own)

    def keys(self, phrases: Phrases) -> np.ndarray:
        value = np.full(len(phrases), phrases.words.shape[1], np.uint64)
        with np.errstate(over="ignore"):
            for column in phrases.words.T:
                value = mixed(value * SEED + self.hashes[column])
        return value

    def first_round(self) -> list[Phrases]:
        """Words and pairs."""
        words = self.index.single()
        return [words, self.index.extended(words, left=False)]

    def second_round(self, pairs: Phrases) -> list[Phrases]:
        """Longer phrases all of whose pairs are among ``pairs``."""
        known = np.sort(pairs.words[:, 0] * self.index.symbols + pairs.words[:, 1])
        out, phrases, left = [], pairs, True
        for _ in range(LONGEST - 2):
            phrases = self.index.extended(phrases, left)
            new = phrases.words[:, :2] if left else phrases.words[:, -2:]
            if len(known):
                value = new[:, 0] * self.index.symbols + new[:, 1]
                at = np.minimum(np.searchsorted(known, value), len(known) - 1)
                phrases = phrases.where(known[at] == value)
            out.append(phrases)
            left = not left
        return out


ASKED = "part int, shard long, hashes binary, counts binary"


def _asked(shard: int, keys: np.ndarray, counts: np.ndarray, ranges: int, least: int) -> Iterator[pa.RecordBatch]:
    """What a shard sends to each range of hashes, in the order of its phrases there."""
    part = (keys >> np.uint64(32)) % np.uint64(ranges)
    order, new = _grouped(part, np.zeros(len(part), np.int8))
    cuts = np.append(np.flatnonzero(new), len(part))
    low, few = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")[order], np.minimum(counts, least).astype("<u4")[order]
    few = few.astype("u1") if least < 256 else few
    yield pa.RecordBatch.from_pydict({
        "part": pa.array(part[order][cuts[:-1]].astype(np.int32), pa.int32()), "shard": pa.array([shard] * (len(cuts) - 1), pa.int64()),
        "hashes": pa.array([low[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
        "counts": pa.array([few[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})


def answered(asked: DataFrame, least: int) -> DataFrame:
    """(shard, part, bits): which of the hashes that a shard sent to a range have a total
    of ``least`` or more over all shards."""
    wide = "u1" if least < 256 else "<u4"

    def answer(table: pa.Table) -> pa.Table:
        sent, counts = table.column("hashes").to_pylist(), table.column("counts").to_pylist()
        every = np.frombuffer(b"".join(sent), "<u4")
        codes, unique = pd.factorize(every)
        total = np.bincount(codes, np.frombuffer(b"".join(counts), wide), len(unique))
        enough = (total >= least)[codes]
        ends = np.cumsum([len(s) // 4 for s in sent])
        bits = [np.packbits(enough[a:b]).tobytes() for a, b in zip([0, *ends[:-1]], ends)]
        return pa.Table.from_pydict({"shard": table.column("shard"), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})

    return asked.groupBy("part").applyInArrow(answer, "shard long, part int, bits binary")


def _enough(keys: np.ndarray, ranges: int, bits: list[tuple[int, bytes]]) -> np.ndarray:
    """The answers, in the order of ``keys``."""
    part = (keys >> np.uint64(32)) % np.uint64(ranges)
    order, _ = _grouped(part, np.zeros(len(part), np.int8))
    size = np.bincount(part.astype(np.int64), minlength=ranges)
    out = np.zeros(len(keys), bool)
    told = [np.unpackbits(np.frombuffer(b, np.uint8), count=size[p]) for p, b in sorted(bits)]
    out[order] = np.concatenate(told).astype(bool) if told else False
    return out


def counted(docs: DataFrame, least: int = LEAST, size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of up to four words that occur ``least``
    times or more, and (lang, n) with all word occurrences."""
    parts = staged(shards(docs, size))
    symbols = parts.agg(F.sum(F.length("ids") / 4)).first()[0] or 0
    ranges = 1 << max(0, int(symbols / RANGE).bit_length())

    def each(use: Callable[[dict, Shard], Iterator[pa.RecordBatch]]) -> Callable:
        """A task that builds one shard's index after the other."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                    yield from use(row, Shard(row["lang"], row.pop("words"), row.pop("ids")))
                    pa.default_memory_pool().release_unused()

        return work

    def split(of: list[Phrases], keep: np.ndarray) -> list[Phrases]:
        cuts = np.cumsum([len(p) for p in of])[:-1]
        return [p.where(k) for p, k in zip(of, np.split(keep, cuts))]

    def sent(shard: int, own: Shard, of: list[Phrases]) -> Iterator[pa.RecordBatch]:
        return _asked(shard, np.concatenate([own.keys(p) for p in of]), np.concatenate([p.count for p in of]), ranges, least)

    def passed(own: Shard, of: list[Phrases], bits: list[dict]) -> list[Phrases]:
        keys = np.concatenate([own.keys(p) for p in of])
        return split(of, _enough(keys, ranges, [(b["part"], b["bits"]) for b in bits or []]))

    def ask_pairs(row: dict, own: Shard) -> Iterator[pa.RecordBatch]:
        return sent(row["shard"], own, own.first_round())

    def ask_longer(row: dict, own: Shard) -> Iterator[pa.RecordBatch]:
        pairs = passed(own, own.first_round(), row["pairs"])[1]
        return sent(row["shard"], own, own.second_round(pairs))

    def spell(row: dict, own: Shard) -> Iterator[pa.RecordBatch]:
        short = passed(own, own.first_round(), row["pairs"])
        for of in short + passed(own, own.second_round(short[1]), row["longer"]):
            columns = [[own.spelled[i - 1] for i in column] for column in of.words.T.tolist()]
            text = [b" ".join(w).decode("utf-8", "replace") for w in zip(*columns)]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([row["lang"]] * len(of), pa.string()), "phrase": pa.array(text, pa.string()),
                "words": pa.array([of.words.shape[1]] * len(of), pa.int32()), "f": pa.array(of.count, pa.int64())})

    def told(asked: DataFrame, name: str) -> DataFrame:
        """One row per shard with all its answers, a bit for each phrase it asked for."""
        return answered(asked, least).groupBy("shard").agg(F.collect_list(F.struct("part", "bits")).alias(name))

    pairs = staged(told(parts.mapInArrow(each(ask_pairs), ASKED), "pairs"))
    with_pairs = parts.join(pairs, "shard", "left")
    longer = staged(told(with_pairs.mapInArrow(each(ask_longer), ASKED), "longer"))
    spelled = with_pairs.join(longer, "shard", "left").mapInArrow(each(spell), "lang string, phrase string, words int, f long")
    table = spelled.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return staged(table), parts.groupBy("lang").agg(F.sum("n").cast("long").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, size: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases.

    Texts are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line breaks, and those
    into words at blanks and tabs. A candidate of two to four words occurs a >= ``least``
    times within pieces of its language (null: ``und``). Its weakest cut, into parts that
    occur l and r times, gives the score floor(2000000 a / (l + r)), ties to the shorter
    first part. Candidates within a longer one that has at least ``COVERED`` hundredths
    of their occurrences are dropped. Order: score, a, both falling, then the phrase's
    bytes. Null and empty texts have no words; repeated rows count each time; long texts
    are counted whole; doc_id and other columns are ignored; an empty table, or one with
    too few occurrences, gives no rows.
    """
    table, total = counted(docs, least, size)
    # A longer phrase holds a shorter one through phrases that are one word longer each and
    # at least as frequent, so one word more at either end is all there is to look at.
    parts = F.split("phrase", " ")
    head, tail = F.array_join(F.slice(parts, 1, F.col("words") - 1), " "), F.array_join(F.slice(parts, 2, F.col("words") - 1), " ")
    inner = table.where("words > 2").select("lang", F.explode(F.array_distinct(F.array(head, tail))).alias("phrase"), "f")
    longest = inner.groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    kept = table.where("words > 1").join(longest, ["lang", "phrase"], "left").where(
        F.col("cover").isNull() | (F.col("cover").cast("decimal(38,0)") * 100 < F.col("f").cast("decimal(38,0)") * COVERED))

    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = kept.select("lang", "phrase", "words", F.col("f").alias("a"), cut).withColumns({
        "first": F.array_join(F.slice(parts, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " ")})
    left, right = (table.select("lang", F.col("phrase").alias(p), F.col("f").alias(c)) for p, c in (("first", "l"), ("rest", "r")))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn(
        "score", F.expr("CAST((CAST(a AS DECIMAL(20,0)) * 2000000) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS LONG)"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    found = weakest.select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for groups in (1024, 32):  # no task ranks all phrases of a frequent language
        salt = F.pmod(F.xxhash64("phrase"), F.lit(groups))
        at = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
        found = found.withColumn("salt", salt).withColumn("at", at).where(F.col("at") <= top).drop("salt", "at")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
