"""Near-duplicate texts by order MinHash and banded alignment.

The k-mers of a text are its runs of five words, each labelled with its
occurrence number. A sketch takes the ``PICKED`` k-mers with the smallest hash
values and keeps them in text order, so two texts agree on it only where they
share k-mers in the same order. Texts that agree on one of ``SKETCHES`` sketches
are candidates. A candidate counts when a banded alignment needs edits of no more
than a fifth of the longer text's words. First each member of a bucket is aligned
with the bucket's shortest and longest text and its hub; then all pairs of a bucket
whose texts are not connected yet are tried, in blocks, so that two texts that
share a bucket and are alike are always in one class.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import Words, chunks, mixed, sliced, staged
from tablegauge.llm.components import components

K = 5
PICKED = 3
SKETCHES = 40
SIMILAR = 0.8
#: Words from which an alignment through shared k-mers is tried before a full one.
LONG = 2000
#: Texts whose lengths differ by more than a class are not alike.
CLASS = math.log(1 / SIMILAR) + 1e-9
#: Texts of a bucket that are compared with one another, or with as many more, in one step.
BLOCK = 256
MULTIPLIERS = np.random.default_rng(5).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_key() -> Column:
    """Identifies a text; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("key")


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Hashes told apart by occurrence: the second equal one differs from the first."""
    order = hashes.argsort(kind="stable")
    ranked, each = hashes[order], np.arange(len(hashes))
    first = np.where(np.concatenate(([True], ranked[1:] != ranked[:-1])), each, 0) if len(hashes) else each
    count = np.empty(len(hashes), np.uint64)
    count[order] = each - np.maximum.accumulate(first)
    with np.errstate(over="ignore"):
        return mixed(hashes + count * np.uint64(0xD6E8FEB86659FD93))


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the runs of k words; of the whole where it is shorter."""
    k = min(k, len(words))
    with np.errstate(over="ignore"):
        total = np.zeros(max(len(words) - k + 1, 1), np.uint64)
        for j in range(k):
            total = (total + words[j:len(words) - k + 1 + j]) * MULTIPLIERS[j]
    return mixed(total)


def sketches(words: np.ndarray, many: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """Order MinHash sketches of a text given by its words' hashes."""
    grams = kmers(words)
    values = labelled(grams)
    picked = min(picked, len(values))
    seeds = MULTIPLIERS[16:16 + many]
    rows = max(1, 2_000_000 // len(values))
    chosen = np.empty((many, picked), np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, many, rows):
            grid = values[None, :] * seeds[at:at + rows, None]
            each = np.arange(len(grid))
            for p in range(picked):
                best = grid.argmin(axis=1)
                chosen[at:at + rows, p] = best
                grid[each, best] = np.uint64(2**64 - 1)
        chosen.sort(axis=1)  # text order
        total = np.arange(many, dtype=np.uint64)
        for p in range(picked):
            total = mixed(total + grams[chosen[:, p]] * MULTIPLIERS[8 + p])
    return total.view(np.int64)


def rising(values: np.ndarray) -> np.ndarray:
    """Places of a longest rising subsequence of distinct numbers."""
    if (np.diff(values) > 0).all():
        return np.arange(len(values))
    tails: list[int] = []
    ends: list[int] = []
    before = []
    for i, v in enumerate(values.tolist()):
        at = bisect_left(tails, v)
        before.append(ends[at - 1] if at else -1)
        tails[at:at + 1] = [v]
        ends[at:at + 1] = [i]
    out, i = [], ends[-1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1])


def shared(a: np.ndarray, b: np.ndarray, q: int) -> int:
    """q-grams of two word sequences in common, with repetition."""
    if min(len(a), len(b)) < q:
        return 0
    return len(np.intersect1d(*(labelled(kmers(w.astype(np.uint64), q)) for w in (a, b)), assume_unique=True))


def anchored(a: np.ndarray, b: np.ndarray, k: int = 3) -> int:
    """Edits of an alignment through shared k-mers in rising order: an upper bound
    of the edit distance, close where edits are few."""
    if min(len(a), len(b)) < k:
        return max(len(a), len(b))
    x, y = (labelled(kmers(w.astype(np.uint64), k)) for w in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return max(len(a), len(b))
    order = i.argsort()
    i, j = i[order], j[order]
    chain = rising(j)
    i, j = i[chain], j[chain]
    p, r = np.diff(i) - 1, np.diff(j) - 1  # words between neighbouring anchors' first words
    between = np.maximum(p, r) - np.minimum(np.minimum(p, r), k - 1)
    return int(max(i[0], j[0]) + between.sum() + max(len(a) - i[-1] - k, len(b) - j[-1] - k))


def spots(words: np.ndarray) -> tuple[dict[int, list[int]], dict[int, int]]:
    """Where each word stands; of words that stand in more than four places also as bits."""
    places: dict[int, list[int]] = {}
    for i, word in enumerate(words.tolist()):
        places.setdefault(word, []).append(i)
    return places, {word: sum(1 << i for i in at) for word, at in places.items() if len(at) > 4}


def banded(a: np.ndarray, b: np.ndarray, most: int, known: tuple | None = None) -> bool:
    """Whether ``most`` edits turn a into b, by a column-wise alignment in a band.
    ``known``: the ``spots`` of a, which then must not be the shorter one.

    Only the cells within ``most`` of the diagonal count. A column's are held as the bits
    of whole numbers that say where values rise or fall by one from cell to cell; the
    next column follows from them by a few operations on all bits at once.
    """
    if known is None and len(a) < len(b):
        a, b = b, a
    places, often = known or spots(a)
    # Bit k of a column j stands for row j + k - most; rows count from 1.
    width = 2 * most + 1
    mask, top, centre = (1 << width) - 1, 1 << (width - 1), 1 << most
    rise, fall = mask ^ ((centre << 1) - 1), (centre << 1) - 1
    extra, on_diagonal = len(a) - len(b), 0
    for j, word in enumerate(b.tolist()):
        shift = j - most  # of the row whose bit is the lowest, counted from 0
        if (same := often.get(word)) is not None:
            same = (same >> shift if shift >= 0 else same << -shift) & mask
        else:
            same = 0
            for i in places.get(word, ()):
                if 0 <= i - shift < width:
                    same |= 1 << (i - shift)
        rise, fall = (rise >> 1) | top, fall >> 1  # the same rows, a column later
        level = (((same & rise) + rise) ^ rise | same | fall) & mask  # as its upper left neighbour
        if not level & centre:
            on_diagonal += 1
            if on_diagonal > most + extra:
                return False
        up, down = (fall | ~(level | rise)) & mask, level & rise  # from the column before
        up = up << 1 | 1
        rise, fall = (down << 1 | ~(level | up)) & mask, up & level
    below = ((1 << extra) - 1) << (most + 1)
    return on_diagonal + (rise & below).bit_count() - (fall & below).bit_count() <= most


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether ``most`` edits (insertions, deletions, substitutions) turn a into b.

    Equal places settle many pairs that are alike, counts of shared q-grams most that are
    not; an alignment in a band of what is between the common ends decides the others.
    """
    if abs(len(a) - len(b)) > most:
        return False
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    if len(a) == len(b) and len(differ) <= most:
        return True
    for q in (3, 2):  # an edit changes at most q of the q-grams
        if shared(a, b, q) < max(len(a), len(b)) - q + 1 - q * most:
            return False
    if short > LONG and anchored(a, b) <= most:
        return True
    front = int(differ[0]) if len(differ) else short
    a, b = a[front:], b[front:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - short:][::-1] != b[len(b) - short:][::-1])
    back = int(differ[0]) if len(differ) else short
    return banded(a[:len(a) - back], b[:len(b) - back], most)


def alike(a: np.ndarray, b: np.ndarray, similar: float = SIMILAR) -> bool:
    """Whether the edit similarity of two word sequences reaches ``similar``."""
    longest = max(len(a), len(b))
    return within(a, b, int((1 - similar) * longest + 1e-9))


def word_hashes(texts: list[str]) -> Iterator[np.ndarray]:
    """The hashes of each text's words, in lower case."""
    for part in chunks(texts):
        words = Words([text.lower() for text in texts[part]])
        every = words.hashes[words.at]
        yield from (every[a:b] for a, b in zip(words.starts, words.ends))


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, sketch) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            size, made = [], []
            for words in word_hashes(batch.column("text").to_pylist()):
                size.append(len(words))
                made.append(sketches(words) if len(words) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "key": batch.column("key").cast(pa.binary()), "n_words": pa.array(size, pa.int32()),
                "sketch": pa.array(made, pa.list_(pa.int64()))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_key())
    return rows.mapInArrow(work, "doc_id long, key binary, n_words int, sketch array<bigint>")


def memberships(nodes: DataFrame) -> DataFrame:
    """(key, n_words, slot, bucket): every text in the bucket of each of its sketches."""
    return nodes.select("key", "n_words", F.posexplode("sketch").alias("slot", "bucket"))


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b, hits): members of a bucket with its shortest and longest text and with
    its hub, the text that meets most others in all its buckets."""
    member = memberships(nodes)
    met = staged(member.join(member.groupBy("bucket").agg(F.count("*").alias("met")).where("met > 1"), "bucket"))
    member = met.join(met.groupBy("key").agg(F.sum("met").alias("degree")), "key")
    size = F.struct("n_words", "key")
    ends = member.groupBy("bucket").agg(F.min(size).alias("low"), F.max(size).alias("high"), F.max(F.struct("degree", "key")).alias("hub"))
    ends = ends.select("bucket", F.array_distinct(F.array("low.key", "high.key", "hub.key")).alias("ends"))
    pairs = met.join(ends, "bucket").select("key", F.explode("ends").alias("end")).where("key <> end")
    return pairs.groupBy(F.least("key", "end").alias("a"), F.greatest("key", "end").alias("b")).agg(F.count("*").alias("hits"))


def spelled(keys: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, words) of some texts: the hashes of their words in turn, as bytes."""
    needed = keys.distinct().join(nodes.select("key", "first"), "key")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raw = [words.astype(np.uint32).tobytes() for words in word_hashes(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_pydict({"key": batch.column("key").cast(pa.binary()), "words": pa.array(raw, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("first"), F.coalesce("text", F.lit("")).alias("text"), text_key())
    wanted = needed.withColumnsRenamed({"key": "want", "first": "row"})
    found = rows.join(wanted, (rows["key"] == wanted["want"]) & rows["first"].eqNullSafe(wanted["row"])).select("key", "text")
    return staged(found.mapInArrow(encode, "key binary, words binary").dropDuplicates(["key"]))


def aligned(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike, as links (u, v)."""
    words = spelled(pairs.select(F.explode(F.array("a", "b")).alias("key")), docs, nodes)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            same = [alike(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)) for p, q in zip(x, y)]
            yield batch.select(["u", "v"]).filter(pa.array(same, pa.bool_()))

    left = words.select(F.col("key").alias("a"), F.col("words").alias("x"))
    right = words.select(F.col("key").alias("b"), F.col("words").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select(F.col("a").alias("u"), F.col("b").alias("v"), "x", "y")
    return both.mapInArrow(verify, "u binary, v binary")


def shares(left: list[np.ndarray], right: list[np.ndarray], q: int) -> np.ndarray:
    """How many q-grams, told apart by occurrence, each text of ``left`` shares with each
    of ``right``: a product of 0/1 rows over the q-grams that some two texts share."""
    grams = [labelled(kmers(w.astype(np.uint64), q)) if len(w) >= q else np.zeros(0, np.uint64) for w in (*left, *right)]
    codes, unique = pd.factorize(np.concatenate(grams))
    common = np.bincount(codes, minlength=len(unique)) > 1
    column = np.cumsum(common) - 1
    texts = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    cells = np.zeros((len(grams), int(common.sum())), np.float32)
    cells[texts[common[codes]], column[codes[common[codes]]]] = 1
    return cells[:len(left)] @ cells[len(left):].T


def joined_pairs(slot: int, crossing: bool, side: np.ndarray, roots: list[bytes], sketch: np.ndarray, words: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """Links of roots by the alike pairs of one block (or, ``crossing``, of two) of a bucket.

    Every pair of different roots whose first common sketch is ``slot`` is tried,
    unless its roots are linked by then; those that share most words come first.
    """
    _, root = np.unique(np.array(roots, object), return_inverse=True)
    if root.max() == 0:
        return []
    i = np.flatnonzero(side == 0) if crossing else np.arange(len(root))
    j = np.flatnonzero(side == 1) if crossing else i
    size = np.array([len(w) for w in words])
    longest = np.maximum(size[i][:, None], size[j][None, :])
    most = ((1 - SIMILAR) * longest + 1e-9).astype(np.int64)
    open_ = (root[i][:, None] != root[j][None, :]) & (longest - np.minimum(size[i][:, None], size[j][None, :]) <= most)
    if not crossing:
        open_ &= i[:, None] < j[None, :]
    for earlier in range(slot):
        if not open_.any():
            return []
        open_ &= sketch[i, earlier][:, None] != sketch[j, earlier][None, :]
    share = np.zeros(open_.shape, np.float32)
    if open_.sum() > 8:
        for grams in (3, 2, 4, 1):
            rows, columns = open_.any(axis=1), open_.any(axis=0)
            if not rows.any():
                return []
            share = np.zeros(open_.shape, np.float32)
            share[np.ix_(rows, columns)] = shares([words[x] for x in i[rows]], [words[x] for x in j[columns]], grams)
            open_ &= share >= longest - grams + 1 - grams * most
    p, q = open_.nonzero()
    order = (-share[p, q] / longest[p, q]).argsort(kind="stable")
    p, q = p[order], q[order]
    head = list(range(int(root.max()) + 1))

    def find(r: int) -> int:
        while head[r] != r:
            head[r] = r = head[head[r]]
        return r

    prepared: dict[int, tuple] = {}

    def linked(x: int, y: int) -> bool:
        """Whether two texts that share q-grams enough are alike."""
        if size[x] < size[y]:
            x, y = y, x
        most = int((1 - SIMILAR) * size[x] + 1e-9)
        if size[x] > LONG:
            return within(words[x], words[y], most)
        if size[x] == size[y] and int((words[x] != words[y]).sum()) <= most:
            return True
        if x not in prepared:
            prepared[x] = spots(words[x])
        return banded(words[x], words[y], most, prepared[x])

    links = []
    for x, y in zip(i[p].tolist(), j[q].tolist()):
        u, v = find(int(root[x])), find(int(root[y]))
        if u != v and linked(x, y):
            head[u] = v
            links.append((roots[x], roots[y]))
    return links


def remaining(joined: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (u, v) of roots by all pairs that share a bucket and are not connected.

    A bucket whose members have one root is done. Members of another are dealt by length
    class, and by whether they have the bucket's largest root, over blocks of about
    ``BLOCK`` texts. Two blocks meet in one group, unless both hold the largest root or
    their lengths are too different for any pair to be alike.
    """
    member = memberships(nodes).join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    open_ = member.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("bucket")
    classed = member.join(open_, "bucket").withColumn("class", F.floor(F.log(F.col("n_words")) / CLASS).cast("long"))
    left = staged(classed)
    largest = left.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"))
    left = left.join(largest.select("bucket", F.col("most.root").alias("top")), "bucket").withColumn("main", (F.col("root") == F.col("top")).cast("long"))
    blocks = left.groupBy("bucket", "class", "main").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    met = blocks.select("bucket", F.col("class").alias("class_"), F.col("main").alias("main_"), F.col("blocks").alias("blocks_"))
    words = spelled(left.select("key"), docs, nodes)

    def number(cls: str, main: str, block: Column) -> Column:
        return F.shiftleft(2 * F.col(cls) + F.col(main), 32) + block

    own = left.join(blocks, ["bucket", "class", "main"]).withColumn("block", number("class", "main", F.pmod(F.xxhash64("key"), F.col("blocks"))))
    every = own.join(met, "bucket").where("abs(class - class_) <= 1 AND main + main_ < 2")
    every = every.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1))).withColumn("other", number("class_", "main_", F.col("other")))
    group = ["bucket", "low", "high"]
    dealt = every.select(
        "key", "root", "slot", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        (F.col("block") > F.col("other")).cast("int").alias("side"))
    full = dealt.join(words, "key").join(nodes.select("key", "sketch"), "key").repartition(*group).sortWithinPartitions(*group)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(of: tuple, rows: list[dict]) -> pa.RecordBatch:
            alone = len({r["root"] for r in rows}) == 1 or (of[1] != of[2] and len({r["side"] for r in rows}) == 1)
            found = [] if alone else joined_pairs(
                rows[0]["slot"], of[1] != of[2], np.array([r["side"] for r in rows]), [r["root"] for r in rows],
                np.array([r["sketch"] for r in rows], np.int64), [np.frombuffer(r["words"], np.uint32) for r in rows])
            return pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in found], pa.binary()), "v": pa.array([v for _, v in found], pa.binary())})

        now, own = None, []
        for batch in sliced(batches, 200):
            for row in batch.to_pylist():
                if (of := tuple(row[c] for c in group)) != now and own:
                    yield links(now, own)
                    own = []
                now = of
                own.append(row)
        if own:
            yield links(now, own)

    return full.mapInArrow(settle, "u binary, v binary")


def merged(joined: DataFrame, over: DataFrame) -> DataFrame:
    """``joined`` (node, root) with links (u, v) between roots; a node without one is its own root."""
    final = staged(components(staged(over)))
    of = joined.join(final.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = final.join(joined.select(F.col("node").alias("old")), final["node"] == F.col("old"), "left_anti")
    return staged(of.union(alone.select("node", "root")))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, key) of ``docs``, and (key, class_doc, class_key) of every
    distinct text: the row of the smallest doc_id of its class."""
    rows = staged(sketched(docs))
    nodes = staged(rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("n_words").alias("n_words"), F.min("sketch").alias("sketch")))
    pairs = staged(candidates(nodes))
    best = F.max_by(F.struct("a", "b"), F.struct("hits", "a"))
    chosen = staged(pairs.groupBy("b").agg(best.alias("p")).select("p.*"))
    links = staged(aligned(chosen, docs, nodes))
    joined = staged(components(links))
    left, right = (joined.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b"))
    apart = (
        pairs.join(chosen, ["a", "b"], "left_anti").join(left, "a", "left").join(right, "b", "left")
        .select("a", "b", F.coalesce("a_root", "a").alias("u"), F.coalesce("b_root", "b").alias("v")).where("u <> v"))
    apart = staged(apart)
    more = aligned(apart.select("a", "b"), docs, nodes)
    joined = merged(joined, more.withColumnsRenamed({"u": "a", "v": "b"}).join(apart, ["a", "b"]).select("u", "v"))
    roots = merged(joined, remaining(joined, docs, nodes)).withColumnRenamed("node", "key")
    named = nodes.select("key", "first").join(roots, "key", "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    named = staged(named)
    winner = named.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), F.col("first").alias("doc"), "key")).alias("w"))
    table = named.join(winner, "root").select("key", F.col("w.doc").alias("class_doc"), F.col("w.key").alias("class_key"))
    return rows.select("doc_id", "key"), table


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with its class: doc_id, class_id.

    class_id is the smallest doc_id of the texts that are equal, alike, or linked
    through others that are. Null texts are empty ones and form one class; a text
    of fewer than five words is one k-mer; texts without white space are one word.
    A null doc_id is kept and only names a class that has no other; repeated rows
    get one row each; other columns are ignored; an empty table gives no rows.
    """
    rows, table = classes(docs)
    return rows.join(table.select("key", F.col("class_doc").alias("class_id")), "key").select("doc_id", "class_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, with all their columns.

    The row with the class's smallest doc_id stays; of rows with the same doc_id
    and text any one.
    """
    rows, table = classes(docs)
    winners = table.where("key = class_key").select(F.col("key").alias("__own"), F.col("class_doc").alias("__doc"))
    counted = staged(rows.join(winners, (F.col("key") == F.col("__own")) & F.col("doc_id").eqNullSafe(F.col("__doc")))
                     .groupBy("__own", "__doc").agg(F.count("*").alias("__copies")))
    marked = docs.withColumn("__key", text_key())

    def chosen(of: DataFrame) -> DataFrame:
        return marked.join(of, (marked["__key"] == of["__own"]) & marked["doc_id"].cast("long").eqNullSafe(of["__doc"])).drop("__own", "__doc", "__copies")

    once = chosen(counted.where("__copies = 1"))
    again = chosen(counted.where("__copies > 1")).dropDuplicates(["doc_id", "__key"])
    return once.unionByName(again).drop("__key")
