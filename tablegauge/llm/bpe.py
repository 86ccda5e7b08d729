"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs, and decoding.

A text is normalised, split at the vocabulary's added tokens and cut into pieces; each
piece starts as one symbol per byte, the last one marked as a word end. The leaves of a
segment tree hold the rank of the merge of each symbol with the next one, every inner
node the lowest below it. The root thus gives the lowest rank, and going down, left
first, its leftmost place; a merge changes three leaves and their ancestors. Short
pieces have their trees side by side in arrays; a process keeps the ids of many.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablegauge.llm.common import chunks, sliced

#: Pieces whose ids a process keeps; those of the last texts, when there are more.
KEPT = 300_000
#: Symbols of pieces whose trees lie side by side, by classes, and trees in one step.
CLASSES, TREES = (8, 16, 32), 50_000
#: Characters of a text that are cut into pieces at once; cuts lie before white space.
SLICE = 1_000_000
NEVER = 1 << 40
UNRANKED = 1 << 30
BLANK = regex.compile(r"\s")
#: Characters outside these ranges may be classed otherwise by another Unicode version:
#: texts with them are normalised and cut by the library itself.
SETTLED = regex.compile("[\0-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0482\u048a-\u0523\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")


class Ranks:
    """A segment tree: the lowest of some ranks and its leftmost place."""

    def __init__(self, ranks: list[int]):
        self.size = size = 1 << max(len(ranks) - 1, 0).bit_length()
        self.tree = tree = [NEVER] * size + ranks + [NEVER] * (size - len(ranks))
        for node in range(size - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left <= right else right

    def lowest(self) -> int:
        """The leftmost place of the lowest rank; -1 if there is none."""
        tree, node = self.tree, 1
        if tree[1] == NEVER:
            return -1
        while node < self.size:
            node *= 2
            if tree[node] > tree[node + 1]:
                node += 1
        return node - self.size

    def set(self, place: int, rank: int) -> None:
        tree, node = self.tree, place + self.size
        tree[node] = rank
        while node > 1:
            node >>= 1
            left, right = tree[2 * node], tree[2 * node + 1]
            low = left if left <= right else right
            if tree[node] == low:
                break
            tree[node] = low


def merged(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """``symbols`` after all merges, the lowest rank first, of equal ones the leftmost.

    ``merges`` gives the rank and the new symbol of a pair.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    symbols, nothing = list(symbols), (NEVER, -1)
    ranks = Ranks([merges.get(pair, nothing)[0] for pair in zip(symbols, symbols[1:])])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (i := ranks.lowest()) >= 0:
        j = after[i]
        symbols[i] = merges[symbols[i], symbols[j]][1]
        symbols[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            ranks.set(j, NEVER)
        if k < n:
            before[k] = i
            ranks.set(i, merges.get((symbols[i], symbols[k]), nothing)[0])
        else:
            ranks.set(i, NEVER)
        if (h := before[i]) >= 0:
            ranks.set(h, merges.get((symbols[h], symbols[i]), nothing)[0])
    return [s for s in symbols if s >= 0]


class Forest:
    """Many small segment trees side by side: each step merges one pair of every piece."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]], symbols: int):
        self.symbols = symbols
        keys = np.array([a * symbols + b for a, b in merges], np.int64)
        order = keys.argsort()
        self.keys, self.ranks = keys[order], np.array([rank for rank, _ in merges.values()], np.int32)[order]
        self.made = np.zeros(len(merges), np.int32)
        self.made[[rank for rank, _ in merges.values()]] = [new for _, new in merges.values()]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs; ``UNRANKED`` where they do not merge."""
        key = a.astype(np.int64) * self.symbols + b
        at = np.minimum(self.keys.searchsorted(key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], UNRANKED)

    def merged(self, symbols: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        """The symbols of each piece after all its merges, as ``merged`` gives them, from
        those of all pieces end to end."""
        size = 1 << max(int(lengths.max()) - 1, 1).bit_length()
        wide, rows = 2 * size, len(lengths)
        symbol = np.full((rows, size + 1), -1, np.int32)
        symbol[np.arange(size + 1) < lengths[:, None]] = symbols
        tree = np.full((rows, wide), UNRANKED, np.int32)
        row, at = np.nonzero(symbol[:, 1:] >= 0)
        tree[row, size + at] = self.rank(symbol[row, at], symbol[row, at + 1])
        node = size
        while node > 1:
            node //= 2
            tree[:, node:2 * node] = np.minimum(tree[:, 2 * node:4 * node:2], tree[:, 2 * node + 1:4 * node:2])
        after = np.tile(np.arange(1, size + 2, dtype=np.int32), (rows, 1))
        before = after - 2
        symbol, tree, after, before = symbol.ravel(), tree.ravel(), after.ravel(), before.ravel()

        def place(of: np.ndarray, leaf: np.ndarray, rank: np.ndarray) -> None:
            """Sets a leaf of each of some trees, and what stands above it."""
            base, node = of * wide, leaf + size
            tree[base + node] = rank
            while node[0] > 1:
                node = node >> 1
                left = base + 2 * node
                tree[base + node] = np.minimum(tree[left], tree[left + 1])

        open_ = np.arange(rows)
        while True:
            rank = tree[open_ * wide + 1]
            go = rank < UNRANKED
            open_, rank = open_[go], rank[go]
            if not len(open_):
                break
            base, node = open_ * wide, np.ones(len(open_), np.int64)
            while node[0] < size:
                node = 2 * node
                node += tree[base + node] > tree[base + node + 1]
            i, base, new = node - size, open_ * (size + 1), self.made[rank]
            j = after[base + i]
            k = after[base + j]
            symbol[base + i], symbol[base + j] = new, -1
            after[base + i] = k
            inner = k < size
            before[(base + k)[inner]] = i[inner]
            place(open_, j, UNRANKED)
            follows = np.where(inner, symbol[base + np.minimum(k, size)], -1)
            place(open_, i, np.where(follows >= 0, self.rank(new, np.maximum(follows, 0)), UNRANKED))
            h = before[base + i]
            has = h >= 0
            if has.any():
                place(open_[has], h[has], self.rank(symbol[(base + h)[has]], new[has]))
        symbol = symbol.reshape(rows, size + 1)
        kept = symbol >= 0
        ids, ends = symbol[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _symbol_of_byte() -> list[str]:
    """The character that stands for each byte: itself where it prints, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Coder:
    """Encodes and decodes as a vocabulary file of byte-level pieces with word ends says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model, steps = described["model"], described["normalizer"]["normalizers"]
        splits = described["pre_tokenizer"]["pretokenizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"] or described["decoder"]:
            raise ValueError("only vocabularies with NFC, blanks, lower case, one split expression, byte-level pieces and no decoder are known")
        added = described.get("added_tokens") or []
        if any(t[k] for t in added for k in ("normalized", "single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens must be plain ones: as spelled, anywhere in a text")
        vocabulary, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in added}
        self.marker = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.piece = regex.compile(splits[0]["pattern"]["Regex"])
        self.library = Tokenizer.from_file(path)
        spelled = _symbol_of_byte()
        self.byte = {c: b for b, c in enumerate(spelled)}
        self.inner = np.array([vocabulary[c] for c in spelled], np.int32)
        self.last = np.array([vocabulary[c + end] for c in spelled], np.int32)
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        self.spelled = np.empty(max([*vocabulary.values(), *self.added.values()]) + 1, object)
        for text, number in chain(vocabulary.items(), self.added.items()):
            self.spelled[number] = text
        self.forest = Forest(self.merges, max(vocabulary.values()) + 1)
        # Added tokens as bytes, pieces as text, pieces in the library's own spelling as tuples.
        self.fixed = {content.encode(): [number] for content, number in self.added.items()}
        self.known: dict[bytes | str | tuple[str], list[int]] = dict(self.fixed)

    def _plain(self, text: str) -> list:
        """The pieces of a text without added tokens."""
        if not text.isascii():
            if not SETTLED.fullmatch(text):
                return [(piece,) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
            # The library lowers each character by itself, also a sigma at a word's end.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.piece.findall(text.lower())

    def _cut(self, text: str) -> list:
        if self.marker is None or not any(t in text for t in self.added):
            return self._plain(text)
        pieces, at = [], 0
        for found in self.marker.finditer(text):
            pieces += self._plain(text[at:found.start()])
            pieces.append(found.group().encode())
            at = found.end()
        return pieces + self._plain(text[at:])

    def _raw(self, piece: str | tuple[str]) -> bytes:
        return bytes(map(self.byte.__getitem__, piece[0])) if isinstance(piece, tuple) else piece.encode("utf-8", "replace")

    def _learn(self, pieces: set) -> None:
        """Adds pieces to the known ones."""
        if len(self.known) + len(pieces) > KEPT:
            self.known = self.fixed | {p: self.known[p] for p in pieces & self.known.keys()}
        new = list(pieces - self.known.keys())
        raw = list(map(self._raw, new))
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        order = lengths.argsort(kind="stable")
        for low, high in zip((0, *CLASSES), CLASSES):
            own = order[np.searchsorted(lengths[order], low, "right"):np.searchsorted(lengths[order], high, "right")]
            for at in range(0, len(own), TREES):
                part = own[at:at + TREES]
                joined = np.frombuffer(b"".join([raw[i] for i in part.tolist()]), np.uint8)
                symbols, ends = self.inner[joined], np.cumsum(lengths[part]) - 1
                symbols[ends] = self.last[joined[ends]]
                self.known.update(zip([new[i] for i in part.tolist()], self.forest.merged(symbols, lengths[part])))
        for i in order[np.searchsorted(lengths[order], CLASSES[-1], "right"):].tolist():
            self.known[new[i]] = merged([*self.inner[list(raw[i][:-1])].tolist(), int(self.last[raw[i][-1]])], self.merges)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self._cut(text) for text in texts]
        self._learn(set(chain.from_iterable(cut)))
        return [np.array(list(chain.from_iterable(map(self.known.__getitem__, pieces))), np.int32) for pieces in cut]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; added tokens that it spells out have their own, none is put around it."""
        out: list[np.ndarray] = []
        for part in chunks(texts, SLICE):
            own = texts[part]
            if len(own) == 1 and len(own[0]) > SLICE:
                out.append(np.concatenate([self._encoded([x])[0] for x in _slices(own[0])]))
            else:
                out += self._encoded(own)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' spellings, joined by blanks, as the vocabulary names no decoder.
        Ids outside the vocabulary are left out."""
        known = ids[(ids >= 0) & (ids < len(self.spelled))]
        return " ".join([t for t in self.spelled[known] if t is not None])


def _slices(text: str) -> Iterator[str]:
    """Parts of ``SLICE`` characters or more, cut before white space, which no piece or
    added token holds: the parts' ids are the text's. A run without any is not cut."""
    start = 0
    while start < len(text):
        found = BLANK.search(text, start + SLICE)
        stop = found.start() if found else len(text)
        yield text[start:stop]
        start = stop


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """The coder of a vocabulary file, read once per Python process."""
    return Coder(path)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row of ``docs``, as the vocabulary's own library
    gives them without special tokens, truncation or padding.

    A null or empty text has no ids; texts are taken whole, however long; repeated rows,
    ties and null doc_ids stay as they are; other columns are ignored; an empty table
    gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for batch in sliced(batches, 200):
            ids = own.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids and decoded (the text of the ids) of every row of ``encoded``.

    No ids, or null ones, give an empty text; ids that the vocabulary does not have, and
    null ids, are left out; other columns are ignored; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for batch in sliced(batches, 200):
            ids = batch.column("ids")
            values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            text = [own.decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": ids, "decoded": pa.array(text, pa.string())})

    known = F.filter(F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")), lambda x: x.isNotNull())
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), known.alias("ids")).mapInArrow(work, "doc_id long, ids array<int>, decoded string")
