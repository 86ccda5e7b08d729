"""Language identification by known words, with backoff to character n-grams.

A word that the model knows adds its log frequency in each language. A word it
does not know is read from left to right: at each character the longest known
n-gram that starts there (up to five characters, word ends marked) adds its log
frequency, and every step down to a shorter one costs a fixed factor.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.llm.common import Words, chunks, remainder, ruled, sampled, sliced, staged

UNKNOWN = "und"
LONGEST = 5
BACKOFF = np.log(0.4)
NOT_LETTERS = re.compile(r"[\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")


def letters(word: str) -> str:
    return word if word.isalpha() else NOT_LETTERS.sub("", word)


def grams(word: str) -> Iterator[str]:
    marked = f" {word} "
    for n in range(1, LONGEST + 1):
        for i in range(len(marked) - n + 1):
            yield marked[i:i + n]


class LanguageModel:
    """Log frequencies per language: a row for each known word and n-gram."""

    def __init__(self, languages: list[str], prior: np.ndarray, words: dict[str, np.ndarray], parts: dict[str, np.ndarray]):
        self.languages, self.prior = languages, prior
        self.words = {w: i for i, w in enumerate(words)}
        self.word_logs = np.array(list(words.values())).reshape(len(words), len(languages))
        self.parts = {g: i + 1 for i, g in enumerate(parts)}
        floor = np.full((1, len(languages)), np.log(1e-7))  # a character never seen
        steps = np.array([0.0] + [(LONGEST - len(g)) * BACKOFF for g in parts])
        self.part_logs = np.concatenate((floor, np.array(list(parts.values())).reshape(len(parts), len(languages)))) + steps[:, None]

    def longest_parts(self, word: str) -> list[int]:
        """The rows of the longest known n-grams of an unseen word, left to right."""
        marked, get, found = f" {word} ", self.parts.get, []
        i, last = 0, len(word) + 2
        while i < last:
            for n in range(min(LONGEST, last - i), 0, -1):
                if row := get(marked[i:i + n]):
                    found.append(row)
                    i += n
                    break
            else:
                found.append(0)
                i += 1
        return found

    def rows(self, unique: list[str]) -> np.ndarray:
        """Log scores of each word in each language; words without a letter add nothing."""
        out = np.zeros((len(unique), len(self.languages)))
        known: list[tuple[int, int]] = []
        unseen: list[int] = []
        parts: list[int] = []
        ends: list[int] = []
        for i, raw in enumerate(unique):
            if word := letters(raw):
                row = self.words.get(word)
                if row is None:
                    unseen.append(i)
                    parts += self.longest_parts(word)
                    ends.append(len(parts))
                else:
                    known.append((i, row))
        if known:
            at, row = np.array(known).T
            out[at] = self.word_logs[row]
        if unseen:
            total = np.concatenate((np.zeros((1, out.shape[1])), np.cumsum(self.part_logs[parts], axis=0)))
            starts = np.array([0, *ends[:-1]])
            out[unseen] = (total[ends] - total[starts]) / (np.array(ends) - starts)[:, None]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its posterior."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        named, score = [], []
        for part in chunks(texts):
            own = texts[part]
            words = Words([text.lower() for text in own])
            total = words.sums(self.rows(words.unique)) + self.prior
            chance = np.exp(total - total.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            best = chance.argmax(axis=1)
            for text, k, p in zip(own, best, chance.max(axis=1)):
                seen = LETTER.search(text) is not None
                named.append(self.languages[k] if seen else UNKNOWN)
                score.append(float(p) if seen else 0.0)
        return named, score


def fit(labelled: DataFrame, rows: int = 2000, words: int = 300_000, parts: int = 300_000) -> LanguageModel:
    """A model of the (text, lang) rows of ``labelled``.

    ``rows`` bounds the rows learnt from (chosen by a hash of doc_id and text), ``words``
    and ``parts`` the words and n-grams that the model keeps, most frequent
    first. Null languages and texts teach nothing; a tie between languages goes
    to the first in order.
    """
    usable = sampled(labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang"), ["doc_id", "text"], rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found: dict[str, Counter] = defaultdict(Counter)
            docs: Counter = Counter()
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                found[lang].update(w for raw in text.lower().split() if (w := letters(raw)))
                docs[lang] += 1
            out: list[tuple[str, int, str, int]] = []
            for lang, own in found.items():
                out += [(lang, 0, w, n) for w, n in own.items()]
                pieces: Counter = Counter()
                for w, n in own.items():
                    for g in grams(w):
                        pieces[g] += n
                out += [(lang, 1, g, n) for g, n in pieces.items()]
                out.append((lang, 2, "", docs[lang]))
            yield pa.RecordBatch.from_pydict({k: [row[i] for row in out] for i, k in enumerate(("lang", "kind", "item", "n"))},
                                             schema=pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("item", pa.string()), ("n", pa.int64())]))

    counts = usable.mapInArrow(count, "lang string, kind int, item string, n long")
    counted = staged(counts.groupBy("kind", "item", "lang").agg(F.sum("n").alias("n")))
    docs = {r["lang"]: r["n"] for r in counted.where("kind = 2").collect()}
    return build(docs, _kept(counted, 0, words), _kept(counted, 1, parts))


def _kept(counted: DataFrame, kind: int, bound: int) -> list[tuple[str, str, int]]:
    """The most frequent counts of a kind, seen twice at least; ``bound`` limits them."""
    rows = counted.where((F.col("kind") == kind) & (F.col("n") >= 2)).orderBy(F.desc("n"), "item", "lang").limit(bound)
    return [(r["item"], r["lang"], r["n"]) for r in rows.collect()]


def build(docs: dict[str, int], words: list[tuple[str, str, int]], parts: list[tuple[str, str, int]]) -> LanguageModel:
    """The model of document counts per language and (item, language, count) lists."""
    languages = sorted(docs)
    at = {lang: i for i, lang in enumerate(languages)}
    prior = np.log(np.array([docs[lang] for lang in languages], float) / max(1, sum(docs.values()))) if languages else np.zeros(0)

    def logs(items: list[tuple[str, str, int]]) -> dict[str, np.ndarray]:
        counts: dict[str, np.ndarray] = {}
        total = np.zeros(len(languages))
        for item, lang, n in items:
            counts.setdefault(item, np.zeros(len(languages)))[at[lang]] = n
            total[at[lang]] += n
        return {item: np.log((row + 0.1) / (total + 0.1 * len(counts))) for item, row in counts.items()}

    by_length: dict[int, list[tuple[str, str, int]]] = defaultdict(list)
    for row in parts:
        by_length[len(row[0])].append(row)
    return LanguageModel(languages, prior, logs(words), {k: v for own in by_length.values() for k, v in logs(own).items()})


def predict(docs: DataFrame, model: LanguageModel, lang: str = "lang_pred", posterior: str = "score") -> DataFrame:
    """``docs`` with the columns named by ``lang`` and ``posterior``.

    A null text or one without a letter is ``und`` with score 0; every other row
    gets a language of the model, an empty model gives ``und``. Existing columns
    of these names are replaced; other columns pass through, repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(lang, posterior)
    out = T.StructType([*kept.schema.fields, T.StructField(lang, T.StringType()), T.StructField(posterior, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            named, score = shared.value.predict([x or "" for x in batch.column("text").to_pylist()])
            yield batch.append_column(lang, pa.array(named, pa.string())).append_column(posterior, pa.array(score, pa.float64()))

    return kept.mapInArrow(work, out)


def held_out() -> Column:
    """The rule of documents never learnt from; true where doc_id is null."""
    return ruled(remainder("doc_id", 4) == 2)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out())


def identify(docs: DataFrame, rows: int = 2000) -> DataFrame:
    """Language of every document, learnt from those whose crc32(doc_id) mod 4 is not 2.

    Rows with a null doc_id are held out. Returns docs' columns, held_out,
    lang_pred and score.
    """
    return predict(docs.withColumn("held_out", held_out()), fit(learnable(docs), rows))
