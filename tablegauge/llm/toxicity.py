"""Toxicity of texts by maximum-scoring segments of token log-odds.

The log-odds of toxic against other texts of each word, of its plain form (look-alike
digits, separators and repeated letters undone) and of that form's beginnings have an
informative Dirichlet prior (the corpus's own frequencies) and are drawn towards zero by
``DRAWN`` standard errors; the strongest of a word's counts, and all words carry a small
loss. A linear scan finds every maximal scoring segment. A segment's score becomes an
excess over what chance gives in a text of that length (the extreme-value law of maximal
segments), and the summed excess, or how far the best segment stays below, becomes a
probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import Words, chunks, remainder, ruled, sliced, staged

#: Labelled rows learnt from, and features kept.
ROWS, WORDS = 20_000, 300_000
#: Pseudo-texts of the Dirichlet prior; standard errors by which log-odds are drawn to zero.
PRIOR = 10.0
DRAWN = 2.0
#: Characters of a word's beginnings that are features like words.
SHORTEST, LONGEST = 4, 7
LOSS = 0.15
SEGMENT = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("excess", pa.float64())])
STRIPPED = ".,;:!?\"'()[]*$%&#|<>"


#: Digits and signs that stand for letters.
LOOK_ALIKE = str.maketrans("013457@$!|", "oieastasii")
SEPARATORS = re.compile(r"[.\-_*+~'’]+")
REPEATED = re.compile(r"(\w)\1+")


def folded(word: str) -> str:
    return word.strip(STRIPPED)


def plain(word: str) -> str:
    """A word without look-alike signs, inner separators and repeated letters; a number
    is itself."""
    if word.isalpha():
        letters = word
    elif any(c.isalpha() for c in word):
        letters = SEPARATORS.sub("", word.translate(LOOK_ALIKE))
    else:
        return word
    return REPEATED.sub(r"\1", letters)


def segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of a sequence, in one
    pass over its positive values: each candidate joins earlier ones while that
    raises its score (the method of Ruzzo and Tompa)."""
    positive = np.flatnonzero(values > 0)
    if not len(positive):
        return []
    sums = np.concatenate(([0.0], np.cumsum(values)))
    kept: list[list[float]] = []  # first, last + 1, sum before, sum after
    for i in positive.tolist():
        new = [i, i + 1, sums[i], sums[i + 1]]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(int(a), int(b), float(q - p)) for a, b, p, q in kept]


def features(word: str) -> list[str]:
    """A word, its plain form and that form's beginnings, marked."""
    own = plain(word)
    return [word, f"~{own}", *(f"{own[:n]}*" for n in range(min(LONGEST, len(own) - 1), SHORTEST - 1, -1))]


def drawn(odds: np.ndarray, error: np.ndarray) -> np.ndarray:
    """Log-odds moved towards zero by some of their standard errors, at most to it."""
    return np.sign(odds) * np.maximum(np.abs(odds) - DRAWN * error, 0.0)


@dataclass
class ToxicityModel:
    log_odds: dict[str, float]  # of features, drawn towards zero, where they differ from it
    scale: float  # lambda of the extreme-value law
    factor: float  # its K
    weights: tuple[float, float]  # of 1 and log(1 + excess)

    def excess(self, score: float, tokens: int) -> float:
        return max(0.0, self.scale * score - np.log(max(self.factor * tokens, 1e-300)))

    def value(self, word: str) -> float:
        """The strongest log-odds among a word's features, less the loss."""
        return max((self.log_odds.get(f, 0.0) for f in features(word)), key=abs) - LOSS

    def scan(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int, float]]]]:
        """(number of tokens, segments) of each text."""
        out = []
        for part in chunks(texts):
            words = Words([text.lower() for text in texts[part]])
            values = np.array([self.value(folded(w)) for w in words.unique])
            for a, b in zip(words.starts, words.ends):
                out.append((int(b - a), segments(values[words.at[a:b]]) if b > a else []))
        return out

    def evidence(self, tokens: int, scores: list[float]) -> float:
        """log(1 + summed excess) of a text's segments; where none has any, how far the
        best one is below significance, between -1 and 0."""
        total = sum(self.excess(s, tokens) for s in scores)
        if total > 0:
            return float(np.log1p(total))
        if not scores:
            return -1.0
        below = np.log(max(self.factor * tokens, 1e-300)) - self.scale * max(scores)
        return float(-max(below, 0.0) / (1 + max(below, 0.0)))

    def score(self, tokens: int, found: list[tuple[int, int, float]]) -> float:
        z = self.weights[0] + self.weights[1] * self.evidence(tokens, [s for _, _, s in found])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """(text, toxic) of about ``rows`` labelled documents, by a hash of doc_id. A
    document with several labels is toxic if one says so. The chosen labels are
    broadcast: ``rows`` bounds them."""
    told = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    told = told.where(~held_out())
    total = told.count()
    if total > rows:
        told = told.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(total)) < rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(told), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def held_out() -> Column:
    return ruled(remainder("doc_id", 5) == 0)


def fit(rows: DataFrame, words: int = WORDS) -> ToxicityModel | None:
    """A model of (text, toxic) rows, a bounded table; None without both labels."""
    rows = staged(rows.groupBy("text").agg(F.max("toxic").alias("toxic")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts: tuple[Counter, Counter] = (Counter(), Counter())
            tokens: Counter = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = Counter(w for raw in text.lower().split() if (w := folded(raw)))
                own: Counter = Counter({"": sum(words.values())})
                for word, n in words.items():
                    for feature in features(word):
                        own[feature] += n
                texts[toxic > 0].update(own.keys())
                if toxic <= 0:
                    tokens.update(own)
            every = list(texts[0].keys() | texts[1].keys())
            yield pa.RecordBatch.from_pydict({"feature": pa.array(every, pa.string())} | {
                k: pa.array([c[w] for w in every], pa.int64()) for k, c in (("clean", texts[0]), ("toxic", texts[1]), ("tokens", tokens))})

    counted = rows.mapInArrow(count, "feature string, clean long, toxic long, tokens long").groupBy("feature").agg(
        *(F.sum(k).alias(k) for k in ("clean", "toxic", "tokens")))
    counted = staged(counted.where("clean + toxic >= 3 OR feature = ''"))
    whole = counted.where("feature = ''").first()
    if whole is None or not whole["clean"] or not whole["toxic"]:
        return None
    top = counted.where("feature <> ''").orderBy(F.desc(F.col("clean") + F.col("toxic")), "feature").limit(words).collect()
    n0, n1 = whole["clean"], whole["toxic"]
    y0, y1 = (np.array([r[k] for r in top], float) for k in ("clean", "toxic"))
    prior = PRIOR * (y0 + y1) / (n0 + n1)
    without1, without0 = (np.maximum(n + PRIOR - y - prior, 0.5) for n, y in ((n1, y1), (n0, y0)))  # none: in every text
    odds = np.log((y1 + prior) / without1) - np.log((y0 + prior) / without0)
    error = np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior) + 1 / without1 + 1 / without0)
    odds = drawn(odds, error)
    clear = odds != 0
    share = np.array([r["tokens"] for r in top], float)[clear] / max(whole["tokens"], 1)
    known = {r["feature"]: float(o) for r, o, keep in zip(top, odds, clear) if keep}
    # Of a word's features the strongest counts: words alone, whose shares add up to no more than one.
    single = np.array([r["feature"][0] == "~" for r, keep in zip(top, clear) if keep], bool)
    return _calibrated(ToxicityModel(known, _root(odds[clear][single], share[single]), 1.0, (0.0, 0.0)), rows)


def _root(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum p exp(l s) = 1 over the tokens of other texts."""
    if not (scores > LOSS).any():
        return 1.0
    rest = max(0.0, 1 - share.sum())
    share = np.maximum(share, 1e-9)

    def above(rate: float) -> bool:
        return (share * np.exp(np.minimum(rate * (scores - LOSS), 700))).sum() + rest * np.exp(-rate * LOSS) > 1

    low, high = 0.0, 1.0
    while not above(high) and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if above(middle) else (middle, high)
    return high


def _calibrated(model: ToxicityModel, rows: DataFrame) -> ToxicityModel:
    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = model.scan(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([n for n, _ in found], pa.int64()), "best": pa.array([max((s for *_, s in own), default=0.0) for _, own in found], pa.float64()),
                "every": pa.array([[s for *_, s in own] for _, own in found], pa.list_(pa.float64())), "toxic": batch.column("toxic")})

    got = rows.mapInArrow(figures, "n long, best double, every array<double>, toxic int").orderBy("n", "best", "toxic").collect()
    clean = [r for r in got if not r["toxic"] and r["n"]]
    if clean:
        model.factor = len(clean) / sum(r["n"] * np.exp(-model.scale * r["best"]) for r in clean)
    x = np.array([model.evidence(r["n"], r["every"]) for r in got])
    y = np.array([r["toxic"] > 0 for r in got], float)
    design, w = np.stack((np.ones(len(x)), x), axis=1), np.zeros(2)
    for _ in range(30):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-design @ w))
        w = w + np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * w)
    model.weights = (float(w[0]), max(float(w[1]), 0.0))
    return model


def predict(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id, held_out, score, predicted, n_segments, best_segment (first and last + 1
    token and score of the best passage) and segments (all passages beyond chance: first,
    last + 1, score, excess) of every row of ``docs``.

    A null or empty text has no segment and the score of one; without a model every
    score is 0. Rows repeat as in ``docs``, null doc_ids are held out, other columns
    are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own, texts = shared.value, batch.column("text").to_pylist()
            found = own.scan(texts) if own else [(0, [])] * len(texts)
            score = [own.score(n, s) if own else 0.0 for n, s in found]
            best = [max(s, key=lambda x: (x[2], -x[0]), default=None) for _, s in found]
            beyond = [[(a, b, x, e) for a, b, x in s if (e := own.excess(x, n)) > 0] if own else [] for n, s in found]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(score, pa.float64()),
                "predicted": pa.array([int(s >= 0.5) for s in score], pa.int32()),
                "n_segments": pa.array(list(map(len, beyond)), pa.int64()),
                "best_segment": pa.array(["" if b is None else f"{b[0]}:{b[1]}:{b[2]:.6g}" for b in best], pa.string()),
                "segments": pa.array([[dict(zip(SEGMENT.names, x)) for x in s] for s in beyond], pa.list_(SEGMENT))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int, n_segments long, best_segment string, "
                             "segments array<struct<first: bigint, last: bigint, score: double, excess: double>>")
