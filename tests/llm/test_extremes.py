"""Neighbours of huge and tiny vectors, alignments, and toxicity against plain versions."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from tablegauge.llm import near, neighbours, toxicity  # noqa: E402


@pytest.mark.parametrize("make", [
    lambda i: [float(i), 1e200], lambda i: [i * 5e-324, 5e-324], lambda i: [i * 1e-160, 1e-155], lambda i: [1e308 / (i + 1), float(i)],
    lambda i: [1e300 * (i % 2), float(i), 1.0]])
def test_neighbours_of_huge_and_tiny_vectors(spark, make):
    vectors = {i: make(i) for i in range(1, 9)}
    df = spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 3 == 0, 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in (3, 6):
        with np.errstate(over="ignore", under="ignore"):
            far = sorted((float(np.sqrt(sum((a - b) * (a - b) for a, b in zip(vectors[q], v)))), i) for i, v in vectors.items() if i != q)
        assert [got[q][k][1] for k in (1, 2, 3, 4)] == [d for d, _ in far[:4]]
        assert [got[q][k][0] for k in (1, 2, 3, 4)] == [i for _, i in far[:4]]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_counts_edits():
    rng = random.Random(1)
    for _ in range(1500):
        k = rng.choice([2, 3, 8])
        a = [rng.randrange(k) for _ in range(rng.randrange(22))]
        b = [rng.randrange(k) if rng.random() < 0.2 else x for x in a if rng.random() > 0.15] if rng.random() < 0.6 else [rng.randrange(k) for _ in range(rng.randrange(22))]
        plain, x, y = edits(a, b), np.array(a, np.uint32), np.array(b, np.uint32)
        for most in range(12):
            assert near.within(x, y, most) is (plain <= most)
            if most >= abs(len(a) - len(b)):
                assert near.banded(x, y, most) is (plain <= most)


def test_shared_grams_are_counted_exactly():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 6, rng.integers(0, 30)).astype(np.uint32) for _ in range(12)]
    for q in (1, 2, 3, 4):
        got = near.shares(texts[:5], texts[5:], q)
        assert got.astype(int).tolist() == [[near.shared(a, b, q) for b in texts[5:]] for a in texts[:5]]


def test_plain_forms():
    assert [toxicity.plain(w) for w in ("loser", "l0ser", "l.o.s.e.r", "looooser", "1234", "10:30", "w0rthless")] == [
        "loser", "loser", "loser", "loser", "1234", "10:30", "worthles"]
    assert toxicity.features("worthless") == ["worthless", "~worthles", "worthle*", "worthl*", "worth*", "wort*"]


def test_log_odds_are_drawn_towards_zero():
    got = toxicity.drawn(np.array([5.0, -5.0, 1.0, -1.0, 0.0]), np.array([1.0, 1.0, 1.0, 0.25, 1.0]))
    assert got.tolist() == [3.0, -3.0, 0.0, -0.5, 0.0]


def test_counts_and_log_odds_equal_a_plain_sum(spark):
    rng, rows = random.Random(3), []
    for i in range(120):
        words = [rng.choice(["river", "stone", "light", "garden", "quiet"]) for _ in range(20)]
        rows.append((" ".join(words + ["villain"] * (i % 4 == 0)), int(i % 4 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    rows = list(dict(rows).items())
    n1 = sum(t for _, t in rows)
    n0, y1 = len(rows) - n1, n1
    prior = toxicity.PRIOR * y1 / (n0 + n1)
    odds = np.log((y1 + prior) / (n1 + toxicity.PRIOR - y1 - prior)) - np.log(prior / (n0 + toxicity.PRIOR - prior))
    error = np.sqrt(1 / (y1 + prior) + 1 / prior + 1 / (n1 + toxicity.PRIOR - y1 - prior) + 1 / (n0 + toxicity.PRIOR - prior))
    assert model.log_odds["villain"] == pytest.approx(odds - toxicity.DRAWN * error)
    assert model.value("villain") == pytest.approx(odds - toxicity.DRAWN * error - toxicity.LOSS) and model.value("unseen") == -toxicity.LOSS
    assert model.evidence(1000, []) == -1.0 and -1 < model.evidence(1000, [0.01]) <= 0 < model.evidence(1000, [50.0])
    got = toxicity.predict(spark.createDataFrame([(1, "quiet garden villain light"), (2, None)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [s["first"] for s in got[0].segments] == [2] and got[0].score > got[1].score and got[1].segments == []
