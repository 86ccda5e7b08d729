"""Personal data in texts: fixed rules, and a character tagger trained on them.

The rules find what they define. A character-level bidirectional LSTM with CRF
transitions is trained from labelled spans (those of the rules in a bounded sample
of documents) and adds spans of the same shapes that the rules pass over. Texts are
read in overlapping windows; candidates of all windows are reconciled over the
whole text, by the set of disjoint spans of highest total confidence.

Every kind needs a digit or an "@", and spans without one are never kept, so only
windows that hold one are decoded; the others could add nothing.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import sampled, sliced, staged
from tablegauge.llm.tagger import Tagger

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# --- fixed values: the rules' patterns, written so that none runs twice over a text ---
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# --- end of fixed values ---
MARK = re.compile(r"[0-9@]")
DIGIT = re.compile(r"[0-9]")

WINDOW, STRIDE = 96, 32
#: Of training: documents sampled, windows of either sort (with a span or without).
DOCUMENTS, WINDOWS = 20_000, 1000
CONFIDENT = 0.9
#: Characters an added span has at least.
LEAST = 6

_PUNCTUATION = "@.+-_%() \n"
SYMBOLS = 3 + len(_PUNCTUATION)  # padding, letters, digits, these, and all else as letters
_SYMBOL = {c: i + 3 for i, c in enumerate(_PUNCTUATION)} | {c: 2 for c in "0123456789"}
TAGS = 1 + 2 * len(KINDS)  # none; begin and inside of each kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        if domain := DOMAIN.match(text, at + 1):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The rules' spans by kind, then start: leftmost, not overlapping within a
    kind; a match that fails its condition is dropped, without a second try."""
    if not MARK.search(text):
        return []
    found: list[Span] = [("email", a, b) for a, b in emails(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text)
              if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = "".join(DIGIT.findall(m.group())) if m.end() - m.start() < 64 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return found


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an "@"."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    starts: set[int] = set()
    for m in MARK.finditer(text):
        high = m.start() // STRIDE
        starts.update(range(max(0, -(-(m.start() - WINDOW + 1) // STRIDE)), min(high, last) + 1))
    return [s * STRIDE for s in sorted(starts)]


def symbols(text: str, start: int) -> list[int]:
    own = [_SYMBOL.get(c, 1) for c in text[start:start + WINDOW]]
    return own + [0] * (WINDOW - len(own))


def gold_tags(spans: list[Span], start: int) -> list[int]:
    tags = [0] * WINDOW
    for kind, a, b in spans:
        base = 1 + 2 * KINDS.index(kind)
        for i in range(max(a, start), min(b, start + WINDOW)):
            tags[i - start] = base + (i > a and i > start)
    return tags


def allowed() -> tuple[np.ndarray, np.ndarray]:
    follow = np.ones((TAGS, TAGS), bool)
    for inside in range(2, TAGS, 2):
        follow[:, inside] = False
        follow[[inside - 1, inside], inside] = True
    return follow, np.array([t == 0 or t % 2 == 1 for t in range(TAGS)])


def train(docs: DataFrame, documents: int = DOCUMENTS, windows: int = WINDOWS) -> Tagger | None:
    """A tagger of windows of sampled documents; None where no span is found.

    ``documents`` and ``windows`` bound what is sampled (by hashes) and collected:
    windows with a span, and as many without.
    """
    rows = sampled(docs, ["text"], documents)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x, y = [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text or "")
                for start in window_starts(text or ""):
                    x.append(bytes(symbols(text, start)))
                    y.append(bytes(gold_tags([s for s in spans if s[1] < start + WINDOW and s[2] > start], start)))
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.binary()), "y": pa.array(y, pa.binary())})

    cuts = staged(rows.select(F.col("text").cast("string").alias("text")).mapInArrow(cut, "x binary, y binary").distinct())
    plain = F.col("y") == F.lit(bytes(WINDOW))
    chosen = [r for rule in (~plain, plain) for r in cuts.where(rule).orderBy(F.xxhash64("x", "y"), "x", "y").limit(windows).collect()]
    if not any(any(r["y"]) for r in chosen):
        return None
    model = Tagger(SYMBOLS, TAGS, *allowed())
    model.train(np.array([list(r["x"]) for r in chosen]), np.array([list(r["y"]) for r in chosen]))
    return model


def disjoint(candidates: dict[Span, float]) -> list[Span]:
    """The disjoint spans of highest total confidence."""
    order = sorted(candidates, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in order]
    best: list[tuple[float, list[Span] | None, Span | None]] = [(0.0, None, None)]
    back: list[int] = []
    for i, span in enumerate(order):
        before = bisect_right(ends, span[1], 0, i)
        back.append(before)
        take = best[before][0] + candidates[span]
        best.append((take, None, span) if take > best[i][0] else (best[i][0], None, None))
    chosen, i = [], len(order)
    while i:
        if best[i][2] is not None:
            chosen.append(best[i][2])
            i = back[i - 1]
        else:
            i -= 1
    return chosen[::-1]


def model_spans(texts: list[str], model: Tagger, confident: float = CONFIDENT, size: int = 512) -> list[list[Span]]:
    """The tagger's spans of each text, reconciled over its windows."""
    where = [(i, start) for i, text in enumerate(texts) for start in window_starts(text)]
    votes: list[dict[Span, float]] = [defaultdict(float) for _ in texts]
    for at in range(0, len(where), size):
        part = where[at:at + size]
        tags, chance = model.marginals(np.array([symbols(texts[i], start) for i, start in part]))
        for (i, start), row, sure in zip(part, tags, chance):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], (row + 1) // 2, [0]))) | np.concatenate((row % 2 == 1, [False])))
            text = texts[i]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if not row[a]:
                    continue
                # A span cut by a window's edge is left to the window that holds it whole.
                if (a == 0 and start) or (b == WINDOW and start + WINDOW < len(text)):
                    continue
                p, q = start + a, min(start + b, len(text))
                trust = float(sure[a:b].mean())
                if trust >= confident and q - p >= LEAST and MARK.search(text, p, q):
                    votes[i][(KINDS[(row[a] - 1) // 2], p, q)] += trust
    return [disjoint(v) if v else [] for v in votes]


def beside(text: str, span: Span, base: list[Span]) -> list[Span]:
    """What of an added span lies outside the rules' spans and is still long enough."""
    kind, end = span[0], span[2]
    left, at = [], span[1]
    for a, b in sorted((a, b) for _, a, b in base if a < end and span[1] < b):
        left.append((at, a))
        at = max(at, b)
    out = []
    for a, b in [*left, (at, end)]:
        own = text[a:b]
        a += len(own) - len(own.lstrip())
        b = a + len(own.strip())
        if b - a >= LEAST and MARK.search(text, a, b):
            out.append((kind, a, b))
    return out


def all_spans(texts: list[str], model: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """(rules' spans, added spans) of each text; added ones overlap no rule's span."""
    out = []
    for text, more in zip(texts, model_spans(texts, model) if model else [[]] * len(texts)):
        base = base_spans(text)
        out.append((base, [s for span in more for s in beside(text, span, base)]))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """Spans of every row of ``docs``: doc_id, counts and digest of the rules' spans,
    ``spans`` (all of them) and n_added.

    A null or empty text has none. Offsets count code points. Rows repeat as in
    ``docs``, null doc_ids stay, other columns are ignored, no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = all_spans([t or "" for t in batch.column("text").to_pylist()], shared.value)
            out = {"doc_id": batch.column("doc_id")} | {
                f"n_{k}": pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS}
            out["base_sha256"] = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
            out["spans"] = pa.array([listed(base + more) for base, more in found], pa.string())
            out["n_added"] = pa.array([len(more) for _, more in found], pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind; spans that overlap become one."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def mask(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced by its kind, and n_chars,
    where there is such a column, set to the new length; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            found = all_spans([t or "" for t in texts], shared.value)
            new = pa.array([t if t is None else masked(t, base + more) for t, (base, more) in zip(texts, found)], pa.string())
            yield batch.set_column(at, batch.schema.field(at), new.cast(batch.schema.field(at).type))

    out = docs.mapInArrow(work, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
