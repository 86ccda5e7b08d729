"""Registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm import binary, bpe, decontaminate, language, near, neighbours, packing, phrases, pii, secrets, sharding, toxicity, whitening
from tablegauge.llm.common import documents, staged, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return pii.find(docs, pii.train(docs))


def op2_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), vocabulary())


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find(documents(spark, folder))


def op4_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(documents(spark, folder))


def op5_near(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(documents(spark, folder))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, folder, "labels")))
    return toxicity.predict(docs, model)


def op7_binary(spark: SparkSession, folder: str) -> DataFrame:
    return binary.segments(staged(binary.matrices(documents(spark, folder), vocabulary())))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.overlaps(documents(spark, folder), table(spark, folder, "benchmark"))
    return found.drop("text_hash")


def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(documents(spark, folder)).select("doc_id", "held_out", "lang_pred", "score")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    done = whitening.whiten(table(spark, folder, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return done.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(documents(spark, folder))


def op13_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(documents(spark, folder), vocabulary()), vocabulary())
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_pii, op2_pack, op3_secrets, op4_shards, op5_near, op6_toxicity, op7_binary, op8_decontaminate, op9_neighbours, op10_language,
    op11_whitening, op12_phrases, op13_bpe)}

# --- DuckDB SQL; the other queries are tested against plain versions ---

#: Rows that take part in a search.
_USABLE = """vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""

_NEAREST = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_USABLE}),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM scored)
WHERE rank <= 10"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(number: int, rule: secrets.Rule) -> str:
    """Rows of one rule's matches: where they start follows from the lengths of
    what lies between matches and of the matches before."""
    pattern = _quoted(rule.pattern)
    return f"""SELECT doc_id, {number} AS number, '{rule.kind}' AS kind, start, start + length(m[k]) AS stop FROM (
      SELECT doc_id, k, m, v, list_sum(list_transform(g[1:k], lambda x: length(x)))
        + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS start
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (
        SELECT doc_id, regexp_split_to_array(text, {pattern}) AS g, regexp_extract_all(text, {pattern}, 0) AS m,
               regexp_extract_all(text, {pattern}, {rule.group}) AS v FROM documents WHERE text IS NOT NULL)))
    WHERE length(v[k]) >= {rule.least}"""


_LISTED = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number)"
_SECRETS = f"""
WITH found AS ({" UNION ALL ".join(_matches(i, r) for i, r in enumerate(secrets.RULES))}),
listed AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)},
  {_LISTED} FILTER (WHERE number < {len(secrets.BASE)}) AS base, {_LISTED} AS spans FROM found GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN listed USING (doc_id)"""


def _round(i: int, source: str) -> str:
    """One round of the network over rows (number, l, r, total, a, b)."""
    multiplier, addend = sharding.ROUNDS[i]
    half, other, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
    stirred = f"(({other} * {multiplier} + {addend}) % {sharding.PRIME})"
    moved = f"({half} + ({stirred} * {stirred}) % {sharding.PRIME}) % {size}"
    left, right = (moved, "r") if half == "l" else ("l", moved)
    return f"(SELECT number, {left} AS l, {right} AS r, total, a, b FROM {source})"


_network = "(SELECT number, n // b AS l, n % b AS r, total, a, b FROM walk WHERE NOT done)"
for _i in range(len(sharding.ROUNDS)):
    _network = _round(_i, _network)

_SHARDS = f"""
WITH RECURSIVE shape AS (SELECT total, a, CAST(ceil(total / a) AS BIGINT) AS b FROM (
  SELECT count(*) AS total, greatest(1, CAST(ceil(sqrt(count(*))) AS BIGINT)) AS a FROM documents)),
numbered AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS number, doc_id, encode(coalesce(text, '')) AS bytes FROM documents),
walk AS (SELECT number, number AS n, FALSE AS done, total, a, b FROM numbered, shape
  UNION ALL SELECT number, l * b + r AS n, l * b + r < total AS done, total, a, b FROM {_network}),
bits AS (SELECT i AS x, i, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, i, k + 1 FROM bits WHERE k < 8),
steps AS (SELECT list(x ORDER BY i) AS step FROM bits WHERE k = 8),
summed AS (SELECT number, doc_id, octet_length(bytes) + 1 AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(regexp_extract_all(hex(bytes), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, x: xor(c // 256, step[xor(c % 256, x) + 1])), 4294967295) AS text_crc32 FROM numbered, steps)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(n % {sharding.SHARDS} AS INTEGER) AS shard, n // {sharding.SHARDS} AS slot,
  CAST(NULL AS INTEGER) AS grown_shard FROM summed JOIN (SELECT number, n FROM walk WHERE done) USING (number)"""

_PHRASES = f"""
WITH pieces AS (SELECT coalesce(lang, '{phrases.UNNAMED}') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
runs AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM words, range(1, {phrases.LONGEST + 1}) t(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS p FROM f WHERE m > 1 AND f >= {phrases.LEAST}),
inside AS (SELECT lang, f AS longer, unnest(flatten(list_transform(range(2, m), lambda s: list_transform(range(1, m - s + 2),
  lambda i: array_to_string(p[i:i + s - 1], ' '))))) AS phrase FROM often WHERE m > 2),
covered AS (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT lang, m, phrase, f, p FROM often LEFT JOIN covered USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {phrases.COVERED} * f),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(p[1:k], ' ') AS x, array_to_string(p[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scored AS (SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= {phrases.TOP}"""

ORACLES: dict[str, str] = {"op3_secrets": _SECRETS, "op4_shards": _SHARDS, "op9_neighbours": _NEAREST, "op12_phrases": _PHRASES}
