"""The registered queries of the text operators and, where SQL can say the same, their statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import conversations, decontamination, fingerprints, language, licenses, likelihood, mixing, near_dup, negatives, pieces, secrets, token_counts, toxicity
from ledgerloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct 4-word shingles, links from 80 % of the union."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    joined = {c: F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")}
    return found.select(*(joined.get(c, c) for c in found.columns))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.spelled(F.col("base")), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.detect(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.scores(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document."""
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1 over the sources in order, 150 % of all words, at most two epochs."""
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=150, epochs=2)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of conversation c comes from c - c % 5 and has crc32(c) % 9 turns."""
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"), base=lambda c: c - c % 5, head=lambda c: F.crc32(c.cast("string")) % 9, longest=8).drop("turn_conv", "turn_pos")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 100; where an id is divisible by 7 the label moves on by one."""
    moved = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(moved, every=100, positives=5, negatives=5, low=80)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_minhash_near_dedup, op2_token_counts, op3_license_scan, op4_secret_scan, op5_document_fingerprints, op6_benchmark_decontamination,
                                                     op7_toxicity, op8_language_id, op9_lm_scoring, op10_sentencepiece, op11_mix_sources, op12_conversation_trie, op13_hard_negatives)}
QUERIES["pipeline"] = corpus_pipeline.run

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.x >= 80 * (na.n + nb.n - p.x)),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.node = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(node) AS m FROM r GROUP BY doc_id) c USING (doc_id)""",
    "op6_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, j, j + 9), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS j FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM x),
o AS (SELECT doc_id, k, j, array_to_string(list_slice(w, j, j + k - 1), ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, k WHERE len(w) >= k)),
h AS (SELECT o.doc_id, o.j, o.k, x.item_id FROM o JOIN x ON o.k = x.k AND o.g = x.g),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, c.doc_id IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_mix_sources": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, left(md5(concat('11:', coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, '')))), 16) AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY s * 10 // w, source) AS k FROM s),
c AS (SELECT k, s, w, 150 * sum(s) OVER () - 200 * sum(s) OVER (ORDER BY k) AS num, 100 * (sum(w) OVER () - sum(w) OVER (ORDER BY k)) AS den FROM r UNION ALL SELECT 0, 0, 1, 150 * sum(s), 100 * sum(w) FROM r),
l AS (SELECT c.k, c.num, c.den FROM c LEFT JOIN c n ON n.k = c.k + 1 WHERE n.k IS NULL OR 2 * n.s * c.den > n.w * c.num ORDER BY c.k LIMIT 1),
t AS (SELECT source, s, CASE WHEN r.k <= l.k THEN 2.0::DOUBLE * s ELSE w::DOUBLE * num::DOUBLE / den::DOUBLE END AS target FROM r, l),
x AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS whole FROM t),
y AS (SELECT *, floor(target + 0.5)::BIGINT - whole * s AS extra FROM x),
q AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY u) AS upto, sum(size) OVER (PARTITION BY source, u) AS tied FROM d)
SELECT doc_id, q.source, size, s AS source_size, target,
  (whole * size + CASE WHEN upto <= extra THEN size WHEN upto - tied >= extra THEN 0 ELSE size * (extra - upto + tied) // tied END)::BIGINT AS taken
FROM q JOIN y ON q.source IS NOT DISTINCT FROM y.source""",
    "op12_conversation_trie": r"""
WITH o AS (SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, l, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda a, b: list_reduce([xor(a, b)] || range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 9 AS h FROM o),
b AS (SELECT h.conv_id, list_concat(list_slice(coalesce(o.l, []), 1, h.h), list_slice(h.l, h.h + 1, len(h.l))) AS s FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, list_slice(s, 1, d) AS p, d = len(s) AS e FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM b)),
n AS (SELECT d, p, min(conv_id) AS c, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE e), '') AS ends FROM p GROUP BY d, p),
k AS (SELECT d - 1 AS d, list_slice(p, 1, d - 1) AS p, count(*) AS k FROM n WHERE d > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(k.k, 0) AS k FROM n LEFT JOIN k ON n.d = k.d AND n.p = k.p),
s AS (SELECT a AS d, list_slice(p, 1, a) AS p, count(*) FILTER (WHERE k = 0) AS leaves, sum(CASE WHEN d > 0 THEN (n - 1) * strlen(p[d].x) ELSE 0 END) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY 1, 2)
SELECT m.c AS conv_id, m.d AS depth, u.c AS parent_conv_id, m.n AS n_convs, m.k AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s ON m.d = s.d AND m.p = s.p LEFT JOIN n u ON u.d = m.d - 1 AND u.p = list_slice(m.p, 1, m.d - 1)""",
    "op13_hard_negatives": r"""
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, c.id AS c, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS s FROM r a JOIN r c ON a.id % 100 = 0 AND a.id <> c.id AND len(a.v) = len(c.v)),
p AS (SELECT a, c AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, c) <= 5)
SELECT p.a AS anchor_id, p.p AS positive_id, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.s DESC, s.c)::INTEGER AS rank, s.c AS negative_id, p.ps AS positive_score, s.s AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.ps <= 100 * s.s AND s.s <= p.ps QUALIFY rank <= 5""",
}
