"""One query per operator of this subpackage over its whole table; `ORACLES` has SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from driftline.llm import alignment, bpe, byte_words, fingerprint, hard_negatives, html_text, near_dedup, packing, pii, quality_model, quality_rules, secret_scan, toxicity
from driftline.llm.common import held_out, table

# Vocabularies are read where they are installed and passed on by path.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def training_labels(spark, sf, column):
    """Labelled ids that may be learned from: crc32 of the id as text modulo 3 is not 1."""
    return table(spark, sf, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", column)


@query
def op10_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, training_labels(spark, sf, "toxic"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op5_quality_rules(spark, sf):
    judged = quality_rules.apply_rules(table(spark, sf, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


ORACLES["op5_quality_rules"] = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
starts AS (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i:i+7]) AS c FROM starts),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM windows WHERE c > 1) GROUP BY r),
m AS (SELECT w.r, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN covered ON w.r = covered.r),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             100 * n_symbols > 10 * word_chars AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup_lines FROM m),
h AS (SELECT host, count(*) AS n, sum(symbols::INT) AS s, sum(dup_lines::INT) AS d FROM f GROUP BY host),
a AS (SELECT sum(s) / sum(n) AS ms, sum(d) / sum(n) AS md, var_pop(s / n) AS vs, var_pop(d / n) AS vd FROM h),
k AS (SELECT *, CASE WHEN vs > 0 THEN greatest(2.0, least(1000.0, ms * (1 - ms) / vs - 1)) ELSE 1000.0 END AS ws,
             CASE WHEN vd > 0 THEN greatest(2.0, least(1000.0, md * (1 - md) / vd - 1)) ELSE 1000.0 END AS wd FROM a),
v AS (SELECT host, (s + ms * ws) / (n + ws) >= 0.5 AS bad_s, (d + md * wd) / (n + wd) >= 0.5 AS bad_d FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (symbols AND bad_s) AND NOT (dup_lines AND bad_d) AS kept
FROM f JOIN v USING (host)
"""


@query
def op9_secret_scan(spark, sf):
    docs = table(spark, sf, "documents")
    scanner = secret_scan.Scanner(secret_scan.build_dictionary(docs))
    return secret_scan.scan_secrets(docs, scanner)


@query
def op1_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), WORD_BPE)


@query
def op3_near_dedup(spark, sf):
    return near_dedup.near_duplicates(table(spark, sf, "documents"), near_dedup.Near(words=4))


@query
def op2_fingerprint(spark, sf):
    return fingerprint.compare_edits(table(spark, sf, "documents"))


@query
def op7_bpe(spark, sf):
    return bpe.encode_and_decode(table(spark, sf, "documents"), BYTE_BPE)


@query
def op6_quality_model(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality_model.fit(docs, training_labels(spark, sf, "quality"))
    return quality_model.score_quality(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_html_text(spark, sf):
    pages = table(spark, sf, "pages")
    return html_text.extract(pages, html_text.learn_weights(pages))


@query
def op4_pii(spark, sf):
    docs = table(spark, sf, "documents")
    return pii.find_personal_data(docs, pii.learn_patterns(docs))


@query
def op11_byte_words(spark, sf):
    return byte_words.encode_and_decode(table(spark, sf, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


@query
def op12_hard_negatives(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), label.alias("label"), hard_negatives.whole_components(F.col("embedding")).alias("q"))
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


ORACLES["op12_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS r FROM s WHERE alike QUALIFY r <= 5)
SELECT p.anchor_id, p.other AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
       s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""


@query
def op13_alignment(spark, sf):
    return alignment.align(table(spark, sf, "documents"), BYTE_BPE, PIECE_BPE)
