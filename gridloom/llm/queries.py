"""The registered queries of this subpackage, over the whole tables of a folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontam, hard_negatives, lang_id, line_dedup, mixing, near_dedup, packing, quality, spelling, token_counts, token_store, url_filter, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SEQUENCE_TOKENS, OVER_LIMIT = 2048, 1024


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines, those dropped (numbers from 0) and the text that is left. Null text: null, no lines. Repeated rows lose the same lines; an empty table gives an empty table."""
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.size("_gone").cast("long").alias("n_dropped"), F.array_join(F.col("_gone").cast("array<string>"), ",").alias("dropped"), "text")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens. Null text: the end id alone. Repeated rows are packed each by itself; an empty table gives an empty table."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"), TOKENIZER, SEQUENCE_TOKENS, end_id=0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text. Null text: empty. Repeated rows give repeated rows; an empty table gives an empty table."""
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), TOKENIZER, OVER_LIMIT)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the archive written of it says. Null html: an empty payload; null url: an empty target. Repeated rows give repeated records; an empty table gives an archive without records."""
    pages = _read(spark, sf_dir, "pages")
    path = token_store.store_path(spark, "warc")
    warc.write(pages, path)
    return warc.index(spark, path, pages.schema["page_id"].dataType.simpleString())


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document. Null or empty text: an empty set, linked with nothing; null id: no part in it. Rows of one id follow each its own text; an empty table gives an empty table."""
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document. Null text: no words, so that the base rules fail. Repeated rows give repeated rows; an empty table gives an empty table; without labels only the base rules hold."""
    docs = _read(spark, sf_dir, "documents")
    out = quality.judged(docs, quality.train(docs, _read(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, tokens and checksum of every document, read back from the store. Null text: the end id alone. Null ids come first; repeated rows are stored each by itself; an empty table gives an empty store."""
    path = token_store.store_path(spark, "tokens")
    token_store.write(_read(spark, sf_dir, "documents"), TOKENIZER, path, end_id=2)
    return token_store.read(spark, path)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and hits of every document. Null text on either side: no words, no windows. Repeated rows give repeated rows; an empty benchmark hits nothing; an empty table gives an empty table."""
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("h")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document. Null text and text without letters: und, score 0. Repeated rows give repeated rows; without documents to learn from all are und; an empty table gives an empty table."""
    docs = _read(spark, sf_dir, "documents")
    return lang_id.identify(docs, lang_id.train(docs))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page. Null url, or one without a scheme: empty host and path, allow. Repeated rows give repeated rows; an empty table gives an empty table."""
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document and the words of it that the mix takes. Null text: no words. A null source is the last source; null ids and repeated rows take part each by itself; an empty table gives an empty table."""
    return mixing.mix(_read(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, epochs=2)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive. Rows with a null id, label, vector or component, or one that isn't finite, take no part. Repeated rows are rows of their own; an empty table gives an empty table."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"), label=label)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form and root. Null text: no words; null id: no letter deleted. Repeated rows count each; an empty table gives an empty table."""
    return spelling.variants(spelling.word_counts(_read(spark, sf_dir, "documents").select("doc_id", "text"), least_length=5, least_n=3, drop_one_in=97))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the whole documents; each stage states what it does with nulls, repeated rows and empty tables."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_best_fit_packing, op3_token_counts, op4_warc, op5_minhash_near_dedup, op6_quality_rules, op7_token_store, op8_decontamination, op9_language_id, op10_url_filter, op11_source_mixing, op12_hard_negatives, op13_spelling_variants, pipeline)
}

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS holder FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id IS NOT DISTINCT FROM holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR page_id IS NOT DISTINCT FROM holder THEN NULL ELSE holder END AS refers_to
FROM m
"""

_DECONTAM_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iwin AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iwin),
dwin AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT d.doc_id, d.s, d.n, i.item FROM dwin d JOIN iwin i USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id),
names AS (SELECT doc_id, list_sort(list_distinct(list(item))) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN names USING (doc_id)
"""

_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           CAST('0x' || substr(md5('11' || coalesce(':' || CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM d GROUP BY source),
-- sources by limit over weight: with those before a row at their limit the rest would share what is left; the highest such level is the right one
r AS (SELECT *, 2.0 * source_size / w AS ratio, 1.5 * sum(source_size) OVER () AS total FROM s),
f AS (SELECT CAST(total - coalesce(sum(2.0 * source_size) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM r),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), CAST(w AS DOUBLE) * (SELECT max(level) FROM f)) AS target FROM s),
p AS (SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
      CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, greatest(0, least(size, budget - before)) + greatest(0, least(size, budget - source_size - before)) AS taken FROM p
"""

_NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

#: The other operators need a tokenizer, a trained model or MinHash; their tests hold them against brute force.
ORACLES = {"op4_warc": _WARC_SQL, "op8_decontamination": _DECONTAM_SQL, "op11_source_mixing": _MIX_SQL, "op12_hard_negatives": _NEGATIVES_SQL}
