"""The registered queries of this folder, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, linededup, lmscore, mixing, neardup, quality, rules, sentencepieces, simhash, substrings

#: The tokenizer's model file.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepieces.encode(_table(spark, sf_dir, "documents"), sentencepieces.read_model(MODEL))
    return coded.withColumnRenamed("id", "doc_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("spans")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.classify(docs, labels).withColumnRenamed("id", "doc_id")


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(
        "page_id", linededup.host_of(F.col("url")).alias("host"), linededup.page_text(F.col("html")).alias("text")
    )
    cleaned = linededup.line_dedup(pages.withColumn("before", F.size(linededup.lines(F.col("text")))), "host")
    left = F.size(linededup.lines(F.col("text")))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")  # noqa: E731  a null page has no lines
    return cleaned.select(
        "page_id", "host", count(F.col("before")).alias("n_lines"), count(F.col("before") - left).alias("n_dropped"),
        F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_texts(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_mixing, op3_near_vectors, op4_substring, op5_quality, op6_rules, op7_line_dedup, op8_simhash, op9_lm_score, op10_language)}

_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(w for words in rules.STOP_WORDS.values() for w in words))

SQL = {
    # weights are doubles, so 2^52 of them are whole numbers; all slots in one run, where the operator has segments from 8,192 blocks on
    "op2_mixing": r"""
WITH RECURSIVE n AS (
  SELECT coalesce(source, '') AS s, CAST(sqrt(count(*)) * CAST(4503599627370496 AS DOUBLE) AS HUGEINT) AS w, (count(*) + 15) // 16 AS k
  FROM documents GROUP BY 1),
l AS (SELECT list(s ORDER BY s) AS names, list(w ORDER BY s) AS ws, list(k ORDER BY s) AS ks, CAST(sum(w) AS HUGEINT) AS total FROM n),
e AS (
  SELECT CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS pick, list_transform(ws, lambda w: CAST(0 AS BIGINT)) AS done, ws, ks, total FROM l
  UNION ALL
  SELECT t + 1, CASE WHEN best < 9000000000000000 THEN p ELSE 0 END,
    list_transform(done, lambda d, i: CASE WHEN i = p AND best < 9000000000000000 THEN d + 1 ELSE d END), ws, ks, total
  FROM (
    SELECT *, list_position(o, list_min(o)) AS p, list_min(o) AS best FROM (
      SELECT *, list_transform(done, lambda d, i: CASE WHEN d < ks[i] AND d * total // ws[i] <= t
        THEN CAST(((d + 1) * total + ws[i] - 1) // ws[i] * 1000000 + i AS BIGINT) ELSE 9000000000000000 END) AS o
      FROM e WHERE list_sum(done) < list_sum(ks)))),
r AS (SELECT names[pick] AS s, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) AS block FROM e, l WHERE pick > 0),
d AS (
  SELECT doc_id, source, coalesce(source, '') AS s,
    (row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1) // 16 + 1 AS block
  FROM documents)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST((block - 1) * total // w AS BIGINT) AS release,
  CAST((block * total + w - 1) // w AS BIGINT) AS deadline, CAST(slot AS BIGINT) AS slot
FROM d JOIN n USING (s) JOIN r USING (s, block), l""",
    "op3_near_vectors": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= CAST(0.95 AS DOUBLE)),
r AS (SELECT vec_id AS x, vec_id AS c FROM embeddings UNION SELECT p.x, r.c FROM r JOIN p ON p.y = r.x AND r.c < p.x),
g AS (SELECT x, min(c) AS component_id FROM r GROUP BY x),
l AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN g ON g.x = vec_id LEFT JOIN l ON l.x = vec_id""",
    "op4_substring": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (SELECT r, i, md5(list_aggregate(w[i:i + 34], 'string_agg', ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
p AS (SELECT r, i FROM s QUALIFY count(*) OVER (PARTITION BY h) > 1),
c AS (SELECT DISTINCT r, i + k AS i FROM p, (SELECT unnest(range(35)) AS k)),
k AS (
  SELECT x.r, count(c.i) AS n, string_agg(x.v, ' ' ORDER BY x.i) FILTER (c.i IS NULL) AS t
  FROM (SELECT r, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM d) x LEFT JOIN c ON c.r = x.r AND c.i = x.i GROUP BY x.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)""",
    "op6_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
l AS (
  SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS bare
  FROM d),
g AS (
  SELECT r, i, list_aggregate(w[i:i + 2], 'string_agg', ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
f AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM f, (VALUES (0), (1), (2)) v(k) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(bare) AS word_chars,
         length(bare) - length(regexp_replace(bare, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         length(bare) - length(replace(bare, '!', '')) AS bangs, len(ls) AS n_lines,
         len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) IN ({_STOPS}))) AS stops
  FROM l LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS k FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND stops / k >= 0.02 AND word_chars / k BETWEEN 2.0 AND 12.0 AND n_symbols / k <= 0.1
         AND bangs / k <= 0.5 AND n_repeat_words / k <= 0.5 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
FROM b""",
    "op7_line_dedup": r"""
WITH a AS (
  SELECT row_number() OVER () AS r, page_id,
    coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'),
      '(?i)</?(?:p|div|li|ul|ol|nav|h[1-6]|br|title|article|table|tr|td|footer|header|body|html|head|section|aside)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g') AS t0
  FROM pages),
p AS (
  SELECT r, page_id, host, string_split(replace(replace(replace(replace(replace(replace(t0,
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(10)) AS ls
  FROM a),
x AS (
  SELECT r, page_id, host, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM p),
y AS (SELECT *, trim(l, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS c FROM x),
h AS (SELECT host, count(*) AS total FROM p GROUP BY host),
k AS (SELECT host, c, count(DISTINCT r) AS n FROM y WHERE c <> '' GROUP BY host, c),
d AS (SELECT host, c FROM k JOIN h USING (host) WHERE n > 1 AND n > CAST(0.1 AS DOUBLE) * total),
z AS (SELECT y.*, d.c IS NOT NULL AS gone FROM y LEFT JOIN d USING (host, c))
SELECT page_id, host, count(*) FILTER (c <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped,
       md5(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_md5
FROM z GROUP BY r, page_id, host""",
}
