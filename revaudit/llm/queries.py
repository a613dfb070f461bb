"""One query an operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, filter_audit, hard_negatives, line_dedup, media, mixing, ngram_join, repetition, secrets, sharding, toxicity, warc
from .common import documents


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(documents(spark, sf_dir)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "dropped_lines", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir)).drop("media")


#: The tree of the mix: a source belongs to a domain by its number.
def levels() -> dict[str, Column]:
    domain = F.when(F.col("source").rlike("^src[0-6]$"), "web").when(F.col("source").rlike("^src([7-9]|1[0-3])$"), "books").otherwise("reference")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


WEIGHTS = {"domain": {"web": 5, "books": 3, "reference": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 2}}


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), levels(), WEIGHTS)
    return mixed.select("doc_id", "mix_domain", "mix_lang", "mix_source", "mix_tokens", "mix_epoch")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_toxicity": op2_toxicity,
    "op3_ring_shards": op3_ring_shards,
    "op4_line_dedup": op4_line_dedup,
    "op5_warc": op5_warc,
    "op6_media_columns": op6_media_columns,
    "op7_mix": op7_mix,
    "op8_ngram_join": op8_ngram_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_filter_audit": op13_filter_audit,
}

#: Those that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op7_mix": r"""
WITH d AS (
  SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-6]$') THEN 'web' WHEN regexp_matches(source, '^src([7-9]|1[0-3])$') THEN 'books' ELSE 'reference' END AS dom,
         lang, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS tok
  FROM documents),
leaf AS (SELECT dom, lang, source, CAST(sum(tok) AS BIGINT) AS tok, CAST(2 * sum(tok) AS BIGINT) AS supply FROM d GROUP BY ALL),
n1 AS (SELECT dom, CAST(sum(supply) AS BIGINT) AS supply, CASE dom WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END AS w, (SELECT CAST(sum(tok) AS BIGINT) FROM leaf) AS b FROM leaf GROUP BY dom),
o1 AS (SELECT *, row_number() OVER o AS rn, greatest(b - coalesce(sum(supply) OVER p, 0), 0) AS lef, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS rw FROM n1
  WINDOW o AS (ORDER BY supply / w, dom NULLS FIRST), p AS (ORDER BY supply / w, dom NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f1 AS (SELECT min(rn) AS rn, arg_min(lef, rn) AS lef, arg_min(rw, rn) AS rw FROM o1 WHERE supply * rw > lef * w),
g1 AS (SELECT o1.dom, CASE WHEN f1.rn IS NULL OR o1.rn < f1.rn THEN supply ELSE f1.lef * w // f1.rw END AS b FROM o1, f1),
n2 AS (SELECT l.dom, lang, CAST(sum(supply) AS BIGINT) AS supply, CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS w, any_value(g1.b) AS b FROM leaf l JOIN g1 ON l.dom IS NOT DISTINCT FROM g1.dom GROUP BY l.dom, lang),
o2 AS (SELECT *, row_number() OVER o AS rn, greatest(b - coalesce(sum(supply) OVER p, 0), 0) AS lef, sum(w) OVER (PARTITION BY dom) - coalesce(sum(w) OVER p, 0) AS rw FROM n2
  WINDOW o AS (PARTITION BY dom ORDER BY supply / w, lang NULLS FIRST), p AS (PARTITION BY dom ORDER BY supply / w, lang NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f2 AS (SELECT dom, min(rn) AS rn, arg_min(lef, rn) AS lef, arg_min(rw, rn) AS rw FROM o2 WHERE supply * rw > lef * w GROUP BY dom),
g2 AS (SELECT o2.dom, o2.lang, CASE WHEN f2.rn IS NULL OR o2.rn < f2.rn THEN supply ELSE f2.lef * w // f2.rw END AS b FROM o2 LEFT JOIN f2 ON o2.dom IS NOT DISTINCT FROM f2.dom),
n3 AS (SELECT l.dom, l.lang, l.source, l.tok, l.supply, CASE WHEN l.source = 'src0' THEN 2 ELSE 1 END AS w, g2.b FROM leaf l JOIN g2 ON l.dom IS NOT DISTINCT FROM g2.dom AND l.lang IS NOT DISTINCT FROM g2.lang),
o3 AS (SELECT *, row_number() OVER o AS rn, greatest(b - coalesce(sum(supply) OVER p, 0), 0) AS lef, sum(w) OVER (PARTITION BY dom, lang) - coalesce(sum(w) OVER p, 0) AS rw FROM n3
  WINDOW o AS (PARTITION BY dom, lang ORDER BY supply / w, source NULLS FIRST), p AS (PARTITION BY dom, lang ORDER BY supply / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f3 AS (SELECT dom, lang, min(rn) AS rn, arg_min(lef, rn) AS lef, arg_min(rw, rn) AS rw FROM o3 WHERE supply * rw > lef * w GROUP BY dom, lang),
g3 AS (SELECT o3.dom, o3.lang, o3.source, tok, CASE WHEN f3.rn IS NULL OR o3.rn < f3.rn THEN supply ELSE f3.lef * w // f3.rw END AS target FROM o3 LEFT JOIN f3 ON o3.dom IS NOT DISTINCT FROM f3.dom AND o3.lang IS NOT DISTINCT FROM f3.lang),
t AS (SELECT *, CASE WHEN tok > 0 THEN target // tok ELSE 2 END AS whole, CASE WHEN tok > 0 THEN target % tok ELSE 0 END AS rest FROM g3),
k AS (SELECT d.*, t.whole, t.rest, md5(concat('7:', CAST(t.whole AS BIGINT), ':', coalesce(CAST(doc_id AS VARCHAR), 'none'))) AS o
  FROM d JOIN t ON d.dom IS NOT DISTINCT FROM t.dom AND d.lang IS NOT DISTINCT FROM t.lang AND d.source IS NOT DISTINCT FROM t.source),
s AS (SELECT *, sum(tok) OVER (PARTITION BY dom, lang, source ORDER BY o RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k),
c AS (SELECT *, CAST(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM s)
SELECT doc_id, dom AS mix_domain, lang AS mix_lang, source AS mix_source, tok AS mix_tokens, CAST(e AS INTEGER) AS mix_epoch
FROM (SELECT *, unnest(range(0, copies)) AS e FROM c)
""",
    # All pairs: what the query returns where its tables miss no link.
    "op11_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS i, vec_id, embedding::DOUBLE[] AS x,
         coalesce(len(embedding) > 0 AND list_bool_and([y IS NOT NULL AND isfinite(y) FOR y IN embedding]) AND list_bool_or([y <> 0 FOR y IN embedding]), false) AS good
  FROM embeddings),
l AS (SELECT a.i AS a, b.i AS b FROM v a JOIN v b ON a.good AND b.good AND a.i <> b.i AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT i AS a, i AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS i, min(v.vec_id) AS component_id FROM r JOIN v ON r.b = v.i GROUP BY r.a),
n AS (SELECT a AS i, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (i) LEFT JOIN n USING (i)
""",
    # Sums of whole numbers are exact in doubles here.
    "op12_hard_negatives": r"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * y::DOUBLE) FOR y IN embedding] AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and([y IS NOT NULL AND isfinite(y) FOR y IN embedding]), true)),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS k
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE k <= 3
""",
    "op13_filter_audit": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(w.doc_id > least, least IS NOT NULL) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT '' AS o UNION ALL SELECT o || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(o, c)),
s AS (SELECT o AS filter_order, CAST(k AS INTEGER) AS step, substr(o, k, 1) AS f, substr(o, 1, k - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS k) WHERE length(o) = 5),
x AS (SELECT g.*, s.*, contains(fails, f) AS failing, len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND before <> '' AND fails <> '' AS gone FROM g, s),
r AS (
  SELECT part, filter_order, step, any_value(f) AS f, CAST(coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (failing AND gone), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (fails = f), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (failing AND NOT gone), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (failing AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM x GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
""",
}
