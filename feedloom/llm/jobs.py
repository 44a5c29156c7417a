"""The queries of the training-data operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, merkle, mixing, near_copies, neighbours, packing, quality, repeats, secret_scan, sharding, token_counts, token_files, toxicity, twins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep(fn) if fn else keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op1_quality_rules(spark, d):
    v = quality.verdicts(table(spark, d, "documents"))
    ints = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return v.select("doc_id", *ints, "base_failed", "kept", *quality.FENCES)


@query
def op5_simhash_near_dedup(spark, d):
    return near_copies.near_duplicates(table(spark, d, "documents"))


@query
def op6_bounded_ring_shards(spark, d):
    return sharding.shard(table(spark, d, "documents"))


@query
def op7_secret_scan(spark, d):
    return secret_scan.report(table(spark, d, "documents"))


def _filled(t: str, parent: str) -> str:
    """Nodes of ``t`` with their budget, by definition: each gets min(supply, line * w).

    What all nodes together take is a concave function of the line, the least of its
    tangents; so the line that takes just what is given is the largest of the tangents'.
    """
    same = f"b.{parent} IS NOT DISTINCT FROM a.{parent}"
    line = f"""(SELECT max(l) FROM (
      SELECT (a.given - coalesce(sum(c.supply) FILTER (c.supply / c.w < b.supply / b.w), 0))
        / sum(c.w) FILTER (c.supply / c.w >= b.supply / b.w) AS l
      FROM {t} b JOIN {t} c ON c.{parent} IS NOT DISTINCT FROM b.{parent} WHERE {same} GROUP BY b.supply / b.w))"""
    return f"""SELECT a.*, CAST(CASE WHEN a.given >= (SELECT sum(b.supply) FROM {t} b WHERE {same}) THEN a.supply
      ELSE least(a.supply, floor(a.w * {line})) END AS BIGINT) AS budget FROM {t} a"""


OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % 4 AS domain, lang, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens, md5(text) AS same
  FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
dom AS (
  SELECT 0 AS top, domain, CAST(sum(tokens) * 4 AS BIGINT) AS supply, (ARRAY[40.0, 30.0, 20.0, 10.0])[domain + 1]::DOUBLE AS w,
    (SELECT CAST(floor(sum(tokens)::DOUBLE * 0.8) AS BIGINT) FROM leaf) AS given
  FROM leaf GROUP BY domain),
dom_b AS ({_filled("dom", "top")}),
tongue AS (
  SELECT domain, lang, CAST(sum(tokens) * 4 AS BIGINT) AS supply,
    CASE WHEN lang = 'en' THEN 5.0 WHEN lang = 'de' THEN 3.0 ELSE 2.0 END::DOUBLE AS w, any_value(b.budget) AS given
  FROM leaf JOIN dom_b b USING (domain) GROUP BY domain, lang),
tongue_b AS ({_filled("tongue", "domain")}),
src AS (
  SELECT l.domain, l.lang, {{'d': l.domain, 'l': l.lang}} AS up, l.source, l.tokens, l.tokens * 4 AS supply, 1.0::DOUBLE AS w, b.budget AS given
  FROM leaf l JOIN tongue_b b ON l.domain = b.domain AND l.lang IS NOT DISTINCT FROM b.lang),
src_b AS ({_filled("src", "up")}),
placed AS (
  SELECT d.*, b.budget, CASE WHEN b.tokens > 0 THEN b.budget // b.tokens ELSE 0 END AS whole,
    CASE WHEN b.tokens > 0 THEN b.budget % b.tokens ELSE b.budget END AS rest
  FROM d JOIN src_b b ON d.domain = b.domain AND d.lang IS NOT DISTINCT FROM b.lang AND d.source IS NOT DISTINCT FROM b.source),
ordered AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY substr(md5(concat_ws(':', '7', whole, doc_id, same)), 1, 15), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM placed)
SELECT doc_id, domain, lang, source, tokens, budget,
  CAST(whole + CASE WHEN rest > 0 AND before < rest AND 2 * (rest - before) >= tokens THEN 1 ELSE 0 END AS INT) AS copies
FROM ordered"""


@query(sql=OP8_SQL)
def op8_hierarchical_mix(spark, d):
    return mixing.select(table(spark, d, "documents"))


@query
def op9_sum_of_squares_packing(spark, d):
    return packing.pack(table(spark, d, "documents"))


@query
def op10_toxic_chain(spark, d):
    docs = table(spark, d, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, d, "labels")))


@query
def op2_sharded_hnsw(spark, d):
    return neighbours.nearest(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_columnwise_repeats(spark, d):
    return repeats.remove_repeats(table(spark, d, "documents")).drop("kept")


@query
def op4_context_mixed_tokens(spark, d):
    return token_files.round_trip(table(spark, d, "documents"))


@query(sql=twins.OP11_SQL)
def op11_phrase_collocations(spark, d):
    return collocations.phrases(table(spark, d, "documents"))


@query
def op12_token_counts(spark, d):
    return token_counts.count_tokens(table(spark, d, "documents"))


@query(sql=twins.OP13_SQL)
def op13_merkle_manifest(spark, d):
    return merkle.manifest(table(spark, d, "documents"))
