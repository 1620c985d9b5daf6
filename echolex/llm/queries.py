"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolex.llm import embeddings, fim, fingerprints, html_extraction, licenses, minhash, mixing, packing, quality, sharding, toxicity, vector_codes, vector_graph


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_read(spark, sf_dir, "pages"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path(), 4096)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its source's weight (9 places), its block, its place in the source's permutation, and
    how often it is taken."""
    units = mixing.plan(_read(spark, sf_dir, "documents"))
    each = F.explode(F.sequence(F.lit(0), F.col("rows").cast("int") - 1)).alias("_row")
    rows = units.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "block", "place", "copies", each)
    return rows.withColumn("place", F.col("place") + F.col("_row")).drop("_row")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), minhash.MinHashConfig(k=3, threshold=Fraction(85, 100), rows=8, bands=40))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_read(spark, sf_dir, "documents"))


def fingerprint_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of the fingerprints' method: signature bands joined, Jaccard similarity verified, components."""
    return fingerprints.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_read(spark, sf_dir, "embeddings"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(_read(spark, sf_dir, "documents"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.nearest(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html, op2_licenses, op3_packing, op4_embeddings, op5_mixing, op6_quality, op7_minhash, op8_sharding, op9_toxicity, op10_fingerprints, fingerprint_components, op11_codes, op12_fim, op13_neighbours)}


MIXING_SQL = """
WITH RECURSIVE units AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, count(*) AS rows, max(CAST(ceil(strlen(coalesce(text, '')) / 4) AS BIGINT)) AS n_tokens
  FROM documents GROUP BY ALL),
sizes AS (SELECT source, sum(n_tokens * rows) AS tokens, count(*) AS units FROM units GROUP BY source),
shares AS (SELECT list(tokens / total ORDER BY source) AS s, count(*) AS n FROM (SELECT *, sum(tokens) OVER ()::DOUBLE AS total FROM sizes) WHERE tokens > 0),
steps AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT i + 1, CASE WHEN fits THEN mid ELSE low END, CASE WHEN fits THEN high ELSE mid END FROM (
    SELECT i, low, high, mid, ln(z) - e / z >= 0.97::DOUBLE * ln(n) AS fits FROM (
      SELECT i, low, high, n, (low + high) / 2 AS mid,
        list_sum(list_transform(s, lambda x: pow(x, (low + high) / 2))) AS z,
        list_sum(list_transform(s, lambda x: pow(x, (low + high) / 2) * ln(pow(x, (low + high) / 2)))) AS e
      FROM steps, shares WHERE i < 40))),
alpha AS (
  SELECT CASE WHEN (SELECT n = 1 OR -list_sum(list_transform(s, lambda x: x * ln(x))) >= 0.97::DOUBLE * ln(n) FROM shares) THEN 1.0 ELSE (SELECT low FROM steps WHERE i = 40) END AS a),
powers AS (SELECT sizes.*, CASE WHEN tokens > 0 THEN pow(tokens / (sum(tokens) OVER ())::DOUBLE, a) ELSE 0 END AS q, (sum(tokens) OVER ())::DOUBLE AS total FROM sizes, alpha),
weights AS (SELECT *, q / sum(q) OVER () AS weight, q / sum(q) OVER () * total AS budget FROM powers),
dealt AS (
  SELECT u.*, w.tokens, w.weight, w.budget, ('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || digest), 1, 15))::BIGINT AS h,
    greatest(1, CAST(ceil(w.units / 512) AS BIGINT)) AS blocks,
    CASE WHEN w.tokens > 0 THEN CAST(floor(w.budget / w.tokens + 1e-9) AS BIGINT) ELSE 1 END AS epochs
  FROM units u JOIN weights w ON u.source IS NOT DISTINCT FROM w.source),
placed AS (SELECT *, h % blocks AS block, CASE WHEN tokens > 0 THEN budget - epochs * tokens + 1e-6 ELSE 0 END AS rest FROM dealt),
sums AS (SELECT source, block, sum(n_tokens * rows) AS t, sum(rows) AS n, ('0x' || substr(md5('mix|block|' || coalesce(source, '') || '|' || CAST(block AS VARCHAR)), 1, 15))::BIGINT AS o FROM placed GROUP BY source, block),
starts AS (
  SELECT source, block, coalesce(sum(t) OVER w, 0) AS start, coalesce(sum(n) OVER w, 0) AS first
  FROM sums WINDOW w AS (PARTITION BY source ORDER BY o, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
taken AS (
  SELECT p.*, first + coalesce(sum(rows) OVER (PARTITION BY p.source, p.block ORDER BY h, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place, epochs + CASE WHEN tokens > 0 AND start + sum(n_tokens * rows) OVER (PARTITION BY p.source, p.block ORDER BY h, doc_id, digest ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies
  FROM placed p JOIN starts s ON p.source IS NOT DISTINCT FROM s.source AND p.block = s.block)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, CAST(block AS BIGINT) AS block, CAST(place + r AS BIGINT) AS place, CAST(copies AS BIGINT) AS copies FROM (SELECT *, unnest(range(rows)) AS r FROM taken)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": licenses.oracle_sql(), "op5_mixing": MIXING_SQL, "op11_codes": vector_codes.oracle_sql(), "op12_fim": fim.oracle_sql()}
