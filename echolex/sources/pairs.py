"""Pairs of a reference and a transcript as JSON lines; result documents; licences of corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _TEXTS, _NUMBER = T.StringType(), T.ArrayType(T.StringType()), T.DoubleType()
_KINDS = {"glossary_terms": _TEXTS, "error_types": _TEXTS, "speed": _NUMBER, "snr_db": _NUMBER}
PAIR = T.StructType(
    [T.StructField(c, _KINDS.get(c, _TEXT)) for c in "id gold hypothesis glossary_terms error_types speaker speed snr_db room asr_model source_corpus source_license split provenance".split()]
)
_DEFAULTS = {"speaker": "", "speed": 1.0, "room": "close", "asr_model": "", "source_corpus": "", "source_license": "", "split": "train", "provenance": "measured"}

# Corpora, their licences, and whether a licence is still to be checked for each work.
LICENCES = [
    ("aozora", "PublicDomain-or-CC-BY (per work)", True),
    ("wikipedia-ja", "CC-BY-SA-4.0", False),
    ("e-gov", "CC-BY-4.0 (政府標準利用規約 第2.0版)", False),
    ("jrc-acquis-ja", "Check upstream", True),
    ("synthetic", "CC0-1.0", False),
]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of JSON lines, absent fields by their defaults. A line with an unknown field, or that is no JSON, is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", PAIR, {"mode": "FAILFAST"}).alias("p"), F.json_object_keys("value").alias("keys"))
    odd = F.array_except("keys", F.array(*map(F.lit, PAIR.names)))
    known = F.when(F.size(odd) == 0, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("unknown field "), F.array_join(odd, ", "))))
    rows = parsed.select(known.alias("p")).select("p.*")
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("glossary_terms", "error_types")}
    return rows.withColumns(lists | {c: F.coalesce(c, F.lit(v)) for c, v in _DEFAULTS.items()}).select(*PAIR.names)


def write(pairs: DataFrame, path: str) -> None:
    """JSON lines, null fields written too."""
    pairs.select(*PAIR.names).write.option("ignoreNullFields", False).mode("overwrite").json(path)


def statistics(pairs: DataFrame) -> DataFrame:
    """label, pairs: how many pairs have each error label."""
    return pairs.select(F.explode("error_types").alias("label")).groupBy("label").agg(F.count("*").alias("pairs"))


def conditions(pairs: DataFrame) -> DataFrame:
    """One row: pairs, speakers, rooms, corpora (sorted, each once) and how many were simulated."""
    each = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return pairs.agg(F.count("*").alias("pairs"), each("speaker").alias("speakers"), each("room").alias("rooms"), each("source_corpus").alias("corpora"), F.count_if(F.col("provenance") == "simulated").alias("simulated"))


def licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LICENCES, "corpus string, licence string, to_check boolean")


def publishable(pairs: DataFrame) -> DataFrame:
    """``pairs`` if each is of a known corpus whose licence needs no further check; any other row raises when it is met."""
    known = F.broadcast(licences(pairs.sparkSession))  # a fixed list
    joined = pairs.join(known, F.col("source_corpus") == F.col("corpus"), "left")
    why = F.when(F.col("corpus").isNull(), "unknown corpus").when(F.col("to_check") | (F.col("licence") == ""), "licence to be checked")
    checked = F.when(why.isNull(), F.col("id")).otherwise(F.raise_error(F.concat(why, F.lit(": "), F.coalesce("source_corpus", F.lit("")))))
    return joined.withColumn("id", checked).select(*pairs.columns)
