"""Glossaries from CSV, TSV, JSON, JSON lines or plain text, and back to CSV.

A glossary file is parsed by Spark's readers, whatever its size. Only its first characters come to the driver, to tell the format
and the header. Rows become (entry_id, surface, reading, aliases, category, weight, notes) with repeated surfaces merged.
``entry_id`` is in file order; a glossary in one file keeps it.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolex.functions import characters
from echolex.operators import correction, glossary

FIELDS = ["surface", "reading", "aliases", "category", "weight", "notes"]

# Header cells that name each field.
HEADERS = {
    "surface": "surface term word 表記 表層 語 用語 見出し".split(),
    "reading": "reading yomi kana pron 読み よみ カナ かな 読み方".split(),
    "aliases": "aliases alias variants 異読 別読み 別名".split(),
    "category": "category type class 種別 カテゴリ 分類".split(),
    "weight": "weight prior freq 重み 頻度".split(),
    "notes": "notes note comment 備考 メモ".split(),
}
_HEAD = 1 << 16  # characters of the file that the format is told by


def field_of(cell: str) -> str | None:
    """The field that a header cell names, if any."""
    name = cell.strip().lower().lstrip("﻿")
    return next((field for field, names in HEADERS.items() if name in names), None)


def _first_line(spark: SparkSession, path: str) -> str:
    """The first line with text, without the mark of byte order."""
    rows = spark.read.text(path).select(F.substring("value", 1, _HEAD).alias("value")).where(F.trim("value") != "").limit(1).collect()
    return rows[0]["value"].lstrip("﻿") if rows else ""


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def _number(text: Column) -> Column:
    """A weight; 1 where it is empty or no number."""
    return F.coalesce(text.try_cast("double"), F.lit(1.0))


def rows(cells: DataFrame) -> DataFrame:
    """Glossary rows of a table with ``entry_id`` and any of the fields as strings: trimmed, aliases split at commas and
    bars, weights as numbers (1 where there is none), without empty surfaces and comments, repeated surfaces merged."""
    have = {c: _text(F.col(c)) if c in cells.columns else F.lit("") for c in FIELDS}
    aliases = F.filter(F.transform(F.split(have["aliases"], r"[,|]"), lambda x: F.trim(x)), lambda x: x != "")
    typed = cells.select("entry_id", *(have[c].alias(c) for c in ("surface", "reading", "category", "notes")), aliases.alias("aliases"), _number(have["weight"]).alias("weight"))
    return glossary.merge(typed)


def read(spark: SparkSession, path: str, kanji: DataFrame | None = None) -> DataFrame:
    """The glossary in a file. The format is told by the name (.tsv, .tab, .json, .jsonl, .ndjson) and the first line:
    a ``[`` begins JSON whatever the name; a tab without a comma makes tabs the separator; a line that names the surface's column
    is a header, else columns are surface, reading, category, weight. ``kanji``: a table of readings to fill missing ones from."""
    ending, head = re.sub(r".*\.", ".", path.rstrip("/").lower()), _first_line(spark, path)
    numbered = F.monotonically_increasing_id().alias("entry_id")
    if ending == ".json" or head.lstrip().startswith("["):
        found = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
        # a null in JSON is the text None, as an empty cell is not
        got = rows(found.select(numbered, *(F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in FIELDS if c in found.columns)))
    elif ending in (".jsonl", ".ndjson"):
        found = spark.read.option("primitivesAsString", True).json(path)
        got = rows(found.select(numbered, *(F.col(c) for c in FIELDS if c in found.columns)))
    else:
        tabs = ending in (".tsv", ".tab") or ("\t" in head and "," not in head)
        separator = "\t" if tabs else ","
        cells = next(csv.reader([head], delimiter=separator), [])
        names = [field_of(c) for c in cells]
        headed = "surface" in names
        names = [n if n and n not in names[:i] else f"extra{i}" for i, n in enumerate(names)] if headed else ["surface", "reading", "category", "weight"]
        lines = spark.read.option("sep", separator).option("quote", '"').option("escape", '"').option("header", headed).option("mode", "PERMISSIVE").schema(", ".join(f"`{n}` string" for n in names)).option("enforceSchema", True).csv(path)
        got = rows(lines.withColumn("surface", F.regexp_replace("surface", "^﻿", "")).select(numbered, *(n for n in names if n in FIELDS)))
    return got if kanji is None else fill_missing_readings(got, kanji)


def fill_missing_readings(entries: DataFrame, kanji: DataFrame, most: int = 4) -> DataFrame:
    """``entries`` with readings where there were none: a surface in kana reads as itself; others by up to ``most`` readings of
    their tokens and the voiced forms of these, the first as reading and the rest as aliases. What has unknown parts stays
    without a reading (and is not indexed)."""
    lacking = entries.where(F.coalesce("reading", F.lit("")) == "").select(F.col("entry_id").alias("doc_id"), F.col("surface").alias("text"))
    kana = rf"^[{characters.CLASSES['hiragana']}{characters.CLASSES['katakana']}]+$"
    tokens = characters.tokens(lacking.where(~F.rlike("text", F.lit(kana))), kanji)
    each = F.struct("tok", "start", "end", "kind", F.slice("readings", 1, correction.READINGS_A_TOKEN).alias("readings"))
    runs = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("run"))
    runs = runs.where(~F.exists("run", lambda t: t["kind"].isin("punct", "space")))
    found = runs.select("doc_id", F.filter(characters.with_voiced(correction.reading_variants(F.col("run"), most), F.col("run"), most), lambda v: ~v.contains("?")).alias("v"))
    joined = entries.join(found, F.col("entry_id") == F.col("doc_id"), "left").drop("doc_id")
    missing = F.coalesce("reading", F.lit("")) == ""
    reading = F.when(~missing, F.col("reading")).when(F.rlike("surface", F.lit(kana)), F.col("surface")).otherwise(F.coalesce(F.get("v", F.lit(0)), F.lit("")))
    out = joined.withColumn("_r", reading)
    more = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.when(missing, F.coalesce("v", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("aliases", F.array_distinct(F.filter(more, lambda a: (a != "") & (a != F.col("_r"))))).withColumn("reading", F.col("_r"))
    return out.select(*entries.columns)


def with_readings(entries: DataFrame) -> DataFrame:
    """``entries`` with ``readings``: reading and aliases in order, each once, as the index takes them."""
    return entries.withColumn("readings", F.array_distinct(F.filter(F.concat(F.array("reading"), "aliases"), lambda r: r != "")))


def write(entries: DataFrame, path: str) -> None:
    """CSV with a header: aliases joined by bars, weights in their shortest form, rows in order of ``entry_id``.

    The order makes one sorted file of ranges; a large glossary is several."""
    weight = F.regexp_replace(F.format_string("%.6g", "weight"), r"(\.\d*?)0+$", "$1")
    cells = entries.orderBy("entry_id").select("surface", "reading", F.array_join("aliases", "|").alias("aliases"), "category", F.regexp_replace(weight, r"\.$", "").alias("weight"), "notes")
    cells.write.option("header", True).option("escape", '"').option("emptyValue", "").mode("overwrite").csv(path)
