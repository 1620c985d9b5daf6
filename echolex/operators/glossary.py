"""Glossary tables: merging of repeated surfaces and nested subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(rows: DataFrame) -> DataFrame:
    """(entry_id, surface, reading, aliases, category, weight) with one row a surface: the first place and reading, aliases
    in order of appearance, the first category (and ``notes``, where there are any) that is not empty, the largest weight.
    Empty surfaces and comments go."""
    clean = rows.where((F.trim("surface") != "") & ~F.trim("surface").startswith("#")).withColumn("surface", F.trim("surface"))
    grouped = clean.groupBy("surface").agg(
        F.min("entry_id").alias("entry_id"),
        F.array_sort(F.collect_list(F.struct("entry_id", "reading", "aliases"))).alias("all"),
        F.min_by("category", F.when(F.col("category") != "", F.col("entry_id"))).alias("category"),
        F.max("weight").alias("weight"),
        *([F.min_by("notes", F.when(F.col("notes") != "", F.col("entry_id"))).alias("notes")] if "notes" in rows.columns else []),
    )
    reading = F.coalesce(F.get("all", F.lit(0))["reading"], F.lit(""))
    every = F.flatten(F.transform("all", lambda x: F.concat(F.array(F.coalesce(x["reading"], F.lit(""))), F.coalesce(x["aliases"], F.array().cast("array<string>")))))
    return grouped.select("entry_id", "surface", reading.alias("reading"), F.array_distinct(F.filter(every, lambda r: (r != "") & (r != reading))).alias("aliases"), F.coalesce("category", F.lit("")).alias("category"), "weight", *([F.coalesce("notes", F.lit("")).alias("notes")] if "notes" in rows.columns else []))


def subset(glossary: DataFrame, n: int, seed: str) -> DataFrame:
    """``n`` entries by a seeded hash; a larger n keeps those of a smaller one."""
    return glossary.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("entry_id").cast("string"))), "entry_id").limit(n)


def coverage(glossary: DataFrame, n: int) -> DataFrame:
    """The first ``n`` entries in order of ``entry_id``: larger glossaries hold smaller ones."""
    return glossary.orderBy("entry_id").limit(n)


def sized(targets: DataFrame, others: DataFrame, n: int, seed: str) -> DataFrame:
    """``n`` entries in a seeded order (column ``place``): all targets, and the first others whose surface is no target's.

    Too few others, or more targets than ``n``, are an error."""
    columns = [c for c in targets.columns if c in others.columns]
    pool = others.join(targets.select("surface"), "surface", "left_anti")
    have, more = targets.count(), pool.count()
    if n < have or n - have > more:
        raise ValueError(f"{n} entries of {have} targets and {more} others")
    chosen = targets.select(columns).union(pool.orderBy("entry_id").limit(n - have).select(columns))
    # ranks without a window over all: entries are dealt by the first byte of their hash
    order = F.md5(F.concat_ws("|", F.lit(seed), "surface"))
    dealt = chosen.withColumn("_o", order).withColumn("_b", F.substring("_o", 1, 2))
    counts = dealt.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # 256 rows
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_o", "surface")) - 1
    return dealt.join(F.broadcast(before), "_b").withColumn("place", place).drop("_o", "_b", "_before")
