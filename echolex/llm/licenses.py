"""License scan by diagonal voting, on DataFrame functions only.

Every run of ``K`` words of a text is hashed and joined to the positions of license templates. A match at word p of the
text and word t of a template votes for the diagonal p - t; votes are aggregated by diagonal, neighbouring diagonals
(an inserted or missing word or two) are merged, and the merged span is verified: the runs agree word for word, the span is
not much longer than the template, and its coverage (matched runs / runs of the template) reaches ``LEAST``.

Runs are made only where all words occur in templates, which loses no match. The templates are a fixed table, small
enough to broadcast whatever the corpus. Votes are kept by document, so a passage that many documents share makes no
large group.

Besides, base phrases are looked up everywhere in the text.

Defined cases: null text is empty (n_words 0, labels empty, first_word and last_word null, score 0); rows that repeat
one another have the same result each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolex.llm.scratch import cut

K = 3
LEAST = 0.6
NEAR = 2  # diagonals that merge
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Public license notices, as words.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "copyright all rights reserved"),
]


def positions() -> list[tuple[int, str, int, int, str]]:
    """(template, label, runs of the template, position, run) of every run of K words of the templates."""
    out = []
    for i, (label, text) in enumerate(TEMPLATES):
        words = text.split()
        n = len(words) - K + 1
        out += [(i, label, n, t, " ".join(words[t : t + K])) for t in range(n)]
    return out


def _vocabulary() -> list[str]:
    return sorted({w for _, text in [*TEMPLATES, *BASE.items()] for w in text.split()})


def _starts(at: str, phrase: str) -> Column:
    """Positions (of those in ``at``) where the phrase's words stand one after another."""

    def here(i: Column) -> Column:
        found = F.lit(True)
        for j, w in enumerate(phrase.split()):
            found = found & (F.get("words", i + j) == w)
        return F.coalesce(found, F.lit(False))

    return F.filter(at, here)


def words_of(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, key (of its text), n_words, places of the base phrases, and its runs within the templates' words."""
    vocabulary = _vocabulary()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0)).alias("words"))
    rows = rows.withColumn("at", F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), i).otherwise(F.lit(-1))), lambda i: i >= 0))

    def run(i: Column) -> Column:
        return F.struct(i.alias("p"), F.array_join(F.slice("words", i + 1, K), " ").alias("run"))

    # a run begins where the next K - 1 words are in the vocabulary too; each is looked up at its place
    whole = F.filter("at", lambda i: functools.reduce(Column.__and__, (F.coalesce(F.get("words", i + j).isin(vocabulary), F.lit(False)) for j in range(1, K))))
    base = {label: _starts("at", phrase) for label, phrase in BASE.items()}
    rows = rows.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), *(x.alias(f"base {label}") for label, x in base.items()), F.transform(whole, run).alias("runs"))
    return rows


def votes(rows: DataFrame) -> DataFrame:
    """(doc_id, key, template, label, total, diagonal, p, t): matches of a text's runs with template positions."""
    spark: SparkSession = rows.sparkSession
    places = spark.createDataFrame(positions(), "template int, label string, total int, t int, template_run string").withColumn("hash", F.xxhash64("template_run"))
    runs = rows.where("size(runs) > 0").select("doc_id", "key", F.explode("runs").alias("r")).select("doc_id", "key", "r.p", "r.run", F.xxhash64("r.run").alias("hash"))
    # the template table is a constant of this module: a bounded broadcast
    met = runs.join(F.broadcast(places), "hash").where("run = template_run")
    return met.select("doc_id", "key", "template", "label", "total", (F.col("p") - F.col("t")).alias("diagonal"), "p", "t").distinct()


def spans(matches: DataFrame) -> DataFrame:
    """(doc_id, key, label, template, first, last, coverage) of verified spans."""
    own = ["doc_id", "key", "template", "label", "total"]
    lines = matches.groupBy(*own, "diagonal").agg(F.count("*").alias("votes"), F.min("p").alias("first"), F.max("p").alias("last"), F.collect_set("t").alias("ts"))
    # diagonals merge when they are near one another both across and along: in order of diagonal, then of place
    w = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(w) <= NEAR, 0).otherwise(1)
    merged = lines.withColumn("fresh", fresh).withColumn("band", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = merged.groupBy(*own, "band").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("matched"))
    coverage = F.col("matched") / F.col("total")
    length = F.col("last") - F.col("first") + 1
    return found.where((coverage >= LEAST) & (length <= 2 * (F.col("total") + K - 1))).select("doc_id", "key", "label", "template", "first", "last", coverage.alias("coverage"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of ``docs``."""
    rows = cut(words_of(docs), "words")
    found = spans(votes(rows)).groupBy("doc_id", "key").agg(F.collect_set("label").alias("_labels"), F.max("coverage").alias("_score"))
    found = found.withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    places = F.flatten(F.array(*(f"base {x}" for x in BASE)))
    base = F.array_compact(F.array(*(F.when(F.size(f"base {x}") > 0, x) for x in sorted(BASE))))
    rows = rows.select("doc_id", "key", "n_words", places.alias("places"), base.alias("base"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("_labels", F.array().cast("array<string>"))))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0)))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )


def oracle_sql() -> str:
    """The same rows by window functions over all words, for a SQL engine with RE2."""
    values = ", ".join(f"({i}, '{label}', {n}, {t}, '{run}')" for i, label, n, t, run in positions())
    base = ", ".join(f"('{label}', '{phrase.split()[0]}', '{phrase}', {len(phrase.split())})" for label, phrase in BASE.items())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS words FROM documents),
templates(template, label, total, t, run) AS (VALUES {values}),
base(label, head, phrase, n) AS (VALUES {base}),
flat AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS p FROM docs),
runs AS (SELECT r, p, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM flat WINDOW o AS (PARTITION BY r ORDER BY p)),
places AS (SELECT r, p, label FROM runs JOIN base ON w = head AND phrase = CASE n WHEN 2 THEN w || ' ' || w1 ELSE w || ' ' || w1 || ' ' || w2 END),
basic AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY r),
votes AS (SELECT DISTINCT r, template, label, total, p - t AS diagonal, p, t FROM runs JOIN templates ON w || ' ' || w1 || ' ' || w2 = run),
lines AS (SELECT r, template, label, total, diagonal, min(p) AS first, max(p) AS last, list(DISTINCT t) AS ts FROM votes GROUP BY ALL),
fresh AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= {NEAR} THEN 0 ELSE 1 END AS f FROM lines WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)),
bands AS (SELECT *, sum(f) OVER (PARTITION BY r, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS band FROM fresh),
merged AS (SELECT r, template, label, total, band, min(first) AS first, max(last) + {K - 1} AS last, len(list_distinct(flatten(list(ts)))) AS matched FROM bands GROUP BY ALL),
found AS (SELECT r, list_distinct(list(label)) AS labels, max(matched / total) AS score FROM merged WHERE matched / total >= {LEAST} AND last - first + 1 <= 2 * (total + {K - 1}) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(basic.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(basic.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM docs LEFT JOIN basic USING (r) LEFT JOIN found USING (r)
"""
