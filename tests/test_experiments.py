"""All sizes of a glossary in one plan against a run for each."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import functions as F

from echolex.functions import characters
from echolex.operators import correction, experiments, gate, measures

TERMS = [("新藤", "シンドウ"), ("中村", "ナカムラ"), ("佐藤太郎", "サトウタロウ"), ("進藤", "シンドー"), ("トウキョー", "トウキョウ"), ("仲村", "ナカムタ"), ("やまだ", "ヤマダ")]
TEXTS = [("シントウさん、ナカムタです。", "新藤さん、中村です。"), ("サドウタロウとシンドウ", "佐藤太郎と新藤"), ("トウキョーのヤマダ", "トウキョーのやまだ"), ("なにもない", "なにもない"), (None, "")]


def test_sizes_in_one_plan(spark):
    glossary = spark.createDataFrame([(i, s, [r], float(i % 2), i) for i, (s, r) in enumerate(TERMS)], "entry_id long, surface string, readings array<string>, weight double, place int")
    pairs = spark.createDataFrame([(i, gold, heard) for i, (heard, gold) in enumerate(TEXTS)], "doc_id long, reference string, baseline string")
    docs = pairs.select("doc_id", F.col("baseline").alias("text"))
    tokens = characters.tokens(docs, spark.createDataFrame([], "kanji string, readings array<string>"))
    config = correction.CorrectionConfig(gate=0.0, has_pos=False, screen=False)
    sizes = [2, 4, 6]
    sized = experiments.with_sizes(glossary, sizes)
    assert [r["size"] for r in sized.orderBy("place").collect()] == [2, 2, 4, 4, 6, 6, None]
    done = experiments.corrected(docs, tokens, sized, sizes, config).cache()
    found = {(r["size"], r["doc_id"]): r["text"] for r in done.collect()}
    expected = {}
    for s in sizes:
        for r in correction.correct(docs, tokens, glossary.where(F.col("place") < s), config).collect():
            expected[s, r["doc_id"]] = r["text"]
    assert found == expected
    assert len({found[s, 0] for s in sizes} | {found[s, 1] for s in sizes}) > 3  # the sizes differ
    terms = glossary.select(F.col("surface").alias("term"))
    rows = experiments.conditions(pairs, done, terms)
    by = {(r["condition"], r["size"]): r for r in rows.collect()}
    assert set(by) == {("A", None), ("D", 2), ("D", 4), ("D", 6)}
    for s in sizes:
        own = pairs.join(done.where(F.col("size") == s).withColumnRenamed("text", "corrected"), "doc_id").select("reference", "baseline", "corrected")
        damage = measures.term_damage(own, terms).first()
        assert (by["D", s]["broken"], by["D", s]["fixed"], by["D", s]["term_damage"]) == (damage["broken"], damage["fixed"], damage["damage_rate"])
        whole = measures.summarize(own, terms).first()
        assert (round(by["D", s]["cer"], 9), by["D", s]["term_recall"]) == (round(whole["cer"], 9), whole["term_recall"])
    assert by["A", None]["broken"] == by["A", None]["fixed"] == 0 and by["A", None]["term_recall"] < by["D", 6]["term_recall"]
    whole = json.loads(experiments.document(rows).first()["json"])["conditions"]
    assert [r["size"] for r in whole["D"]] == sizes and len(whole["A"]) == 1 and whole["D"][2]["sentences"] == 5
    assert experiments.corrected(docs.limit(0), tokens.limit(0), sized, sizes, replace(config), gate.Gate()).count() == 0
