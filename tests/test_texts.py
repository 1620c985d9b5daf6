"""Tokens, readings, whole corrections from texts, alignments, the gate, sources and sweeps: goldens and plain twins."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolex.functions import characters, distance_batch, sound_tables, sounds
from echolex.functions.columns import once
from echolex.operators import correction, gate, glossary, lookup, measures, prompts, sweeps, synthesis
from echolex.sources import glossaries, pairs
from echolex.streaming import correct_stream

KANJI = [("進", ["シン"]), ("新", ["シン", "アタラ"]), ("藤", ["ドウ", "フジ"]), ("両", ["リョウ"]), ("氏", ["シ"]), ("誤", ["アヤマ", "ゴ"]), ("訂", ["テイ"]), ("正", ["マサ", "セイ"]), ("中", ["ナカ", "チュウ"]), ("村", ["ムラ"]), ("小", ["コ"]), ("林", ["ハヤシ", "リン"]), ("話", ["ハナシ"])]
TERMS = [("新藤", "シンドウ", "person"), ("中村", "ナカムラ", "person"), ("量子誤り訂正", "リョウシアヤマリテイセイ", "jargon"), ("ミライドライブ", "ミライドライブ", "product"), ("逐次復号", "チクジフクゴウ", "jargon"), ("佐藤太郎", "サトウタロウ", "person")]


@pytest.fixture(scope="module")
def kanji(spark):
    return spark.createDataFrame(KANJI, "kanji string, readings array<string>")


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame([(i, s, [r], 1.0, c) for i, (s, r, c) in enumerate(TERMS)], "entry_id long, surface string, readings array<string>, weight double, category string")


def test_kinds(spark):
    want = {" ": "space", "　": "space", "・": "punct", "~": "punct", "ー": "katakana", "ヶ": "katakana", "々": "kanji", "あ": "hiragana", "ゝ": "hiragana", "漢": "kanji", "7": "digit", "７": "digit", "①": "digit", "²": "digit", "a": "latin", "Ｚ": "latin", "é": "other", "—": "punct", "€": "other", "#": "punct", " ": "other"}
    rows = spark.createDataFrame(list(want.items()), "c string, k string").select("c", characters.kind("c").alias("k")).collect()
    assert {r["c"]: r["k"] for r in rows} == want


def test_tokens(spark, kanji):
    docs = spark.createDataFrame([(1, "caféABC12進藤さん。"), (2, ""), (3, None), (4, "ｶ Ａ1")], "doc_id long, text string")
    rows = sorted(characters.tokens(docs, kanji).collect(), key=lambda r: (r["doc_id"], r["tok"]))
    got = [(r["surface"], r["kind"], r["readings"][:1], r["blocked"]) for r in rows if r["doc_id"] == 1]
    assert got == [("caf", "latin", ["シーエーエフ"], False), ("é", "other", [], False), ("ABC", "latin", ["エービーシー"], False), ("12", "digit", ["イチニ"], False), ("進", "kanji", ["シン"], False), ("藤", "kanji", ["ドウ"], False), ("さ", "hiragana", ["さ"], False), ("ん", "hiragana", ["ん"], True), ("。", "punct", [], True)]
    assert all("caféABC12進藤さん。"[r["start"] : r["end"]] == r["surface"] for r in rows if r["doc_id"] == 1)
    assert {r["doc_id"] for r in rows} == {1, 4}
    assert [r["readings"] for r in rows if r["surface"] == "Ａ"] == [[""]]
    read = {r["doc_id"]: r["reading"] for r in characters.reading_of_texts(characters.tokens(docs, kanji)).collect()}
    assert read[1] == "シーエーエフéエービーシーイチニシンドウさん。"


def test_lexicon_tokens(spark, kanji):
    lexicon = spark.createDataFrame([("進藤", ["シンドウ"], "名詞", "固有名詞"), ("さん", ["サン"], "接尾辞", ""), ("藤さ", ["x"], "名詞", "普通名詞"), ("話", ["ハナシ"], "名詞", "普通名詞")], "surface string, readings array<string>, pos string, pos2 string")
    docs = spark.createDataFrame([(1, "進藤さんの話")], "doc_id long, text string")
    rows = sorted(characters.lexicon_tokens(docs, lexicon, kanji).collect(), key=lambda r: r["tok"])
    assert [(r["surface"], r["start"], r["end"], r["blocked"], r["common"], r["proper"]) for r in rows] == [("進藤", 0, 2, False, False, True), ("さん", 2, 4, True, False, False), ("の", 4, 5, True, False, False), ("話", 5, 6, False, True, False)]


def test_voiced_variants(spark):
    run = F.array(*(F.struct(F.array(*map(F.lit, r)).alias("readings"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("kanji").alias("kind")) for r in (["コ", "ショウ"], ["ハヤシ", "リン"])))
    row = spark.range(1).select(run.alias("run")).select(characters.with_voiced(correction.reading_variants(F.col("run"), 4), F.col("run"), 4).alias("v")).first()
    assert row["v"] == ["コハヤシ", "コリン", "ショウハヤシ", "ショウリン", "コバヤシ", "ショウバヤシ"]


def test_units(spark):
    rows = spark.createDataFrame([("ABC12 進藤さん。。、カナx_ é€",)], "t string").select(characters.units("t").alias("u")).first()
    assert rows["u"] == ["ABC", "12", "進藤", "さん", "。", "。", "、", "カナ", "x", "_", "é€"]


def test_unit_distance_is_plain(spark):
    rng = random.Random(1)
    rows = [([rng.choice("abcde") * 2 for _ in range(rng.randint(0, 9))], [rng.choice("abcde") * 2 for _ in range(rng.randint(0, 9))]) for _ in range(60)]

    def plain(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(line[j + 1] + 1, new[-1] + 1, line[j] + (x != y)))
            line = new
        return line[-1]

    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", measures.unit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r["d"] == plain(r["a"], r["b"]) for r in got)


def test_corrections_of_texts(spark, kanji, terms):
    texts = ["進藤さんが両氏誤り訂正の話をしました。", "進藤さんです。", "中村さんの話です。", "予算の確認です。ご視聴ありがとうございました。", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in correction.correct_texts(docs, terms, kanji).collect()}
    assert got == {0: "新藤さんが量子誤り訂正の話をしました。", 1: "新藤さんです。", 2: texts[2], 3: "予算の確認です。", 4: "", 5: None}
    again = spark.createDataFrame(list(got.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in correction.correct_texts(again, terms, kanji).collect()} == got
    same = correction.correct_texts(docs, terms.limit(0), kanji, correction.CorrectionConfig(remove_hallucinations=False)).collect()
    assert {r["doc_id"]: r["text"] for r in same} == dict(enumerate(texts))
    found = correction.candidate_set(spark.createDataFrame([(1, "進藤"), (2, "話。")], "doc_id long, text string"), terms, kanji).collect()
    assert [(r["doc_id"], r["surface"], r["nd"]) for r in found] == [(1, "新藤", 0.0)]


def test_receipts(spark, kanji, terms):
    docs = spark.createDataFrame([(0, "進藤さんが両氏誤り訂正の話をしました。"), (1, "何も")], "doc_id long, text string")
    tokens, config = characters.tokens(docs, kanji), correction.CorrectionConfig(has_pos=False, rendaku=True)
    rows = correction.explain(docs, tokens, terms, config).collect()
    applied = {(r["span"], r["replacement"]) for r in rows if r["applied"]}
    assert applied == {("進藤", "新藤"), ("両氏誤り訂正", "量子誤り訂正")}
    for r in rows:
        assert r["accepted"] == (r["probability"] >= 0.5)
        assert r["reason"] == ("gate-accept" if r["accepted"] else f"gate-reject(p={r['probability']:.3f}<0.50)")
        assert sum(o["cost"] for o in r["alignment"]) == pytest.approx(r["raw"], abs=1e-2)
        assert list(r["features"].asDict()) == gate.FEATURES
        assert r["raw"] <= r["max_raw"] + 1e-9 and r["nd"] <= r["tau"] + 1e-9
    counts = {r["doc_id"]: r for r in correction.span_counts(docs, tokens, terms, config).collect()}
    assert counts[0]["enumerated"] > counts[0]["queried"] > 0 and counts[1]["queried"] == 0

    @F.pandas_udf("array<double>")
    def prefers(before, options, after):
        import pandas as pd

        return pd.Series([[0.0, 9.0 if o[1] == "新藤" else 1.0] for o in options])

    scored = correction.proposals(docs, tokens, terms, config, rerank=prefers).collect()
    assert {r["features"]["lm_delta"] for r in scored if r["replacement"] == "新藤"} == {5.0}


def test_alignment_and_bounded_distance(spark):
    rng = random.Random(3)
    kana = "アカサタナハマヤラワンッーキシチョュドガ"
    rows = [("".join(rng.choices(kana, k=rng.randint(1, 8))), "".join(rng.choices(kana, k=rng.randint(1, 8)))) for _ in range(300)] + [("シントウ", "シンドウ")]
    df = spark.createDataFrame(rows, "a string, b string").select(sounds.phonemes("a").alias("a"), sounds.phonemes("b").alias("b"))
    df = df.withColumn("ca", sounds.indel_costs("a")).withColumn("cb", sounds.indel_costs("b"))
    budget = F.lit(0.28) * F.greatest(F.size("a"), F.size("b"))
    got = df.select("a", "b", budget.alias("budget"), sounds.phonetic_distance("a", "b", "ca", "cb").alias("d"), distance_batch.bounded_distance("a", "b", "ca", "cb", budget).alias("near"), distance_batch.alignment("a", "b", "ca", "cb").alias("ops")).collect()
    for r in got:
        assert r["near"] == (r["d"] if r["d"] <= r["budget"] else None)
        assert sum(o["cost"] for o in r["ops"]) == pytest.approx(r["d"], abs=1e-9)
        assert [o["a"] for o in r["ops"] if o["a"]] == r["a"] and [o["b"] for o in r["ops"] if o["b"]] == r["b"]
    assert [(o["op"], o["a"], o["b"]) for o in got[-1]["ops"] if o["op"] != "="] == [("~", "t", "d")]


def test_alphabet_and_long_vowels(spark):
    assert len(sound_tables.alphabet()) == 43 and len(sound_tables.cost_model()) == 94
    row = spark.range(1).select(sounds.canonicalize(F.array(*map(F.lit, "k o u R a a".split())), collapse=True).alias("p")).first()
    assert row["p"] == ["k", "o", "a"]


def test_gate_fit_is_the_plain_one(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 20))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=120) * 0.3 > 0).astype(int)
    rows = [(i, dict(zip(gate.FEATURES, map(float, r), strict=True)), int(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    schema = "id long, features struct<" + ", ".join(f"{n}: double" for n in gate.FEATURES) + ">, label int"
    fitted = gate.fit(spark.createDataFrame(rows, schema), ["id"])
    order = np.random.default_rng(0).permutation(120)
    used = order[30:]
    mean, scale = x[used].mean(0), x[used].std(0)
    z, w, b = (x[used] - mean) / scale, np.zeros(20), 0.0
    weight = np.where(y[used] > 0, 1.0, 3.0)
    weight = weight / weight.mean()
    for epoch in range(400):
        err = (1 / (1 + np.exp(-(z @ w + b))) - y[used]) * weight
        gw, gb = z.T @ err / 90 + w / 90, err.mean()
        w, b = w - 0.5 / (1 + 0.01 * epoch) * gw, b - 0.5 / (1 + 0.01 * epoch) * gb
    assert np.allclose(fitted.weights, w) and fitted.bias == pytest.approx(b)
    assert fitted.metadata["training"]["accuracy"] > 0.9
    path = str(tmp_path / "gate.json")
    fitted.save(path)
    assert gate.load(path) == fitted
    own = json.load(open(path))
    own["features"] = own["features"][::-1]
    json.dump(own, open(path, "w"))
    with pytest.raises(ValueError, match="features"):
        gate.load(path)
    p = spark.createDataFrame(rows, schema).select(fitted.probability({n: F.col(f"features.{n}") for n in gate.FEATURES}).alias("p")).first()["p"]
    s = float((x[0] - mean) / scale @ np.array(fitted.weights) + fitted.bias)
    assert p == pytest.approx(0.0 if x[0][14] >= 1 else 1 / (1 + math.exp(-(fitted.platt[0] * s + fitted.platt[1]))))


CSV = "表記,読み,種別,重み,異読\n新藤,シンドウ,person,2.5,\n# note,x,,,\n中村,ナカムラ,,,チュウムラ|ナカソン\n新藤,シントウ,other,bad,\n"


@pytest.mark.parametrize(("name", "text", "want"), [
    ("a.csv", CSV, [("新藤", "シンドウ", ["シントウ"], "person", 2.5), ("中村", "ナカムラ", ["チュウムラ", "ナカソン"], "", 1.0)]),
    ("b.csv", "新藤,シンドウ\n\n中村,ナカムラ,person\n", [("新藤", "シンドウ", [], "", 1.0), ("中村", "ナカムラ", [], "person", 1.0)]),
    ("c.tsv", "surface\treading\n新藤\tシンドウ\n", [("新藤", "シンドウ", [], "", 1.0)]),
    ("d.json", '[{"surface": "新藤", "reading": "シンドウ", "weight": 2}, {"surface": "中村", "reading": null}]', [("新藤", "シンドウ", [], "", 2.0), ("中村", "None", [], "", 1.0)]),
    ("e.jsonl", '{"surface": "新藤", "reading": "シンドウ"}\n', [("新藤", "シンドウ", [], "", 1.0)]),
    ("f.txt", "新藤\nミライ\n", [("新藤", "シンドウ", [], "", 1.0), ("ミライ", "ミライ", [], "", 1.0)]),
    ("g.csv", "", []),
])
def test_glossary_files(spark, tmp_path, kanji, name, text, want):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    rows = glossaries.read(spark, str(path), kanji if name == "f.txt" else None).orderBy("entry_id").collect()
    got = [(r["surface"], r["reading"], r["aliases"] if name != "f.txt" else [], r["category"], r["weight"]) for r in rows]
    assert [(*g[:3], g[3], g[4]) for g in got] == [(*w[:3], "" if name == "d.json" and g[3] == "None" else w[3], w[4]) for g, w in zip(got, want, strict=True)]


def test_glossary_round_trip(spark, tmp_path):
    source = tmp_path / "a.csv"
    source.write_text(CSV + '"a,""b""",エー,x,0.125,\n', encoding="utf-8")
    first = glossaries.read(spark, str(source))
    glossaries.write(first, str(tmp_path / "out.csv"))
    again = glossaries.read(spark, str(tmp_path / "out.csv"))
    row = lambda df: sorted((r["surface"], r["reading"], tuple(r["aliases"]), r["category"], r["weight"]) for r in df.collect())
    assert row(first) == row(again) and len(row(first)) == 3


def test_pairs(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text('{"id": "1", "gold": "a", "hypothesis": "b", "error_types": ["voicing", "word-drop"], "source_corpus": "synthetic"}\n{"id": "2", "gold": "c", "hypothesis": "c", "error_types": ["voicing"], "source_corpus": "aozora"}\n', encoding="utf-8")
    rows = pairs.read(spark, str(path))
    pairs.write(rows, str(tmp_path / "out"))
    assert sorted(map(str, pairs.read(spark, str(tmp_path / "out")).collect())) == sorted(map(str, rows.collect()))
    assert {(r["label"], r["pairs"]) for r in pairs.statistics(rows).collect()} == {("voicing", 2), ("word-drop", 1)}
    assert pairs.conditions(rows).first()["corpora"] == "aozora,synthetic"
    assert pairs.publishable(rows.where("id = '1'")).count() == 1
    with pytest.raises(Exception, match="licence to be checked"):
        pairs.publishable(rows).collect()
    path.write_text('{"id": "1", "odd": 1}\n')
    with pytest.raises(Exception, match="unknown field odd"):
        pairs.read(spark, str(path)).collect()


def test_prompts(spark, kanji, terms):
    rng = random.Random(2)
    entries = [(i, "a" * rng.randint(1, 60), "x" * rng.randint(0, 40)) for i in range(80)]
    df = spark.createDataFrame(entries, "entry_id long, surface string, reading string")
    cost = {r["entry_id"]: r["c"] for r in df.select("entry_id", measures.count_tokens(prompts.piece()).alias("c")).collect()}
    used, taken = 0, []
    for i, _, _ in entries:
        if used + cost[i] <= 90:
            taken.append(i)
            used += cost[i]
    packed = prompts.pack(df, 90)
    assert (packed.places, packed.used, packed.entries) == (taken, used, 80)
    row = prompts.build(spark.createDataFrame([(1, "text")], "doc_id long, text string"), df, 200).first()
    assert row["prompt"].startswith(prompts.INSTRUCTION) and row["prompt"].endswith("text") and row["terms_included"] + row["terms_dropped"] == 80
    docs = spark.createDataFrame([(1, "昨日、進藤さん。")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "新藤", "シンドウ"), (1, "zz", "パピプペポ")], "doc_id long, term string, reading string")
    found = prompts.closest_spans(characters.tokens(docs, kanji), asked).collect()
    assert [(r["term"], r["start"], r["end"], r["nd"]) for r in found] == [("新藤", 3, 5, 0.0)]
    pattern = spark.range(1).select(prompts.candidate_pattern(F.array(F.lit("a.b"), F.lit("c"))).alias("p"), prompts.candidate_pattern(F.array().cast("array<string>")).alias("n"), prompts.choose(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(1.0), F.lit(2.0))).alias("c")).first()
    assert (pattern["p"], pattern["n"], pattern["c"]) == (r"^(?:a\.b|c)$", "(?!)", "b")


def test_index_screen_and_recall(spark, terms):
    index = lookup.readings(terms)
    asked = spark.createDataFrame([("a", "シンドウ", 0.28), ("b", "パピプペポパピプペポ", 0.28), ("c", "ア", 0.28)], "q_key string, r string, tau double").withColumn("phonemes", sounds.phonemes("r"))
    assert {r["q_key"] for r in lookup.screen(asked, index).collect()} >= {"a"} and "b" not in {r["q_key"] for r in lookup.screen(asked, index).collect()}
    assert lookup.screen(asked, index.limit(0)).count() == 0
    row = lookup.retrieval_recall(asked.select("q_key", "phonemes"), index).first()
    assert row["recall"] == 1.0 and row["exhaustive_hits"] >= 1
    stats = lookup.index_stats(terms, index).first()
    assert (stats["entries"], stats["indexed_readings"], stats["reachable_terms"]) == (6, 6, 6)


def test_sweeps(spark, kanji, terms):
    rows = [("1", "新藤さんです。", "進藤さんです。"), ("2", "中村さんの話。", "中村さんの話。"), ("3", "進藤さん。", "進藤さん。")]
    found = spark.createDataFrame(rows, "doc_id string, gold string, hypothesis string")
    propose = sweeps.proposer(found, terms, kanji)
    made = propose(correction.CorrectionConfig())
    labels = {(r["doc_id"], r["span"]): r["outcome"] for r in sweeps.training_rows(found, made).collect()}
    assert labels[("1", "進藤")] == "repair" and labels[("3", "進藤")] == "damage"
    points = {round(r["threshold"], 2): r for r in sweeps.operating_points(found, made, terms.select(F.col("surface").alias("term")), 10).collect()}
    assert len(points) == 11
    assert points[0.0]["correction_rate"] == 1.0 and points[0.0]["damage_rate"] == 0.0 and points[0.0]["accepted"] == 2
    assert points[1.0]["accepted"] == 0 and points[1.0]["correction_rate"] == 0.0


def test_synthesis(spark):
    parts = spark.createDataFrame([("p", s, f"{c}{s}", f"{c}{s}r", 1.0, 1.0) for s in (1, 2) for c in "abcdef"], "category string, slot int, surface string, reading string, share double, weight double")
    train, test = synthesis.disjoint(parts, 20, 10, "s")
    a, b = ({r["surface"] for r in x.collect()} for x in (train, test))
    assert len(a) == 20 and len(b) == 10 and not a & b
    with pytest.raises(ValueError, match="only"):
        synthesis.glossary(parts, 40, "s")
    own = spark.createDataFrame([("a9b", "a9b", ["x"]), ("a9b", "a8b", ["a"]), ("long text that is said", "short", []), ("ab", "ac", ["ab"])], "g string, h string, t array<string>")
    got = [r["l"] for r in own.select(synthesis.labels(F.col("g"), F.col("h"), F.col("t")).alias("l")).collect()]
    assert got == [["term-phonetic"], ["number-unit"], ["word-drop"], ["term-phonetic"]]
    sized = glossary.sized(train.select("entry_id", "surface").limit(4), test.select("entry_id", "surface"), 9, "s").collect()
    assert sorted(r["place"] for r in sized) == list(range(9))
    assert synthesis.silence_probes(spark).count() == 7 and synthesis.pathologies(spark).count() == 9


def test_stream_is_the_batch(spark, tmp_path, kanji, terms):
    docs = spark.createDataFrame([(1, "進藤さんです。"), (2, "何も。")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    correct_stream(stream, lambda b: correction.correct_texts(b, terms, kanji), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "新藤さんです。", 2: "何も。"}


def test_what_a_filter_asks_for_is_computed_once(spark):
    names = spark.range(40).select((F.col("id") % 4).alias("n")).distinct()
    rows = once(names, a=F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: i * 7)).where(F.size("a") > 1)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") == 1, plan
    assert plan.index("transform(") < plan.index("Aggregate"), plan
    assert sorted(r["a"] for r in rows.collect()) == [[7 * i for i in range(n + 1)] for n in (1, 2, 3)]


def test_no_token_is_shuffled_to_meet_its_reading(spark, kanji):
    rows = characters.tokens(spark.createDataFrame([(1, "a b 山 c 12")], "doc_id long, text string"), kanji)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan, plan
    assert [r["surface"] for r in rows.orderBy("tok").collect()] == ["a", " ", "b", " ", "山", " ", "c", " ", "12"]
