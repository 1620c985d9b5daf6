"""The trie's top-k against comparing every pair, and the phonetic model's settings against hand-written values."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from echolex import catalog
from echolex.functions import distance_batch, sounds
from echolex.functions import sound_tables as S
from echolex.functions.cost_model import DEFAULT, CostModel
from echolex.operators import correction, lookup

KANA = "アイウエオカキクサシタチナニハマヤラリワンッーガザョャ"


def _kana(rng, n):
    return "".join(rng.choice(KANA) for _ in range(n))


def _glossary(spark, rng, n):
    """Terms of which many begin alike, with several readings, equal readings and one that is unknown."""
    heads = [_kana(rng, 3) for _ in range(12)]
    rows = []
    for i in range(n):
        readings = [rng.choice(heads) + _kana(rng, rng.randint(0, 5)) for _ in range(rng.randint(1, 3))]
        rows.append((i * 3 % n, f"t{i % (n - 3)}", readings + ([""] if i % 9 == 0 else []) + (["蘇"] if i % 11 == 0 else []), float(rng.randint(0, 3)) if i % 7 else None))
    return spark.createDataFrame(rows, "entry_id long, surface string, readings array<string>, weight double"), heads


def _costs(ph, m):
    out = []
    for i, p in enumerate(ph):
        before, after = ph[i - 1] if i else "", ph[i + 1] if i + 1 < len(ph) else ""
        if p in S.VOWELS:
            thin = (p == "u" and before in S.EPENTHESIS_U) or (p == "i" and before in S.EPENTHESIS_I)
            out.append(m.indel_long_vowel if p in (before, after) else m.indel_epenthetic if thin else m.indel_vowel)
        else:
            out.append({"?": m.indel_unknown, "Q": m.indel_Q, "N": m.indel_N, "R": m.indel_R, "y": m.indel_glide, "w": m.indel_glide}.get(p, m.indel_consonant))
    return out


def plain_distance(a, b, m):
    ca, cb = _costs(a, m), _costs(b, m)
    row = [0.0]
    for c in cb:
        row.append(row[-1] + c)
    for p, c in zip(a, ca, strict=True):
        new = [row[0] + c]
        for j, q in enumerate(b):
            new.append(min(row[j + 1] + c, new[-1] + cb[j], row[j] + S.substitution(p, q, m)))
        row = new
    return row[-1]


def plain_top_k(asked, index, bounds, model):
    morae = lambda ph: sum(p in "aiueoNQR" for p in ph)
    out = {}
    for key, ph, tau, most in asked:
        best = {}
        for r in index if ph else []:
            a, b = morae(ph), morae(r["phonemes"])
            if bounds.max_mora_ratio is not None and a and b and abs(a - b) / max(a, b) > bounds.max_mora_ratio + 1e-9:
                continue
            raw, norm = plain_distance(ph, r["phonemes"], model), max(len(ph), len(r["phonemes"]))
            if raw > tau * norm or (most is not None and raw > most):
                continue
            hit = (raw / norm, (r["slot"]["entry_id"], r["slot"]["place"]), raw, r)
            best[r["entry_id"]] = min(best.get(r["entry_id"], hit), hit, key=lambda h: h[:2])
        ranked = sorted(best.values(), key=lambda h: (h[0], h[3]["weight"] is None, -(h[3]["weight"] or 0), h[3]["surface"], h[3]["entry_id"]))
        out |= {(key, i + 1): (h[3]["entry_id"], h[3]["reading"], h[2], h[0]) for i, h in enumerate(ranked[: bounds.top_k])}
    return out


def _found(df):
    return {(r["q_key"], r["rank"]): (r["entry_id"], r["reading"], r["raw"], r["nd"]) for r in df.collect()}


@pytest.mark.parametrize("model", [DEFAULT, CostModel(expand_long_vowel_mark=False, fold_ou_to_oo=False, indel_consonant=0.4, vowel_vowel_default=0.05, indel_R=0.01)])
def test_trie_is_comparing_every_pair(spark, monkeypatch, model):
    rng = random.Random(5)
    glossary, heads = _glossary(spark, rng, 260)
    index = lookup.readings(glossary, model)
    texts = [rng.choice(heads) + _kana(rng, rng.randint(0, 5)) for _ in range(60)] + ["ア", "ン", "蘇", "蘇蘇ア", "", "カカ"]
    rows = [(f"q{i}", x, rng.choice([0.05, 0.28, 0.6]), rng.choice([None, 0.4, 2.0])) for i, x in enumerate(texts + texts[:5])]
    asked = spark.createDataFrame(rows, "q_key string, kana string, tau double, max_raw double").select("q_key", sounds.phonemes("kana", model).alias("phonemes"), "tau", "max_raw")
    mine, theirs = [tuple(r) for r in asked.collect()], index.collect()
    for bounds in (lookup.QueryBounds(top_k=4), lookup.QueryBounds(top_k=2, max_mora_ratio=None)):
        expected = plain_top_k(mine, theirs, bounds, model)
        assert len(expected) > 60
        assert _found(lookup.top_k(asked, index, bounds, model=model)) == expected
        # in parts of an index and blocks of queries that no task may exceed
        monkeypatch.setattr(lookup, "TRIE_READINGS", 60)
        monkeypatch.setattr(lookup, "QUERY_BLOCK", 20)
        assert _found(lookup.top_k(asked, index, bounds, model=model)) == expected
        monkeypatch.undo()


def test_empty_sides(spark):
    glossary, _ = _glossary(spark, random.Random(1), 20)
    index = lookup.readings(glossary)
    asked = spark.createDataFrame([("a", "カキ")], "q_key string, kana string").select("q_key", sounds.phonemes("kana").alias("phonemes"))
    assert lookup.top_k(asked.limit(0), index).count() == 0
    assert lookup.top_k(asked, index.limit(0)).count() == 0
    assert lookup.screen(asked.withColumn("tau", F.lit(0.28)), index.limit(0)).count() == 0


def test_all_grams_may_count(spark):
    """Without the cuts of the gram join, what shares a gram is found however common it is."""
    rows = [(i, f"t{i}", ["カキクケ" + k], 1.0) for i, k in enumerate("サシスセソタチツテト")]
    index = lookup.readings(spark.createDataFrame(rows, "entry_id long, surface string, readings array<string>, weight double"))
    asked = spark.createDataFrame([("a", "カキクケナ")], "q_key string, kana string").select("q_key", sounds.phonemes("kana").alias("phonemes"))
    bounds = lookup.QueryBounds(top_k=20, prefilter=None, max_df=None)
    assert _found(lookup.top_k(asked, index, bounds, exhaustive=False)) == _found(lookup.top_k(asked, index, bounds)) != {}


@pytest.mark.parametrize(
    ("settings", "kana", "expected"),
    [
        ({}, "トーキョーセイオウ", "t o o ky o o s e e o o"),
        ({"expand_long_vowel_mark": False}, "トーキョーセイ", "t o R ky o R s e e"),
        ({"expand_long_vowel_mark": False}, "ーア", "R a"),
        ({"fold_ou_to_oo": False}, "トウキョー", "t o u ky o o"),
        ({"fold_ei_to_ee": False}, "セイドウ", "s e i d o o"),
        ({"fold_ou_to_oo": False, "fold_ei_to_ee": False}, "セイドウ", "s e i d o u"),
        ({"collapse_long_vowels": True}, "トーキョーオオア", "t o ky o a"),
        ({"expand_long_vowel_mark": False, "fold_ei_to_ee": False}, "a", "e R"),
        ({"expand_long_vowel_mark": False}, "b", "b i R"),
    ],
)
def test_passes(spark, settings, kana, expected):
    model = CostModel.from_dict(settings)
    row = spark.createDataFrame([(kana,)], "k string").select(F.array_join(sounds.phonemes("k", model), " ").alias("p")).first()
    assert row["p"] == expected


@pytest.mark.parametrize(
    ("name", "a", "b", "before", "after"),
    [
        ("vowel_vowel_default", ["a"], ["e"], 0.5, 0.5), ("consonant_consonant_default", ["k"], ["m"], 1.0, 0.07), ("cross_class_default", ["k"], ["a"], 1.1, 0.07), ("unknown_sub_cost", ["?"], ["a"], 0.95, 0.07),
        ("indel_consonant", ["k"], [], 1.0, 0.07), ("indel_vowel", ["a"], [], 0.85, 0.07), ("indel_Q", ["Q"], [], 0.25, 0.07), ("indel_N", ["N"], [], 0.4, 0.07), ("indel_R", ["R"], [], 0.15, 0.07),
        ("indel_long_vowel", ["a", "a"], ["a"], 0.15, 0.07), ("indel_glide", ["y"], [], 0.5, 0.07), ("indel_epenthetic", ["s", "u"], ["s"], 0.5, 0.07), ("indel_unknown", ["?"], [], 0.95, 0.07),
    ],
)
def test_costs(spark, name, a, b, before, after):
    rows = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    for model, expected in ((DEFAULT, before), (CostModel.from_dict({name: 0.07}), after)):
        batch = distance_batch.phonetic_distance("a", "b", sounds.indel_costs("a", model), sounds.indel_costs("b", model), model)
        found = rows.select(sounds.phonetic_distance("a", "b", model=model).alias("x"), batch.alias("y")).first()
        assert found["x"] == pytest.approx(expected) and found["y"] == pytest.approx(expected)
        assert plain_distance(a, b, model) == pytest.approx(expected)


def test_settings_are_data(spark):
    custom = CostModel(vowel_vowel_default=0.42, indel_Q=0.11, normalize_by="term")
    assert CostModel.from_dict(json.loads(json.dumps(custom.to_dict()))) == custom
    assert CostModel.from_dict({"indel_Q": 1, "no_such_name": 3, "collapse_long_vowels": True}) == CostModel(indel_Q=1.0, collapse_long_vowels=True)
    assert (DEFAULT.least_indel, custom.least_indel) == (0.15, 0.11)
    rows = spark.createDataFrame([(["k", "a"], ["k", "a", "N", "t"])], "a array<string>, b array<string>")
    nd = [rows.select(sounds.normalized_distance("a", "b", model=CostModel(normalize_by=by)).alias("x")).first()["x"] for by in ("max", "term", "mean")]
    assert nd == pytest.approx([1.4 / 4, 1.4 / 4, 1.4 / 3])


def test_correction_takes_a_model(spark):
    """A mark that stays costs less to lose than the vowel that it would have become."""
    glossary = spark.createDataFrame([(1, "新語", ["カノト"], 1.0)], "entry_id long, surface string, readings array<string>, weight double")
    docs = spark.createDataFrame([(1, "カノートです")], "doc_id long, text string")
    kanji = spark.createDataFrame([], "kanji string, readings array<string>")
    fixed = lambda model: correction.correct_texts(docs, glossary, kanji, correction.CorrectionConfig(gate=0.0, model=model)).first()["text"]
    assert fixed(DEFAULT) == "新語です"
    assert fixed(CostModel(expand_long_vowel_mark=False, indel_R=3.0)) == "カノートです"


def test_terms_as_near_but_for_rounding_are_ranked_by_weight(spark):
    # both at 0.36, a step of the bound 0.6: 2.52 / 7, and 3.6 / 10, which is over 0.36 * 10 in doubles
    rows = [(1, "new gear", 1.0), (2, "cold ring", 2.0)]
    terms = spark.createDataFrame(rows, "entry_id long, surface string, weight double").withColumn("readings", F.array(catalog.as_kana("surface")))
    asked = spark.createDataFrame([("erheing",)], "q_key string").withColumn("phonemes", sounds.phonemes(catalog.as_kana("q_key")))
    best = lookup.top_k(asked, lookup.readings(terms), lookup.QueryBounds(tau=0.6, top_k=1)).collect()
    assert [(r["surface"], r["nd"]) for r in best] == [("cold ring", 0.36)]


def test_a_large_index_is_made_once_and_dealt_to_all_cores(spark, monkeypatch):
    glossary, _ = _glossary(spark, random.Random(2), 90)
    index = lookup.readings(glossary)
    monkeypatch.setattr(lookup, "TRIE_READINGS", index.count() - 1)
    asked = spark.createDataFrame([("a", "カキ")], "q_key string, kana string").select("q_key", sounds.phonemes("kana").alias("phonemes"))
    plan = lookup.top_k(asked, index)._jdf.queryExecution().analyzed().toString()
    assert "posexplode" not in plan
    assert f"explode(sequence(0, {spark.sparkContext.defaultParallelism - 1}," in plan, [x.strip()[:120] for x in plan.splitlines() if "Generate" in x]
