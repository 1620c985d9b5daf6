"""Spans, proposals and whole corrections: brute force and goldens."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from echolex.operators import correction

TOKENS = "doc_id long, tok int, start int, end int, kind string, readings array<string>, blocked boolean, common boolean, proper boolean"
GLOSSARY = "entry_id long, surface string, readings array<string>, weight double"


def _tables(spark, texts):
    """texts: lists of (surface, kind, readings, blocked, common, proper)."""
    docs, tokens = [], []
    for d, parts in enumerate(texts):
        at = 0
        for i, (surface, kind, *rest) in enumerate(parts):
            tokens.append((d, i, at, at + len(surface), kind, *rest))
            at += len(surface)
        docs.append((d, "".join(p[0] for p in parts)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(tokens, TOKENS)


def _kanji(surface, *readings, common=False, proper=False):
    return (surface, "kanji", list(readings), False, common, proper)


GA, STOP = ("が", "hiragana", ["ガ"], True, False, False), ("。", "punct", [], False, False, False)


def test_spans_brute_force(spark):
    rng = random.Random(4)
    kinds = [_kanji("漢字", "カンジ", "カンジ", "アザナ"), ("テスト", "katakana", ["テスト"], False, True, False), GA, STOP, ("長い長い長い言葉", "kanji", None, False, True, False)]
    texts = [[rng.choice(kinds) for _ in range(rng.randint(0, 14))] for _ in range(30)]
    docs, tokens = _tables(spark, texts)
    want = set()
    for d, parts in enumerate(texts):
        at = [0]
        for p in parts:
            at.append(at[-1] + len(p[0]))
        for i in range(len(parts)):
            if parts[i][3] or parts[i][1] == "punct":
                continue
            for j in range(i, min(i + 8, len(parts))):
                if parts[j][1] == "punct" or at[j + 1] - at[i] > 24:
                    break
                if not parts[j][3]:
                    beam = [("", 0)]
                    for p in parts[i : j + 1]:
                        made = sorted(((t + f, r + k) for t, r in beam for k, f in enumerate((p[2] or ["?" * len(p[0])])[:3])), key=lambda x: x[1])
                        beam = list({t: (t, r) for t, r in reversed(made)}.values())[::-1]
                        beam = sorted(beam, key=lambda x: x[1])[:32]
                    compound = j > i and all(p[1] == "katakana" for p in parts[i : j + 1])
                    common = not compound and all(p[4] or p[3] for p in parts[i : j + 1])
                    want.add((d, at[i], at[j + 1], "".join(p[0] for p in parts[i : j + 1]), common, tuple(t for t, _ in beam)[:8]))
    got = [(r["doc_id"], r["start"], r["end"], r["span"], r["common"], tuple(r["variants"])) for r in correction.spans(docs, tokens).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_correct(spark):
    glossary = spark.createDataFrame([(0, "量子誤り訂正", ["リョウシアヤマリテイセイ"], 1.0), (1, "新藤", ["シンドウ"], 1.0), (2, "加藤", ["カトウ"], 1.0), (3, "非線形復号", ["ヒセンケイフクゴウ"], 1.0), (4, "非線形符号化", ["ヒセンケイフゴウカ"], 1.0)], GLOSSARY)
    error = [_kanji("両氏", "リョウシ", common=True), _kanji("誤り", "アヤマリ", common=True), _kanji("訂正", "テイセイ", common=True), GA, STOP]
    texts = [
        error,
        [_kanji("進藤", "シンドウ", proper=True), GA, _kanji("来る", "クル", common=True), STOP],
        [_kanji("稼働", "カドウ", common=True), GA, STOP],
        [_kanji("新藤", "シンドウ", proper=True), GA, STOP],
        [_kanji("非線形", "ヒセンケイ", common=True), _kanji("符号", "フゴウ", common=True), STOP],
        [STOP],
    ]
    docs, tokens = _tables(spark, texts)
    got = {r["doc_id"]: r["text"] for r in correction.correct(docs, tokens, glossary).collect()}
    assert got == {0: "量子誤り訂正が。", 1: "新藤が来る。", 2: "稼働が。", 3: "新藤が。", 4: "非線形符号。", 5: "。"}
    found = correction.proposals(docs, tokens, glossary)
    assert found.where(F.col("nd") > F.col("tau") + 1e-9).count() == 0
    row = found.where("doc_id = 1").first()
    assert (row["span"], row["replacement"], row["nd"], row["margin"], row["n_candidates"]) == ("進藤", "新藤", 0.0, 1.0, 1)
    # an empty glossary, and empty tables, change nothing
    same = correction.correct(docs, tokens, glossary.limit(0))
    assert {r["doc_id"]: r["text"] for r in same.collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}
    assert correction.correct(docs.limit(0), tokens.limit(0), glossary).count() == 0
