"""Many terms in texts, segments around places, and places without overlap, against plain Python."""

from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from echolex.functions.columns import offsets
from echolex.operators import edits, hallucination, measures, running, term_automaton


def _counted(terms, texts):
    machine = term_automaton.Automaton([t.encode() for t in terms])
    found, counts = [], {}
    for text, term, at in machine.find([t.encode() for t in texts]):
        found += zip(text.tolist(), term.tolist(), at.tolist(), strict=True)
        for i in term_automaton.apart(text, term, at, np.array([len(t) for t in terms])[term]):
            key = int(text[i]), int(term[i])
            counts[key] = counts.get(key, 0) + 1
    return sorted(found), counts


def test_automaton_finds_every_place(monkeypatch):
    rng = random.Random(7)
    for _ in range(150):
        letters = rng.choice(["ab", "abc", "aé日", "ab "])
        terms = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))})
        texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 20, 400]))) for _ in range(rng.randint(0, 8))]
        monkeypatch.setattr(term_automaton, "BLOCK", rng.choice([5, 17, 1 << 22]))
        monkeypatch.setattr(term_automaton, "SLICE", rng.choice([10, 300, 1 << 20]))
        found, counts = _counted(terms, texts)
        assert found == [(i, j, k) for i, t in enumerate(texts) for j, w in enumerate(terms) for k in range(len(t)) if t.startswith(w, k)]
        assert counts == {(i, j): t.count(w) for i, t in enumerate(texts) for j, w in enumerate(terms) if w in t}


def test_ten_thousand_terms_in_a_long_text():
    rng = random.Random(3)
    terms = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(10_500)})[:10_000]
    text = "".join(rng.choice([*terms[:500], " ", "aaaa"]) for _ in range(200_000))
    assert len(text) > 1_000_000
    began = time.time()
    found, counts = _counted(terms, [text])
    assert time.time() - began < 20
    for j in [*range(0, 10_000, 211), 0, 1, 2]:
        assert counts.get((0, j), 0) == text.count(terms[j])


def _table(spark):
    rows = [(1, "aaa bab", "aa bab", 7), (2, None, "ab", 8), (3, "", "", 9), (4, "日本日本語 aaaa", None, 9), (5, "zz", "ab", 9), (1, "aaa bab", "aa bab", 7)]
    terms = [("aa", "x"), ("ab", "x"), ("日本", "y"), ("日本語", "y"), ("", "z"), (None, "z"), ("bab", "z"), ("absent", "z"), ("aa", "x")]
    return spark.createDataFrame(rows, "id int, reference string, hypothesis string, n_0 int"), spark.createDataFrame(terms, "term string, category string")


@pytest.mark.parametrize("limit", [300_000, 4])
def test_counts_of_odd_tables(spark, monkeypatch, limit):
    """Also where terms are dealt into parts, a task for each part and block of texts."""
    monkeypatch.setattr(term_automaton, "TERM_BYTES", limit)
    monkeypatch.setattr(term_automaton, "SLICE", 1 if limit == 4 else 1 << 20)
    rows, terms = _table(spark)
    found = sorted(tuple(r) for r in term_automaton.counts(rows, terms, ["reference", "hypothesis"], ["id"], ["term", "category"]).collect())
    assert found == sorted([(1, "aa", "x", 1, 1), (1, "ab", "x", 1, 1), (1, "bab", "z", 1, 1)] * 2 + [(4, "aa", "x", 2, 0), (4, "日本", "y", 2, 0), (4, "日本語", "y", 1, 0)])
    places = sorted(tuple(r) for r in term_automaton.places(rows.where("id = 4"), terms, "reference", ["id"], ["term"]).collect())
    assert places == [(4, "aa", 6, 8), (4, "aa", 8, 10), (4, "日本", 0, 2), (4, "日本", 2, 4), (4, "日本語", 2, 5)]
    assert measures.term_recall(rows, terms, ["category"]).orderBy("category").collect()[0][:3] == ("x", 4, 6)
    assert term_automaton.counts(rows, terms.limit(0), ["reference"], ["id"], ["term"]).count() == 0
    assert term_automaton.counts(rows.limit(0), terms, ["reference"], ["id"], ["term"]).count() == 0
    assert measures.term_damage(rows.withColumn("baseline", F.col("hypothesis")).withColumn("corrected", F.col("reference")), terms).first()[:3] == (6, 0, 5)


def test_offsets(spark):
    rows = spark.createDataFrame([(1, [3, 0, 2]), (2, []), (3, None), (4, [5]), (5, [1, 1])], "i int, n array<int>")
    assert [r["o"] for r in rows.select(offsets(F.col("n")).alias("o"), "i").orderBy("i").collect()] == [[0, 3, 3], [], None, [0], [0, 1]]
    plan = rows.select("i", offsets(F.col("n")))._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_segments_around_places(spark):
    text = "ab cd。ef\n\ngh" + "x" * 3000 + "。ij"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "。。")], "doc_id int, text string")
    assert [tuple(r)[1:3] for r in hallucination.segments(docs).orderBy("start").collect()] == [(0, 5), (6, 8), (10, 3012), (3013, 3015)]
    found = spark.createDataFrame([(1, 0, 2), (1, 3, 5), (1, 4, 7), (1, 5, 6), (1, 6, 8), (1, 2900, 3012), (1, 3011, 3013), (1, 10, 3012), (9, 0, 1)], "doc_id int, start int, end int")
    own = {(r["doc_id"], r["start"]): r["segment"] for r in hallucination.containing(found, hallucination.segments(docs)).collect()}
    assert {k for k, v in own.items() if v is None} == {(1, 4), (1, 5), (1, 3011), (9, 0)}
    assert own[1, 0] == own[1, 3] == "ab cd" and own[1, 6] == "ef" and own[1, 2900] == own[1, 10] == "gh" + "x" * 3000


def test_overlaps_go_in_greedy_order(spark):
    """By score, then length, then start: in a chain the best takes its neighbours away, whose own neighbours then stay."""
    schema = "doc_id int, start int, end int, text string, pattern string, evidence array<string>, score double, place int"
    chain = [(1, 0, 4, 1.0), (1, 3, 7, 2.0), (1, 6, 10, 1.5), (1, 9, 12, 1.0), (2, 0, 3, 1.0), (2, 2, 6, 1.0), (2, 5, 8, 1.0), (3, 0, 2, 1.0), (3, 2, 4, 1.0), (3, 1, 3, 1.0), (4, 0, 9, 1.0), (4, 1, 2, 1.5), (4, 4, 5, 1.5)]
    rows = spark.createDataFrame([(d, a, b, "", "", [], s, i) for i, (d, a, b, s) in enumerate(chain)], schema)
    kept = sorted((r["doc_id"], r["start"], r["end"]) for r in hallucination.apart(rows).collect())
    assert kept == [(1, 3, 7), (1, 9, 12), (2, 2, 6), (3, 0, 2), (3, 2, 4), (4, 1, 2), (4, 4, 5)]


def test_phrases_by_evidence_alone(spark):
    docs = spark.createDataFrame([(1, "彼はご視聴ありがとうございましたと言った。"), (2, "はいご清聴ありがとうございましたはい"), (3, "資料です。ご清聴ありがとうございました。")], "doc_id int, text string")
    free = hallucination.find(docs, hallucination.FilterConfig(require_segment=False, least_score=0.5))
    assert sorted((r["doc_id"], r["text"], r["score"]) for r in free.collect()) == [(1, "ご視聴ありがとうございました", 0.5), (2, "ご清聴ありがとうございました", 0.5), (3, "ご清聴ありがとうございました", 1.5)]
    assert sorted(r["doc_id"] for r in hallucination.find(docs).collect()) == [3]


def plain_diagonal(a, b):
    n, m = len(a), len(b)
    d = [[i + j if not i * j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    i, j, out = n, m, []
    while i and j:
        if d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j, a[i] == b[j]))
        elif d[i][j] == d[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def test_alignment_is_the_plain_one():
    rng = random.Random(2)
    for _ in range(300):
        letters = rng.choice(["ab", "abcd", "xyé日"])
        a = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 90])))
        b = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 90]))) if rng.random() < 0.5 else "".join(c if rng.random() < 0.9 else rng.choice(["", letters[0], c + c]) for c in a)
        i, j, same = edits.diagonal(a, b)
        assert list(zip(i.tolist(), j.tolist(), same.astype(bool).tolist(), strict=True)) == plain_diagonal(a, b)


def test_alignment_of_long_texts_takes_little_memory():
    """The whole matrix would have 900 million places."""
    rng = random.Random(4)
    a = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    b = "".join(c if rng.random() < 0.98 else rng.choice(["", "x", c + c]) for c in a)
    tracemalloc.start()
    i, j, same = edits.diagonal(a, b)
    assert tracemalloc.get_traced_memory()[1] < 30_000_000
    tracemalloc.stop()
    assert same.sum() > 29_000 and (np.diff(i) > 0).all() and (np.diff(j) > 0).all()
    assert all((a[p] == b[q]) == bool(s) for p, q, s in zip(i.tolist(), j.tolist(), same.tolist(), strict=True))


def test_running_sums_and_continuous_scores(spark):
    rows = spark.range(3000).select((F.col("id") * 7 % 3001).alias("k"), (F.col("id") % 5).alias("v")).repartition(5)
    found = sorted((r["k"], r["v"], r["n"]) for r in running.before(rows, "k", "v", "n").collect())
    total = 0
    for k, v, n in found:
        assert n == total, k
        total += v
    assert running.before(rows.limit(0), "k", "v", "n").count() == 0
    rng = random.Random(1)
    scored = [(rng.choice([rng.random(), 0.5, None]), rng.randint(0, 1)) for _ in range(900)]
    good = [(s, y) for s, y in scored if s is not None]
    pairs = sum((p > q) + 0.5 * (p == q) for p, y in good if y for q, z in good if not z)
    exact = pairs / (sum(y for _, y in good) * sum(1 - y for _, y in good))
    df = spark.createDataFrame(good, "score double, y int")
    assert measures.roc_auc(df).first()["auc"] == pytest.approx(exact)
    assert measures.roc_auc(df.where("y = 1")).first()["auc"] == 0.5
    assert measures.roc_auc(df.limit(0)).first()["auc"] == 0.5


def test_words_find_every_place(monkeypatch):
    rng = random.Random(11)
    for _ in range(150):
        letters = rng.choice(["a", "ab", "aé日", "ab "])
        terms = sorted({"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 7, 8, 9, 16, 17, 30]))) for _ in range(rng.randint(1, 40))})
        texts = ["".join(rng.choice([*letters, *terms]) for _ in range(rng.choice([0, 1, 3, 20, 60]))) for _ in range(rng.randint(0, 8))]
        monkeypatch.setattr(term_automaton, "BLOCK", rng.choice([5, 17, 1 << 22]))
        monkeypatch.setattr(term_automaton, "SLICE", rng.choice([10, 300, 1 << 20]))
        words = term_automaton.Words([t.encode() for t in terms])
        found = sorted(x for f in words.find([t.encode() for t in texts]) for x in zip(*(c.tolist() for c in f), strict=True))
        assert found == [(i, j, k) for i, t in enumerate(texts) for j, w in enumerate(terms) for k in range(len(t)) if t.startswith(w, k)]


def test_texts_stay_where_they_are_read_however_many_terms(spark, monkeypatch):
    monkeypatch.setattr(term_automaton, "TERM_BYTES", 4)
    rows, terms = _table(spark)
    plan = term_automaton.counts(rows, terms, ["reference", "hypothesis"], ["id"], ["term"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CoGroup" not in plan, plan


def test_a_call_gets_few_bytes_of_texts(spark):
    """However many texts an Arrow batch has, and however long they are; a longer text goes alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    most = 1 << 22
    rows = spark.range(2000, numPartitions=1).select("id", F.when(F.col("id") == 7, F.repeat(F.lit("ab "), most)).when(F.col("id") % 5 > 0, F.repeat(F.lit("ab cd "), 2000)).alias("text"))
    terms = spark.createDataFrame([("cd",)], "term string")

    def work(table, terms, texts, keep, of):
        size = sum(len(x or "") for x in table.column("text").to_pylist())
        return pa.table({"id": table.column("id"), "n": pa.array([size if table.num_rows > 1 else 0] * table.num_rows, pa.int64())})

    got = term_automaton._each(rows, terms, ["text"], ["id"], [], work, "n long").collect()
    assert sorted(r["id"] for r in got) == list(range(2000))
    assert max(r["n"] for r in got) <= most
    assert term_automaton.places(rows.where("id % 5 > 0"), terms, "text", ["id"], ["term"]).count() == 1599 * 2000
