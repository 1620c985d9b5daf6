"""Vector codes, fill-in-middle and the neighbour graph against plain Python."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echolex.llm import fim, vector_codes, vector_graph

ROWS = "vec_id long, embedding array<float>, label int, n int, place int, h long"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, 3) for i, v, label in rows], ROWS).repartition(3)


# ---- codes ----


def plain_codes(x: list[list[int]], starts: list[int], parts: int, rounds: int) -> tuple[list[list[int]], list[int], list]:
    """By comparing every part with every entry, in Python's integers."""
    wide = len(x[0]) // parts
    cut = [[v[k * wide : (k + 1) * wide] for k in range(parts)] for v in x]
    books = [[cut[i][k] for i in starts] for k in range(parts)]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for r in range(rounds + 1):
        own = [[min(range(len(books[k])), key=lambda j, k=k, c=c: (far(c[k], books[k][j]), j)) for k in range(parts)] for c in cut]
        if r < rounds:
            for k in range(parts):
                for j in range(len(books[k])):
                    members = [c[k] for c, o in zip(cut, own, strict=True) if o[k] == j]
                    if members:
                        books[k][j] = [sum(m[i] for m in members) // len(members) for i in range(wide)]
    return own, [sum(far(c[k], books[k][o[k]]) for k in range(parts)) for c, o in zip(cut, own, strict=True)], books


@pytest.mark.parametrize("coarse", [False, True])
def test_codes_equal_plain_lloyd(spark, coarse):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 32)).astype(np.float32) * 0.2
    if coarse:
        x = np.round(x * 4) / 4  # many ties and equal parts
    rows = [(int(i * 7 % 300), x[i].tolist(), None if i % 5 == 0 else i % 3) for i in range(300)]
    bad = [(900, None, 1), (901, [None] * 32, 1), (902, [float("nan")] * 32, 1), (903, [float("-inf")] + [0.0] * 31, None)]
    found = vector_codes.compress(_vectors(spark, rows + bad)).toPandas().set_index("vec_id")
    order = sorted(rows)
    whole = [[int(np.floor(256 * np.float64(c))) for c in v] for _, v, _ in order]
    own, error, books = plain_codes(whole, list(range(64)), 16, 2)
    assert sorted(found.index) == list(range(300))
    assert [found.code[i] for i in range(300)] == ["".join(f"{j:02x}" for j in o) for o in own]
    assert [found.error[i] for i in range(300)] == error
    sums = {}
    for (_, _, label), e in zip(order, error, strict=True):
        sums[label] = sums.get(label, 0) + e
    assert [found.label_error[i] for i in range(300)] == [sums[label] for _, _, label in order]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    assert set(found.codebooks_sha256) == {sha}


def test_bounds_hold_and_prune_when_entries_move():
    rng = np.random.default_rng(1)
    for spread in (3, 400, 200_000_000):
        x, entries = rng.integers(-spread, spread + 1, (500, 4)), rng.integers(-spread, spread + 1, (64, 4))
        have = vector_codes.first(x, entries)
        for step in range(4):
            before, entries = entries, entries + rng.integers(-spread // 50 - 1, spread // 50 + 2, entries.shape)
            have, asked = vector_codes.moved(x, entries, before, vector_codes.Bounds.unpacked(*have.packed()))
            exact = ((x[:, None, :] - entries[None]).astype(object) ** 2).sum(2)
            assert have.entry.tolist() == exact.astype(np.float64).argmin(1).tolist() if spread > 1000 else have.entry.tolist() == [min(range(64), key=lambda j, r=r: (r[j], j)) for r in exact]
            root = np.sqrt(exact.astype(np.float64))
            assert (have.lower <= root).all() and (have.upper >= root[np.arange(500), have.entry]).all()
            assert asked < 0.5 * 500 * 63 or spread == 3


def test_codes_of_odd_tables(spark):
    assert vector_codes.compress(_vectors(spark, [])).count() == 0
    assert vector_codes.compress(_vectors(spark, [(1, None, 1)])).count() == 0
    rows = [(1, [0.5] * 32, 1), (1, [0.25] * 32, None), (None, [0.75] * 32, None), (2, [1e30] * 32, 2), (3, [0.1] * 20, 2), (4, [], 2), (5, [0.1] * 3, 2)]
    found = vector_codes.compress(_vectors(spark, rows)).toPandas()
    assert len(found) == 7 and (found.error >= 0).all()
    assert found[found.vec_id == 2].error.item() == 0 and found[found.vec_id == 4].code.item() == "00" * 16
    # of the rows that repeat 1 the smaller one begins an entry; both are near it after two rounds
    assert sorted(found[found.vec_id == 1].error) == [0, 0] or found[found.vec_id == 1].error.sum() > 0
    assert found.codebooks_sha256.nunique() == 4  # a length each


def test_label_errors_with_many_labels(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 2)
    rows = spark.range(5000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 1500).alias("label"), F.lit(2).cast("long").alias("error"))
    found = vector_codes.with_label_error(rows).toPandas()
    assert len(found) == 5000
    exact = found.groupby(found.label.fillna(-1)).error.transform("sum")
    assert (found.label_error == exact).all()


# ---- fill-in-middle ----


def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "\n", "\n\n", "a", "a\n", "\na", "é\n日本\n😀x", "<P>", "a<S>b\n", "x<M", "<<P>", "<P\n>", "<\n<S", "a\n<M\n>", "0>\n<P\n<S<", "�\x00\n\r\n b", "line\n" * 4000, "日" * 70000 + "\n<M"]


def test_fim_equals_plain(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS * 8)] + [(None, "a\nb\nc", 1, "x"), (3, "other\ntext", 1, "x"), (3, "other\ntext", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, output string").repartition(4)
    found = {}
    for r in fim.fill_in_middle(docs).collect():
        found.setdefault(r.doc_id, []).append((r.n, r.form, r.prefix_chars, r.middle_chars, r.output))
    expected = {}
    for i, t, _, _ in rows:
        expected.setdefault(i, []).append(plain_fim(i, t))
    key = lambda x: [str(y) for y in x]
    assert {k: sorted(v, key=key) for k, v in found.items()} == {k: sorted(v, key=key) for k, v in expected.items()}
    back = fim.digests(docs).join(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("was")).distinct(), "doc_id")
    assert back.where("restored_sha256 <> was").where("doc_id <> 3").count() == 0
    assert {r[1] for v in found.values() for r in v} == {"plain", "psm", "spm"}
    assert fim.digests(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="<>PSM\naé日😀", max_size=40), min_size=1, max_size=6), st.integers(0, 1000))
def test_fim_on_any_text(texts, start):
    draws, plain = [], []
    for i, t in enumerate(texts):
        h = hashlib.sha256(f"7:{start + i}".encode()).hexdigest()
        draws.append(tuple(int(h[8 * j : 8 * j + 8], 16) for j in range(4)))
        plain.append(plain_fim(start + i, t))
    own = [(n, form, a, b, out.decode()) for n, form, a, b, out in fim.arranged([t.encode() for t in texts], draws, fim.FimConfig())]
    assert own == plain


def test_fim_in_blocks(monkeypatch):
    """Texts longer than a block, with lines, characters and sentinels over the blocks' ends."""
    for block in (1, 2, 3, 7, 64, 1000):
        monkeypatch.setattr(fim, "BLOCK", block)
        for text in ("日本\n語<P", "a" * 50 + "\n" + "😀" * 30 + "\nb", "\n" * 40, "x" * 63 + "<S>" + "y" * 20, "no line", "q\n" * 700):
            for seed in range(12):
                h = hashlib.sha256(f"7:{seed}".encode()).hexdigest()
                draw = tuple(int(h[8 * j : 8 * j + 8], 16) for j in range(4))
                n, form, a, b, out = next(iter(fim.arranged([text.encode()], [draw], fim.FimConfig())))
                assert (n, form, a, b, out.decode()) == plain_fim(seed, text)


def test_automaton_counts_transitions():
    machine = fim.Automaton((b"<P>", b"<S>", b"<M>"))
    raw = np.frombuffer("é\n<P>\n".encode() + bytes([fim.END]), np.uint8)
    taken = machine.run(raw)
    begins, lead, hits = (int(machine.effects[i][taken].sum()) for i in range(3))
    assert (begins, lead, hits) == (2, 6, 1)


def test_fim_with_other_sentinels(spark):
    config = fim.FimConfig("<|pre|>", "<|suf|>", "<|mid|>", percent=60, spm_percent=30, seed=1)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("a<|pre|\n"), F.col("id").cast("string"), F.lit("\n|>\nz")).alias("text"))
    rows = fim.fill_in_middle(docs, config).withColumn("back", fim.restored(F.col("output"), F.col("form"), config)).join(docs, "doc_id").toPandas()
    assert (rows.back == rows.text).all()
    counts = rows.form.value_counts()
    assert 80 < counts["plain"] < 160 and 25 < counts["spm"] < 90


# ---- neighbours ----


def exact(rows: list, k: int, every: int) -> list[tuple]:
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    asked = {}
    for i, v in good:
        if i % every == 0 and (i not in asked or tuple(v) < tuple(asked[i])):
            asked[i] = v
    unit = lambda v: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())
    out = []
    for i, v in asked.items():
        seen = {(j, tuple(w)) for j, w in good if j != i and len(w) == len(v)}
        ranked = sorted((-round(float(unit(v) @ unit(np.array(w))), 12), j) for j, w in seen)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(ranked)]
    return sorted(out)


def found_rows(df) -> list[tuple]:
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in df.collect())


def test_neighbours_of_odd_tables(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(0, e, 1), (0, [2.0, 0.0, 0.0], 1), (50, [0.0, 1.0, 0.0], None), (100, [0.0] * 3, 1), (150, None, 1), (200, [None, 1.0, 1.0], 1), (250, [float("nan"), 1.0, 1.0], 1), (None, e, 1)]
    rows += [(i, e, 1) for i in range(1, 40)] + [(40, e, 1)] * 9 + [(41, [1.0, 1.0], 2), (300, [1.0, 0.5], 2), (42, [3e38, 0.0, 1e38], 1), (350, [1e-38, 0.0, 0.0], 1), (43, [0.5, 0.5, 0.1], 1), (400, [-0.0, 1.0, -0.0], 1)]
    found = found_rows(vector_graph.nearest(_vectors(spark, rows)))
    assert found == exact(rows, 5, 50)
    assert [r[2] for r in found if r[0] == 300] == [41]
    assert vector_graph.nearest(_vectors(spark, [])).count() == 0
    assert vector_graph.nearest(_vectors(spark, [(0, e, 1)])).count() == 0


def test_neighbours_recall(spark):
    """Clusters, noise and groups of copies, over several shards and blocks of queries."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([centres[rng.integers(0, 40, 2500)] + 0.3 * rng.normal(size=(2500, 32)), rng.normal(size=(2500, 32))]).astype(np.float32)
    rows = [(i, x[i].tolist(), 0) for i in range(5000)] + [(5000 + i, x[i % 3].tolist(), 0) for i in range(1200)]
    config = vector_graph.GraphConfig(block=40, shard_rows=700)
    found = vector_graph.nearest(_vectors(spark, rows), config).toPandas()
    truth = pd.DataFrame(exact(rows, 5, 50), columns=["query_id", "rank", "vec_id", "score"])
    assert len(found) == len(truth) == 124 * 5
    assert vector_graph.recall(found, truth) >= 0.98
    copies = [r[:3] for r in found_rows(vector_graph.search(vector_graph.every_nth(_vectors(spark, rows), 50).where("query_id = 5100"), vector_graph.index(_vectors(spark, rows), config), config))]
    assert copies == [(5100, 1, 1), (5100, 2, 5001), (5100, 3, 5004), (5100, 4, 5007), (5100, 5, 5010)]


def test_pruning_keeps_edges_that_point_apart():
    x = vector_graph.unit(np.array([[1, 0], [0.99, 0.1], [0.98, 0.2], [0.99, -0.1]]))
    graph = vector_graph.Graph(x, np.full((4, 3), -1), np.array([0]), vector_graph.GraphConfig(degree=3))
    kept = graph.prune(np.array([0]), np.array([[0, 1, 1, 2, 3, -1]]))[0]
    assert sorted(kept.tolist()) == [-1, 1, 3]
