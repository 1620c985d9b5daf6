"""Operators against brute force, exact round trips and held-out labels, with nulls, empty and repeated rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolex.llm import components, embeddings, fingerprints, fm, html_extraction, html_blocks, licenses, minhash, mixing, packing, quality, queries, sharding, toxicity
from echolex.llm.components import connected_components
from echolex.llm.kernels import LETTERS, NOT_BLANK, Words, shingle_sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
UPPER = {i: i + 32 for i in range(65, 91)}


def documents(spark, texts):
    """Extra and clashing columns included; sources with a hot one."""
    rows = [(i, x, "en", None if i % 7 == 0 else f"s{i % 3 if i % 2 else 0}", None, "x") for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, pool=400):
    return " ".join(f"w{rng.integers(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    base = [prose(rng, int(n)) for n in rng.integers(1, 300, 40)]
    near = []
    for x in base[:12]:
        for _ in range(6):
            w = x.split()
            for _ in range(max(1, len(w) // 60)):
                w[rng.integers(len(w))] = "edited"
            near.append(" ".join(w))
    long = prose(rng, 9000, 5000)
    return [*base, *near, *base[:5], None, "", "   ", "one", "ONE two", "one two", long, long + " more", "É caffè  naïve\n\nÉ", *["hot copy of a text that is long enough"] * 30]


def sets(texts, k):
    out = []
    for x in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(UPPER))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def groups(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_words_and_shingles(texts):
    raw = [(x or "").encode() for x in texts]
    words = Words(raw, NOT_BLANK)
    assert words.counts.tolist() == [len(re.findall(rb"[^\x20\x09-\x0D]+", x)) for x in raw]
    assert [len(x) for x in shingle_sets(raw, 3)] == [len(x) for x in sets(texts, 3)]
    assert Words([b"A-b", b""], LETTERS).hashes().tolist() == Words([b"a", b"b"], LETTERS).hashes().tolist()


@pytest.mark.parametrize(("k", "threshold", "bands"), [(3, Fraction(85, 100), 40), (5, Fraction(4, 5), 64)])
def test_minhash(spark, texts, k, threshold, bands):
    own = sets(texts, k)
    linked = [(i, j) for i in range(len(own)) for j in range(i) if own[i] and len(own[i] & own[j]) >= threshold * len(own[i] | own[j])]
    expected = groups(len(texts), linked)
    rows = {r["doc_id"]: r for r in minhash.near_duplicates(documents(spark, texts), minhash.MinHashConfig(k=k, threshold=threshold, bands=bands)).collect()}
    assert [rows[i]["component_id"] for i in range(len(texts))] == expected
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == [len(x) for x in own]
    assert all(r["kept"] == (r["component_id"] == i) for i, r in rows.items())


def test_minhash_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_FROM", 8)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = np.random.default_rng(4)
    base, many = prose(rng, 120).split(), []
    for _ in range(70):
        w = list(base)
        for _ in range(int(rng.integers(1, 7))):
            w[rng.integers(len(w))] = f"e{rng.integers(1000)}"
        many.append(" ".join(w))
    own = sets(many, 3)
    linked = [(i, j) for i in range(70) for j in range(i) if 100 * len(own[i] & own[j]) >= 85 * len(own[i] | own[j])]
    rows = minhash.near_duplicates(documents(spark, many), minhash.MinHashConfig(k=3, threshold=Fraction(85, 100), bands=40)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(groups(70, linked)))


def test_minhash_neighbours_in_either_order(spark, texts, monkeypatch):
    members, pairs = [], []
    chain, estimated = minhash.neighbours_in_order, minhash._estimated

    def keep_members(rows, partitions):
        members.append(minhash.cut(chain(rows, partitions), "members"))
        return members[0]

    def keep_pairs(found, sketches, config):
        pairs.append({(r["u"], r["v"]) for r in found.collect()})
        return estimated(found, sketches, config)

    monkeypatch.setattr(minhash, "neighbours_in_order", keep_members)
    monkeypatch.setattr(minhash, "_estimated", keep_pairs)
    minhash.near_duplicates(documents(spark, texts))
    met = [(r["prev"], r["node"]) for r in members[0].where("prev is not null").collect()]
    assert any(a > b for a, b in met)
    assert {(min(x), max(x)) for x in met} <= pairs[0]
    assert all(a < b for a, b in pairs[0])


def test_minhash_pairs_grow_with_members(spark, monkeypatch):
    """Texts that share a passage and many bands but are no near copies: no pair becomes a row before it is estimated."""
    rng = np.random.default_rng(8)
    passage = prose(rng, 200, 5000)
    many = [f"{passage} {prose(rng, 40, 5000)}" for _ in range(60)]
    many += [f"{x} end" for x in many[:10]]
    members, pairs = [], []
    chain, estimated = minhash.neighbours_in_order, minhash._estimated

    def keep_members(rows, partitions):
        members.append(minhash.cut(chain(rows, partitions), "members"))
        return members[0]

    def keep_pairs(found, *more):
        pairs.append(found.count())
        return estimated(found, *more)

    monkeypatch.setattr(minhash, "neighbours_in_order", keep_members)
    monkeypatch.setattr(minhash, "_estimated", keep_pairs)
    config = minhash.MinHashConfig(k=3, threshold=Fraction(85, 100), rows=4, bands=8)
    rows = minhash.near_duplicates(documents(spark, many), config).collect()
    own = sets(many, 3)
    linked = [(i, j) for i in range(70) for j in range(i) if 100 * len(own[i] & own[j]) >= 85 * len(own[i] | own[j])]
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(groups(70, linked)))
    assert sum(pairs) <= members[0].count()


def test_minhash_small_buckets_over_batches(spark, monkeypatch):
    """Every pair of a bucket is met, also where batches end inside it, and none within a component or across buckets."""
    monkeypatch.setattr(minhash, "_possible", lambda a, b, na, nb, config: a[:, 0] == b[:, 0])
    rows = [(key, 100 * key + i, 100 * key + i // 3, 40) for key in range(30) for i in range(30)]
    mixed = spark.createDataFrame([x for x in rows if x[0] != 4], "key long, node long, component long, n long")
    config = minhash.MinHashConfig(rows=1, bands=2)
    sketches = spark.createDataFrame([(node, 9, bytes([i % 2, 0, 0, 0])) for i, (_, node, _, _) in enumerate(rows)], "node long, n_shingles long, regs binary")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "7")
    try:
        found = [tuple(r) for r in minhash._across(mixed, sketches, config).collect()]
    finally:
        spark.conf.set(setting, before)
    expected = {(a, b) for k, a, ca, _ in rows for other, b, cb, _ in rows if k == other != 4 and a < b and ca != cb and (a - b) % 2 == 0}
    assert len(found) == len(expected) and set(found) == expected


def test_minhash_remove_keeps_columns(spark, texts):
    docs = documents(spark, texts)
    kept = minhash.remove(docs)
    assert kept.columns == docs.columns
    assert kept.count() == minhash.near_duplicates(docs).where("kept").count()


def test_minhash_remove_repeated_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "other words", "x"), (2, "a b c d e f", "x"), (2, "a b c d e f", "x")]
    rows += [(3, None, "x"), (3, None, "x"), (3, " ", "x"), (None, "a b c d e f", "x"), (None, "a b c d e f", "x"), (4, "alone", "x")]
    kept = minhash.remove(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    found = sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept))
    assert found == sorted([(0, "a b c d e f")] * 2 + [(1, "a b c d e f"), (1, "other words"), (3, ""), (3, ""), (3, " "), (4, "alone")])


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 99), (7, 7), (200, 150), (150, 300)]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    found = {r["node"]: r["component"] for r in rows}
    assert len(rows) == len(found)
    assert all(found[i] == 0 for i in range(51)) and found[100] == 99 and found[300] == 150


def test_components_of_hot_nodes(spark):
    """Nodes with many smaller and with many larger neighbours, repeated edges and chains, against plain union-find."""
    rng = np.random.default_rng(5)
    edges = [(0, i) for i in range(1, 700)] + [(5000, i) for i in range(1000, 1700)] + [(i, i + 1) for i in range(2000, 2040)]
    edges += [(int(a), int(b)) for a, b in rng.integers(3000, 3400, (300, 2))] + edges[:50] + [(699, 1000), (4000, None)]
    parent = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    order = rng.permutation(len(edges))
    frame = spark.createDataFrame([edges[i] for i in order], "a long, b long").repartition(12)
    rows = connected_components(frame).collect()
    linked = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in rows} == {x: root(x) for x in linked} and len(rows) == len(linked)


def test_components_in_many_tasks(spark, monkeypatch):
    """Chains, a comb and hot nodes, dealt over many tasks, against plain union-find; stars cost no round."""
    written = []
    real = components.cut

    def keep(df, name, instead_of=None):
        written.append(name)
        return real(df, name, instead_of)

    monkeypatch.setattr(components, "cut", keep)
    monkeypatch.setattr(components, "EDGES", 20)
    rng = np.random.default_rng(9)
    names = rng.permutation(3000)
    edges = [(i, i + 1) for i in range(400)] + [(500, i) for i in range(501, 900)] + [(i, i + 1) for i in range(1000, 1300, 2)] + [(i, 999) for i in range(1000, 1300, 3)]
    edges = [(int(names[a]), int(names[b])) for a, b in edges]
    own = groups(3000, edges)
    linked = {x for e in edges for x in e}
    rows = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()
    assert {r["node"]: r["component"] for r in rows} == {x: own[x] for x in linked} and len(rows) == len(linked)
    written.clear()
    rows = connected_components(spark.createDataFrame([(0, i) for i in range(1, 300)], "a long, b long").repartition(9)).collect()
    assert {r["node"]: r["component"] for r in rows} == dict.fromkeys(range(300), 0)
    assert written.count("edges") == 1


def test_fingerprints(spark, texts):
    docs = documents(spark, texts)
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs, 5).collect()}
    n = len(texts)
    clean = [x or "" for x in texts]
    for i in range(n):
        edit = fingerprints.edited(clean[i], clean[(i + 1) % n])
        assert rows[i]["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert rows[i]["n_chars"] == len(clean[i])
        assert rows[i]["near_next"] == fingerprints.likeness(bytes.fromhex(rows[i]["fingerprint"]), bytes.fromhex(rows[(i + 1) % n]["fingerprint"]))
    assert rows[0]["fingerprint"] == rows[112]["fingerprint"] and clean[0] == clean[112]
    same = {r["doc_id"]: r["component_id"] for r in fingerprints.near_duplicates(docs).collect()}
    assert same == {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert fingerprints.fingerprint_edits(docs.limit(0), 3).count() == 0


def test_likeness_follows_jaccard():
    rng = np.random.default_rng(8)
    a = np.sort(rng.integers(0, 2**63, 600, dtype=np.uint64))
    for shared in (0, 300, 500):
        b = np.sort(np.concatenate([a[:shared], rng.integers(0, 2**63, 600 - shared, dtype=np.uint64)]))
        assert abs(fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)) - shared / (1200 - shared)) < 0.17


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    odd = [*texts, "<|endoftext|> don't  x y\tz　q é İ \x1c a", "İSTANBUL BELEDİYESİ, TÜRKİYE. x<|endoftext|>! <|ENDOFTEXT|>", "שׁ. क़! Σ."]
    rows = packing.pack(documents(spark, odd), queries.tokenizer_path(), 512).collect()
    found = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(found) == len(rows)
    expected = {}
    for i, x in enumerate(odd):
        ids = np.array([*tokenizer.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        for p, start in enumerate(range(0, len(ids), 512)):
            part = ids[start : start + 512]
            expected[i, p] = (start, len(part), zlib.crc32(part.tobytes()))
    assert {k: (r["start"], r["length"], r["ids_crc32"]) for k, r in found.items()} == expected
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(documents(spark, texts).limit(0), queries.tokenizer_path(), 512).count() == 0


def test_best_fit_decreasing_is_the_plain_one():
    rng = np.random.default_rng(1)
    for capacity in (10, 37, 100):
        lengths = rng.integers(1, capacity + 1, 300)
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        open_bins: list[int] = []
        for x in sorted(lengths.tolist(), reverse=True):
            fit = [r for r in open_bins if r >= x]
            room = min(fit) if fit else capacity
            if fit:
                open_bins.remove(room)
            open_bins.append(room - x)
        runs = packing.best_fit_decreasing(counts, capacity)
        used = {}
        for r in runs:
            for i in range(r.count):
                used[r.bin + i // r.each] = used.get(r.bin + i // r.each, 0) + r.length
        assert sorted(capacity - x for x in used.values()) == sorted(open_bins)


def test_mixing(spark, texts):
    docs = documents(spark, texts)
    config = mixing.MixConfig(entropy=0.99, block_rows=8)
    sizes = docs.select("source", mixing.tokens().alias("n")).groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("rows"))
    weights = mixing.source_weights(sizes, config).collect()
    w = np.array([r["weight"] for r in weights if r["tokens"]])
    assert w.sum() == pytest.approx(1)
    assert -(w * np.log(w)).sum() == pytest.approx(0.99 * np.log(len(w)), abs=1e-6)
    limited = mixing.source_weights(sizes, mixing.MixConfig(most_epochs=1.2)).collect()
    assert max(r["budget"] / r["tokens"] for r in limited) <= 1.2 + 1e-9
    planned = mixing.plan(docs, config).collect()
    budget = {r["source"]: r["budget"] for r in weights}
    longest = max(r["n_tokens"] for r in planned)
    for source, most in budget.items():
        taken = sum(r["n_tokens"] * r["rows"] * r["copies"] for r in planned if r["source"] == source)
        assert most - longest - 1 <= taken <= most + 1
    mixed = mixing.mix(docs, config)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["rows"] * r["copies"] for r in planned)
    assert mixing.mix(docs.limit(0), config).count() == 0


def test_sharding(spark, texts):
    rows = sharding.shard(documents(spark, texts), sharding.ShardConfig(shards=4, block_rows=8)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        x = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(x) + 16, zlib.crc32(x))
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {r["shard"] for r in rows} <= set(range(4))
    assert sharding.shard(documents(spark, texts).limit(0)).count() == 0


def test_licenses(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "x GNU General Public License, version 3. All rights reserved.", "Released under the MIT License.", None, "", "released MIT under license", "under the mit license " * 3]
    rows = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts)).collect()}
    assert [rows[i]["base_labels"] for i in range(7)] == ["cc-by", "gpl,reserved", "", "", "", "", ""]
    assert rows[0]["labels"] == "cc-by,cc-by-nc" and rows[2]["labels"] == "mit" and rows[5]["labels"] == ""
    assert (rows[1]["n_base"], rows[1]["first_word"], rows[1]["last_word"], rows[1]["n_words"]) == (2, 2, 7, 10)
    assert rows[3]["n_words"] == 0 and rows[3]["first_word"] is None and rows[3]["score"] == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.12, base[:20] + rng.normal(size=(20, 16)) * 0.2, base[:3], np.repeat(base[:1], 30, 0)])
    label = [None if i == 5 else i % 2 for i in range(len(x))]
    rows = [(i, v.tolist(), y) for i, (v, y) in enumerate(zip(x, label, strict=True))]
    bad = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0, 2.0], 1), (905, [2.0, 4.0], 1)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int"), embeddings.PQConfig(list_rows=20, block=16, codes=8)).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.93) & np.array([[a is not None and a == b for b in label] for a in label])
    linked = [(i, j) for i in range(len(x)) for j in range(i) if near[i, j]]
    expected = groups(len(x), linked)
    assert [got[i]["component_id"] for i in range(len(x))] == expected
    assert [got[i]["n_links"] for i in range(len(x))] == [int(near[i].sum() - near[i, i]) for i in range(len(x))]
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (900, 901, 902, 903))
    assert got[905]["component_id"] == 904


def test_embeddings_outside_the_sample(spark):
    rng = np.random.default_rng(9)
    order = [r["id"] for r in spark.range(300).orderBy(F.xxhash64("id"), "id").collect()]
    x = np.eye(16)[rng.integers(4, size=300)] + rng.normal(size=(300, 16)) * 0.002  # tight clusters
    x[order[-2]] = rng.normal(size=16)  # a pair that is far from them, and that no sample of 50 covers
    x[order[-1]] = x[order[-2]] + rng.normal(size=16) * 0.1
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.93
    assert near[order[-2]].sum() == near[order[-1]].sum() == 2
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), embeddings.PQConfig(sample=50, block=64, codes=8)).collect()}
    assert [got[i]["n_links"] for i in range(300)] == (near.sum(1) - 1).tolist()
    assert [got[i]["component_id"] for i in range(300)] == groups(300, np.argwhere(near).tolist())


def test_embeddings_repeated_ids(spark):
    """One vec_id on several vectors, the smallest of each: two of them link, one is alone, one has a copy."""
    rows = [(1, [1.0, 0.0, 0.0, 0.0], 1), (1, [1.0, 0.1, 0.0, 0.0], 1), (1, [0.0, 0.0, 0.0, 1.0], 1), (2, [1.0, 0.0, 0.0, 0.0], 1), (3, [0.0, 0.0, 1.0, 0.0], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 0, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_html():
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Home page</a></ul></nav><div class="ad">Buy this now.</div><article><h1>Title here.</h1><p><b>First &amp; second\n  line.<br><p>More text, in the article.</p></article><footer>&copy; x</footer></body><foo'
    field = html_extraction.default_field()
    assert html_extraction.main_text(page, field) == "Title here.\nFirst & second line.\nMore text, in the article."
    assert html_extraction.main_text(None, field) == html_extraction.main_text("", field) == ""
    unseen = html_extraction.labelled(120, 77)
    wrong = sum(a != b for p, y in unseen for a, b in zip(field.decode(p), y, strict=True))
    assert wrong <= 0.01 * sum(len(y) for _, y in unseen)
    assert [b.text for b in html_blocks.blocks("a<p>b<p>c</div>d&am")] == ["a", "b", "c", "d&am"]


def test_html_extract(spark):
    rows = spark.createDataFrame([(1, "u", None), (2, "u", "<p>x"), (2, "u", "<p>x")], "page_id long, url string, html string")
    assert html_extraction.extract(rows).count() == 3


def test_factorisation_machine_learns_pairs():
    rng = np.random.default_rng(6)
    rows = [np.unique(np.concatenate([rng.choice(40, 6, replace=False) + 10, rng.choice(4, int(rng.integers(0, 4)), replace=False)])).astype(np.int32) for _ in range(3000)]
    y = np.array([int((0 in r and 1 in r) or (2 in r and 3 in r)) for r in rows])  # neither term alone says it
    model = fm.fit(rows[:2000], y[:2000], fm.FMConfig(hash_bits=8, epochs=300))
    doc, flat = np.repeat(np.arange(1000), [len(r) for r in rows[2000:]]), np.concatenate(rows[2000:])
    z = model.logits(doc, flat, 1000)
    assert ((z > 0) == y[2000:]).mean() > 0.97
    pairs = [sum(float(model.v[model.slot[a]] @ model.v[model.slot[b]]) for i, a in enumerate(r) for b in r[:i] if model.slot[a] >= 0 and model.slot[b] >= 0) for r in rows[2000:2010]]
    plain = [model.w0 + sum(model.w[model.slot[a]] for a in r if model.slot[a] >= 0) + p for r, p in zip(rows[2000:2010], pairs, strict=True)]
    assert z[:10] == pytest.approx(plain)


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, module, label):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, "")], "doc_id long, text string")
    rows = module.score(docs.select("doc_id", "text").union(extra), labels).join(labels, "doc_id", "left").toPandas()
    assert len(rows) == docs.count() + 2
    test = rows[rows.held_out & rows[label].notna()]
    assert (test.held_out == test.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (test.predicted == test[label]).mean() > 0.85
    blank = rows[rows.doc_id >= 10**6]
    assert blank.score.nunique() == 1
