"""Defined cases, and queries that SQL cannot express held against plain versions of them."""

from __future__ import annotations

import itertools
import os
import random
import re
import time
import zlib
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from echolex.llm import embeddings, fingerprints, fm, html_blocks, html_extraction, kernels, licenses, minhash, mixing, packing, quality, queries, scratch, sharding, toxicity
from tests.llm.test_llm import UPPER, documents, groups, prose, sets

CLASHING = "doc_id long, text string, lang string, source string, score double, shard int, node long, block long, component string, key string"


def clashing(spark, texts, ids=None):
    """Columns named as the operators' own."""
    return spark.createDataFrame([(i if ids is None else ids[i], x, "en", "s", 0.5, 1, 2, 3, "c", "k") for i, x in enumerate(texts)], CLASHING)


def test_html_of_malformed_pages_is_linear():
    field = html_extraction.default_field()
    pages = ["<a b " * 200_000, "<div>" * 20_000 + "x" + "<p>y" * 20_000, '<a "' * 250_000 + ">", "<a \"'" * 200_000 + ">x", "<div>" * 20_000 + "</section>" * 20_000, "<!--" * 200_000, "<b>" * 50_000 + "</i>" * 50_000]
    for page in pages:
        began = time.time()
        html_extraction.main_text(page, field)
        assert time.time() - began < 6
    assert [b.text for b in html_blocks.blocks("a < b<p>1 <2 <p class='>'>c")] == ["a < b", "1 <2", "c"]
    assert [b.path for b in html_blocks.blocks("<table><tr><td>a<tr><td>b</table>")] == [("table", "tr", "td")] * 2


def test_html_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(4)
    field = html_extraction.Field(rng.normal(size=(html_extraction.DIMENSIONS, 2)), rng.normal(size=(2, 2, 2)))
    page = html_blocks.blocks("<div>a<p>b.</p><p>c</p></div><ul><li>d<li>e</ul><h1>f!</h1>g")
    found, same = html_extraction.features(page), html_extraction.same_parent(page)

    def score(labels):
        total = sum(field.unary[list(f), y].sum() for f, y in zip(found, labels, strict=True))
        return total + sum(field.pair[same[t], labels[t - 1], labels[t]] for t in range(1, len(labels)))

    best = max(itertools.product((0, 1), repeat=len(page)), key=score)
    assert field.decode(page) == list(best)


def test_html_depth_and_borders():
    """What a block stands in counts at any depth, formulas are text, and no reference goes over a tag's border."""
    field = html_extraction.default_field()
    article = "<article>" + "<p>The harbour was rebuilt after the storm, and the town paid for the new pier.</p>" * 4
    comment = '<section class="comments"><h3>Comments</h3>{0}<p>First, nice article!</p>{1}</section>'
    plain = html_extraction.main_text("<body>" + article + comment.format("", "") + "</article></body>", field)
    deep = html_extraction.main_text("<body>" + "<div>" * 40 + article + comment.format("<div>" * 40, "</div>" * 40) + "</article>" + "</div>" * 40 + "</body>", field)
    assert "nice article" not in plain and "nice article" not in deep and "harbour" in deep
    (block,) = html_blocks.blocks("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> always true &am<b>p;</b> so &amp; &lt<i>x</i></p>")
    assert block.text == "Energy is E=m always true &amp; so & <x"
    a, b = html_blocks.blocks("<div class='x'>" + "<div>" * 300 + "a</div><div>b")
    assert a.inside == b.inside and a.above == b.above and a.inside >> html_blocks.place("word x") & 1


def test_clashing_helper_names(spark):
    """Columns that are named as helpers might be, in the pipeline's stages."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, 5, 6, "a", 7), (2, text, 5, 6, "b", 7), (2, text, 5, 6, "b", 7), (3, "alone among the other texts of this table", 5, 6, "c", 7), (None, text, 5, 6, "d", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n int, _id int, _text string, _y int").withColumn("_times0", F.lit(1))
    left = minhash.remove(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["_text"]) for r in left.collect()) == [(0, "d"), (1, "a"), (3, "c")]
    held = docs.select(fm.held_out().alias("h"), "doc_id").where("doc_id is null").first()["h"]
    assert held is True


def test_html_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    assert html_extraction.extract(spark.createDataFrame([], schema)).count() == 0
    rows = html_extraction.extract(spark.createDataFrame([(1, "u", "<article><p>Some words here.</p></article>", "other", "x")], schema)).collect()
    assert [(r["text"], r["n_chars"]) for r in rows] == [("Some words here.", 16)]


def test_packing_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    rng, texts = random.Random(5), []
    alphabet = list("abcXYZ éÉßİıǅﬁ שׁקक़́̇ .,;:!?#$%&*|<>'_-\t\n\r\x0b\x1c\x85　0129½你カｶﾞςΣ👍")
    pieces = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "BELEDİYESİ.", "don't", "it's.", "Hello,", "שׁ.", "क़!", "x́."]
    for _ in range(4000):
        texts.append("".join(rng.choice(pieces if rng.random() < 0.3 else alphabet) for _ in range(rng.randint(0, 8))))
    wanted = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [list(array("I", bytes(x))) for x in packing._encoder(path)(pa.array(texts))] == wanted


def test_packing_ties_and_repeated_rows(spark):
    rows = packing.pack(clashing(spark, ["a b c", "a b c", "d e f", None], [7, 7, 8, None]), queries.tokenizer_path(), 8).collect()
    assert sorted((r["doc_id"] or 0, r["piece"], r["length"]) for r in rows) == [(0, 0, 1), (7, 0, 4), (7, 0, 4), (8, 0, 4)]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 4
    assert len({r["sequence_id"] for r in rows}) == 2


def test_licenses_of_a_long_text_are_linear(spark):
    phrase = "permission is hereby granted free of charge to any person obtaining a copy of this software "
    seconds = []
    for n in (1000, 8000):
        docs = spark.createDataFrame([(1, phrase * n)], "doc_id long, text string")
        began = time.time()
        assert licenses.scan(docs).collect()[0]["n_words"] == 16 * n
        seconds.append(time.time() - began)
    assert seconds[1] < 10 * seconds[0] + 5


def test_licenses_tables(spark):
    docs = clashing(spark, ["Released under the MIT License."] * 2 + [None], [1, 1, None])
    assert sorted((r["doc_id"] or 0, r["labels"]) for r in licenses.scan(docs).collect()) == [(0, ""), (1, "mit"), (1, "mit")]
    assert licenses.scan(docs.limit(0)).count() == 0


def _linked(x, label):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    return (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])


@pytest.mark.parametrize("recall", [0.995, 1])
def test_embeddings_recall_in_64_dimensions(spark, recall):
    """Clusters along a few directions, with links about the threshold, the hardest to find."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(150, 64))
    x = np.concatenate([c + (rng.normal(size=(20, 6)) @ rng.normal(size=(6, 64))) * 0.11 for c in centres])
    label = np.arange(len(x)) // 20 % 2
    near = _linked(x, label)
    np.fill_diagonal(near, False)
    assert near.sum() > 2000
    rows = [(i, v.tolist(), int(y), 1) for i, (v, y) in enumerate(zip(x, label, strict=True))]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, count int")
    got = embeddings.near_duplicates(docs, embeddings.PQConfig(recall=recall, list_rows=100)).toPandas().set_index("vec_id").sort_index()
    found, all_links = got["n_links"].to_numpy(), near.sum(1)
    assert (found <= all_links).all()
    assert found.sum() >= (0.99 if recall < 1 else 1) * all_links.sum()
    if recall == 1:
        assert got["component_id"].tolist() == groups(len(x), np.argwhere(near).tolist())


def test_embeddings_tables(spark):
    schema = "vec_id long, embedding array<double>, label int, rep long, count string, kept string"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    big, small = [1e200, 2e200, 0.0], [1e-200, 2e-200, 0.0]
    rows = [(1, big, 1), (2, small, 1), (3, [0.0, -0.0, 5.0], 1), (4, [0.0, 0.0, 5.0], 1), (5, big, None), (6, [], 1), (7, [1.0, 2.0, float("inf")], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame([(*r, 9, "x", "y") for r in rows], schema)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6), 7: (0, 7)}


def test_toxicity_terms_in_plain_python():
    text = "You ABSURDLY bad naïve x2, absurd"
    words = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]
    parts = {(w, 0) for w in words} | {(w[:n], n) for w in words for n in (4, 5, 6) if len(w) > n}

    def one(w, n):
        h = kernels.Words([w], kernels.LETTERS).hashes()[0] ^ np.uint64(n << 40)
        return int(h >> np.uint64(44))

    doc, found = toxicity.terms([b"", text.encode()], 20)
    assert set(doc.tolist()) == {1}
    assert set(found.tolist()) == {one(w, n) for w, n in parts}


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifier_cases(spark, module):
    rng = np.random.default_rng(3)
    texts = [prose(rng, 30) + (" vile idiots" if i % 2 else " fine people") for i in range(300)]
    docs = clashing(spark, [*texts, None, "", texts[1]], [*range(300), None, 400, 1])
    labels = spark.createDataFrame([*((i, i % 2, i % 2) for i in range(300)), (None, 1, 1), (5, None, None), (1, 1, 1)], "doc_id long, quality int, toxic int")
    rows = module.score(docs, labels).collect()
    assert len(rows) == 303
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r["score"])
    assert len(set(by_id[1])) == 1 and len(by_id[1]) == 2  # repeated rows score alike
    assert by_id[None] == by_id[400]  # null text is empty
    assert all(0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert out and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in out]) > 0.9
    assert module.score(docs.limit(0), labels).count() == 0
    for some, share in ((labels.limit(0), 0.5), (labels.where("doc_id is not null and toxic = 1"), None)):
        alike = {r["score"] for r in module.score(docs, some).collect()}
        assert len(alike) == 1 and (share is None or alike == {share})
    kept = module.remove(docs, module.train(docs, labels))
    assert kept.columns == docs.columns
    wrong = sum(r["predicted"] != (0 if module is toxicity else 1) for r in rows)
    assert kept.count() == 303 - wrong


def test_fm_score_is_the_plain_double_sum(spark):
    rng = np.random.default_rng(3)
    texts = [prose(rng, 12, 60) + (" vile idiots" if i % 2 else " fine people") for i in range(200)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = {r["doc_id"]: r["score"] for r in fm.score(docs, model, toxicity.terms, 0.5).collect()}
    for i in range(0, 200, 20):
        slots = sorted({int(model.slot[f]) for f in toxicity.terms([texts[i].encode()], model.hash_bits)[1]} - {-1})
        z = model.w0 + sum(model.w[a] for a in slots) + sum(float(model.v[a] @ model.v[b]) for a, b in itertools.combinations(slots, 2))
        assert rows[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_minhash_cases(spark):
    text = "one two three four five six seven eight nine ten"
    texts = [text, text, None, "", "other words that are not like them at all", text.upper(), "short", "short"]
    ids = [5, 5, 1, 2, 3, None, 8, 9]
    rows = minhash.near_duplicates(clashing(spark, texts, ids)).collect()
    found = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in rows)
    assert found == [(0, 6, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 5, 3, True), (5, 6, 5, True), (5, 6, 5, True), (8, 1, 8, True), (9, 1, 8, False)]
    assert minhash.near_duplicates(clashing(spark, texts, ids).limit(0)).count() == 0


def test_minhash_of_short_texts_with_a_common_passage(spark):
    """Texts that share a passage but are not alike make no links; short near copies do."""
    rng = np.random.default_rng(1)
    passage = prose(rng, 25)
    texts = [f"{prose(rng, 40, 9000)} {passage} {prose(rng, 40, 9000)}" for _ in range(150)]
    for i in range(0, 60):
        w = prose(rng, int(rng.integers(12, 30)), 9000).split()
        texts += [" ".join(w), " ".join([*w[:-1], "end"])]
    own = sets(texts, 3)
    linked = [(i, j) for i in range(len(own)) for j in range(i) if 100 * len(own[i] & own[j]) >= 85 * len(own[i] | own[j])]
    rows = minhash.near_duplicates(documents(spark, texts), minhash.MinHashConfig(k=3, threshold=Fraction(85, 100), bands=40)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(groups(len(texts), linked)))


def test_densified_registers_are_filled_alike():
    rng = np.random.default_rng(2)
    regs = np.full((3, 64), minhash.EMPTY, np.uint16)
    regs[0, rng.choice(64, 5, replace=False)] = [1, 2, 3, 4, 5]
    regs[1] = regs[0]
    full = minhash.densified(regs)
    assert (full[0] == full[1]).all() and (full[0] != minhash.EMPTY).all() and set(full[0]) <= {1, 2, 3, 4, 5}
    assert (full[2] == minhash.EMPTY).all()


def _plain_fingerprint(text):
    own = sets([text], fingerprints.SHINGLE)[0]
    if not own:
        return ""
    hashes = [next(kernels.shingle_sets([" ".join(x).encode()], fingerprints.SHINGLE))[0] for x in own]
    out = []
    for a, b in zip(fingerprints._A.tolist(), fingerprints._B.tolist(), strict=True):
        least = min(((int(h) >> 32) * a + b) % 2**32 for h in hashes)
        out.append(int(kernels.mix(np.array([least], np.uint64))[0]) & 0xFF)
    return bytes(out).hex()


def test_fingerprints_are_plain_minhash(spark):
    rng = np.random.default_rng(7)
    texts = [prose(rng, int(n)) for n in (3, 40, 90, 5, 60)] + ["", None, "Ünï cödé wörds hére and möre of thém"]
    ids = [10, 11, 11, 12, None, 14, 15, 16]
    docs = clashing(spark, texts, ids)
    rows = fingerprints.fingerprint_edits(docs, 3).collect()
    # in order of id (null first), then text
    order = sorted(range(len(texts)), key=lambda i: (ids[i] if ids[i] is not None else -1, texts[i] or ""))
    wanted = []
    for at, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(own) // 2
        edit = own[: len(own) - half] + after[:half]
        a, b, c = (_plain_fingerprint(x) for x in (own, edit, after))
        alike = [fingerprints.likeness(bytes.fromhex(a), bytes.fromhex(x)) for x in (b, c)]
        wanted.append((ids[i] or 0, a, b, *alike))
    assert sorted((r["doc_id"] or 0, r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in rows) == sorted(wanted)


def test_shards_hold_groups_whole_and_nearly_equal_bytes(spark):
    rng = np.random.default_rng(5)
    texts = [prose(rng, int(n)) for n in rng.integers(5, 60, 700)]
    texts += [x for x in texts[:40] for _ in range(int(rng.integers(1, 12)))] + ["a hot text of some words"] * 400 + [None, ""] * 3
    docs = documents(spark, texts)
    rows = sharding.shard(docs, sharding.ShardConfig(shards=8, block_rows=16)).collect()
    total = sum(r["size"] for r in rows) / 8
    by_shard, by_text = {}, {}
    for r in rows:
        by_shard[r["shard"]] = by_shard.get(r["shard"], 0) + r["size"]
        by_text.setdefault(texts[r["doc_id"]] or "", []).append(r)
    assert set(by_shard) == set(range(8))
    assert max(by_shard.values()) < 1.1 * total and min(by_shard.values()) > 0.9 * total
    assert all(len({r["shard"] for r in own}) == 1 for own in by_text.values() if sum(r["size"] for r in own) <= total)
    for s in by_shard:
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    again = sharding.shard(docs.repartition(3), sharding.ShardConfig(shards=8, block_rows=16)).collect()
    assert {(r["doc_id"], r["shard"]) for r in again} == {(r["doc_id"], r["shard"]) for r in rows}


def test_shard_tree_is_the_plain_one(spark):
    """The tree against one that sorts all units in memory."""
    rng = np.random.default_rng(6)
    units = [(float(a), float(b), float(c), int(w)) for a, b, c, w in zip(rng.random(400) * 9, rng.integers(3, size=400) + rng.random(400) * 1e-6, rng.random(400), rng.integers(1, 50, 400), strict=True)]
    config = sharding.ShardConfig(shards=6)
    df = spark.createDataFrame([(i, *u) for i, u in enumerate(units)], "unit long, size double, lang double, source double, weight long")
    root = sharding.tree(df, [1.0] * 6, config)
    got = {r["unit"]: r["shard"] for r in df.select("unit", sharding._leaf(root, lambda n: n.first).alias("shard")).collect()}
    scale = [max(u[d] for u in units) - min(u[d] for u in units) for d in range(3)]
    wanted = {}

    def split(rows, first, count):
        if count == 1:
            wanted.update(dict.fromkeys(rows, first))
            return
        spread = [(max(units[i][d] for i in rows) - min(units[i][d] for i in rows)) / scale[d] for d in range(3)]
        d = spread.index(max(spread))
        rows, upto, part = sorted(rows, key=lambda i: units[i][d]), 0, (count // 2) / count * sum(units[i][3] for i in rows)
        at = next(k for k, i in enumerate(rows) if (upto := upto + units[i][3]) >= part)
        split(rows[: at + 1], first, count // 2)
        split(rows[at + 1 :], first + count // 2, count - count // 2)

    split(list(range(400)), 0, 6)
    assert got == wanted


def test_large_groups_go_where_there_is_room():
    assert sharding.place_large([(9, 3), (9, 1), (8, 2), (2, 2), (30, 1)], 10.0, 3) == ([0, 1, 2, 2, 0], [0.0, 1.0, 0.0])
    assert sharding.place_large([(25, 5), (6, 3), (6, 3), (6, 3)], 10.0, 2) == ([None, 0, 1, None], [4.0, 4.0])


def test_sharding_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None), (1, "", "en", None), (None, "x", None, "s"), (2, "x" * 5000, "en", "s")], "doc_id long, text string, lang string, source string")
    rows = sharding.shard(docs, sharding.ShardConfig(shards=2)).collect()
    assert len(rows) == 4 and {r["shard"] for r in rows} == {0, 1}
    alone = next(r["shard"] for r in rows if r["doc_id"] == 2)
    assert sum(r["shard"] == alone for r in rows) == 1


def test_mixing_places(spark):
    rng = np.random.default_rng(2)
    texts = [prose(rng, int(n)) for n in rng.integers(3, 60, 90)]
    docs = clashing(spark, [*texts, *texts[:3], None, ""], [*range(90), 0, 1, 2, None, 90])
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 7 == 0, None).otherwise("b"))
    config = mixing.MixConfig(entropy=0.999, block_rows=4)
    units = mixing.plan(docs, config).collect()
    for source in ("a", "b", None):
        own = sorted((r["place"], r["rows"]) for r in units if r["source"] == source)
        at = 0
        for place, n in own:
            assert place == at
            at += n
    mixed = mixing.mix(docs, config, order="order")
    assert mixed.columns == [*docs.columns, "order"]
    rows = mixed.collect()
    assert len(rows) == mixing.mix(docs, config).count() == sum(r["rows"] * r["copies"] for r in units)
    for source in ("a", "b", None):
        order = sorted(r["order"] for r in rows if r["source"] == source)
        whole = min(r["copies"] for r in units if r["source"] == source) * sum(r["rows"] for r in units if r["source"] == source)
        assert len(order) == len(set(order)) and order[:whole] == list(range(whole))


def test_scratch_needs_a_shared_folder_outside_local_mode(spark):
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": lambda self, k, d=None: d})()

    with pytest.raises(RuntimeError, match="share"):
        scratch.shared_dir(Session())
    first = scratch.cut(spark.range(3), "test")
    second = scratch.cut(first.selectExpr("id + 1 as id"), "test", instead_of=first)
    assert sorted(r["id"] for r in second.collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="(?i)not exist|not found|FAILED_READ"):
        first.collect()


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    pool = [prose(rng, int(n), 3000) for n in rng.integers(8, 120, 150)]
    texts = [x + (" vile idiots" if i % 5 == 0 else "") + (" !!! $$$ zz" * 6 if i % 5 == 1 else "") for i, x in enumerate(pool)]
    texts += [x + " more" for x in texts[:60]] + texts[:20] + [None, "", " "]
    rows = [(i, x, "en", f"s{i % 3}" if i % 2 else "s0", len(x or ""), "extra") for i, x in enumerate(texts)] + [(3, texts[3], "en", "s0", 1, "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 1), int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = str(tmp_path)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "minhash", "mixing", "packing"]
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    as_rows = lambda df: sorted(map(str, df.collect()))
    for stage, module, wrong in ((corpus_pipeline.drop_toxic, toxicity, 1), (corpus_pipeline.drop_poor, quality, 0)):
        bad = {r["doc_id"] for r in module.score(docs, labels).collect() if r["predicted"] == wrong}
        kept = scratch.cut(stage(spark, docs, folder), "test")
        assert kept.columns == docs.columns
        assert as_rows(kept) == as_rows(docs.where(~F.col("doc_id").isin(list(bad))))
        docs = kept
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids, own = list(before), sets(list(before.values()), 5)
    linked = [(i, j) for i in range(len(ids)) for j in range(i) if own[i] and 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])]
    of = groups(len(ids), [(sorted(range(len(ids)), key=ids.__getitem__).index(i), sorted(range(len(ids)), key=ids.__getitem__).index(j)) for i, j in linked])
    least = {k for k, x in zip(sorted(ids), of, strict=True) if sorted(ids)[x] == k}
    docs = scratch.cut(corpus_pipeline.drop_near_duplicates(spark, docs, folder), "test")
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(least)
    copies = {r["doc_id"]: r["copies"] for r in mixing.plan(docs).collect()}
    mixed = scratch.cut(corpus_pipeline.mix_sources(spark, docs, folder), "test")
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(k for k, n in copies.items() for _ in range(n))
    packed = corpus_pipeline.run(spark, folder).collect()
    lengths = {}
    for r in packed:
        lengths.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in lengths.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096
    assert sorted(r["doc_id"] for r in packed if r["piece"] == 0) == sorted(r["doc_id"] for r in mixed.collect())


def test_upper_table():
    assert "AÉ".translate(UPPER) == "aÉ"


def test_the_sample_is_fitted_outside_the_driver(spark, monkeypatch):
    """The driver gets the weights, which are those of the same rows fitted plainly."""
    texts = {i: f"you {'vile rotten' if i % 3 == 0 else 'kind gentle'} person number {i % 50} {'said so' if i % 2 else ''}" for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in texts], "doc_id long, toxic int")
    driver, plain = os.getpid(), fm.fit

    def noted(*args):
        assert os.getpid() != driver, "fitted in the driver"
        return plain(*args)

    monkeypatch.setattr(fm, "fit", noted)
    model = toxicity.train(docs, labels)
    learned = sorted(i for i in texts if zlib.crc32(str(i).encode()) % 5)
    same = plain([np.unique(toxicity.terms([texts[i].encode()], 20)[1]).astype(np.int32) for i in learned], np.array([int(i % 3 == 0) for i in learned]), toxicity.CONFIG)
    assert model.report == same.report and model.report["features"] > 0 and model.w0 == same.w0
    assert all(np.array_equal(getattr(model, c), getattr(same, c)) for c in ("slot", "w", "v"))
    monkeypatch.setattr(fm, "fit", plain)
    assert fm.FMModel.of(*toxicity.train(docs, labels.limit(0)).sent()).w0 == 0
