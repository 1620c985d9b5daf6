"""The lattice reader against all paths, rendering against hand-written HTML, and the gate's fit over all rows against the driver's."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolex.__main__ import main
from echolex.operators import gate, lattice, rendering

LEXICON = "surface string, readings array<string>, pos string, pos2 string, cost int, left int, right int"


def every_path(length, words, connections, unknown):
    """Of all ways through: cost, parts, and from the end where parts begin and what class they end with."""
    best = None

    def go(at, parts, cost, right):
        nonlocal best
        if at == length:
            key = [cost + connections.get((right, 0), 0), len(parts)]
            classes = [words[k][4] if k is not None else 0 for _, _, k in parts]
            for n in range(len(parts) - 1, -1, -1):
                key += [parts[n][0], classes[n]] if n == len(parts) - 1 else [classes[n], parts[n][0]]
            if best is None or key < best[0]:
                best = key, list(parts)
            return
        for end, k, own in [(at + 1, None, 0)] + [(w[1], k, w[4]) for k, w in enumerate(words) if w[0] == at]:
            price = unknown if k is None else words[k][2]
            left = 0 if k is None else words[k][3]
            go(end, [*parts, (at, end, k)], cost + price + connections.get((right, left), 0), own)

    go(0, [], 0, 0)
    return best


def test_lattice_is_the_best_of_all_paths():
    rng = random.Random(6)
    for _ in range(300):
        length = rng.randint(0, 7)
        words = sorted({(s, rng.randint(s + 1, length)) for s in (rng.randrange(length) for _ in range(rng.randint(0, 8)))} if length else set())
        words = [(s, e, rng.randint(0, 4), rng.randint(0, 2), rng.randint(0, 2)) for s, e in words]
        connections = {(a, b): rng.randint(-1, 2) for a in range(3) for b in range(3) if rng.random() < 0.6}
        unknown = rng.randint(1, 5)
        way = lattice.cheapest(length, words, connections, unknown)
        if not length:
            assert way == []
            continue
        best = every_path(length, words, connections, unknown)
        expected = []
        for a, b, k in best[1]:
            if k is None and expected and isinstance(expected[-1], tuple):
                expected[-1] = (expected[-1][0], b)
            else:
                expected.append((a, b) if k is None else k)
        assert way == expected


def test_lattice_tokens(spark):
    lexicon = spark.createDataFrame(
        [("東京", ["トウキョウ"], "名詞", "固有名詞", 10, 1, 1), ("京都", ["キョウト"], "名詞", "固有名詞", 10, 1, 1), ("東", ["ヒガシ"], "名詞", "普通名詞", 20, 1, 1), ("都", ["ト"], "接尾辞", "", 5, 2, 2), ("に", ["ニ"], "助詞", "", 3, 3, 3), ("bc", ["ビーシー"], "名詞", "普通名詞", 1, 1, 1)],
        LEXICON,
    )
    kanji = spark.createDataFrame([("行", ["イ"])], "kanji string, readings array<string>")
    docs = spark.createDataFrame([(1, "東京都に行く"), (2, "東京都に行く。"), (3, None), (4, ""), (5, "abcd12"), (6, "。。")], "doc_id long, text string")
    rows = lattice.tokens(docs, lexicon, kanji).orderBy("doc_id", "tok").collect()
    surfaces = lambda i: [r["surface"] for r in rows if r["doc_id"] == i]
    assert surfaces(1) == ["東京", "都", "に", "行", "く"] and surfaces(2) == ["東京", "都", "に", "行", "く", "。"]
    assert surfaces(5) == ["a", "bc", "d", "12"] and surfaces(6) == ["。", "。"] and not surfaces(3) + surfaces(4)
    one = [r for r in rows if r["doc_id"] == 1]
    assert [(r["start"], r["end"]) for r in one] == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 6)]
    assert [r["readings"] for r in one] == [["トウキョウ"], ["ト"], ["ニ"], ["イ"], ["く"]]
    assert [r["proper"] for r in one][:2] == [True, False] and [r["blocked"] for r in one][1:3] == [True, True]
    # a suffix may not follow a name here, so the other way through is cheaper
    connections = spark.createDataFrame([(1, 2, 100)], "right int, left int, cost int")
    other = lattice.tokens(docs.where("doc_id = 1"), lexicon, kanji, connections).orderBy("tok").collect()
    assert [r["surface"] for r in other] == ["東", "京都", "に", "行", "く"]
    assert [r["surface"] for r in lattice.reader("lattice")(docs.where("doc_id = 1"), lexicon, kanji).orderBy("tok").collect()] == surfaces(1)
    assert lattice.reader("longest")(docs.where("doc_id = 1"), lexicon, kanji).count() == 5 and lattice.reader("characters")(docs.where("doc_id = 1"), lexicon, kanji).count() == 6
    with pytest.raises(ValueError, match="no reader"):
        lattice.reader("none")


def test_diff(spark):
    docs = spark.createDataFrame([(1, "a<b & \"c\"\n'd'"), (2, None), (3, "none & <i>"), (4, "abcdef")], "doc_id int, text string")
    edits = spark.createDataFrame([(1, 1, 2, "<&>"), (1, 10, 11, None), (4, 1, 3, "x"), (4, 2, 5, "y"), (4, 3, 4, ""), (9, 0, 1, "z")], "doc_id int, start int, end int, replacement string")
    found = {r["doc_id"]: (r["html"], r["shown"]) for r in rendering.diff(docs, edits).collect()}
    assert found == {
        1: ("a<del>&lt;</del><ins>&lt;&amp;&gt;</ins>b &amp; &quot;c&quot;<br><del>&#x27;</del>d&#x27;", 2),
        2: ("", 0),
        3: ("none &amp; &lt;i&gt;", 0),
        4: ("a<del>bc</del><ins>x</ins><del>d</del><ins></ins>ef", 2),
    }


def test_evidence(spark):
    schema = "doc_id int, start int, end int, span string, replacement string, nd double, tau double, raw double, probability double, margin double, reason string, accepted boolean, applied boolean, phonemes array<string>, t_phonemes array<string>, alignment array<struct<op: string, a: string, b: string, cost: double>>"
    ops = [("~", "k", "g", 0.3), ("+", "", "a", 0.85)]
    rows = [(1, i, i + 1, "<x>", "y", 0.1234, 0.28, 0.5, 0.9, 0.2, "gate-accept", i == 0, i == 0, ["k"], ["g", "a"], ops) for i in range(5)]
    found = rendering.evidence(spark.createDataFrame(rows, schema), most_rejected=2).orderBy("start").collect()
    assert [r["start"] for r in found] == [0, 1, 2]
    assert found[0]["html"] == (
        '<dl class="evidence"><dt>applied</dt><dd><del>&lt;x&gt;</del> <ins>y</ins></dd><dt>heard</dt><dd>k</dd><dt>term</dt><dd>g a</dd><dt>distance</dt><dd>0.1234 &le; 0.28 (0.500)</dd>'
        '<dt>gate</dt><dd>0.9000, margin 0.200, gate-accept</dd><dt>alignment</dt><dd><span title="0.30">~k&rarr;g</span> <span title="0.85">+ε&rarr;a</span></dd></dl>'
    )
    assert found[1]["html"].startswith('<dl class="evidence"><dt>not applied</dt>')


def test_fit_over_all_rows_is_the_drivers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, len(gate.FEATURES)))
    x[:, 3] = 2.0  # no spread
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=160) > 0).astype(int)
    rows = [(i, tuple(map(float, x[i])), int(y[i])) for i in range(160)]
    schema = f"id int, features struct<{', '.join(f'{n}: double' for n in gate.FEATURES)}>, label int"
    decisions = spark.createDataFrame(rows, schema).repartition(3)
    config = gate.FitConfig(epochs=12, calibration_epochs=6)
    held = F.col("id") % 5 == 0
    one, all_ = gate.fit(decisions, ["id"], config, held=held), gate.fit_all(decisions, ["id"], config, held=held)
    for name in ("weights", "mean", "scale", "platt"):
        assert np.allclose(getattr(one, name), getattr(all_, name), rtol=0, atol=1e-9)
    assert abs(one.bias - all_.bias) < 1e-9
    assert one.metadata["training"]["n_train"] == all_.metadata["training"]["n_train"] == 128
    assert all_.metadata["training"]["log_loss"] == pytest.approx(one.metadata["training"]["log_loss"])
    with pytest.raises(ValueError, match="no decisions"):
        gate.fit_all(decisions.limit(0), ["id"], config)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "glossary.csv").write_text("surface,reading\n新藤,シンドウ\n", "utf-8")
    (tmp_path / "text.txt").write_text("シントウです。ご視聴ありがとうございました。", "utf-8")
    (tmp_path / "model.json").write_text('{"vowel_vowel_default": 0.5, "not_known": 1}', "utf-8")
    (tmp_path / "lexicon.jsonl").write_text('{"surface": "です", "readings": ["デス"], "pos": "助動詞", "pos2": "", "cost": 1, "left": 1, "right": 1}\n', "utf-8")
    run = lambda *more: main([*more, str(tmp_path / "text.txt"), "-g", str(tmp_path / "glossary.csv"), "--gate-threshold", "0.0"])
    assert run("fix") == 0 and capsys.readouterr().out.strip() == "新藤です。"
    assert run("fix", "--keep-hallucinations", "--json", "--phonetic-config", str(tmp_path / "model.json"), "--reader", "lattice", "--lexicon", str(tmp_path / "lexicon.jsonl")) == 0
    assert json.loads(capsys.readouterr().out)["text"] == "新藤です。ご視聴ありがとうございました。"
    assert run("explain") == 0
    assert "<del>シントウ</del> <ins>新藤</ins>" in capsys.readouterr().out
    assert run("fix", "-o", str(tmp_path / "out")) == 0
    assert "".join(p.read_text("utf-8") for p in (tmp_path / "out").glob("*.txt")).strip() == "新藤です。"
