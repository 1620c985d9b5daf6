"""Morphological tokens: the cheapest way through a text's lattice of words.

A lexicon's words (surface, readings, pos, pos2, cost, left, right) are found at all places of a text by one automaton pass. A path
from the text's begin to its end costs what its words cost, what it costs that a word of class ``left`` follows one of class ``right``
(0 where the table of connections has no such pair; texts begin and end with class 0), and ``unknown`` for each character that no word of the path covers, which
are of class 0. Of equally cheap paths that with the fewest parts is taken, then, from the end, that with the longer word, then the
smaller class. A text's words meet in one task, since its path depends on all of them; texts do not.

Readers are a registry by name: ``characters`` (kinds of characters), ``longest`` (longest match) and ``lattice``."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolex.functions import characters
from echolex.functions.columns import nullable
from echolex.operators import term_automaton
from echolex.sources.checkpoints import written

UNKNOWN = 10_000
CONNECTIONS = 1_000_000  # rows that a table of connections may have: classes in pairs


def cheapest(length: int, words: list[tuple[int, int, int, int, int]], connections: dict[tuple[int, int], int], unknown: int) -> list[int | tuple[int, int]]:
    """The path through words (start, end, cost, left, right): places in ``words``, and (start, end) of runs that none covers."""
    by_start: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_start.setdefault(w[0], []).append(k)
    # at each place, for each class that a part may have ended with there: cost, parts, and how it came about
    best: list[dict[int, tuple]] = [{} for _ in range(length + 1)]
    best[0][0] = (0, 0, 0, 0, None, None)
    for at in range(length):
        for right, (cost, parts, *_) in best[at].items():
            options = [(at + 1, cost + unknown + connections.get((right, 0), 0), 0, None)]
            options += [(words[k][1], cost + words[k][2] + connections.get((right, words[k][3]), 0), words[k][4], k) for k in by_start.get(at, ())]
            for end, total, own, k in options:
                new = (total, parts + 1, at, right, k, at)
                have = best[end].get(own)
                if have is None or new[:4] < have[:4]:
                    best[end][own] = new
        if at:
            best[at] = {r: (b[2], b[3], b[4]) for r, b in best[at].items()}  # only the way back is needed from here on
    final = min(((b[0] + connections.get((r, 0), 0), b[1], b[2], r) for r, b in best[length].items()), default=None)
    if not length or final is None:
        return []
    out: list[int | tuple[int, int]] = []
    at, right = length, final[3]
    while at:
        before, came, k = best[at][right][2:5] if at == length else best[at][right]
        if k is None and out and isinstance(out[-1], tuple):
            out[-1] = (before, out[-1][1])
        else:
            out.append((before, at) if k is None else k)
        at, right = before, came
    return out[::-1]


def tokens(docs: DataFrame, lexicon: DataFrame, kanji: DataFrame, connections: DataFrame | None = None, unknown: int = UNKNOWN) -> DataFrame:
    """doc_id, tok, surface, start, end, kind, readings, pos, pos2, blocked, common, proper of the cheapest path of each text (doc_id unique, text).

    ``lexicon``: surface (each once), readings, pos, pos2, cost, left, right; ``connections``: right, left, cost. A run that no word covers gives the tokens
    that ``characters.tokens`` makes of its characters. Null and empty texts have none."""
    table: dict[tuple[int, int], int] = {}
    if connections is not None:
        rows = connections.select("right", "left", "cost").limit(CONNECTIONS + 1).collect()
        if len(rows) > CONNECTIONS:
            raise ValueError(f"more than {CONNECTIONS} connections")
        table = {(r["right"], r["left"]): r["cost"] for r in rows}
    shared = docs.sparkSession.sparkContext.broadcast(table)
    found = term_automaton.places(docs, lexicon.withColumn("term", F.col("surface")), "text", ["doc_id"], ["surface", "cost", "left", "right"], overlapping=True)
    # the text itself travels as one more row
    whole = docs.where(F.length("text") > 0).select("doc_id", F.col("text").alias("surface"), *(F.lit(0).alias(c) for c in ("cost", "left", "right")), F.lit(-1).alias("start"), F.length("text").alias("end"))
    ints = [F.col(c).cast("int").alias(c) for c in ("cost", "left", "right", "start", "end")]
    each = found.select("doc_id", "surface", *ints).union(whole.select("doc_id", "surface", *ints))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def path(rows: pa.Table) -> pa.Table:
        columns = {c: rows.column(c).to_pylist() for c in ("start", "end", "cost", "left", "right", "surface")}
        text = next((columns["surface"][k] for k, s in enumerate(columns["start"]) if s < 0), "")
        keep = sorted((k for k, s in enumerate(columns["start"]) if s >= 0), key=lambda k: (columns["start"][k], columns["end"][k]))
        words = [tuple(columns[c][k] for c in ("start", "end", "cost", "left", "right")) for k in keep]
        parts = [(*words[p][:2], True) if isinstance(p, int) else (*p, False) for p in cheapest(len(text), words, shared.value, unknown)]
        doc = rows.column("doc_id").take(pa.array([0] * len(parts), pa.int64()))
        columns = [pa.array([p[k] for p in parts], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.bool_()))]
        return nullable(pa.table([doc, *columns, pa.array([text[a:b] for a, b, _ in parts], pa.string())], names=["doc_id", "start", "end", "known", "piece"]))

    taken = written(each.groupBy("doc_id").applyInArrow(path, f"doc_id {kind}, start int, end int, known boolean, piece string"))  # read for both kinds of parts
    words = lexicon.select(F.col("surface").alias("piece"), "readings", "pos", "pos2").dropDuplicates(["piece"])
    fields = ["start", "end", "surface", "kind", "readings", "pos", "pos2"]
    own = taken.where("known").join(words, "piece").withColumn("surface", F.col("piece")).withColumn("kind", characters.kind(F.substring("piece", 1, 1)))
    rest = characters.tokens(taken.where("not known").select(F.struct("doc_id", "start").alias("doc_id"), F.col("piece").alias("text")), kanji)
    at = F.col("doc_id.start")
    rest = rest.select(F.col("doc_id.doc_id").alias("doc_id"), (F.col("start") + at).alias("start"), (F.col("end") + at).alias("end"), "surface", "kind", "readings", "pos", "pos2")
    ordered = own.select("doc_id", *fields).union(rest.select("doc_id", *fields)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("t"))
    rows = ordered.select("doc_id", F.posexplode("t").alias("tok", "t")).select("doc_id", "tok", *(F.col(f"t.{c}") for c in fields))
    return characters.with_flags(rows)


Reader = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
READERS: dict[str, Reader] = {
    "characters": lambda docs, lexicon, kanji: characters.tokens(docs, kanji),
    "longest": lambda docs, lexicon, kanji: characters.lexicon_tokens(docs, lexicon, kanji),
    "lattice": lambda docs, lexicon, kanji: tokens(docs, lexicon, kanji),
}


def reader(name: str = "longest") -> Reader:
    """A reader (texts, lexicon, table of kanji -> tokens) by its name."""
    if name not in READERS:
        raise ValueError(f"no reader {name}; there are {', '.join(READERS)}")
    return READERS[name]
