"""Glossary index and the bounded phonetic-similarity top-k join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolex.functions import distance_batch, sounds
from echolex.functions.columns import nullable, once
from echolex.functions.cost_model import DEFAULT, CostModel
from echolex.operators.phoneme_trie import Trie
from echolex.sources.checkpoints import written

PREFILTER = 300
MAX_DF = 0.30
#: Readings of an index that is broadcast as one trie (some 100 bytes each); larger ones are dealt into parts of about that size.
TRIE_READINGS = 200_000
QUERY_BLOCK = 20_000


@dataclass(frozen=True)
class QueryBounds:
    tau: float = 0.28
    top_k: int = 5
    max_raw: float | None = None
    max_mora_ratio: float | None = 0.34
    prefilter: int | None = PREFILTER  # by shared grams: as many candidates; None: all that share one
    max_df: float | None = MAX_DF  # by shared grams: those in a larger share of readings do not count; None: all do


def readings(glossary: DataFrame, model: CostModel = DEFAULT) -> DataFrame:
    """slot, entry_id, surface, weight, reading, phonemes, morae, indel of a glossary (entry_id, surface, readings, weight).

    Readings that are empty or wholly unknown are left out. Slots are (entry_id, place) in order, without a number over
    all rows, so nothing is sorted in one task."""
    rows = glossary.select("entry_id", "surface", "weight", F.posexplode(F.array_distinct(F.filter("readings", lambda r: r.isNotNull() & (r != "")))).alias("place", "reading"))
    # making phonemes is what costs, however few bytes a glossary has
    rows = rows.repartition(glossary.sparkSession.sparkContext.defaultParallelism)
    known = F.filter(sounds.heard("reading", model), lambda h: (F.size(h["phonemes"]) > 0) & F.exists(h["phonemes"], lambda p: p != "?"))
    # a generator, so that what is made for the filter is not made again
    return rows.select(F.struct("entry_id", "place").alias("slot"), "entry_id", "surface", "weight", "reading", F.inline(known))


def grams(phonemes: str) -> F.Column:
    """The set of 2-grams, and of 3-grams from four phonemes on."""
    two, three = sounds.phoneme_ngrams(phonemes, 2), sounds.phoneme_ngrams(phonemes, 3)
    return F.array_distinct(F.when(F.size(phonemes) >= 4, F.concat(two, three)).otherwise(two))


def postings(index: DataFrame, *more: F.Column) -> DataFrame:
    return index.select("slot", F.size(grams("phonemes")).alias("n_grams"), *more, F.explode(grams("phonemes")).alias("gram"))


def gram_stats(index: DataFrame) -> DataFrame:
    """gram, df, idf = ln(1 + n / (1 + df))."""
    n = index.agg(F.count("*").alias("n"))
    # one row: a bounded broadcast
    return postings(index).groupBy("gram").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("gram", "df", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))


def _by_grams(queries: DataFrame, index: DataFrame, bounds: QueryBounds, model: CostModel) -> DataFrame:
    """The nearest by shared grams only: a query meets the ``prefilter`` readings that share the most weight with it."""
    side = index.select("slot", "entry_id", "surface", "weight", "reading", F.col("phonemes").alias("t_phonemes"), F.col("morae").alias("t_morae"), F.col("indel").alias("t_indel"))
    stats = gram_stats(index)
    if bounds.max_df is not None:
        stats = stats.where(F.col("df") <= max(1, int(bounds.max_df * index.count())))
    terms = postings(index, F.size("phonemes").alias("t_size")).join(stats, "gram")
    asked = queries.withColumn("q_grams", grams("q_phonemes")).select("q_key", "tau", F.size("q_phonemes").alias("q_size"), F.size("q_grams").alias("q_n"), F.explode("q_grams").alias("gram"))
    # only numbers are joined, summed and ranked; phonemes come to the candidates that are left
    one = lambda c: F.first(c).alias(c)
    scored = asked.join(terms, "gram").groupBy("q_key", "slot").agg((F.sum("idf") / (F.sqrt(F.first("q_n")) * F.sqrt(F.first("n_grams")))).alias("score"), one("tau"), one("q_size"), one("t_size"))
    longer = F.greatest("q_size", "t_size")
    scored = scored.where(F.abs(F.col("q_size") - F.col("t_size")) * model.least_indel <= F.col("tau") * longer + 1e-9)
    if bounds.prefilter is not None:
        first = F.row_number().over(Window.partitionBy("q_key").orderBy(F.desc("score"), "slot"))
        scored = scored.withColumn("_n", first).where(F.col("_n") <= bounds.prefilter)
    met = scored.select("q_key", "slot").join(queries, "q_key").join(side, "slot")
    if bounds.max_mora_ratio is not None:
        off = F.abs(F.col("q_morae") - F.col("t_morae")) / F.greatest(F.lit(1), "q_morae", "t_morae")
        met = met.where((F.col("q_morae") == 0) | (F.col("t_morae") == 0) | (off <= bounds.max_mora_ratio + 1e-9))
    norm = F.greatest(F.lit(1), F.size("q_phonemes"), F.size("t_phonemes"))
    budget = F.least(F.col("tau") * norm, "max_raw")  # least() leaves a null bound out
    raw = distance_batch.bounded_distance("q_phonemes", "t_phonemes", "q_indel", "t_indel", budget, model)
    return met.withColumn("raw", raw).where(F.col("raw").isNotNull()).withColumn("nd", F.col("raw") / norm)


_HIT = "q_key string, slot struct<entry_id: {entry}, place: int>, entry_id {entry}, surface string, reading string, weight {weight}, t_phonemes array<string>, raw double, nd double"


def _trie(index: pa.Table, model: CostModel) -> Trie:
    """Readings in order of their slots, with the numbers that ``Trie.nearest`` ranks by."""
    index = index.combine_chunks()
    index = index.append_column("place", index.column("slot").combine_chunks().field("place")).sort_by([("entry_id", "ascending"), ("place", "ascending")])
    ranked = pc.sort_indices(index, sort_keys=[("weight", "descending"), ("surface", "ascending"), ("entry_id", "ascending")]).to_numpy()
    order = np.empty(len(ranked), np.int64)
    order[ranked] = np.arange(len(ranked))
    group = index.column("entry_id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return Trie.build(index.append_column("group", pa.array(group.astype(np.int64))).append_column("order", pa.array(order)), model)


def _hits(asked: pa.Table, trie: Trie, bounds: QueryBounds) -> pa.Table:
    found = trie.nearest(asked.rename_columns({"q_phonemes": "phonemes", "q_indel": "indel", "q_morae": "morae"}), bounds.top_k, bounds.max_mora_ratio)
    own = trie.readings.take(found.column("slot"))
    columns = {"q_key": asked.column("q_key").take(found.column("query"))} | {c: own.column(c) for c in ("slot", "entry_id", "surface", "reading", "weight")}
    return pa.table(columns | {"t_phonemes": own.column("phonemes"), "raw": found.column("raw"), "nd": found.column("nd")})


def _by_trie(queries: DataFrame, index: DataFrame, bounds: QueryBounds, model: CostModel) -> DataFrame:
    """All readings within the bounds: each query walks a trie of the index.

    An index of up to ``TRIE_READINGS`` is one trie, which each task gets. A larger one is dealt into parts by the first
    two phonemes of its readings, commoner beginnings into several; a task holds one part and one block of queries."""
    context = queries.sparkSession.sparkContext
    kinds = {"entry": index.schema["entry_id"].dataType.simpleString(), "weight": index.schema["weight"].dataType.simpleString()}
    columns = ["slot", "entry_id", "surface", "reading", "weight", "phonemes", "indel", "morae"]
    some = index.select(columns).limit(TRIE_READINGS + 1).toArrow()
    if some.num_rows <= TRIE_READINGS:
        shared = context.broadcast(_trie(some, model))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from _hits(pa.table(batch), shared.value, bounds).combine_chunks().to_batches()

        # the walk is what costs, however few rows there are
        return queries.repartition(3 * context.defaultParallelism).mapInArrow(walk, _HIT.format(**kinds))
    # read several times: its readings are made once
    index = written(index.select(columns))
    n = index.count()
    # as many parts as there are cores, several each where there are few blocks; none over TRIE_READINGS or so
    parts = max(-(-n // TRIE_READINGS), context.defaultParallelism)
    each = -(-n // parts)
    first = F.array_join(F.slice("phonemes", 1, 2), " ")
    sizes = index.groupBy(first.alias("_first")).agg(F.count("*").alias("_n"))  # as many rows as pairs of phonemes
    dealt = index.join(F.broadcast(sizes), first == F.col("_first"))
    some = F.pmod(F.xxhash64("slot"), F.ceil(F.col("_n") / each).cast("long"))
    dealt = dealt.select(F.pmod(F.xxhash64("_first", some), F.lit(parts)).cast("int").alias("part"), *columns)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("q_key"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        # a block that meets no part has no rows either
        found = _hits(left if right.num_rows else left.slice(0, 0), _trie(right, model), bounds)
        return nullable(found)

    return asked.groupBy("part", "block").cogroup(dealt.groupBy("part", "block")).applyInArrow(both, _HIT.format(**kinds))


def top_k(queries: DataFrame, index: DataFrame, bounds: QueryBounds = QueryBounds(), exhaustive: bool | None = None, model: CostModel = DEFAULT) -> DataFrame:
    """For each query (q_key, phonemes) its ``top_k`` closest glossary entries: q_key, rank, entry_id, surface, reading, raw, nd, weight, t_phonemes.

    Columns ``tau`` and ``max_raw`` of the queries, where present, hold instead of the bounds of that name.
    Equal phonemes are looked up once. All terms within the bounds are found, whatever the index's size, unless ``exhaustive``
    is false: then queries of three phonemes and more meet only the best by shared grams."""
    own = lambda name, value: F.col(name) if name in queries.columns else F.lit(value).cast("double").alias(name)
    keyed = once(queries, q_phonemes=F.col("phonemes")).select("q_key", "q_phonemes", own("tau", bounds.tau), own("max_raw", bounds.max_raw))
    key = F.concat_ws("|", F.array_join("q_phonemes", " "), F.col("tau").cast("string"), F.col("max_raw").cast("string"))
    distinct = keyed.select("q_phonemes", "tau", "max_raw").distinct().withColumn("q_key", key).where(F.size("q_phonemes") > 0)
    distinct = distinct.withColumn("q_morae", sounds.mora_count("q_phonemes")).withColumn("q_indel", sounds.indel_costs("q_phonemes", model))
    names = ["q_key", "slot", "entry_id", "surface", "reading", "weight", "t_phonemes", "raw", "nd"]
    if exhaustive is False:
        short = F.size("q_phonemes") < 3
        near = _by_grams(distinct.where(~short), index, bounds, model).select(names).union(_by_trie(distinct.where(short), index, bounds, model).select(names))
    else:
        near = _by_trie(distinct, index, bounds, model)
    one = F.row_number().over(Window.partitionBy("q_key", "entry_id").orderBy("nd", "slot"))
    best = near.withColumn("_n", one).where("_n = 1")
    rank = F.row_number().over(Window.partitionBy("q_key").orderBy("nd", F.desc("weight"), "surface", "entry_id"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= bounds.top_k).select(F.col("q_key").alias("_k"), "rank", "entry_id", "surface", "reading", "raw", "nd", "weight", "t_phonemes")
    return keyed.join(ranked, key == F.col("_k")).select("q_key", "rank", "entry_id", "surface", "reading", "raw", "nd", "weight", "t_phonemes")


def index_stats(glossary: DataFrame, index: DataFrame) -> DataFrame:
    """One row: entries, indexed_readings, reachable_terms, grams, mean_posting, max_posting, shortest, longest."""
    sizes = postings(index).groupBy("gram").agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    grams_ = sizes.agg(F.count("*").alias("grams"), zero(F.avg("n")).alias("mean_posting"), zero(F.max("n")).alias("max_posting"))
    length = F.size("phonemes")
    own = index.agg(F.count("*").alias("indexed_readings"), F.count_distinct("entry_id").alias("reachable_terms"), zero(F.min(length)).alias("shortest"), zero(F.max(length)).alias("longest"))
    # three single rows
    return glossary.agg(F.count("*").alias("entries")).join(F.broadcast(own)).join(F.broadcast(grams_)).select("entries", "indexed_readings", "reachable_terms", "grams", "mean_posting", "max_posting", "shortest", "longest")


def screen(queries: DataFrame, index: DataFrame, least_share: float = 0.34, model: CostModel = DEFAULT) -> DataFrame:
    """Those of the queries (q_key, phonemes, tau, ...) that may match anything: their length is within reach of the
    index's, and of their 2-grams, repeated ones counted, at least that share stands in the index (short ones pass)."""
    own = sounds.phoneme_ngrams("phonemes", 2)
    queries = once(queries, phonemes=F.col("phonemes"))
    # one row, whose grams are no more than pairs of phonemes
    held = index.select(F.size("phonemes").alias("n"), F.explode(own).alias("gram"))
    known = held.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.collect_set("gram").alias("grams")).first()
    if known["lo"] is None:
        return queries.limit(0)
    n = F.size("phonemes")
    slack = F.col("tau") * F.greatest(n, F.lit(known["hi"])) / model.least_indel
    near = queries.where((n > 0) & (n + slack >= known["lo"]) & (n - slack <= known["hi"]))
    # as one expression, whose list becomes a set; phonemes hold no quotes
    listed = ", ".join(f"'{g}'" for g in sorted(known["grams"]))
    hits = F.expr(f"size(filter(_grams, g -> g IN ({listed})))")
    passed = (n < 3) | (hits >= F.greatest(F.lit(1), F.floor(F.size("_grams") * least_share)))
    return near.withColumn("_grams", own).where(passed).drop("_grams")


def retrieval_recall(queries: DataFrame, index: DataFrame, bounds: QueryBounds = QueryBounds(), model: CostModel = DEFAULT) -> DataFrame:
    """One row: queries, exhaustive_hits, recovered, missed, recall of the gram join's terms against all terms within reach."""
    pairs = lambda exhaustive: top_k(queries, index, bounds, exhaustive, model).select("q_key", "surface").distinct()
    slow = pairs(True).join(pairs(False).withColumn("found", F.lit(1)), ["q_key", "surface"], "left")
    sums = slow.agg(F.count("*").alias("exhaustive_hits"), F.count("found").alias("recovered"))
    sums = sums.join(F.broadcast(queries.agg(F.count("*").alias("queries"))))
    recall = F.coalesce(F.try_divide(F.col("recovered").cast("double"), F.col("exhaustive_hits")), F.lit(1.0))
    return sums.select("queries", "exhaustive_hits", "recovered", (F.col("exhaustive_hits") - F.col("recovered")).alias("missed"), recall.alias("recall"))
