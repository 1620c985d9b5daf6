"""What correction does at each size of a glossary, for all sizes in one plan.

Sizes are nested: a term belongs to its smallest size (``size``) and to all larger ones. Readings are looked up once in the index of all terms; what a
size allows is a filter on the terms found, ranked anew. So a run over ten sizes asks the index as often as a run over one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolex.operators import correction, edits, lookup, term_automaton
from echolex.operators.correction import CorrectionConfig
from echolex.operators.gate import Gate

RAW, SYSTEM = "A", "D"  # as heard, and as corrected
MATCHES = 1 << 30  # of a reading: all within the bounds


def with_sizes(glossary: DataFrame, sizes: list[int]) -> DataFrame:
    """``glossary`` (entry_id, place, ...) with ``size``: the smallest of ``sizes`` that holds the place; null beyond the largest."""
    size = F.lit(None).cast("int")
    for s in sorted(sizes, reverse=True):
        size = F.when(F.col("place") < s, s).otherwise(size)
    return glossary.withColumn("size", size)


def corrected(docs: DataFrame, tokens: DataFrame, glossary: DataFrame, sizes: list[int], config: CorrectionConfig = CorrectionConfig(), gate: Gate = Gate()) -> DataFrame:
    """size, doc_id, text: each text (doc_id, text) corrected by the terms (entry_id, surface, readings, weight, size) of each size.

    The same as ``correction.correct`` with each size's terms alone, without the screen by shared grams, which would know each size's own grams only."""
    glossary = glossary.where(F.col("size").isNotNull())
    every = F.explode(F.array(*map(F.lit, sorted(sizes)))).alias("run")
    keyed = lambda df: df.withColumn("doc_id", F.struct("run", "doc_id"))
    surfaces = glossary.groupBy("surface").agg(F.min("size").alias("least"))
    # spans that are a surface of a size's own terms are left alone at that size
    spans = correction.candidate_spans(docs, tokens, config).select("*", every)
    own = spans.join(surfaces, (F.col("span") == F.col("surface")) & (F.col("least") <= F.col("run")), "left_anti")
    own = keyed(own).drop("run")
    asked = correction.asked_variants(own, config)
    index = lookup.readings(glossary, config.model)
    once = asked.select("q_key", "phonemes", "tau", "max_raw").dropDuplicates(["q_key"])
    found = lookup.top_k(once, index, lookup.QueryBounds(config.tau, MATCHES, None, config.max_mora_ratio), model=config.model)
    found = found.join(glossary.select("entry_id", "size").dropDuplicates(["entry_id"]), "entry_id")
    at = found.select("*", every).where(F.col("size") <= F.col("run"))
    first = F.row_number().over(Window.partitionBy("run", "q_key").orderBy("rank"))
    at = at.withColumn("rank", first).where(F.col("rank") <= config.top_k).withColumn("q_key", F.concat_ws("|", "run", "q_key")).drop("run", "size")
    asked = asked.withColumn("q_key", F.concat_ws("|", F.col("doc_id.run"), "q_key"))
    texts = keyed(docs.select("doc_id", "text", every)).drop("run")
    good = correction.proposed(texts, own, asked, at, gate).where(F.col("probability") >= config.gate)
    done = edits.splice(texts, edits.resolve_overlaps(good.select("doc_id", "start", "end", "replacement", "raw", "nd", "tau", "max_raw", "score")))
    return done.select(F.col("doc_id.run").alias("size"), F.col("doc_id.doc_id").alias("doc_id"), "text")


def conditions(pairs: DataFrame, done: DataFrame, terms: DataFrame) -> DataFrame:
    """condition, size (null for the texts as heard), sentences, cer, term_recall, broken, fixed, term_damage: ``pairs`` (doc_id, reference, baseline) against
    ``done`` (size, doc_id, text), for the places of ``terms`` (term)."""
    rows = pairs.select("doc_id", "reference", "baseline").join(done.withColumnRenamed("text", "corrected"), "doc_id")
    rows = rows.select("size", "reference", "baseline", "corrected")
    heard = pairs.select(F.lit(None).cast("int").alias("size"), "reference", "baseline", F.col("baseline").alias("corrected"))
    each = rows.union(heard)
    cer = each.groupBy("size").agg(F.count("*").alias("sentences"), F.sum(F.levenshtein("reference", "corrected")).alias("e"), F.sum(F.length("reference")).alias("n"))
    counted = term_automaton.counts(each, terms, ["reference", "baseline", "corrected"], ["size"], [])
    before, after = F.least("n_1", "n_0"), F.least("n_2", "n_0")
    sums = counted.groupBy("size").agg(
        F.sum(after).alias("found"), F.sum("n_0").alias("total"), F.sum(before).alias("right"), F.sum(F.greatest(F.lit(0), before - after)).alias("broken"), F.sum(F.greatest(F.lit(0), after - before)).alias("fixed")
    ).withColumnRenamed("size", "s")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rate = lambda a, b: F.coalesce(F.try_divide(zero(a).cast("double"), zero(b).cast("double")), F.lit(0.0))
    out = cer.join(F.broadcast(sums), F.col("s").eqNullSafe(F.col("size")), "left")  # a row for each size
    condition = F.when(F.col("size").isNull(), RAW).otherwise(SYSTEM)
    return out.select(condition.alias("condition"), "size", "sentences", rate("e", "n").alias("cer"), rate("found", "total").alias("term_recall"), zero("broken").alias("broken"), zero("fixed").alias("fixed"), rate("broken", "right").alias("term_damage"))


def document(results: DataFrame) -> DataFrame:
    """One row, ``json``: the rows of ``conditions`` as one document, by condition and size. As many rows as sizes."""
    fields = [c for c in results.columns if c != "condition"]
    by = results.groupBy("condition").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("runs"))
    whole = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("condition", "runs")))).alias("conditions"))
    return whole.select(F.to_json(F.struct("conditions")).alias("json"))
