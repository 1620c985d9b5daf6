"""Whole-pipeline sweeps: labelled proposals to train a gate on, and operating points over thresholds and bounds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolex.operators import correction, edits, term_automaton
from echolex.operators.gate import Gate

Proposer = Callable[[correction.CorrectionConfig], DataFrame]
WIDE = correction.CorrectionConfig(tau=0.45, max_raw=1.2, tau_common=0.12)  # bounds that let wrong candidates through, to learn from


def training_rows(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, start, end, span, replacement, probability, features, outcome, label: proposals of the hypotheses of (doc_id, gold,
    hypothesis), held against the gold text. Only a repair is a positive."""
    rows = found.join(pairs.select("doc_id", F.col("gold").alias("reference"), F.col("hypothesis").alias("baseline")), "doc_id")
    rows = edits.classify_span_edits(rows)
    return rows.select("doc_id", "start", "end", "span", "replacement", "probability", "features", "outcome", (F.col("outcome") == "repair").cast("int").alias("label"))


def operating_points(pairs: DataFrame, found: DataFrame, terms: DataFrame, steps: int = 20) -> DataFrame:
    """A row for each threshold 0..1: proposals are gated, overlaps resolved and edits applied anew, and the terms' places in
    the result counted: threshold, accepted, repairs, damages, neutrals, correction_rate, damage_rate, edit_damage_rate.

    ``pairs``: doc_id, gold, hypothesis; ``terms``: term. The rates' bases are places that the hypothesis has wrong and right."""
    rows = pairs.select("doc_id", F.col("gold").alias("reference"), F.col("hypothesis").alias("baseline"))
    reach = F.floor(F.col("probability") * steps + 1e-9).cast("int")
    each = found.where(reach >= 0).withColumn("step", F.explode(F.sequence(F.lit(0), F.least(reach, F.lit(steps)))))
    each = each.select(F.struct("step", "doc_id").alias("doc_id"), "start", "end", "replacement", "raw", "nd", "tau", "max_raw", "score")
    chosen = edits.resolve_overlaps(each)
    thresholds = found.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    # a text that no edit touches at a threshold is as it was: only touched ones are spliced and counted
    touched = chosen.select("doc_id").distinct().select(F.col("doc_id.step").alias("step"), F.col("doc_id.doc_id").alias("doc_id")).join(rows, "doc_id")
    spliced = edits.splice(touched.select(F.struct("step", "doc_id").alias("doc_id"), F.col("baseline").alias("text")), chosen)
    spliced = spliced.select(F.col("doc_id.step").alias("step"), F.col("doc_id.doc_id").alias("doc_id"), F.col("text").alias("corrected"))
    before = term_automaton.counts(rows, terms, ["reference", "baseline"], ["doc_id"], ["term"])
    before = before.select("doc_id", "term", F.col("n_0").alias("g"), F.least("n_1", "n_0").alias("b"))
    totals = before.agg(F.coalesce(F.sum(F.col("g") - F.col("b")), F.lit(0)).alias("wrong"), F.coalesce(F.sum("b"), F.lit(0)).alias("right"))
    there = term_automaton.counts(spliced.join(rows.select("doc_id", "reference"), "doc_id"), terms, ["reference", "corrected"], ["step", "doc_id"], ["term"])
    after = before.join(there.select("step", "doc_id", "term", "n_1"), ["doc_id", "term"]).withColumn("a", F.least("n_1", "g"))
    changes = after.groupBy("step").agg(F.sum(F.greatest(F.lit(0), F.col("a") - F.col("b"))).alias("fixed"), F.sum(F.greatest(F.lit(0), F.col("b") - F.col("a"))).alias("damaged"))
    made = chosen.select(F.col("doc_id.step").alias("step"), F.col("doc_id.doc_id").alias("doc_id"), "start", "end", "replacement").join(rows, "doc_id")
    outcomes = edits.classify_span_edits(made).groupBy("step").agg(F.count("*").alias("accepted"), F.count_if(F.col("outcome") == "repair").alias("repairs"), F.count_if(F.col("outcome") == "damage").alias("damages"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rate = lambda a, b: F.coalesce(F.try_divide(zero(a).cast("double"), zero(b).cast("double")), F.lit(0.0))
    out = thresholds.join(outcomes, "step", "left").join(changes, "step", "left").join(F.broadcast(totals))
    return out.select(
        (F.col("step") / steps).alias("threshold"), zero("accepted").alias("accepted"), zero("repairs").alias("repairs"), zero("damages").alias("damages"), (zero("accepted") - zero("repairs") - zero("damages")).alias("neutrals"),
        rate("fixed", "wrong").alias("correction_rate"), rate("damaged", "right").alias("damage_rate"), rate("damages", "accepted").alias("edit_damage_rate"),
    )


def grid(pairs: DataFrame, propose: Proposer, terms: DataFrame, bounds: tuple[float, ...] = (0.2, 0.4, 0.8, 1.6, 3.2), steps: int = 20) -> DataFrame:
    """``operating_points`` for each absolute bound on the distance (column ``max_raw``); a short list."""
    out = None
    for b in bounds:
        points = operating_points(pairs, propose(replace(correction.CorrectionConfig(), max_raw=b, gate=0.0)), terms, steps).withColumn("max_raw", F.lit(float(b)))
        out = points if out is None else out.union(points)
    return out


def proposer(pairs: DataFrame, glossary: DataFrame, kanji: DataFrame, gate: Gate = Gate()) -> Proposer:
    """Proposals for the hypotheses of pairs, for whatever bounds."""
    from echolex.functions import characters

    docs = pairs.select("doc_id", F.col("hypothesis").alias("text"))
    tokens = characters.tokens(docs, kanji)
    return lambda config: correction.proposals(docs, tokens, glossary, replace(config, has_pos=False, rendaku=True), gate)
