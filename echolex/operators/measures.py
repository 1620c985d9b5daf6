"""Evaluation measures: error rates, calibration, threshold sweeps, the hand-set gate, token estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolex.functions.characters import CLASSES, units
from echolex.functions.columns import let
from echolex.operators import running, term_automaton


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate of one pair; an empty reference gives 0 for an empty hypothesis, else 1."""
    n = F.length(reference)
    return F.when(n > 0, F.levenshtein(reference, hypothesis) / n).otherwise(F.when(F.length(hypothesis) > 0, 1.0).otherwise(0.0))


def corpus_cer(pairs: DataFrame, by: str) -> DataFrame:
    """Micro-averaged character error rate of (reference, hypothesis) in each group."""
    sums = pairs.groupBy(by).agg(F.sum(F.levenshtein("reference", "hypothesis")).cast("long").alias("edits"), F.sum(F.length("reference")).cast("long").alias("chars"))
    return sums.withColumn("cer", F.coalesce(F.try_divide(F.col("edits").cast("double"), F.col("chars")), F.lit(0.0)))


def unit_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of texts: each distinct one becomes a character, and the strings are compared."""
    def distance(known: Column) -> Column:
        # characters beyond the surrogates, as UTF-32
        spelled = lambda x: F.decode(F.unhex(F.array_join(F.transform(x, lambda u: F.lpad(F.hex(F.array_position(known, u) + 0x10000), 8, "0")), "")), "UTF-32")
        return F.levenshtein(spelled(a), spelled(b))

    return let(F.array_distinct(F.concat(a, b)), distance)


def corpus_wer(pairs: DataFrame, by: str) -> DataFrame:
    """Micro-averaged word error rate of (reference, hypothesis) in each group; words are runs of one kind of character."""
    own = pairs.select(by, units("reference").alias("r"), units("hypothesis").alias("h"))
    sums = own.groupBy(by).agg(F.sum(unit_distance(F.col("r"), F.col("h"))).cast("long").alias("edits"), F.sum(F.size("r")).cast("long").alias("words"))
    return sums.withColumn("wer", F.coalesce(F.try_divide(F.col("edits").cast("double"), F.col("words")), F.lit(0.0)))


def count_places(text: Column, term: Column) -> Column:
    """Places of a term (a column) that do not overlap; none of an empty term."""
    return F.when(F.length(term) > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")).otherwise(F.lit(0).cast("long"))


def term_recall(pairs: DataFrame, terms: DataFrame, by: list[str]) -> DataFrame:
    """``by``, found, total, recall: of the terms' places in the references, those that the hypotheses have too. ``by`` names
    columns of the pairs or of the terms (term, ...)."""
    of = [c for c in by if c in terms.columns]
    met = term_automaton.counts(pairs, terms, ["reference", "hypothesis"], [c for c in by if c not in of], of)
    sums = met.groupBy(*by).agg(F.sum(F.least("n_1", "n_0")).cast("long").alias("found"), F.sum("n_0").cast("long").alias("total"))
    return sums.withColumn("recall", F.coalesce(F.try_divide(F.col("found").cast("double"), F.col("total")), F.lit(0.0)))


def _zero_safe(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def term_damage(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """One row for all (reference, baseline, corrected): terms right before, broken and fixed by the correction, damage rate."""
    met = term_automaton.counts(rows, terms, ["reference", "baseline", "corrected"], [], []).select(F.least("n_1", "n_0").alias("b"), F.least("n_2", "n_0").alias("a"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = met.agg(zero(F.col("b")).alias("correct_before"), zero(F.greatest(F.lit(0), F.col("b") - F.col("a"))).alias("broken"), zero(F.greatest(F.lit(0), F.col("a") - F.col("b"))).alias("fixed"))
    return sums.withColumn("damage_rate", _zero_safe("broken", "correct_before"))


def removal_rate(rows: DataFrame, patterns: list[str]) -> DataFrame:
    """One row: canned phrases that the baseline made up, how many are gone, those that were really said, and how many of
    these went too; ``patterns`` is a short list."""
    sums = []
    for p in patterns:
        r, b, c = (count_occurrences(F.col(x), p) for x in ("reference", "baseline", "corrected"))
        made_up = F.greatest(F.lit(0), b - r)
        sums.append((made_up, F.greatest(F.lit(0), F.least(made_up, b - c)), r, F.when(r > 0, F.greatest(F.lit(0), F.least(r, b) - c)).otherwise(0)))
    names = ["hallucinations", "removed", "legitimate", "false_removals"]
    total = lambda i: F.coalesce(F.sum(sum((s[i] for s in sums), F.lit(0))), F.lit(0)).cast("long")
    out = rows.agg(*(total(i).alias(n) for i, n in enumerate(names)))
    return out.withColumn("removal_rate", _zero_safe("removed", "hallucinations")).withColumn("false_removal_rate", _zero_safe("false_removals", "legitimate"))


def summarize(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """One row of all measures of (reference, baseline, corrected): n, error rates and recall of both, and their gains."""
    d, u = (lambda c: F.levenshtein("reference", c)), (lambda c: unit_distance(units("reference"), units(c)))
    own = rows.agg(
        F.count("*").alias("n"), F.sum(F.length("reference")).alias("chars"), F.sum(F.size(units("reference"))).alias("words"),
        *(F.sum(f(c)).alias(f"{name}_{c}") for c in ("baseline", "corrected") for name, f in (("c", d), ("w", u))),
    )
    met = term_automaton.counts(rows, terms, ["reference", "baseline", "corrected"], [], []).select(F.col("n_0").alias("g"), F.least("n_1", "n_0").alias("baseline"), F.least("n_2", "n_0").alias("corrected"))
    found = met.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"t_{c}") for c in ("baseline", "corrected")), F.coalesce(F.sum("g"), F.lit(0)).alias("t"))
    out = own.join(F.broadcast(found))  # two single rows
    out = out.select(
        "n", _zero_safe("c_corrected", "chars").alias("cer"), _zero_safe("c_baseline", "chars").alias("cer_baseline"), _zero_safe("w_corrected", "words").alias("wer"), _zero_safe("w_baseline", "words").alias("wer_baseline"),
        _zero_safe("t_corrected", "t").alias("term_recall"), _zero_safe("t_baseline", "t").alias("term_recall_baseline"),
    )
    out = out.withColumn("cer_improvement", F.col("cer_baseline") - F.col("cer")).withColumn("term_recall_gain", F.col("term_recall") - F.col("term_recall_baseline"))
    return out.withColumn("cer_improvement_rel", _zero_safe("cer_improvement", "cer_baseline"))


def count_occurrences(text: Column, term: str) -> Column:
    """Places of a term that do not overlap; none of an empty term."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long") if term else F.lit(0).cast("long")


def count_tokens(text: Column) -> Column:
    """Estimated tokens: kanji 1, kana .75, Latin letters .25, digits .5, others 1; rounded half to even, 1 at least; empty 0."""
    n = lambda *names: F.regexp_count(text, F.lit("[" + "".join(CLASSES[x] for x in names) + "]"))
    # what each kind costs less than 1; a text is passed once for each kind
    total = F.length(text) - 0.25 * n("hiragana", "katakana") - 0.75 * n("latin") - 0.5 * n("digit")
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(total))).cast("long")


def _by_score(scored: DataFrame) -> DataFrame:
    return scored.groupBy("score").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row: area under the ROC curve of (score, y); ties count half; 0.5 without both classes.

    Rows are first counted by score; the running sum over distinct scores, as many as rows where they are continuous, is
    made in ranges (``running.before``)."""
    runs = running.before(_by_score(scored), "score", "neg", "below")
    sums = runs.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(F.coalesce(F.try_divide(F.col("u"), (F.col("p") * F.col("n")).cast("double")), F.lit(0.5)).alias("auc"))


def expected_calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """One row: the mean gap between score and share of label 1 over equal bins, weighted by their rows."""
    binned = scored.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg("y").alias("a"))
    return binned.agg((F.sum(F.col("n") * F.abs(F.col("s") - F.col("a"))) / F.sum("n")).alias("ece"))


def sweep_thresholds(scored: DataFrame, steps: int = 100) -> DataFrame:
    """threshold (0..1 in ``steps``), accepted, repairs, damages: how many rows with each label score at least that."""
    counts = _by_score(scored)
    upto = F.explode(F.sequence(F.lit(0), F.least(F.floor(F.col("score") * steps + 1e-9), F.lit(steps)).cast("int"))).alias("step")
    hit = counts.select(upto, "pos", "neg").groupBy("step").agg(F.sum("pos").alias("repairs"), F.sum("neg").alias("damages"))
    return hit.select((F.col("step") / steps).alias("threshold"), (F.col("repairs") + F.col("damages")).alias("accepted"), "repairs", "damages")


def heuristic_gate(f: dict[str, Column]) -> Column:
    """Probability that an edit is safe, by hand-set weights; absent features have their neutral values."""
    g = lambda name, default=0.0: f.get(name, F.lit(default))
    z = 3.2 - 11.0 * g("norm_distance", 1.0) + 2.4 * g("margin") + 0.35 * F.least(g("span_morae"), F.lit(8.0)) - 3.0 * g("unknown_ratio")
    z = z - 0.12 * F.greatest(F.lit(0.0), g("reading_ambiguity", 1.0) - 1.0) - 1.4 * F.greatest(F.lit(0.0), 2.0 - g("span_morae")) + 0.6 * g("span_has_katakana")
    z = z + 0.4 * g("boundary_left") * g("boundary_right") - 2.6 * g("span_is_common_word") + 0.8 * g("span_is_proper_noun")
    return F.when(g("span_is_glossary_surface") >= 1.0, 0.0).otherwise(1 / (1 + F.exp(-z)))
