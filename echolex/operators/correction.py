"""Correction of transcripts against a glossary: spans, proposals within the phonetic bounds, the gate, and splicing.

``correct_texts`` takes texts and a table of kanji readings. The other functions take tokens of any reader: doc_id, tok
(from 0), start, end, kind, readings (best first), and the flags blocked (particles, auxiliaries, affixes: no span begins
or ends there), common and proper. Their readings are combined best first, then with later parts voiced where the
configuration says so. A text's tokens meet in one task, spans and candidates do not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolex.functions import characters, distance_batch, sounds
from echolex.functions.columns import let
from echolex.functions.cost_model import DEFAULT, CostModel
from echolex.operators import edits, hallucination, lookup
from echolex.operators.gate import FEATURES, Gate
from echolex.sources.checkpoints import written

#: Scores (doubles) of the options, an array of texts, between the texts before and after them.
Rerank = Callable[[Column, Column, Column], Column]
CONTEXT = 64  # characters that a reranker sees on each side

BEAM = 32
READINGS_A_TOKEN = 3


@dataclass(frozen=True)
class CorrectionConfig:
    tau: float = 0.28
    tau_short: float = 0.16
    short_morae: int = 3
    tau_common: float = 0.03
    max_raw: float = 0.25
    max_raw_slope: float = 0.20  # for each square root of a mora
    max_mora_ratio: float = 0.34
    least_morae: int = 2
    most_tokens: int = 8
    most_chars: int = 24
    variants: int = 8
    top_k: int = 5
    gate: float = 0.5
    has_pos: bool = True  # without parts of speech, spans with kanji count as common words
    rendaku: bool = False  # voiced forms of later tokens' readings too
    screen: bool = True  # ask the index only for readings whose grams it largely has
    exact: bool = True  # else spans of three phonemes and more meet only the terms that share the most grams
    remove_hallucinations: bool = True  # in ``correct_texts``
    model: CostModel = DEFAULT


def spans(docs: DataFrame, tokens: DataFrame, config: CorrectionConfig = CorrectionConfig()) -> DataFrame:
    """doc_id, start, end, span, common, proper, variants of each run of tokens that may be corrected.

    A span begins at a token that is neither blocked nor a stop (punct, space), goes on to the next stop or
    ``most_chars``, and ends at tokens that are not blocked."""
    ahead = Window.partitionBy("doc_id").orderBy("tok").rowsBetween(0, config.most_tokens - 1)
    stop = F.col("kind").isin("punct", "space")
    each = F.struct("start", "end", "kind", (F.col("blocked") | stop).alias("blocked"), stop.alias("stop"), "common", "proper", F.slice("readings", 1, READINGS_A_TOKEN).alias("readings"))
    runs = tokens.select("doc_id", F.collect_list(each).over(ahead).alias("run")).where(~F.get("run", F.lit(0))["blocked"])
    first_stop = F.array_position(F.transform("run", lambda t: t["stop"]), True).cast("int")
    upto = F.when(first_stop > 0, first_stop - 1).otherwise(F.size("run"))
    ended = runs.select("doc_id", "run", F.explode(F.sequence(F.lit(1), upto)).alias("n")).where(~F.get("run", F.col("n") - 1)["blocked"])
    ended = ended.select("doc_id", F.slice("run", F.lit(1), F.col("n")).alias("run"), "n", F.get("run", F.lit(0))["start"].alias("start"), F.get("run", F.col("n") - 1)["end"].alias("end"))
    ended = ended.where(F.col("end") - F.col("start") <= config.most_chars)
    compound = (F.col("n") > 1) & F.forall("run", lambda t: t["kind"] == "katakana")
    proper = F.exists("run", lambda t: t["proper"])
    ordinary = ~compound & F.forall("run", lambda t: t["common"] | t["blocked"]) & ~proper
    common = ordinary if config.has_pos else F.exists("run", lambda t: t["kind"] == "kanji")
    rows = ended.join(docs.select("doc_id", "text"), "doc_id").withColumn("span", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    stopped = F.lit(r"^[\s　]*$")
    rows = rows.where(~F.rlike("span", stopped)).withColumns({"common": common, "proper": proper, "variants": _all_variants(F.col("run"), config)})
    char = lambda at: F.when((at > 0) & (at <= F.length("text")), F.substring("text", at, 1)).otherwise("")
    edge = lambda c: (c == "") | F.rlike(c, F.lit(r"[\p{P}\s　]"))
    return rows.select("doc_id", "start", "end", "span", "common", "proper", "variants", edge(char(F.col("start"))).alias("left"), edge(char(F.col("end") + 1)).alias("right"))


def _all_variants(run: Column, config: CorrectionConfig) -> Column:
    plain = reading_variants(run, config.variants)
    return characters.with_voiced(plain, run, config.variants) if config.rendaku else plain


def reading_variants(run: Column, most: int) -> Column:
    """Readings of a run of tokens, by the sum of their places, equal ones in order of making; each text once."""
    beam = max(BEAM, 4 * most)
    start = F.array(F.struct(F.lit("").alias("text"), F.lit(0).alias("rank")))

    def step(met: Column, token: Column) -> Column:
        own = F.coalesce(token["readings"], F.array().cast("array<string>"))
        forms = F.when(F.size(own) > 0, own).otherwise(F.array(F.repeat(F.lit("?"), F.greatest(F.lit(1), token["end"] - token["start"]))))
        made = F.flatten(F.transform(met, lambda b: F.transform(forms, lambda f, i: F.struct(F.concat(b["text"], f).alias("text"), (b["rank"] + i).alias("rank")))))
        ordered = F.array_sort(F.transform(made, lambda x, i: F.struct(x["rank"].alias("rank"), i.alias("i"), x["text"].alias("text"))))
        once = lambda o: let(F.transform(o, lambda x: x["text"]), lambda texts: F.filter(o, lambda x, i: F.array_position(texts, x["text"]) == i + 1))
        return F.slice(F.transform(let(ordered, once), lambda x: F.struct(x["text"].alias("text"), x["rank"].alias("rank"))), 1, beam)

    done = F.aggregate(run, start, step)
    return F.slice(F.filter(F.transform(done, lambda x: x["text"]), lambda t: t != ""), 1, most)


def asked_variants(own: DataFrame, config: CorrectionConfig) -> DataFrame:
    """The variants of spans with phonemes, bounds and the key of their look-up."""
    asked = own.select("doc_id", "start", "end", "span", "common", F.posexplode("variants").alias("variant", "reading"))
    # a generator, so that what is made for the filter is not made again
    long = F.filter(sounds.heard("reading", config.model), lambda h: h["morae"] >= config.least_morae)
    asked = asked.select("doc_id", "start", "end", "span", "common", "variant", F.inline(long))
    tau = F.when(F.col("common"), min(config.tau_common, config.tau)).when(F.col("morae") <= config.short_morae, config.tau_short).otherwise(config.tau)
    max_raw = config.max_raw + config.max_raw_slope * F.sqrt("morae")
    asked = asked.select("doc_id", "start", "end", "span", "variant", "phonemes", "morae", tau.alias("tau"), max_raw.alias("max_raw"))
    return asked.withColumn("q_key", F.concat_ws("|", F.array_join("phonemes", " "), "tau"))


def candidate_spans(docs: DataFrame, tokens: DataFrame, config: CorrectionConfig) -> DataFrame:
    """Spans that are not all hiragana."""
    return spans(docs, tokens, config).where(~F.rlike("span", F.lit(r"^[ぁ-ゖゝゞ]+$")))


def _candidate_spans(docs: DataFrame, tokens: DataFrame, glossary: DataFrame, config: CorrectionConfig) -> DataFrame:
    """Spans that are neither a glossary surface nor all hiragana."""
    surfaces = glossary.select(F.col("surface").alias("span")).distinct()
    return candidate_spans(docs, tokens, config).join(surfaces, "span", "left_anti")


def _features() -> dict[str, Column]:
    """The gate's features of a proposal, all from its own columns."""
    flag = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(0.0))
    has = lambda name: flag(F.rlike("span", F.lit(f"[{characters.CLASSES[name]}]")))
    term_morae = sounds.mora_count("t_phonemes").cast("double")
    unknown = F.size(F.filter("phonemes", lambda p: p == "?")) / F.size("phonemes")
    return {
        "norm_distance": F.col("nd"), "margin": F.col("margin"), "exact_reading_match": flag(F.col("nd") <= 1e-9), "span_morae": flag("morae"), "term_morae": term_morae,
        "mora_ratio": F.coalesce(F.try_divide(flag("morae"), term_morae), F.lit(0.0)), "span_chars": flag(F.col("end") - F.col("start")), "n_candidates": flag("n_candidates"),
        "unknown_ratio": F.coalesce(unknown, F.lit(1.0)), "reading_ambiguity": flag(F.size("variants")), "log_term_weight": F.log1p(F.greatest(F.lit(0.0), "weight")),
        "span_has_kanji": has("kanji"), "span_has_katakana": has("katakana"), "span_all_hiragana": F.lit(0.0), "span_is_glossary_surface": F.lit(0.0),
        "span_is_common_word": flag("common"), "span_is_proper_noun": flag("proper"), "boundary_left": flag("left"), "boundary_right": flag("right"), "lm_delta": F.col("lm_delta"),
    }


def proposals(docs: DataFrame, tokens: DataFrame, glossary: DataFrame, config: CorrectionConfig = CorrectionConfig(), gate: Gate = Gate(), rerank: Rerank | None = None) -> DataFrame:
    """One row a span that some glossary term is near to: doc_id, start, end, span, entry_id, replacement, raw, nd, tau,
    margin (to the nearest other term; 1 without), n_candidates, probability (the gate's), score, max_raw, phonemes, t_phonemes
    and features (a struct).

    Spans that are a glossary surface, or all hiragana, are left alone; so is a span that contains, or is contained in,
    the surface of any candidate. Equal readings under the same bound are looked up once. ``rerank`` only weighs the best
    candidate against the span in its context (feature lm_delta, from -5 to 5); it adds none."""
    index = lookup.readings(glossary, config.model)
    own = _candidate_spans(docs, tokens, glossary, config)
    asked = asked_variants(own, config)
    return proposed(docs, own, asked, looked_up(asked, index, config), gate, rerank)


def looked_up(asked: DataFrame, index: DataFrame, config: CorrectionConfig) -> DataFrame:
    """The terms that the variants may become, by ``q_key``."""
    distinct = asked.select("q_key", "phonemes", "tau", "max_raw").dropDuplicates(["q_key"])
    if config.screen:
        distinct = lookup.screen(distinct, index, model=config.model)
    return lookup.top_k(distinct, index, lookup.QueryBounds(config.tau, config.top_k, None, config.max_mora_ratio), exhaustive=config.exact, model=config.model)


def proposed(docs: DataFrame, own: DataFrame, asked: DataFrame, found: DataFrame, gate: Gate, rerank: Rerank | None = None) -> DataFrame:
    """``proposals`` from spans, their variants and the terms found for these."""
    met = written(asked.join(found, "q_key"))  # the matches alone; read twice below
    span = ["doc_id", "start", "end"]
    inside = F.contains("span", "surface") | F.contains("surface", "span")
    hit = F.struct("entry_id", "raw", "nd", "tau", "max_raw", "phonemes", "morae", "t_phonemes", "weight")
    terms = met.groupBy(*span, "surface").agg(
        F.min_by(hit, F.struct("nd", "variant", "rank")).alias("hit"), F.min(F.struct("nd", "variant", "rank")).alias("order"), F.bool_or(inside).alias("inside")
    )
    counts = met.groupBy(*span, "variant").agg(F.count("*").alias("n")).groupBy(*span).agg(F.max("n").alias("n_candidates"))
    best = terms.groupBy(*span).agg(F.min_by(F.struct("surface", "hit"), "order").alias("best"), F.slice(F.array_sort(F.collect_list("order.nd")), 1, 2).alias("two"), F.bool_or("inside").alias("inside")).where(~F.col("inside"))
    rows = best.join(counts, span).join(own, span)
    margin = F.when(F.size("two") > 1, F.get("two", F.lit(1)) - F.get("two", F.lit(0))).otherwise(1.0)
    rows = rows.select(*span, "span", F.col("best.surface").alias("replacement"), "best.hit.*", margin.alias("margin"), "n_candidates", "variants", "common", "proper", "left", "right")
    delta = F.lit(0.0)
    if rerank is not None:
        rows = rows.join(docs.select("doc_id", "text"), "doc_id")
        before = F.substring("text", F.greatest(F.lit(1), F.col("start") - CONTEXT + 1), F.least(F.lit(CONTEXT), F.col("start")))
        scores = rerank(before, F.array("span", "replacement"), F.substring("text", F.col("end") + 1, F.lit(CONTEXT)))
        delta = F.coalesce(F.when(F.size(scores) == 2, F.least(F.greatest(F.get(scores, F.lit(1)) - F.get(scores, F.lit(0)), F.lit(-5.0)), F.lit(5.0))), F.lit(0.0))
    features = _features()
    rows = rows.withColumn("lm_delta", delta).withColumn("features", F.struct(*(features[n].cast("double").alias(n) for n in FEATURES)))
    rows = rows.withColumn("probability", gate.probability({n: F.col(f"features.{n}") for n in FEATURES}))
    rows = rows.withColumn("score", edits.edit_score(F.col("probability"), F.col("nd"), F.col("start"), F.col("end")))
    return rows.select(*span, "span", "entry_id", "replacement", "raw", "nd", "tau", "margin", "n_candidates", "probability", "score", "max_raw", "phonemes", "t_phonemes", "features")


def receipts(found: DataFrame, threshold: float) -> DataFrame:
    """Proposals with ``accepted`` (by the gate) and ``reason``."""
    good = F.col("probability") >= threshold
    reason = F.when(good, "gate-accept").otherwise(F.format_string(f"gate-reject(p=%.3f<{threshold:.2f})", "probability"))
    return found.withColumn("accepted", good).withColumn("reason", reason)


def explain(docs: DataFrame, tokens: DataFrame, glossary: DataFrame, config: CorrectionConfig = CorrectionConfig(), gate: Gate = Gate()) -> DataFrame:
    """The evidence for every proposal: receipts with the alignment of their phonemes (costs to three places). Accepted ones
    that lost to an overlapping edit have ``applied`` false; in each text accepted ones come first, then by place."""
    found = written(receipts(proposals(docs, tokens, glossary, config, gate), config.gate))  # read twice below
    chosen = edits.resolve_overlaps(found.where("accepted").select("doc_id", "start", "end", "score")).select("doc_id", "start", "end", F.lit(True).alias("applied"))
    ops = F.transform(distance_batch.alignment("phonemes", "t_phonemes", sounds.indel_costs("phonemes", config.model), sounds.indel_costs("t_phonemes", config.model), config.model), lambda o: F.struct(o["op"].alias("op"), o["a"].alias("a"), o["b"].alias("b"), F.round(o["cost"], 3).alias("cost")))
    rows = found.withColumn("alignment", ops).join(chosen, ["doc_id", "start", "end"], "left").withColumn("applied", F.coalesce("applied", F.lit(False)))
    return rows.orderBy("doc_id", F.desc("accepted"), "start", "end")


def span_counts(docs: DataFrame, tokens: DataFrame, glossary: DataFrame, config: CorrectionConfig = CorrectionConfig()) -> DataFrame:
    """doc_id, enumerated, queried, screened_out: a text's spans, those of which a reading passed the screen, and the rest of
    those with readings."""
    every = spans(docs, tokens, config)
    asked = asked_variants(_candidate_spans(docs, tokens, glossary, config), config)
    passed = lookup.screen(asked.select("q_key", "phonemes", "tau", "max_raw").dropDuplicates(["q_key"]), lookup.readings(glossary, config.model), model=config.model).select("q_key", F.lit(1).alias("passed"))
    met = asked.join(passed, "q_key", "left").groupBy("doc_id", "start", "end").agg(F.max("passed").alias("passed")).groupBy("doc_id")
    met = met.agg(F.count("passed").alias("queried"), F.count_if(F.col("passed").isNull()).alias("screened_out"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = docs.select("doc_id").join(every.groupBy("doc_id").agg(F.count("*").alias("enumerated")), "doc_id", "left").join(met, "doc_id", "left")
    return rows.select("doc_id", zero("enumerated"), zero("queried"), zero("screened_out"))


def correct(docs: DataFrame, tokens: DataFrame, glossary: DataFrame, config: CorrectionConfig = CorrectionConfig(), gate: Gate = Gate(), rerank: Rerank | None = None) -> DataFrame:
    """doc_id, text with the accepted, not overlapping proposals applied. An empty glossary changes nothing."""
    found = proposals(docs, tokens, glossary, config, gate, rerank).where(F.col("probability") >= config.gate)
    chosen = edits.resolve_overlaps(found.select("doc_id", "start", "end", "replacement", "raw", "nd", "tau", "max_raw", "score"))
    return edits.splice(docs, chosen)


def _without_parts_of_speech(config: CorrectionConfig) -> CorrectionConfig:
    return replace(config, has_pos=False, rendaku=True)


def correct_texts(docs: DataFrame, glossary: DataFrame, kanji: DataFrame, config: CorrectionConfig = CorrectionConfig(), gate: Gate = Gate(), rerank: Rerank | None = None) -> DataFrame:
    """doc_id, text corrected, from texts alone: canned phrases go first, tokens and readings are made (``characters.tokens``)."""
    if config.remove_hallucinations:
        docs = hallucination.remove(docs, hallucination.find(docs, hallucination.FilterConfig(model=config.model))).select("doc_id", "text")
    return correct(docs, characters.tokens(docs, kanji), glossary, _without_parts_of_speech(config), gate, rerank)


def candidate_set(asked: DataFrame, glossary: DataFrame, kanji: DataFrame, config: CorrectionConfig = CorrectionConfig()) -> DataFrame:
    """doc_id, surface, entry_id, raw, nd: every term that a whole text (doc_id, text) may legally become, each by its nearest
    reading. The bound for common words does not hold here."""
    tokens = characters.tokens(asked, kanji)
    each = F.struct("tok", "start", "end", "kind", F.slice("readings", 1, READINGS_A_TOKEN).alias("readings"))
    runs = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("run")).where(~F.exists("run", lambda t: t["kind"].isin("punct", "space")))
    own = runs.select("doc_id", _all_variants(F.col("run"), _without_parts_of_speech(config)).alias("variants"))
    own = own.select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("span"), F.lit(False).alias("common"), "variants")
    rows = asked_variants(own, replace(config, least_morae=0))
    found = lookup.top_k(rows.select("q_key", "phonemes", "tau", "max_raw").dropDuplicates(["q_key"]), lookup.readings(glossary, config.model), lookup.QueryBounds(config.tau, config.top_k, None, config.max_mora_ratio), exhaustive=config.exact, model=config.model)
    met = rows.join(found, "q_key").groupBy("doc_id", "surface").agg(F.min_by(F.struct("entry_id", "raw", "nd"), F.struct("nd", "variant")).alias("hit"))
    return met.select("doc_id", "surface", "hit.entry_id", "hit.raw", "hit.nd")
