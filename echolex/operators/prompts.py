"""Glossaries in prompts: what fits a budget of tokens, patterns that allow only candidates, and where a term's misheard form stands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolex.functions import distance_batch, sounds
from echolex.functions.cost_model import DEFAULT, CostModel
from echolex.operators import measures

TOKEN_LIMIT = 244
# How a term stands in a prompt, and what stands before the terms and before the transcript.
INSTRUCTION = "以下は日本語の音声認識結果です。用語集にある語が音的に近い誤りになっている場合のみ、その語に置き換えてください。それ以外は一切変更しないでください。\n"
TERMS, TRANSCRIPT = "用語集: ", "\n\n認識結果:\n"


def piece(surface: str = "surface", reading: str = "reading") -> Column:
    return F.concat(surface, F.lit("("), reading, F.lit(")、"))


@dataclass(frozen=True)
class Packed:
    places: list[int]  # entry_ids taken, in order
    used: int
    entries: int

    @property
    def coverage(self) -> float:
        return len(self.places) / self.entries if self.entries else 0.0


def pack(glossary: DataFrame, limit: int = TOKEN_LIMIT, used: int = 0) -> Packed:
    """Entries in order of ``entry_id``, each taken if it still fits: a long one is passed over, later short ones are not.

    An entry costs a token at least, so at most ``limit`` are taken. Rounds ask for the next entries that fit what is left, at
    most that many and one; each round takes one at least, so the glossary's rows never meet in one place."""
    costs = glossary.select("entry_id", measures.count_tokens(piece()).alias("cost")).persist()
    try:
        taken, after, left = [], None, limit - used
        while left > 0:
            rest = costs.where(F.col("cost") <= left)
            rest = rest if after is None else rest.where(F.col("entry_id") > after)
            found = rest.orderBy("entry_id").limit(left + 1).collect()
            if not found:
                break
            for r in found:
                if r["cost"] <= left:
                    taken.append(r["entry_id"])
                    left -= r["cost"]
            after = found[-1]["entry_id"]
        return Packed(taken, limit - left, costs.count())
    finally:
        costs.unpersist()


def build(docs: DataFrame, glossary: DataFrame, limit: int | None = TOKEN_LIMIT) -> DataFrame:
    """doc_id, prompt, terms_included, terms_dropped: the instruction, the terms that fit, and each transcript.

    Without a limit all terms are in; a prompt is one string, so this is for glossaries that a prompt can hold."""
    head = INSTRUCTION + TERMS
    spark = docs.sparkSession
    used = spark.range(1).select(measures.count_tokens(F.lit(head))).first()[0]
    if limit is None:
        chosen, n = glossary, glossary.count()
        dropped = 0
    else:
        packed = pack(glossary, limit, used)
        chosen, n = glossary.where(F.col("entry_id").isin(packed.places) if packed.places else F.lit(False)), len(packed.places)
        dropped = packed.entries - n
    parts = chosen.agg(F.array_sort(F.collect_list(F.struct("entry_id", piece().alias("p")))).alias("x")).select(F.array_join("x.p", "").alias("terms"))
    return docs.join(F.broadcast(parts)).select("doc_id", F.concat(F.lit(head), "terms", F.lit(TRANSCRIPT), "text").alias("prompt"), F.lit(n).alias("terms_included"), F.lit(dropped).alias("terms_dropped"))


def candidate_pattern(candidates: Column) -> Column:
    """A regular expression that matches exactly the given texts; nothing where there are none."""
    quoted = F.transform(candidates, lambda c: F.regexp_replace(c, r"([^\w\s]|\s)", r"\\$1"))
    return F.when(F.size(candidates) > 0, F.concat(F.lit("^(?:"), F.array_join(quoted, "|"), F.lit(")$"))).otherwise(F.lit("(?!)"))


def choose(candidates: Column, scores: Column | None = None) -> Column:
    """The candidate with the highest score, the first of equal ones; without scores the first; null of none."""
    if scores is None:
        return F.get(candidates, F.lit(0))
    return F.get(candidates, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def closest_spans(tokens: DataFrame, terms: DataFrame, most: float = 0.5, longest: int = 6, model: CostModel = DEFAULT) -> DataFrame:
    """doc_id, term, start, end, nd: for each (doc_id, term, reading) the run of up to ``longest`` tokens of that text that
    sounds most like the reading, at most ``most`` away; the first of equal ones. Runs end before marks and white space."""
    ahead = Window.partitionBy("doc_id").orderBy("tok").rowsBetween(0, longest - 1)
    stop = F.col("kind").isin("punct", "space")
    spoken = F.when(F.size("readings") > 0, F.get("readings", F.lit(0))).otherwise(F.col("surface"))
    runs = tokens.select("doc_id", "tok", "start", F.collect_list(F.struct("end", stop.alias("stop"), spoken.alias("r"))).over(ahead).alias("run"))
    first = F.array_position(F.transform("run", lambda t: t["stop"]), True).cast("int")
    upto = F.when(first > 0, first - 1).otherwise(F.size("run"))
    spans = runs.where(upto > 0).select("doc_id", "tok", "start", "run", F.explode(F.sequence(F.lit(1), upto)).alias("n"))
    spans = spans.select("doc_id", "tok", "n", "start", F.get("run", F.col("n") - 1)["end"].alias("end"), F.array_join(F.transform(F.slice("run", F.lit(1), F.col("n")), lambda t: t["r"]), "").alias("spoken"))
    spans = spans.withColumn("ph", sounds.phonemes("spoken", model)).where(F.size("ph") > 0)
    own = terms.select("doc_id", "term", sounds.phonemes("reading", model).alias("t_ph")).where(F.size("t_ph") > 0)
    met = spans.join(own, "doc_id")
    # lengths that differ too much cannot be near
    longer = F.greatest(F.size("ph"), F.size("t_ph"))
    met = met.where(F.abs(F.size("ph") - F.size("t_ph")) * model.least_indel <= most * longer + 1e-9)
    raw = distance_batch.bounded_distance("ph", "t_ph", sounds.indel_costs("ph", model), sounds.indel_costs("t_ph", model), most * longer, model)
    near = met.withColumn("nd", raw / longer).where(F.col("nd") <= most)
    best = near.groupBy("doc_id", "term").agg(F.min_by(F.struct("start", "end", "nd"), F.struct("nd", "tok", "n")).alias("b"))
    return best.select("doc_id", "term", "b.start", "b.end", "b.nd")
