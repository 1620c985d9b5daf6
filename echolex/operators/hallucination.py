"""Canned phrases that speech recognisers make up on silence: found by structural evidence, then removed.

Phrases are sought anywhere in a text by one pass of an automaton, and in whole segments by their sound, once for each distinct
segment. Each place then meets the segment around it by a range join in bins of positions, so a long text's segments spread
over tasks. As a rule a phrase is only removed where it is a whole segment; ``require_segment`` = False lets the evidence alone decide.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from echolex.functions import distance_batch, sounds
from echolex.functions.columns import nullable, offsets
from echolex.functions.cost_model import DEFAULT, CostModel
from echolex.operators import term_automaton
from echolex.operators.groups import in_batches

# The phrases, and those among them that are ordinary speech too.
PHRASES = [
    "ご視聴ありがとうございました",
    "ご視聴ありがとうございます",
    "ご清聴ありがとうございました",
    "最後までご視聴いただきありがとうございました",
    "チャンネル登録お願いします",
    "チャンネル登録よろしくお願いします",
    "高評価とチャンネル登録をお願いします",
    "次回もお楽しみに",
    "また次の動画でお会いしましょう",
    "本日はご覧いただきありがとうございます",
    "字幕視聴ありがとうございました",
    "この動画は自動生成された字幕です",
    "エンディング",
    "おわり",
    "終わり",
    "スタッフのみなさん、ありがとうございました",
    "皆さんこんにちは",
    "はい",
    "うん",
    "ありがとうございました",
]
ORDINARY = ["はい", "うん", "おわり", "終わり", "エンディング", "ありがとうございました", "皆さんこんにちは"]
SEGMENT_ENDS = "。．.\n\r！!？?"
SWALLOWED = "。．.、,！!？? 　"
EDGE = " 　、,・"
DEALS = 32  # tasks that segments with one text go to


@dataclass(frozen=True)
class FilterConfig:
    tau: float = 0.12  # 0: exact matches only
    least_score: float = 1.0
    tail: int = 40
    require_segment: bool = True  # hits are whole segments only
    model: CostModel = DEFAULT


def _strip(x: Column, characters: str = "") -> Column:
    own = f"[{characters}]+" if characters else r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    return F.regexp_replace(x, f"^{own}|{own}$", "")


def _phrases(docs: DataFrame) -> DataFrame:
    rows = [(i, x, x in ORDINARY) for i, x in enumerate(PHRASES)]
    return docs.sparkSession.createDataFrame(rows, "place int, pattern string, ordinary boolean")


def segments(docs: DataFrame, longest: int | None = None) -> DataFrame:
    """doc_id, start, end, segment of every run between sentence ends; where more than ``longest`` characters stay without their edges, the text is null."""
    runs = F.regexp_extract_all("text", F.lit(f"[{SEGMENT_ENDS}]+|[^{SEGMENT_ENDS}]+"), F.lit(0))
    rows = docs.select("doc_id", runs.alias("run")).select("doc_id", "run", offsets(F.transform("run", lambda r: F.length(r))).alias("start"))
    rows = rows.select("doc_id", F.inline(F.arrays_zip("run", "start"))).where(~F.rlike("run", F.lit(f"^[{SEGMENT_ENDS}]")))
    rows = rows.withColumn("end", F.col("start") + F.length("run"))
    segment = F.col("run") if longest is None else F.when(F.length(_strip(_strip(F.col("run")), EDGE)) <= longest, F.col("run"))
    return rows.select("doc_id", "start", "end", segment.alias("segment"))


def occurrences(docs: DataFrame, segments_: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """doc_id, start, end, matched, place, pattern, ordinary: where a phrase stands, or a whole segment sounds like one that
    does not stand in it."""
    phrases = _phrases(docs)
    found = term_automaton.places(docs, phrases.withColumn("term", F.col("pattern")), "text", ["doc_id"], ["place", "pattern", "ordinary"])
    found = found.select("doc_id", "start", "end", F.col("pattern").alias("matched"), "place", "pattern", "ordinary")
    if config.tau <= 0:
        return found
    short = segments_.where(F.col("segment").isNotNull()).withColumn("matched", _strip(F.col("segment")))
    heard = short.select("matched").where("matched <> ''").distinct()
    heard = heard.withColumn("ph", sounds.phonemes("matched", config.model)).where(F.size("ph") > 0).withColumn("c", sounds.indel_costs("ph", config.model))
    said = phrases.withColumn("p_ph", sounds.phonemes("pattern", config.model)).where(F.size("p_ph") > 0).withColumn("p_c", sounds.indel_costs("p_ph", config.model))
    ratio = F.length("matched") / F.length("pattern")
    near = heard.join(F.broadcast(said), ratio.between(0.6, 1.6))  # twenty rows
    nd = distance_batch.phonetic_distance("ph", "p_ph", "c", "p_c", config.model) / F.greatest(F.lit(1), F.size("ph"), F.size("p_ph"))
    near = near.where(nd <= config.tau).select("matched", "place", "pattern", "ordinary")
    # a text that very many segments have is dealt over several tasks
    near = near.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    dealt = short.withColumn("_deal", F.pmod(F.xxhash64("doc_id", "start"), F.lit(DEALS)).cast("int"))
    own = dealt.join(near, ["matched", "_deal"]).where(~F.contains("segment", "pattern"))
    start = (F.col("start") + F.position("matched", "segment") - 1).cast("int")
    return found.union(own.select("doc_id", start.alias("start"), (start + F.length("matched")).alias("end"), "matched", "place", "pattern", "ordinary"))


BIN = 1024  # characters


def containing(found: DataFrame, segments_: DataFrame) -> DataFrame:
    """``found`` (doc_id, start, end, ...) with the ``segment`` that holds all of it, else null (as of segments whose text is
    null). A range join: both meet in the bins of positions where the place begins, of which a segment has as many as it is long."""
    bin_of = lambda c: F.floor(F.col(c) / BIN)
    bins = F.explode(F.sequence(bin_of("s_start"), bin_of("s_end"))).alias("_bin")
    around = segments_.select("doc_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"), "segment").select("*", bins)
    inside = (F.col("s_start") <= F.col("start")) & (F.col("end") <= F.col("s_end"))
    met = found.withColumn("_bin", bin_of("start")).alias("f").join(around.alias("s"), (F.col("f.doc_id") == F.col("s.doc_id")) & (F.col("f._bin") == F.col("s._bin")) & inside, "left")
    return met.select(*(F.col(f"f.{c}").alias(c) for c in found.columns), "segment")


_HIT = "start int, end int, text string, pattern string, evidence array<string>, score double"


def apart(hits: DataFrame) -> DataFrame:
    """Of overlapping hits of a text (doc_id, start, end, text, pattern, evidence, score, place) the best stays: by score, then
    length, then start; those left are held against each one taken before."""

    def run(table: pa.Table, begin: np.ndarray) -> pa.Table:
        start, end, score, place = (table.column(c).to_numpy() for c in ("start", "end", "score", "place"))
        size = np.diff(np.append(begin, len(start)))
        group = np.repeat(np.arange(len(begin)), size)
        order = np.lexsort((place, start, start - end, -score, group))
        lone = size[group[order]] == 1
        taken = order[lone].tolist()
        now, starts, ends = -1, [], []  # of those taken in a text, in order, which are apart
        rest = order[~lone]
        for i, g, a, b in zip(rest.tolist(), group[rest].tolist(), start[rest].tolist(), end[rest].tolist(), strict=True):
            if g != now:
                now, starts, ends = g, [], []
            at = bisect_right(starts, a)
            free = (at == 0 or ends[at - 1] <= a) and (at == len(starts) or b <= starts[at])
            if free:
                starts.insert(at, a)
                ends.insert(at, b)
                taken.append(i)
        return nullable(table.take(pa.array(taken, pa.int64())).select(["doc_id", *(f.name for f in hit)]))

    hit = StructType.fromDDL(_HIT)
    return in_batches(hits, "doc_id", run, f"doc_id {hits.schema['doc_id'].dataType.simpleString()}, {_HIT}")


def find(docs: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """Hits in texts (doc_id unique, text): doc_id, start, end, text, pattern, evidence, score. Of overlapping hits the best
    stays: by score, then length, then start. Null and blank texts have none."""
    docs = docs.select("doc_id", "text")
    longest = int(1.6 * max(map(len, PHRASES)))
    around = segments(docs, longest)
    met = containing(occurrences(docs, around, config), around)
    # a segment whose text does not travel is longer than any phrase with its edges
    whole = F.coalesce(_strip(F.col("segment"), EDGE) == _strip(F.col("matched"), EDGE), F.lit(False))
    met = met.withColumn("whole", whole).drop("segment")
    if config.require_segment:
        met = met.where("whole")
    met = met.join(docs.withColumnRenamed("text", "_all"), "doc_id")
    repeated = F.length(F.replace("_all", "pattern", F.lit(""))) + 2 * F.length("pattern") <= F.length("_all")
    tail, entire = F.length("_all") - F.col("end") <= config.tail, _strip(F.col("matched")) == _strip(F.col("_all"))
    points = [("whole-segment", F.col("whole"), 1.0), ("repeated", repeated, 1.0), ("transcript-tail", tail, 0.5), ("entire-transcript", entire, 1.5)]
    evidence = F.array_compact(F.array(*(F.when(c, name) for name, c, _ in points)))
    score = sum((F.when(c, v).otherwise(0.0) for _, c, v in points), F.lit(0.0)) - F.when(F.col("ordinary"), 0.5).otherwise(0.0)
    scored = met.select("doc_id", "start", "end", F.col("matched").alias("text"), "pattern", evidence.alias("evidence"), score.alias("score"), "place", "ordinary")
    # what is ordinary speech too needs two signs besides standing at the end
    signs = F.size(F.array_remove("evidence", "transcript-tail"))
    scored = scored.where((~F.col("ordinary") | (signs >= 2)) & (F.col("score") >= config.least_score)).drop("ordinary")
    return apart(scored)


def remove(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, text without its hits, each with one mark or space after it; the rest is stripped. Texts without hits stay as they are."""
    spans = hits.groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("start", "end")))).alias("spans"))

    def without(text: Column, s: Column) -> Column:
        after = F.substring(text, s["end"] + 1, F.length(text))
        swallow = F.when((after != "") & F.contains(F.lit(SWALLOWED), F.substring(after, 1, 1)), F.substring(after, F.lit(2), F.length(after))).otherwise(after)
        return F.concat(F.substring(text, F.lit(1), s["start"]), swallow)

    joined = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(_strip(F.aggregate("spans", F.col("text"), without))).alias("text"))
