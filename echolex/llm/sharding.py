"""Sharding by k-d tree partitioning, on DataFrame functions only. The law is ``bytes``: shards are near equal in size.

The tree splits the corpus recursively: a node that is to hold some shards is cut at the weighted quantile of its bytes that
is the first half of the shards' part (the weighted median for an even number), along its widest metadata dimension, until
leaves hold one shard's target bytes. Dimensions are the size, the language and the source of a document, each scaled to
the corpus's spread (names by their hash). Quantiles of all nodes of a level are found together by histograms of bytes that
are refined, sums that are pre-aggregated before they are shuffled; only bounds of at most ``shards`` nodes come to the driver.

Groups: rows with equal text are a group, placed as one. Groups above ``large`` of a shard's target are at most
shards / large (a bounded list for the driver): largest first, each goes whole to the shard with the most room, and the tree
then fills the room that is left. So a group is split only where no shard has room for all of it, as with one that is larger
than a shard; its rows are dealt by a hash of doc_id into units of ``large`` of a shard, which the tree places. Smaller groups
stay together by their place in the tree (that of the group's smallest doc_id); units that agree in a dimension are put in
order by a hash. Large groups meet their rows by a broadcast of that bounded list, so no hot text is a join key.

Defined cases: null text has 0 bytes and crc32 of the empty text; null lang and source are the empty name; rows that
repeat a doc_id are rows of their own; a row larger than a shard's target has a shard that is larger too; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolex.llm.scratch import cut

DIMENSIONS = ("size", "lang", "source")


@dataclass(frozen=True)
class ShardConfig:
    shards: int = 40
    large: float = 1 / 16  # of a shard's target: the bytes from which a group is placed by itself
    bins: int = 4096
    refinements: int = 3
    block_rows: int = 512


@dataclass
class _Node:
    first: int  # shards first .. first + count - 1
    count: int
    dimension: str = ""
    at: float = 0.0
    left: "_Node | None" = None
    right: "_Node | None" = None


def _unit_interval(x: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return F.pmod(x, F.lit(1 << 40)).cast("double") / float(1 << 40)


def _leaf(node: _Node, value) -> Column:
    """The tree as an expression: ``value`` of the node that a row falls into."""
    if node.left is None:
        return F.lit(value(node))
    return F.when(F.col(node.dimension) < F.lit(node.at), _leaf(node.left, value)).otherwise(_leaf(node.right, value))


def place_large(groups: list[tuple[int, int]], target: float, shards: int) -> tuple[list[int | None], list[float]]:
    """For groups (bytes, rows), largest first: the shard that takes each whole, or None where it is to be split; and the room left.

    The shard with the most room takes a group if it has room for it; a single row, which cannot be split, in any case."""
    room = [(-target, s) for s in range(shards)]
    out: list[int | None] = []
    for size, rows in groups:
        left, s = room[0]
        fits = size <= -left + 1e-6 or rows == 1
        if fits:
            heapq.heapreplace(room, (left + size, s))
        out.append(s if fits else None)
    by_shard = {s: max(0.0, -left) for left, s in room}
    return out, [by_shard[s] for s in range(shards)]


def _quantiles(units: DataFrame, wanted: dict[int, tuple[str, float, float, float]], config: ShardConfig) -> dict[int, float]:
    """For each node (its number: dimension, part of bytes, low, high): where the bytes below reach the part."""
    if not wanted:
        return {}
    bounds = {n: (low, high) for n, (_, _, low, high) in wanted.items()}
    of = lambda values: F.element_at(F.create_map(*[x for n, v in values.items() for x in (F.lit(n), F.lit(v))]), F.col("node"))
    dimension = of({n: DIMENSIONS.index(w[0]) for n, w in wanted.items()})
    value = F.coalesce(*(F.when(F.col("dimension") == i, F.col(d)) for i, d in enumerate(DIMENSIONS)))
    valued = units.where(F.col("node").isin(list(wanted))).withColumn("dimension", dimension).select("node", value.alias("value"), "weight")
    for _ in range(config.refinements):
        low, width = of({n: b[0] for n, b in bounds.items()}), of({n: max((b[1] - b[0]) / config.bins, 1e-300) for n, b in bounds.items()})
        at = F.greatest(F.lit(-1.0), F.least(F.floor((F.col("value") - F.col("low")) / F.col("width")).cast("double"), F.lit(float(config.bins))))
        got = valued.withColumn("low", low).withColumn("width", width).select("node", at.cast("int").alias("bin"), "weight").groupBy("node", "bin").agg(F.sum("weight").alias("weight"))
        # running sums over the bins: at most shards * bins rows; a row a node comes back
        w = Window.partitionBy("node")
        upto = got.select("node", "bin", F.sum("weight").over(w.orderBy("bin")).alias("upto"), F.sum("weight").over(w).alias("total"))
        steps = upto.where(F.col("upto") >= F.col("total") * of({n: w[1] for n, w in wanted.items()}))
        for r in steps.groupBy("node").agg(F.min("bin").alias("bin")).collect():
            low, high = bounds[r["node"]]
            step, at = (high - low) / config.bins, min(max(r["bin"], 0), config.bins - 1)
            bounds[r["node"]] = (low + at * step, low + (at + 1) * step)
    return {n: b[1] for n, b in bounds.items()}


def tree(units: DataFrame, room: list[float], config: ShardConfig = ShardConfig()) -> _Node:
    """The tree of units (size, lang, source: doubles; weight: bytes) that fills shards in proportion to their ``room``."""
    root = _Node(0, config.shards)
    spread = units.agg(*(F.struct(F.min(d).alias("low"), F.max(d).alias("high")).alias(d) for d in DIMENSIONS)).first()
    scale = {d: max((spread[d]["high"] or 0) - (spread[d]["low"] or 0), 1e-12) for d in DIMENSIONS}
    level = [root] if spread["size"]["low"] is not None else []
    while level := [n for n in level if n.count > 1]:
        here = units.withColumn("node", _leaf(root, lambda n: n.first))
        own = {n.first: n for n in level}
        got = here.where(F.col("node").isin(list(own))).groupBy("node").agg(*(F.struct(F.min(d).alias("low"), F.max(d).alias("high")).alias(d) for d in DIMENSIONS)).collect()
        wanted, found = {}, {}
        for r in got:
            n = own[r["node"]]
            n.dimension = max(DIMENSIONS, key=lambda d: (r[d]["high"] - r[d]["low"]) / scale[d])
            low, high = r[n.dimension]["low"], r[n.dimension]["high"]
            first, both = (sum(room[n.first : n.first + c]) for c in (n.count // 2, n.count))
            if 0 < first < both:
                wanted[n.first] = (n.dimension, first / both, low, high)
            else:  # one side is full: all goes to the other
                found[n.first] = float("-inf") if first <= 0 else float("inf")
        found |= _quantiles(here, wanted, config)
        after = []
        for first, at in found.items():
            n = own[first]
            half = n.count // 2
            n.at, n.left, n.right = at, _Node(n.first, half), _Node(n.first + half, n.count - half)
            after += [n.left, n.right]
        level = after
    return root


def shard(docs: DataFrame, config: ShardConfig = ShardConfig()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("bytes"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")
    )
    rows = cut(rows, "rows")
    key = ["text_hash", "text_crc32", "bytes"]
    groups = rows.groupBy(*key).agg(F.min(F.struct("doc_id", "lang", "source")).alias("of"), F.sum("bytes").alias("group_bytes"), F.count("*").alias("group_rows"))
    groups = cut(groups.select(*key, F.col("of.lang").alias("g_lang"), F.col("of.source").alias("g_source"), "group_bytes", "group_rows"), "groups")
    target = float(groups.agg(F.sum("group_bytes")).first()[0] or 0) / config.shards
    # at most shards / large groups have so many bytes
    large = groups.where(F.col("group_bytes") > target * config.large)
    found = large.orderBy(F.desc("group_bytes"), *key).collect()
    homes, room = place_large([(r["group_bytes"], r["group_rows"]) for r in found], target, config.shards)
    parts = [max(1, math.ceil(r["group_bytes"] / max(1.0, target * config.large))) for r in found]
    listed = [(*(r[c] for c in key), r["g_lang"], r["g_source"], home, n) for r, home, n in zip(found, homes, parts, strict=True)]
    listed = F.broadcast(spark.createDataFrame(listed, "text_hash long, text_crc32 long, bytes long, l_lang string, l_source string, home int, parts int"))
    marked = rows.join(listed, key, "left")
    columns = ["doc_id", "bytes", "text_crc32", "text_hash", "home", "parts"]
    alone = marked.where("parts is not null").select(*columns, F.col("l_lang").alias("lang"), F.col("l_source").alias("source"))
    # the other groups are small, so no key is hot
    small = marked.where("parts is null").join(groups.where(F.col("group_bytes") <= target * config.large), key).select(*columns, F.col("g_lang").alias("lang"), F.col("g_source").alias("source"))
    placed = small.union(alone).withColumn("unit", F.xxhash64("text_hash", F.when(F.col("home").isNull(), F.pmod(F.xxhash64("doc_id", F.lit("unit")), F.coalesce("parts", F.lit(1))))))
    # a unit's hash breaks ties: below one byte, or between one name's hash and the next
    tie = _unit_interval(F.col("unit"))
    name = lambda c: _unit_interval(F.xxhash64(c)) + tie * 1e-6
    placed = placed.select("doc_id", "bytes", "text_crc32", "unit", "home", (F.log2("bytes") + tie * 1e-5).alias("size"), name("lang").alias("lang"), name("source").alias("source"))
    placed = cut(placed, "placed")
    units = cut(placed.where("home is null").groupBy("unit", "size", "lang", "source").agg(F.sum("bytes").alias("weight")), "units")
    root = tree(units, room, config)
    own = F.coalesce("home", _leaf(root, lambda n: n.first)).cast("int")
    out = placed.select("doc_id", F.col("bytes").alias("size"), "text_crc32", "unit", own.alias("shard"))
    return _with_slots(out, config).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _with_slots(rows: DataFrame, config: ShardConfig) -> DataFrame:
    """Numbers each shard's rows from 0 without gaps: places of hashed blocks, then places inside a block."""
    n = rows.count()
    blocks = max(1, n // (config.shards * config.block_rows))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("unit", "doc_id"), F.lit(blocks)))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("unit", "doc_id"))
    return rows.withColumn("_i", inside).join(starts, ["shard", "block"]).withColumn("slot", (F.col("start") + F.col("_i") - 1).cast("long"))
