"""Temperature mixing of sources, on DataFrame functions only.

A source's weight is its token share to the power ``alpha``, normalised: 1 keeps the shares, 0 makes sources equal.
``alpha`` is bisected to the largest value whose weights still reach a target entropy (as a part of the logarithm of
the number of sources), or the smallest at which no source is repeated more often than a limit. Each source then has
a budget of tokens, its weight times the total.

A source is realised as a budgeted permutation of blocks: rows are dealt by a seeded hash into blocks of about
``block_rows`` rows, blocks are put in order by a seeded hash, and rows within a block too. Whole passes over the
source fill the budget as often as they fit; of one more pass, in that order, rows are taken as long as their tokens fit. Running sums
go over spans of blocks, blocks in a span and rows in a block, so no task holds a source or its blocks, however large.

Tokens are estimated as UTF-8 bytes / 4, rounded up (``tokens``: an expression over the input's columns).

Defined cases: null sources are one source of their own; null or empty text has 0 tokens and is in every whole pass,
and in the extra pass up to where the budget ends; sources without tokens keep their rows once; repeated rows
agreeing in id, source and text are taken together; an empty table gives no rows. All columns of the input are kept; added names do not clash with them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolex.llm.scratch import cut


@dataclass(frozen=True)
class MixConfig:
    entropy: float | None = 0.97  # of the weights, as a part of the largest possible
    most_epochs: float | None = None  # instead: no source's budget is over so many times its tokens
    budget: float = 1.0  # total, as a part of all tokens
    block_rows: int = 512
    seed: str = "mix"
    steps: int = 40  # of bisection


def tokens() -> Column:
    return F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4).cast("long")


def _hash(*parts: Column | str) -> Column:
    """60 bits of md5, as SQL elsewhere can compute it too."""
    text = F.concat_ws("|", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_weights(sizes: DataFrame, config: MixConfig) -> DataFrame:
    """source, tokens, weight, budget of a table (source, tokens, ...) of one row a source; alpha by bisection.

    Each job evaluates the 15 midpoints that four steps of bisection can meet, as sums over sources; the driver gets
    these sums only."""
    some = sizes.where("tokens > 0")
    n, total = some.agg(F.count("*"), F.sum("tokens")).first()
    if not n:
        return sizes.select("source", "tokens", "rows", F.lit(0.0).alias("weight"), F.lit(0.0).alias("budget"))
    share = F.col("tokens") / F.lit(float(total))

    def fits(alphas: list[float]) -> list[bool]:
        sums = []
        for a in alphas:
            q = F.pow(share, F.lit(a))
            sums += [F.sum(q), F.sum(q * F.log(q)), F.max(q / share)]
        got = some.agg(*(x.alias(f"s{i}") for i, x in enumerate(sums))).first()
        out = []
        for i in range(len(alphas)):
            z, qlogq, most = got[3 * i : 3 * i + 3]
            if config.most_epochs is not None:
                out.append(most / z * config.budget <= config.most_epochs)
            else:
                out.append(n == 1 or math.log(z) - qlogq / z >= config.entropy * math.log(n))
        return out

    # repetition falls as alpha grows; entropy falls too
    low, high = 0.0, 1.0
    limit = config.most_epochs is not None
    if limit and fits([0.0])[0]:
        alpha = 0.0
    elif not limit and fits([1.0])[0]:
        alpha = 1.0
    else:
        for _ in range(-(-config.steps // 4)):
            ends = [low + (high - low) * i / 16 for i in range(1, 16)]
            good = fits(ends)
            lo, hi = 0, 16
            while hi - lo > 1:
                mid = (lo + hi) // 2
                if good[mid - 1] != limit:
                    lo = mid
                else:
                    hi = mid
            low, high = low + (high - low) * lo / 16, low + (high - low) * hi / 16
        alpha = high if limit else low
    z = some.agg(F.sum(F.pow(share, F.lit(alpha)))).first()[0]
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(alpha)) / F.lit(z)).otherwise(0.0)
    return sizes.select("source", "tokens", "rows", weight.alias("weight"), (weight * F.lit(config.budget * total)).alias("budget"))


def plan(docs: DataFrame, config: MixConfig = MixConfig(), size: Column | None = None) -> DataFrame:
    """doc_id, source, digest, rows, n_tokens, weight, block, place, copies of every unit: the rows that agree in id,
    source and text, which are taken together. ``n_tokens`` is a row's, ``place`` that of its first row in its source's
    permutation (from 0, without gaps), ``copies`` how often each row is taken."""
    small = docs.select("doc_id", "source", (tokens() if size is None else size).alias("n_tokens"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    units = small.groupBy("doc_id", "source", "digest").agg(F.count("*").alias("rows"), F.max("n_tokens").alias("n_tokens"))
    return _planned(cut(units, "units"), config)


def _planned(units: DataFrame, config: MixConfig) -> DataFrame:
    whole = F.col("n_tokens") * F.col("rows")
    sizes = cut(units.groupBy("source").agg(F.sum(whole).alias("tokens"), F.count("*").alias("rows")), "sources")
    weights = cut(source_weights(sizes, config), "weights")
    w = weights.select(F.col("source").alias("_s"), "tokens", F.col("rows").alias("_units"), "weight", "budget")
    # one row a source: AQE broadcasts it only where it is measured to be small, else splits the hot source's rows
    rows = units.join(w, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    seed = F.lit(config.seed)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_units") / config.block_rows))
    rows = rows.withColumn("_h", _hash(seed, "doc_id", "digest")).withColumn("block", F.pmod("_h", blocks))
    rows = rows.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + 1e-9)).otherwise(1))
    rows = cut(rows.withColumn("_rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("epochs") * F.col("tokens") + 1e-6).otherwise(0.0)), "blocks")
    sums = rows.groupBy("source", "block").agg(F.sum(whole).alias("_t"), F.sum("rows").alias("_n")).withColumn("_o", _hash(seed, F.lit("block"), "source", "block"))
    # in two levels, so that no task holds all blocks of a source: blocks come in order of a 60-bit hash, whose first
    # twelve bits are a span of blocks
    spans = cut(sums.withColumn("_span", F.shiftright("_o", 48)), "sums")
    upto, before = Window.unboundedPreceding, -1
    inside = Window.partitionBy("source", "_span").orderBy("_o", "block").rowsBetween(upto, before)
    earlier = Window.partitionBy("source").orderBy("_span").rowsBetween(upto, before)  # at most 4096 rows
    heads = spans.groupBy("source", "_span").agg(F.sum("_t").alias("_t"), F.sum("_n").alias("_n"))
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    heads = heads.select(F.col("source").alias("_hs"), F.col("_span").alias("_hp"), zero("_t", earlier).alias("_ht"), zero("_n", earlier).alias("_hn"))
    starts = spans.select("source", "block", "_span", zero("_t", inside).alias("_it"), zero("_n", inside).alias("_in"))
    starts = starts.join(heads, F.col("source").eqNullSafe(F.col("_hs")) & (F.col("_span") == F.col("_hp")))
    starts = starts.select(F.col("source").alias("_s"), F.col("block").alias("_b"), (F.col("_ht") + F.col("_it")).alias("_start"), (F.col("_hn") + F.col("_in")).alias("_first"))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).drop("_s", "_b")
    own = Window.partitionBy("source", "block").orderBy("_h", "doc_id", "digest")
    extra = ((F.col("tokens") > 0) & (F.col("_start") + F.sum(whole).over(own.rowsBetween(upto, 0)) <= F.col("_rest"))).cast("long")
    place = F.col("_first") + zero("rows", own.rowsBetween(upto, before))
    return rows.select("doc_id", "source", "digest", "rows", "n_tokens", "weight", "block", place.cast("long").alias("place"), (F.col("epochs") + extra).alias("copies"))


def mix(docs: DataFrame, config: MixConfig = MixConfig(), order: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its source's budget takes it.

    ``order`` names a column to add: a row's place in its source's stream (pass after pass, each in the order of the
    permutation; from 0, without gaps up to the last whole pass), to sort or to deal batches by."""
    names = docs.columns
    d = docs.toDF(*[f"c{i}" for i in range(len(names))])
    of = {c: F.col(f"c{names.index(c)}") for c in ("doc_id", "source", "text")}
    planned = plan(docs, config).where("copies > 0")
    if order is None:
        planned = planned.select("doc_id", "source", "digest", "copies")
    else:
        totals = planned.groupBy("source").agg(F.sum("rows").alias("_all"))  # a row a source
        planned = planned.join(totals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "digest", "copies", "place", "rows", "_all")
    same = of["doc_id"].eqNullSafe(F.col("doc_id")) & of["source"].eqNullSafe(F.col("source")) & (F.md5(F.coalesce(of["text"], F.lit(""))) == F.col("digest"))
    copies = F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("_copy")
    if order is None:
        return d.join(planned, same).select(*d.columns, copies).drop("_copy").toDF(*names)
    # rows that agree in id, source and text stand one after another
    among = F.row_number().over(Window.partitionBy(of["doc_id"], of["source"], "digest").orderBy(*d.columns)) - 1
    met = d.join(planned, same).withColumn("_among", among).select(*d.columns, "place", "_among", "_all", copies)
    return met.select(*d.columns, (F.col("_copy") * F.col("_all") + F.col("place") + F.col("_among")).cast("long").alias("_order")).toDF(*names, order)
