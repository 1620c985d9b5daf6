"""MinHash near-dedup with HyperMinHash registers.

Every document's set of word shingles is hashed once. The lowest bits of a hash choose a register; a register keeps the
smallest hash that fell into it, compressed to its count of leading zeros (6 bits) and the mantissa bits after them (10
bits). Bands of ``rows`` compressed registers are the candidate keys; a band whose registers are all empty is no key.
Candidates pass an estimate of Jaccard similarity from equal registers, corrected for chance collisions, with a margin
of more than five standard errors; the rest are confirmed on full shingle sets made anew from whole texts.

Sizes: a pair at the threshold shares no band with a chance of (1 - s**rows)**bands, 3e-6 for 0.85 with 40 bands of 8
and 8e-6 for 0.8 with 64 bands of 8. Sets are compared by 64-bit hashes of their shingles.

Groups: equal sets are one class before banding. In a band's bucket, documents in order are first linked to their
neighbour only (rows are dealt by ranges of bucket and document, so hot buckets are split). Members that are then still
outside their bucket's largest component are compared against all members of other components: within a task in small
buckets, block against block in large ones. So no link between components is lost, no pairs are made inside one, and
only pairs that pass the estimate become rows.

Defined cases: null or wordless text has an empty set and links with nothing; with fewer than ``k`` words the whole
sequence is the one shingle; rows with a null doc_id link with nothing (component_id null, kept true); rows that repeat
a doc_id are one node; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolex.llm import kernels as K
from echolex.llm.components import connected_components, neighbours_in_order
from echolex.llm.scratch import arrow_rows, cut

EMPTY = np.uint16(0xFFFF)
BLOCK_FROM = 64  # members of a bucket from which blocks are compared
BLOCK = 640
MANTISSA = 10
BAND_ROWS = 2_000_000  # in a task


@dataclass(frozen=True)
class MinHashConfig:
    k: int = 5
    threshold: Fraction = Fraction(4, 5)
    rows: int = 8
    bands: int = 64
    make: Callable[[np.ndarray, int], np.ndarray] | None = None  # registers of a sorted set; None: HyperMinHash
    partitions: int | None = None  # of the band rows; None: by their number (``BAND_ROWS`` each), at least twice the session's shuffle partitions

    @property
    def registers(self) -> int:
        return self.rows * self.bands


def registers(unique: np.ndarray, m: int) -> np.ndarray:
    """HyperMinHash registers of a sorted set of 64-bit hashes."""
    out = np.full(m, EMPTY, np.uint16)
    if len(unique):
        at = (unique % np.uint64(m)).astype(np.int64)[::-1]
        least = np.zeros(m, np.uint64)
        filled = np.zeros(m, bool)
        least[at], filled[at] = unique[::-1], True  # the smallest is written last
        value = (least[filled] >> np.uint64(11)).astype(np.float64)  # 53 bits: exact
        part, exponent = np.frexp(value)
        zeros = np.where(value > 0, 53 - exponent, 60)
        mantissa = np.where(value > 0, (part * 2 - 1) * (1 << MANTISSA), 0)
        out[filled] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    return out


@functools.cache
def _donors(m: int) -> np.ndarray:
    """For each register a fixed random order of all registers, in which it looks for one to borrow from."""
    return np.random.default_rng(m).permuted(np.broadcast_to(np.arange(m, dtype=np.int32), (m, m)), axis=1)


def densified(regs: np.ndarray) -> np.ndarray:
    """Registers with empty ones borrowed from the first filled one in their own fixed order (optimal densification,
    Shrivastava, 2017), so that bands of short texts agree with the chance s**rows too. Rows without any stay empty."""
    out, order = regs.copy(), _donors(regs.shape[1])
    filled = regs != EMPTY
    row, at = np.nonzero(~filled & filled.any(1)[:, None])
    for step in range(regs.shape[1]):
        if not len(row):
            break
        donor = order[at, step]
        hit = filled[row, donor]
        out[row[hit], at[hit]] = regs[row[hit], donor[hit]]
        row, at = row[~hit], at[~hit]
    return out


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band, (documents, bands), and a mask: documents without any register have no bands."""
    n, m = regs.shape
    parts = densified(regs).reshape(n, m // rows, rows)
    key = np.broadcast_to(np.arange(m // rows, dtype=np.uint64) + np.uint64(1), (n, m // rows)).copy()
    for j in range(rows):
        key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64), (parts != EMPTY).any(2)


def estimate(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs (rows) of registers: the share of equal ones among those filled in either, less
    the share that would be equal by chance. Two different minima agree in leading zeros and mantissa with a chance
    of about 2**-(MANTISSA + 1) whatever the sizes, as long as the minima use fewer than 53 bits."""
    filled = (a != EMPTY) | (b != EMPTY)
    share = ((a == b) & filled).sum(1) / np.maximum(filled.sum(1), 1)
    chance = np.where(sizes > 0, 2.0 ** -(MANTISSA + 1), 0)
    return np.clip((share - chance) / (1 - chance), 0, 1)


def _possible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, config: MinHashConfig) -> np.ndarray:
    """Whether pairs of registers, of sets with ``na`` and ``nb`` shingles, may reach similarity ``s``: within five
    standard errors of the estimate. HyperMinHash registers are drawn from the union without replacement."""
    s = float(config.threshold)
    filled = np.maximum(((a != EMPTY) | (b != EMPTY)).sum(1), 1)
    union = np.maximum((na + nb) / (1 + s), filled)
    error = np.sqrt(s * (1 - s) / filled * (np.maximum(1 - filled / union, 0.02) if config.make is None else 1))
    sizes = np.minimum(na, nb) >= np.maximum(na, nb) * (s - 1e-9)
    return sizes & ((estimate(a, b, np.minimum(na, nb)) >= s - 5 * error - 2 / filled) | (filled < 24))


def sketch(docs: DataFrame, config: MinHashConfig) -> DataFrame:
    """doc_id, n_shingles, set_key (null if empty), regs (the first registers), bands (keys) of every row."""
    arrow_rows(docs.sparkSession)
    m, make = config.registers, config.make or registers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, regs = [], [], []
            for own in K.shingle_sets(K.as_bytes(batch.column("text")), config.k):
                sizes.append(len(own))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                regs.append(make(own, m))
            regs = np.stack(regs) if regs else np.zeros((0, m), np.uint16)
            band, filled = band_keys(regs, config.rows)
            places = np.concatenate([[0], np.cumsum(filled.sum(1))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(places), pa.array(band[filled]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in regs], pa.binary()), bands], ["doc_id", "n_shingles", "set_key", "regs", "bands"])

    schema = T.StructType([docs.schema["doc_id"]]).add("n_shingles", "long").add("set_key", "binary").add("regs", "binary").add("bands", T.ArrayType(T.LongType()))
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _estimated(pairs: DataFrame, sketches: DataFrame, config: MinHashConfig) -> DataFrame:
    """Pairs (u, v) whose sizes and registers allow the threshold."""
    s, m = float(config.threshold), config.registers
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    joined = pairs.join(side("u"), "u").where("nu > 0").join(side("v"), "v").where(F.least("nu", "nv") >= F.greatest("nu", "nv") * (s - 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, m) for c in ("ru", "rv"))
                good = _possible(a, b, batch.column("nu").to_numpy(), batch.column("nv").to_numpy(), config)
                yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(good)), batch.column("v").filter(pa.array(good))], ["u", "v"])

    return joined.select("u", "v", "nu", "nv", "ru", "rv").mapInArrow(run, "u long, v long")


def _confirmed(pairs: DataFrame, docs: DataFrame, config: MinHashConfig) -> DataFrame:
    """Pairs (u, v) whose full sets reach the threshold exactly."""
    k, up, down = config.k, config.threshold.numerator, config.threshold.denominator
    side = lambda x: docs.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(*(K.shingle_sets(K.as_bytes(batch.column(c)), k) for c in ("tu", "tv")), strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(len(a) > 0 and down * both >= up * (len(a) + len(b) - both))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(good), batch.column("v").filter(good)], ["u", "v"])

    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def _mixed(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members of buckets with more than one component: key, node, component, n (of the bucket), most (its largest)."""
    of = members.join(components.withColumnsRenamed({"node": "_n"}), F.col("node") == F.col("_n"), "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    counts = of.groupBy("key", "component").agg(F.count("*").alias("n"))
    buckets = counts.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("component", F.struct("n", "component")).alias("most"), F.count("*").alias("_c")).where("_c > 1").drop("_c")
    return of.join(buckets, "key")


def _across(mixed: DataFrame, sketches: DataFrame, config: MinHashConfig) -> DataFrame:
    """Pairs (u, v) of one small bucket in different components whose sizes and registers allow the threshold.

    A bucket's members lie together in one task, each with its registers once; its pairs are met there, a distance in
    the order at a time, and only those that pass become rows. So rows grow with members and not with their pairs.
    """
    small = mixed.where(F.col("n") <= BLOCK_FROM).select("key", "node", "component")
    dealt = small.join(sketches.select("node", "n_shingles", "regs"), "node").repartition("key").sortWithinPartitions("key")
    m = config.registers

    def met(key: np.ndarray, node: np.ndarray, comp: np.ndarray, n: np.ndarray, regs: np.ndarray) -> pa.RecordBatch:
        found = [np.zeros((2, 0), np.int64)]
        for d in range(1, len(key)):
            i = np.flatnonzero(key[d:] == key[:-d])
            if not len(i):
                break
            i = i[comp[i] != comp[i + d]]
            i = i[_possible(regs[i], regs[i + d], n[i], n[i + d], config)]
            found.append(np.sort([node[i], node[i + d]], axis=0))
        u, v = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams: holds back the last bucket's rows, at most BLOCK_FROM, because more of them may follow."""
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                own = [batch.column(c).to_numpy() for c in ("key", "node", "component", "n_shingles")]
                own.append(np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, m))
                own = [np.concatenate(x) for x in zip(held, own, strict=True)] if held else own
                last = int(np.searchsorted(own[0], own[0][-1]))
                held = [x[last:] for x in own]
                yield met(*(x[:last] for x in own))
        if held:
            yield met(*held)

    return dealt.select("key", "node", "component", "n_shingles", "regs").mapInArrow(run, "u long, v long").distinct()


def _across_blocks(mixed: DataFrame, docs: DataFrame, config: MinHashConfig) -> DataFrame:
    """Links (u, v) of one large bucket between different components, found block against block.

    Members outside the bucket's largest component, in blocks, meet all members, in blocks. A task holds two blocks of
    about BLOCK texts; it estimates from registers, confirms on full sets, and gives links that join components only.
    """
    large = mixed.where(F.col("n") > BLOCK_FROM)
    sizes = large.groupBy("key").agg(F.count_if(F.expr("component <> most")).alias("o"), F.count("*").alias("all"))
    sizes = sizes.select("key", F.ceil(F.col("o") / BLOCK).alias("bo"), F.ceil((F.col("all") - F.col("o")) / BLOCK).alias("bd"))
    dealt = large.join(sizes, "key").select("key", "node", "component", "bo", "bd", F.expr("case when component <> most then pmod(xxhash64(node), bo) else bo + pmod(xxhash64(node), bd) end").alias("b"))
    other = F.explode(F.expr("case when b < bo then sequence(0L, bo + bd - 1) else sequence(0L, bo - 1) end")).alias("x")
    dealt = dealt.select("key", "node", "component", "b", other).select("key", "node", "component", "b", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"))
    k, up, down, m = config.k, config.threshold.numerator, config.threshold.denominator, config.registers
    make = config.make or registers

    def run(table: pa.Table) -> pa.Table:
        node, comp, block = (table.column(c).to_numpy() for c in ("node", "component", "b"))
        left = block == block.min()
        right = ~left if (~left).any() else left
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        sets = list(K.shingle_sets(K.as_bytes(table.column("text")), k))
        n = np.array([len(x) for x in sets])
        regs = np.stack([make(x, m) for x in sets])
        likely = np.zeros((len(a), len(b)), bool)
        for row, i in enumerate(a):
            pair = np.broadcast_to(regs[i], (len(b), m)), regs[b]
            likely[row] = (comp[b] != comp[i]) & _possible(*pair, np.full(len(b), n[i]), n[b], config)
        found: list[tuple[int, int]] = []
        if likely.any():
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
            ids, at = np.unique(flat, return_inverse=True)
            shared = np.flatnonzero(np.bincount(at) > 1)  # the rest is in no intersection
            both = np.zeros((len(a), len(b)), np.float32)
            for begin in range(0, len(shared), 4096):
                own = shared[begin : begin + 4096]
                column = np.full(len(ids), -1)
                column[own] = np.arange(len(own))
                keep = column[at] >= 0
                has = np.zeros((len(sets), len(own)), np.float32)
                has[owner[keep], column[at[keep]]] = 1
                both += has[a] @ has[b].T
            both = both.astype(np.int64)
            good = likely & (down * both >= up * (n[a][:, None] + n[b][None, :] - both))
            parent: dict[int, int] = {}

            def root(c: int) -> int:
                while parent.setdefault(c, c) != c:
                    c = parent[c]
                return c

            for row, col in zip(*np.nonzero(good), strict=True):
                i, j = a[row], b[col]
                ci, cj = root(int(comp[i])), root(int(comp[j]))
                if ci != cj:
                    parent[ci] = cj
                    found.append((int(node[i]), int(node[j])))
        return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([x for _, x in found], pa.int64())})

    return dealt.join(docs, "node").groupBy("key", "i", "j").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, config: MinHashConfig = MinHashConfig()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    spark = docs.sparkSession
    sketches = cut(sketch(docs, config), "sketches")
    # one class for each distinct set; its smallest document stands for it
    classes = cut(sketches.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").cast("long").alias("node"))
    own = sketches.where("set_key is not null").select(F.col("doc_id").cast("long").alias("node"), "n_shingles", "regs", "bands", "set_key")
    chosen = cut(own.join(classes, ["set_key"]).where("node = rep").drop("rep").dropDuplicates(["set_key"]), "chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    # in a bucket those are neighbours that share the next bands too, so most links are met here
    at = F.posexplode("bands").alias("i", "key")
    partitions = config.partitions or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chosen.count() * config.bands // BAND_ROWS))
    rows = chosen.select(at, "bands", "node").select("key", *(F.coalesce(F.get("bands", F.col("i") + j), F.lit(0)).alias(f"o{j}") for j in (1, 2)), "node")
    members = cut(neighbours_in_order(rows, partitions), "members")
    ends = members.where("edge").groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("nodes")).where("size(nodes) > 1")  # at most two a partition
    ends = ends.select(F.explode(F.arrays_zip(F.slice("nodes", F.lit(1), F.size("nodes") - 1).alias("u"), F.slice("nodes", F.lit(2), F.size("nodes") - 1).alias("v"))).alias("e")).select("e.u", "e.v")
    pairs = members.where("prev is not null").select(F.least("prev", "node").alias("u"), F.greatest("prev", "node").alias("v")).union(ends).where("u <> v").distinct()
    links = cut(_confirmed(cut(_estimated(pairs, chosen, config), "pairs"), texts, config), "links")
    found = connected_components(links)
    mixed = cut(_mixed(members.select("key", "node"), found), "mixed")
    rest = cut(_across(mixed, chosen, config), "pairs")
    links = links.union(cut(_confirmed(rest, texts, config), "links")).union(cut(_across_blocks(mixed, texts, config), "links"))
    # classes join as their smallest document; documents that repeat an id with other sets join the classes
    same = own.join(classes, "set_key").where("node <> rep").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    found = connected_components(links.union(same.distinct()))
    out = sketches.select("doc_id", "n_shingles", F.col("doc_id").cast("long").alias("_n"))
    out = out.join(found, F.col("_n") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "_n").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def remove(docs: DataFrame, config: MinHashConfig = MinHashConfig()) -> DataFrame:
    """One row of each group of near-duplicates: that of its smallest doc_id (of rows that repeat it with the same
    text, one; with other texts, one of each). Rows with empty sets or null ids all stay."""
    found = cut(near_duplicates(docs, config), "found")
    gone = found.where("not kept").select("doc_id").distinct()
    times = next(x for x in (f"_times{i}" for i in range(len(docs.columns) + 1)) if x.lower() not in map(str.lower, docs.columns))
    again = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(times)).where(F.col(times) > 1)
    left = docs.join(gone, "doc_id", "left_anti").join(again, "doc_id", "left")
    # only texts of repeated ids are shuffled
    several = F.col(times).isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return left.where(~several).union(left.where(several).dropDuplicates(["doc_id", "text"])).select(*docs.columns)
