"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Distinct vectors are dealt into shards by hash, and each shard's task builds a graph over its own: a new node's neighbours are
proposed by greedy (beam) searches of the graph so far, then pruned: going from near to far, a kept neighbour removes those
that are nearer to it, times ``alpha``, than to the node, so that edges stay few and point in different directions. Nodes enter in batches of
doubling size, which search and are pruned together in numpy; the nodes they chose get edges back, pruned again where
they have too many. A query is a beam search of every shard from that shard's entry nodes, and the shards' best are merged.

Graphs are built on float32 vectors of length 1, where the nearest by distance are the largest by cosine. What the beams end with is
scored by cosine in double precision on the original vectors (scaled by powers of two only, so nothing over- or underflows).

Groups: equal vectors are one node with its ``k`` + 1 smallest vec_ids, which is all that a result can hold; a limit by rank
before the shuffle keeps a hot vector from meeting in one task. Shards hold some ``shard_rows`` vectors each, so their number grows with
the rows. Queries are dealt into blocks of ``block``; a task holds one shard's graph and one block.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows without vec_id, take no part; vectors
of different length are not compared; of queries that repeat a vec_id the smallest vector stands; candidates with the query's own vec_id
are left out; rows that repeat a vec_id with the same vector are one candidate, with other vectors several; fewer candidates than ``k`` give as many rows; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolex.llm.scratch import arrow_rows, cut


@dataclass(frozen=True)
class GraphConfig:
    k: int = 5
    degree: int = 32
    beam: int = 112  # of a query
    build_beam: int = 48
    at_once: int = 4  # nodes that a step of a search expands
    alpha: float = 1.2
    shard_rows: int = 20_000
    least_shards: int = 8
    block: int = 4096  # queries of a search task
    batch: int = 1024  # nodes that enter the graph together
    seeds: int = 8  # entry nodes of a shard
    seed: int = 13


def _exponent(x: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(x).max(1, initial=0))[1][:, None]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two to components of about 1: no rounding, and no square over- or underflows."""
    return np.ldexp(x, -_exponent(x)) if x.shape[1] else x


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def _first_of_each(ids: np.ndarray) -> np.ndarray:
    """Marks, in each row, the first of equal numbers; -1 is none."""
    order = np.argsort(ids, axis=1, kind="stable")
    ranked = np.take_along_axis(ids, order, 1)
    new = ranked >= 0
    new[:, 1:] &= ranked[:, 1:] != ranked[:, :-1]
    out = np.zeros(ids.shape, bool)
    np.put_along_axis(out, order, new, 1)
    return out


class Graph:
    """``x``: unit vectors; ``out``: each node's neighbours, -1 where there are fewer; ``entries``: where searches begin."""

    def __init__(self, x: np.ndarray, out: np.ndarray, entries: np.ndarray, config: GraphConfig):
        self.x, self.out, self.entries, self.config = x, out, entries, config

    def _far(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own row of nodes; infinite to -1."""
        d = 2 - 2 * np.matmul(self.x[ids], q[:, :, None])[:, :, 0]
        return np.where(ids >= 0, np.maximum(d, 0), np.float32(np.inf))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beams (nodes from near to far, -1 at the end), their distances, and the nodes that were expanded."""
        n, wide = len(q), self.config.at_once
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, len(self.x)), bool)
        ids = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        seen[rows, ids] = True
        far = self._far(q, ids)
        done = np.zeros(ids.shape, bool)
        walked = []
        while True:
            # beams are kept from near to far, so the first open ones are the nearest
            open_ = ~done & (ids >= 0)
            if not open_.any():
                break
            turn = open_ & (np.cumsum(open_, 1) <= wide)
            done |= turn
            place = np.argsort(~turn, axis=1, kind="stable")[:, :wide]
            own = np.where(np.take_along_axis(turn, place, 1), np.take_along_axis(ids, place, 1), -1)
            walked.append(own)
            met = np.where(own[:, :, None] >= 0, self.out[own], -1).reshape(n, -1)
            met = np.where(seen[rows, met], -1, met)
            met = np.where(_first_of_each(met), met, -1)
            row, column = np.nonzero(met >= 0)
            seen[row, met[row, column]] = True
            # narrow the block to what the fullest row needs
            full = max(1, int((met >= 0).sum(1).max(initial=0)))
            met = -np.sort(-met, axis=1)[:, :full]
            ids = np.concatenate([ids, met], 1)
            far = np.concatenate([far, self._far(q, met)], 1)
            done = np.concatenate([done, np.zeros(met.shape, bool)], 1)
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            ids, far, done = (np.take_along_axis(a, order, 1) for a in (ids, far, done))
        return ids, far, np.concatenate(walked, 1) if walked else np.full((n, 1), -1)

    def prune(self, nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For each node its pruned neighbours among a row of candidates (-1: none; the node itself and repeats are left out)."""
        degree, slack = self.config.degree, np.float32(self.config.alpha**2)
        out = np.full((len(nodes), degree), -1)
        for a in range(0, len(nodes), 256):
            own, some = nodes[a : a + 256], ids[a : a + 256]
            some = np.where(_first_of_each(some) & (some != own[:, None]), some, -1)
            far = self._far(self.x[own], some)
            order = np.argsort(far, axis=1, kind="stable")
            some, far = np.take_along_axis(some, order, 1), np.take_along_axis(far, order, 1)
            near = self.x[some]
            between = 2 - 2 * np.matmul(near, near.transpose(0, 2, 1))
            alive, each = some >= 0, np.arange(len(own))
            for r in range(degree):
                if not alive.any():
                    break
                pick = alive.argmax(1)
                got = alive[each, pick]
                out[a + each[got], r] = some[each, pick][got]
                alive &= ~(got[:, None] & (slack * between[each, pick] <= far))
                alive[each, pick] = False
        return out


def build(x: np.ndarray, config: GraphConfig) -> Graph:
    """The graph over unit vectors: the same for the same rows, whoever builds it."""
    n, rng = len(x), np.random.default_rng(config.seed)
    order = rng.permutation(n)
    graph = Graph(x, np.full((n, config.degree), -1), order[: max(1, config.seeds)], config)
    start = min(n, 2 * config.degree)
    graph.out[order[:start]] = graph.prune(order[:start], np.broadcast_to(order[:start], (start, start)))
    at = start
    while at < n:
        new = order[at : at + min(config.batch, at)]
        at += len(new)
        ids, _, walked = graph.search(x[new], config.build_beam)
        # those that enter together are not in the graph yet: each meets the nearest of them directly
        most = min(len(new), config.degree // 2)
        beside = new[np.argpartition(-(x[new] @ x[new].T), most - 1, axis=1)[:, :most]]
        graph.out[new] = graph.prune(new, np.concatenate([ids, walked[:, : config.degree // 2], beside], 1))
        source, target = np.repeat(new, config.degree), graph.out[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        turn = np.argsort(target, kind="stable")
        source, target = source[turn], target[turn]
        hit, begin, count = np.unique(target, return_index=True, return_counts=True)
        # in parts of a few incoming edges, so that a node that many chose does not widen all rows
        for part in range(0, int(count.max(initial=0)), config.degree):
            more = np.flatnonzero(count > part)
            nodes, width = hit[more], np.minimum(count[more] - part, config.degree)
            back = np.full((len(nodes), int(width.max())), -1)
            row = np.repeat(np.arange(len(nodes)), width)
            place = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
            back[row, place] = source[np.repeat(begin[more] + part, width) + place]
            both = np.concatenate([graph.out[nodes], back], 1)
            both = np.where(_first_of_each(both), both, -1)
            some = (both >= 0).sum(1)
            fits = some <= config.degree
            packed = -np.sort(-both, axis=1)[:, : config.degree]
            graph.out[nodes[fits]] = packed[fits]
            graph.out[nodes[~fits]] = graph.prune(nodes[~fits], both[~fits])
    return graph


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of pairs of original vectors, in double precision."""
    q, x = scaled(q), scaled(x)
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


def _doubles(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def usable(embedding: Column) -> Column:
    return embedding.isNotNull() & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(embedding, lambda x: x != 0)


def _nodes(vectors: DataFrame, config: GraphConfig) -> DataFrame:
    """dims, shard, vector, ids: a row for each distinct vector with its ``k`` + 1 smallest vec_ids."""
    zero = F.lit(0.0)
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x + zero.cast("float") if "array<float>" in dict(vectors.dtypes)["embedding"] else x + zero).alias("vector"))
    shards = max(config.least_shards, -(-rows.count() // config.shard_rows))
    rows = rows.withColumn("h", F.xxhash64("vector")).groupBy("h", "vector", "vec_id").agg(F.count("*").alias("n"))
    same = Window.partitionBy("h", "vector").orderBy("vec_id")
    # only ranks up to the limit leave a task, so a hot vector is a few rows of each
    few = rows.withColumn("rank", F.row_number().over(same)).where(F.col("rank") <= config.k + 1)
    each = few.groupBy("h", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    shard = F.pmod(F.xxhash64(F.col("h"), F.lit(config.seed)), F.lit(shards)).cast("int")
    return each.select(F.size("vector").alias("dims"), shard.alias("shard"), F.col("vector").cast("array<double>").alias("vector"), "ids")


_GRAPH = "dims int, shard int, node int, vector binary, ids array<long>, edges array<int>"


def index(vectors: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    """The graphs of ``vectors`` (vec_id, embedding) as a written table: dims, shard, node, vector, ids, edges, a row for each
    distinct vector. Searches of a shard begin at its first nodes."""

    def made(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("first", "ascending")])
        lists = table.column("vector").combine_chunks()
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
        graph = build(unit(x), config)
        # nodes are renamed so that the entries come first
        order = np.concatenate([graph.entries, np.setdiff1d(np.arange(len(x)), graph.entries)])
        name = np.empty(len(x) + 1, np.int64)
        name[order], name[-1] = np.arange(len(x)), -1
        out = name[graph.out][order]
        size = np.concatenate([[0], np.cumsum((out >= 0).sum(1))]).astype(np.int32)
        edges = pa.ListArray.from_arrays(pa.array(size), pa.array(out[out >= 0].astype(np.int32)))
        data, wide = x[order].tobytes(), 8 * x.shape[1]
        vector = pa.array([data[i : i + wide] for i in range(0, len(data), wide)], pa.binary())
        rest = table.take(pa.array(order))
        return pa.table([rest.column("dims"), rest.column("shard"), pa.array(np.arange(len(x)).astype(np.int32)), vector, rest.column("ids").cast(pa.list_(pa.int64())), edges], names=["dims", "shard", "node", "vector", "ids", "edges"])

    nodes = _nodes(vectors, config).withColumn("first", F.get("ids", F.lit(0)))
    return cut(nodes.groupBy("dims", "shard").applyInArrow(made, _GRAPH), "graphs")


def _answer(asked: pa.Table, have: pa.Table, config: GraphConfig) -> pa.Table:
    """A block of queries and a shard's graph -> query_id, vec_id, score of each query's ``k`` best there."""
    have = have.combine_chunks().sort_by([("node", "ascending")])
    vectors, q = _doubles(have.column("vector")), _doubles(asked.column("vector"))
    lists = have.column("edges").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    out = np.full((len(vectors), max(1, int(size.max(initial=0)))), -1)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy(zero_copy_only=False)
    graph = Graph(unit(vectors), out, np.arange(min(len(vectors), max(1, config.seeds))), config)
    groups = have.column("ids").combine_chunks()
    begin, members = groups.offsets.to_numpy(), groups.flatten().to_numpy(zero_copy_only=False)
    found: list[list[np.ndarray]] = []
    ids_of = asked.column("query_id").to_numpy()
    for a in range(0, len(q), config.batch):
        ids, _, _ = graph.search(unit(q[a : a + config.batch]), config.beam)
        i, j = np.nonzero(ids >= 0)
        node = ids[i, j]
        score = np.concatenate([cosines(q[a + i[b : b + 65536]], vectors[node[b : b + 65536]]) for b in range(0, len(i), 65536)])
        many = begin[node + 1] - begin[node]
        turn = np.repeat(np.arange(len(node)), many)
        vec = members[np.repeat(begin[node], many) + np.arange(len(turn)) - np.repeat(np.cumsum(many) - many, many)]
        who, score = a + i[turn], score[turn]
        other = vec != ids_of[who]
        who, vec, score = who[other], vec[other], score[other]
        order = np.lexsort((vec, -score, who))
        who, vec, score = who[order], vec[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        best = rank < config.k
        found.append([ids_of[who[best]], vec[best], score[best]])
    return pa.table([np.concatenate(x) for x in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search(queries: DataFrame, graphs: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found in ``graphs`` of each of ``queries`` (query_id, vector)."""
    rows = queries.groupBy("query_id").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-rows.count() // config.block))
    shards = (graphs.agg(F.max("shard")).first()[0] or 0) + 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([np.array(v, np.float64).tobytes() for v in batch.column("vector").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("dims"), own], ["query_id", "dims", "vector"])

    rows = rows.select("query_id", F.size("vector").alias("dims"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(packed, "query_id long, dims int, vector binary")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    # every block meets every shard: a task for each, with no more than a block and a shard in it
    asked = rows.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    have = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dims", "shard", "block"]

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        return _answer(left, right, config)

    found = asked.groupBy(*key).cogroup(have.groupBy(*key)).applyInArrow(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= config.k).select("query_id", "rank", "vec_id", "score")


def every_nth(vectors: DataFrame, n: int) -> DataFrame:
    """query_id, vector of the usable rows whose vec_id is divisible by ``n``."""
    return vectors.where((F.col("vec_id").cast("long") % n == 0) & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("vector"))


def nearest(vectors: DataFrame, config: GraphConfig = GraphConfig(), every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest other rows of each row whose vec_id is divisible by ``every``."""
    arrow_rows(vectors.sparkSession)
    return search(every_nth(vectors, every), index(vectors, config), config)


def recall(found: pd.DataFrame, exact: pd.DataFrame) -> float:
    """The share of the exact (query_id, vec_id) that were found; 1 of none."""
    return 1.0 if exact.empty else len(found.merge(exact, on=["query_id", "vec_id"])) / len(exact)
