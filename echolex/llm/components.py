"""Connected components of a large graph, none of whose parts ever comes to the driver or to one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolex.llm.scratch import cut, drop

EDGES = 200_000  # in a task, once they are dealt by their larger node


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a partition's edges by stars on their smallest nodes (union-find over this partition only)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): each node of ``edges`` (two long columns) with the smallest node that it can reach.

    Rounds of two steps after large-star and small-star (Kiveris et al., 2014): an edge whose smaller node has smaller
    neighbours moves on to the least of them, so paths shrink geometrically; then all edges from a node to smaller ones
    meet in one task, which makes stars of what it holds. Nodes that edges move from, or that have several smaller
    neighbours, are a table of their own, joined by broadcast while small, so a hot node's edges stay where they are;
    when it is empty, all edges are stars. Null nodes and loops give no rows; repeated edges do no harm.
    """
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}")
    e = cut(e.mapInArrow(_contract, "u long, v long"), "edges")
    for _ in range(most_rounds):
        least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        ends = e.select(F.col("v").alias("u")).distinct().withColumn("end", F.lit(True))
        moves = cut(least.join(ends, "u", "left").where("n > 1 or end").select(F.col("u").alias("v"), "m"), "moves")
        if moves.isEmpty():
            drop(moves)
            break
        moved = e.join(moves, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        moved = moved.repartition(-(-e.count() // EDGES), "u").mapInArrow(_contract, "u long, v long")
        e = cut(moved, "edges", instead_of=e)
        drop(moves)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def neighbours_in_order(rows: DataFrame, partitions: int) -> DataFrame:
    """Of rows (key, further longs to order by, node): those whose key occurs more than once, each with the node
    before it of the same key (``prev``).

    Rows are dealt by ranges of all columns, so a hot key spreads over many tasks and no task holds a group; ``edge``
    marks the ends of partitions, which the caller links.
    """
    dealt = rows.repartitionByRange(partitions, *rows.columns).sortWithinPartitions(*rows.columns).select("key", "node")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams: holds one row back, because only the next row tells whether it is alone."""
        last: tuple[int, int, bool] | None = None  # key, node, has an equal key before it

        def out(k, n, prev, has_prev, edge):
            mask = ~has_prev
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n), pa.array(prev, mask=mask), pa.array(edge)], ["key", "node", "prev", "edge"])

        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if last is not None:
                k, n = np.concatenate([[last[0]], k]), np.concatenate([[last[1]], n])
            same = k[1:] == k[:-1]
            has_prev = np.concatenate([[last is not None and last[2]], same])
            has_next = np.concatenate([same, [False]])
            prev = np.concatenate([[last[3] if last is not None else 0], n[:-1]])
            edge = np.zeros(len(k), bool)
            edge[0] = first
            keep = has_prev | has_next | edge
            keep[-1] = False
            if keep.any():
                yield out(k[keep], n[keep], prev[keep], has_prev[keep], edge[keep])
                first = first and not edge[keep].any()
            lone_first = first and len(k) == 1
            last = (int(k[-1]), int(n[-1]), bool(has_prev[-1]), int(prev[-1]))
            first = lone_first
        if last is not None:
            yield out(np.array([last[0]]), np.array([last[1]]), np.array([last[3]]), np.array([last[2]]), np.array([True]))

    return dealt.mapInArrow(chain, "key long, node long, prev long, edge boolean")
