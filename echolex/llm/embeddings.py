"""Near-duplicate embeddings by product quantisation.

Index: every vector, scaled to length 1, is stored once, in the inverted list of its nearest coarse centroid, with the codes
of its residual in subspaces of a few dimensions (a byte each) and the length of its reconstruction error. Each vector is a
query too: it probes the lists whose centroids are nearest. In a list, a query gets asymmetric distances by table lookups over
the codes; what may reach the threshold within the stored vector's own reconstruction error (so that the codes miss nothing)
is reranked by exact cosine in double precision. Centroids and codebooks are trained on a bounded sample (``sample`` rows
with the smallest hash of id); every row is indexed, and the number of lists grows with the rows, so that a list's expected
length stays the same.

Probes: their number is chosen on the sample, as the least that reaches ``recall`` on pairs made to be the hardest links: a
sample vector and a partner at exactly the threshold's angle, in a random direction, and in the direction of another sample
vector (along the data). A pair counts as found if either of the two probes the other's list, which is also how links are
found: a link that only one side sees is counted for both, so ``n_links`` is symmetric. ``recall=1`` is the exact setting:
it probes every list that a link can be in by the triangle inequality (centroid distance <= nearest + 2 * reach).

Groups: equal vectors of one label are one row with a count before the index. Lists are cut by label, and into blocks of
about ``block`` vectors by hash; a task compares a block of queries with a block of stored vectors and returns, for each
vector, its number of links and spanning links only, so neither a hot list nor a group of copies emits all pairs or meets in
one task.

Defined cases: null label, null or zero vectors and vectors that hold null or non-finite components link with nothing
(n_links 0, component_id their vec_id, kept true); vectors of different length are not compared; very large and very small
components are scaled before they are squared; rows that repeat a vec_id are separate vectors of one node; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolex.llm.components import connected_components
from echolex.llm.scratch import arrow_rows, cut


@dataclass(frozen=True)
class PQConfig:
    threshold: float = 0.93
    sample: int = 20_000  # training vectors
    list_rows: int = 400  # expected length of an inverted list
    most_lists: int = 4096
    sub_dims: int = 8
    codes: int = 64
    block: int = 512
    iterations: int = 8
    recall: float = 0.995  # of the hardest links; 1: all links, by the triangle inequality
    trials: int = 4096  # sample vectors that the number of probes is chosen on
    seed: int = 5


def kmeans(x: np.ndarray, k: int, iterations: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm from random rows; empty clusters keep their centre."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(iterations):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        order = np.argsort(own, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(own[order]) != 0]))
        centres[own[order][begin]] = np.add.reduceat(x[order], begin) / count[own[order][begin]][:, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, initial=0)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


@dataclass
class Index:
    """Coarse centroids, a codebook for each subspace, and how many lists a query probes (0: as the triangle inequality asks)."""

    coarse: np.ndarray
    books: list[np.ndarray]
    probes: int = 0

    @property
    def edges(self) -> list[int]:
        return np.cumsum([0] + [b.shape[1] for b in self.books]).tolist()

    def encode(self, residual: np.ndarray) -> np.ndarray:
        return np.stack([nearest(residual[:, a:b], book) for a, b, book in zip(self.edges, self.edges[1:], self.books, strict=False)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], 1)

    def tables(self, query: np.ndarray) -> list[np.ndarray]:
        """Inner products of each query with each code, a table for each subspace."""
        return [query[:, a:b] @ book.T for a, b, book in zip(self.edges, self.edges[1:], self.books, strict=False)]


def _probes(x: np.ndarray, coarse: np.ndarray, config: PQConfig, rng: np.random.Generator) -> int:
    """The least number of probes that finds ``config.recall`` of pairs at exactly the threshold's angle (see above)."""
    x = x[rng.choice(len(x), min(len(x), config.trials), replace=False)]
    most = 1
    for towards in (rng.normal(size=x.shape), x[rng.permutation(len(x))]):
        side = towards - (towards * x).sum(1)[:, None] * x
        length = np.sqrt((side * side).sum(1))
        there = length > 1e-9
        if not there.any():
            continue
        a = x[there]
        b = config.threshold * a + np.sqrt(1 - config.threshold**2) * side[there] / length[there][:, None]
        da, db = distances(a, coarse), distances(b, coarse)
        each = np.arange(len(a))
        # how many lists are nearer to one than the list of the other
        rank = np.minimum((da < da[each, db.argmin(1)][:, None]).sum(1), (db < db[each, da.argmin(1)][:, None]).sum(1))
        most = max(most, int(np.quantile(rank, config.recall, method="higher")) + 1)
    return min(most, len(coarse))


def train(x: np.ndarray, rows: int, config: PQConfig) -> Index:
    """Fits on sample vectors of length 1; ``rows`` is how many will be indexed."""
    rng = np.random.default_rng(config.seed)
    lists = max(1, min(config.most_lists, -(-rows // config.list_rows), len(x) // 8 or 1))
    coarse = kmeans(x, lists, config.iterations, rng)
    residual = x - coarse[nearest(x, coarse)]
    books = [kmeans(residual[:, a : a + config.sub_dims], config.codes, config.iterations, rng) for a in range(0, x.shape[1], config.sub_dims)]
    return Index(coarse, books, _probes(x, coarse, config, rng) if config.recall < 1 else 0)


def _classes(vectors: DataFrame) -> DataFrame:
    """class, label, vector (array of doubles), rep, count: a row for each distinct usable vector of a label.

    ``class`` tells classes apart, of which several have one ``rep`` where a vec_id is repeated; it is stable once written."""
    v = F.col("vector")
    usable = F.col("label").isNotNull() & v.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(usable).groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("count")).withColumn("class", F.monotonically_increasing_id())


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _bytes(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as its bytes."""
    width = rows.shape[1] * rows.dtype.itemsize
    return pa.array([rows.tobytes()[i : i + width] for i in range(0, len(rows) * width, width)] if width else [b""] * len(rows), pa.binary())


def _rows(column: pa.ChunkedArray, dtype: type, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(n, -1)


_ENTRY = "label {label}, list int, stored boolean, class long, rep long, count long, home int, probes array<int>, vector binary, codes binary, error double"
_FOUND = pa.schema([("class", pa.int64()), ("rep", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _compare(table: pa.Table, index: Index, config: PQConfig) -> pa.Table:
    """A block of queries and a block of stored vectors of one label and list -> links of each vector that has any."""
    stored = table.column("stored").to_numpy(zero_copy_only=False).astype(bool)
    ask, have = table.filter(pa.array(~stored)), table.filter(pa.array(stored))
    if not ask.num_rows or not have.num_rows:
        return _FOUND.empty_table()
    q, s = (_rows(t.column("vector"), np.float64, t.num_rows) for t in (ask, have))
    codes, error = _rows(have.column("codes"), np.uint8, have.num_rows), have.column("error").to_numpy()
    # <query, centre> + sum over subspaces of a table lookup; off by at most the length of the reconstruction error
    approximate = np.repeat((q @ index.coarse[table.column("list")[0].as_py()])[:, None], len(s), 1)
    for m, lookup in enumerate(index.tables(q)):
        approximate += lookup[:, codes[:, m]]
    a, b = np.nonzero(approximate >= config.threshold - error[None, :] - 1e-9)
    (ca, ra, na, ha), (cb, rb, nb, _) = ([t.column(c).to_numpy() for c in ("class", "rep", "count", "home")] for t in (ask, have))
    pairs = []
    for begin in range(0, len(a), 1 << 16):
        i, j = a[begin : begin + (1 << 16)], b[begin : begin + (1 << 16)]
        good = (np.einsum("ij,ij->i", q[i], s[j]) >= config.threshold) & (ca[i] != cb[j])
        pairs.append((i[good], j[good]))
    i, j = (np.concatenate(side) for side in zip(*pairs, strict=True)) if pairs else (a, b)
    if not len(i):
        return _FOUND.empty_table()
    # a stored vector that does not probe the query's list has this link from here only
    lists = have.column("probes").combine_chunks()
    probed = np.zeros((have.num_rows, len(index.coarse)), bool)
    probed[np.repeat(np.arange(have.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
    back = ~probed[j, ha[i]]
    la, lb = np.bincount(i, nb[j], ask.num_rows).astype(np.int64), np.bincount(j[back], na[i[back]], have.num_rows).astype(np.int64)
    # each linked vector with the smallest one that it reaches within the two blocks
    least_a, least_b = ra.copy(), rb.copy()
    while True:
        low = np.minimum(least_a[i], least_b[j])
        if (low == least_a[i]).all() and (low == least_b[j]).all():
            break
        np.minimum.at(least_a, i, low)
        np.minimum.at(least_b, j, low)
    sides = [(c, r, n, o, (n > 0) | (o != r)) for c, r, n, o in ((ca, ra, la, least_a), (cb, rb, lb, least_b))]
    return pa.table([pa.array(np.concatenate([side[k][side[4]] for side in sides]).astype(np.int64)) for k in range(4)], schema=_FOUND)


def links(classes: DataFrame, index: Index, config: PQConfig) -> DataFrame:
    """(class, rep, links, other): for each class and each pair of blocks its number of links there, and the ``rep`` of a class it is connected to."""
    # at most ``most_lists`` centroids and ``codes`` codes a subspace
    shared = classes.sparkSession.sparkContext.broadcast((index.coarse, index.books, index.probes))
    reach = 2 * np.sin(np.arccos(config.threshold) / 2)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stored row for each vector, and a query row for each list that it probes."""
        own = Index(*shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column("vector")))
            d = distances(x, own.coarse)
            home = d.argmin(1)
            if own.probes:
                lists = np.argpartition(d, own.probes - 1, axis=1)[:, : own.probes]
                row, lists = np.repeat(np.arange(len(x)), own.probes), lists.ravel()
            else:
                # a partner is within ``reach``, and nearer to its list's centroid than to any other
                row, lists = np.nonzero(np.sqrt(d) <= np.sqrt(d.min(1))[:, None] + 2 * reach + 1e-9)
            residual = x - own.coarse[home]
            codes = own.encode(residual)
            error = np.sqrt(((residual - own.decode(codes)) ** 2).sum(1))
            probes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))]).astype(np.int32)), pa.array(lists.astype(np.int32)))
            vector, all_rows = _bytes(x), np.arange(len(x))
            named = {c: batch.column(c) for c in ("label", "class", "rep", "count")}
            for at, of, is_stored in ((all_rows, home, True), (row, lists, False)):
                n, take = len(at), pa.array(at)
                columns = named | {"home": pa.array(home.astype(np.int32)), "vector": vector}
                columns = {c: v.take(take) for c, v in columns.items()} | {"list": pa.array(of.astype(np.int32)), "stored": pa.array(np.full(n, is_stored))}
                # a query needs neither codes nor its probes
                columns["probes"] = probes if is_stored else pa.nulls(n, pa.list_(pa.int32()))
                columns["codes"] = _bytes(codes) if is_stored else pa.nulls(n, pa.binary())
                columns["error"] = pa.array(error) if is_stored else pa.nulls(n, pa.float64())
                names = ["label", "list", "stored", "class", "rep", "count", "home", "probes", "vector", "codes", "error"]
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    label = classes.schema["label"].dataType.simpleString()
    dealt = classes.select("label", "vector", "class", "rep", "count").mapInArrow(entries, _ENTRY.format(label=label))
    dealt = cut(dealt, "lists")
    sizes = dealt.groupBy("label", "list").agg(F.count_if("stored").alias("s"), F.count_if(~F.col("stored")).alias("q")).where("s > 0 and q > 0")
    sizes = sizes.select("label", "list", *(F.ceil(F.col(c) / config.block).cast("int").alias(f"b{c}") for c in ("s", "q")))
    own = F.expr("cast(pmod(xxhash64(class), case when stored then bs else bq end) as int)")
    others = F.explode(F.expr("sequence(0, case when stored then bq else bs end - 1)")).alias("there")
    met = dealt.join(sizes, ["label", "list"]).select(*dealt.columns, own.alias("here"), others)
    met = met.select(*dealt.columns, F.expr("case when stored then there else here end").alias("i"), F.expr("case when stored then here else there end").alias("j"))
    compare = _compare
    return met.groupBy("label", "list", "i", "j").applyInArrow(lambda table: compare(table, Index(*shared.value), config), "class long, rep long, links long, other long")


def near_duplicates(vectors: DataFrame, config: PQConfig = PQConfig()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    arrow_rows(vectors.sparkSession)
    positive_zero = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", positive_zero.alias("vector"))
    classes = cut(_classes(v), "classes")
    sizes = {int(x["d"]): int(x["n"]) for x in classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}
    found = None
    for dims, rows in sorted(sizes.items()):  # as a rule one
        own = classes.where(F.size("vector") == dims)
        rows_of = own.orderBy(F.xxhash64("rep"), "rep").limit(config.sample).select("rep", "vector").toPandas().sort_values("rep")
        x = np.array(rows_of["vector"].tolist(), np.float64).reshape(len(rows_of), dims)
        index = train(unit(x), rows, config)
        part = cut(links(own, index, config), "links")
        found = part if found is None else found.union(part)
    ids = v.select("vec_id")
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    of = F.xxhash64("label", "vector")
    numbered = classes.join(counts, "class", "left").select(of.alias("h"), "label", "vector", "rep", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"))
    # hash first, then label and vector themselves: arrays as join keys are compared exactly
    rows = v.withColumn("h", of).alias("a").join(numbered.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.vector") == F.col("b.vector")), "left")
    rows = cut(rows.select("a.vec_id", "b.rep", "b.n_links"), "rows")
    same = rows.where("rep <> vec_id").select(F.col("rep").alias("u"), F.col("vec_id").alias("v")).distinct()
    comps = connected_components(found.select(F.col("rep").alias("u"), F.col("other").alias("v")).union(same))
    out = rows.join(comps, F.col("vec_id") == F.col("node"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
