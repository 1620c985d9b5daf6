"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry, by Elkan's form of Lloyd's rounds.

Components become integers ``floor(scale * x)``; a vector is cut into ``parts`` consecutive parts, and each part position has
a codebook of its own. Between rounds a table in the shared folder keeps, for each part of each vector, its entry, an upper
bound of the distance to it, and one lower bound for each entry of the codebook. When entries move, bounds are shifted by how
far: nothing is computed for an entry that the triangle inequality shows to be strictly farther. What is left is compared by
squared distances in integers, so ties go to the lower index exactly. Lower bounds are kept in a byte, as whole steps (rounded
down) of a scale per part; upper bounds are rounded up; pruning is only ever too careful.

Sums for the next codebook are made per task in integers, added up in Spark, and come to the driver as parts * entries rows.

Defined cases: rows whose vector is null, or holds null or non-finite components, are dropped; the first codebook takes the
smallest distinct vec_ids (null last; of rows that repeat one, the smallest vector), fewer where there are fewer; integers are held within
+-2**27; vectors of different length have codebooks of their own; a length that the parts do not divide gives its first parts
one component more; rows that repeat a vec_id are encoded each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolex.llm.scratch import arrow_rows, cut

LIMIT = 1 << 27
FLOATS = 1 << 20  # up to here sums of squares are exact in doubles
FEW_LABELS = 100_000


@dataclass(frozen=True)
class CodeConfig:
    parts: int = 16
    entries: int = 64  # 256 at most
    rounds: int = 2
    scale: int = 256


Books = list[np.ndarray]  # a codebook of integers for each part position


def edges(dims: int, parts: int) -> list[int]:
    return [0, *np.cumsum([len(x) for x in np.array_split(np.arange(dims), parts)]).tolist()]


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows by entries, exact."""
    if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) <= FLOATS:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i, None] - entries[None, :, i]) ** 2
    return out


def _up(x: np.ndarray) -> np.ndarray:
    return (np.sqrt(x.astype(np.float64)) * (1 + 1e-6)).astype(np.float32) * np.float32(1 + 1e-6)


def _down(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64)) * (1 - 1e-6)


@dataclass
class Bounds:
    """Of one part of some vectors: the entry, an upper bound for it, and a lower bound (rows by entries) for each entry."""

    entry: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        step = (self.lower.max(1, initial=0) / 255 * (1 + 1e-5)).astype(np.float32)
        steps = np.floor(self.lower / np.where(step > 0, step, 1)[:, None])
        return self.entry.astype(np.uint8), (self.upper * (1 + 1e-6)).astype(np.float32), step, np.clip(steps, 0, 255).astype(np.uint8)

    @staticmethod
    def unpacked(entry: np.ndarray, upper: np.ndarray, step: np.ndarray, steps: np.ndarray) -> Bounds:
        return Bounds(entry.astype(np.int64), upper.astype(np.float64), steps * (step.astype(np.float64) * (1 - 1e-5))[:, None])


def first(x: np.ndarray, entries: np.ndarray) -> Bounds:
    d = squares(x, entries)
    entry = d.argmin(1)
    return Bounds(entry, _up(d[np.arange(len(x)), entry]).astype(np.float64), _down(d))


def moved(x: np.ndarray, entries: np.ndarray, before: np.ndarray, have: Bounds) -> tuple[Bounds, int]:
    """Bounds after the entries moved from ``before``, and how many distances to other entries that took."""
    shift = _up(((entries - before) ** 2).sum(1)).astype(np.float64)
    entry, each = have.entry, np.arange(len(x))
    upper, lower = have.upper + shift[entry] * (1 + 1e-9), np.maximum(have.lower - shift[None, :] * (1 + 1e-9), 0)
    half = _down(squares(entries, entries)) / 2

    def open_() -> np.ndarray:
        # only what is strictly farther is left out: an equal distance may be the lower index's
        return (lower <= upper[:, None]) & (half[entry] <= upper[:, None])

    ask = open_()
    ask[each, entry] = False
    rows = np.flatnonzero(ask.any(1))
    own = ((x[rows] - entries[entry[rows]]) ** 2).sum(1)
    upper[rows] = _up(own)
    lower[rows, entry[rows]] = _down(own)
    ask &= open_()
    i, j = np.nonzero(ask)
    d = ((x[i] - entries[j]) ** 2).sum(1)
    lower[i, j] = _down(d)
    table = np.full((len(rows), len(entries)), np.iinfo(np.int64).max)
    place = np.searchsorted(rows, i)
    table[place, j] = d
    table[np.arange(len(rows)), entry[rows]] = own
    entry = entry.copy()
    entry[rows] = table.argmin(1)
    upper[rows] = _up(table.min(1, initial=np.iinfo(np.int64).max))
    return Bounds(entry, upper, lower), len(i)


def _integers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), -1).astype(np.int64)


def _packed(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.dtype.itemsize
    data = np.ascontiguousarray(rows).tobytes()
    return pa.array([data[i * width : (i + 1) * width] for i in range(len(rows))], pa.binary())


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dims").to_numpy()
    for d in np.unique(dims):
        own = np.flatnonzero(dims == d)
        yield int(d), batch if len(own) == len(dims) else batch.take(pa.array(own))


def _state(batch: pa.RecordBatch, parts: int) -> list[Bounds]:
    n = batch.num_rows
    row = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(n, parts, -1)
    entry, upper, step, steps = row("entry", np.uint8), row("upper", np.float32), row("step", np.float32), row("steps", np.uint8)
    return [Bounds.unpacked(entry[:, k, 0], upper[:, k, 0], step[:, k, 0], steps[:, k]) for k in range(parts)]


def usable(embedding: Column) -> Column:
    return embedding.isNotNull() & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _starts(rows: DataFrame, config: CodeConfig) -> dict[int, Books]:
    """The first codebooks, for each length of vectors. ``entries`` rows of each come to the driver."""
    place = F.row_number().over(Window.partitionBy("dims").orderBy(F.asc_nulls_last("vec_id")))
    ids = rows.select("dims", "vec_id").distinct().withColumn("place", place).where(F.col("place") <= config.entries)
    ids = ids.withColumnsRenamed({"dims": "d", "vec_id": "i"})
    # at most ``entries`` rows a length
    met = rows.join(F.broadcast(ids), (F.col("d") == F.col("dims")) & F.col("i").eqNullSafe(F.col("vec_id"))).groupBy("dims", "place").agg(F.min("ints").alias("ints"))
    found: dict[int, list] = {}
    for r in sorted(met.collect(), key=lambda r: (r["dims"], r["place"])):
        found.setdefault(r["dims"], []).append(r["ints"])
    cuts = {d: edges(d, config.parts) for d in found}
    whole = {d: np.array(x, np.int64).reshape(len(x), d) for d, x in found.items()}
    return {d: [whole[d][:, a:b] for a, b in zip(cuts[d], cuts[d][1:], strict=False)] for d in found}


_STATE = "vec_id {vec_id}, label {label}, dims int, ints binary, entry binary, upper binary, step binary, steps binary"


def _assign(rows: DataFrame, now: dict[int, Books], before: dict[int, Books] | None, config: CodeConfig, last: bool) -> DataFrame:
    """Every part to its nearest entry of ``now``: the next state, or codes and errors where this is the last round."""
    shared = rows.sparkSession.sparkContext.broadcast((now, before))  # parts * entries short vectors a length
    parts = config.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, old = shared.value
        for whole in batches:
            for dims, batch in _by_length(whole):
                at = edges(dims, parts)
                x = _integers(batch.column("ints")).reshape(batch.num_rows, dims)
                x = [x[:, a:b] for a, b in zip(at, at[1:], strict=False)]
                if old is None:
                    have = [first(x[k], books[dims][k]) for k in range(parts)]
                else:
                    have = [moved(x[k], books[dims][k], old[dims][k], b)[0] for k, b in enumerate(_state(batch, parts))]
                head = [batch.column("vec_id"), batch.column("label")]
                if last:
                    codes = np.stack([b.entry for b in have], 1).astype(np.uint8)
                    error = sum(((x[k] - books[dims][k][b.entry]) ** 2).sum(1) for k, b in enumerate(have))
                    code = pa.array([row.tobytes().hex() for row in codes], pa.string())
                    yield pa.RecordBatch.from_arrays([*head, batch.column("dims"), code, pa.array(error, pa.int64())], ["vec_id", "label", "dims", "code", "error"])
                    continue
                packed = [b.packed() for b in have]
                stacked = [_packed(np.stack([p[i] for p in packed], 1).reshape(batch.num_rows, -1)) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*head, batch.column("dims"), batch.column("ints"), *stacked], ["vec_id", "label", "dims", "ints", "entry", "upper", "step", "steps"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    out = "vec_id {vec_id}, label {label}, dims int, code string, error long" if last else _STATE
    return rows.mapInArrow(run, out.format(**kinds))


def _means(state: DataFrame, books: dict[int, Books], config: CodeConfig) -> dict[int, Books]:
    """Each entry's componentwise floor of the mean of its parts; unused entries stay."""
    parts = config.parts

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sums and, at place -1, counts: a bounded number of rows."""
        total: dict[int, list[np.ndarray]] = {}
        for whole in batches:
            for dims, batch in _by_length(whole):
                at = edges(dims, parts)
                x = _integers(batch.column("ints")).reshape(batch.num_rows, dims)
                entry = np.frombuffer(b"".join(batch.column("entry").to_pylist()), np.uint8).reshape(batch.num_rows, parts)
                have = total.setdefault(dims, [np.zeros((256, b - a + 1), np.int64) for a, b in zip(at, at[1:], strict=False)])
                for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    np.add.at(have[k], entry[:, k], np.concatenate([np.ones((len(x), 1), np.int64), x[:, a:b]], 1))
        for dims, have in total.items():
            for k, table in enumerate(have):
                used = np.flatnonzero(table[:, 0])
                i, place = np.repeat(used, table.shape[1]), np.tile(np.arange(-1, table.shape[1] - 1), len(used))
                same = lambda v, n=len(i): pa.array(np.full(n, v, np.int32))
                yield pa.RecordBatch.from_arrays([same(dims), same(k), pa.array(i.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(table[used].ravel())], ["dims", "part", "entry", "place", "sum"])

    made = state.select("dims", "ints", "entry").mapInArrow(sums, "dims int, part int, entry int, place int, sum long")
    total = made.groupBy("dims", "part", "entry", "place").agg(F.sum("sum").alias("sum"))
    out = {d: [b.copy() for b in own] for d, own in books.items()}
    rows = {(r["dims"], r["part"], r["entry"], r["place"]): r["sum"] for r in total.collect()}
    for (d, k, i, place), value in rows.items():
        if place >= 0:
            out[d][k][i, place] = value // rows[d, k, i, -1]
    return out


def encode(vectors: DataFrame, config: CodeConfig = CodeConfig()) -> tuple[DataFrame, dict[int, Books]]:
    """(vec_id, label, dims, code, error) of each usable row of ``vectors`` (vec_id, embedding, label), and the final
    codebooks of each length. ``code`` has two hex digits a part; ``error`` is the sum of squared distances."""
    arrow_rows(vectors.sparkSession)
    floor = lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * config.scale))).cast("int")
    rows = vectors.where(usable(F.col("embedding"))).select("vec_id", "label", F.size("embedding").alias("dims"), F.transform("embedding", floor).alias("ints"))
    books, before = _starts(rows, config), None

    def binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ints")
            data, at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.concatenate([[0], np.cumsum(batch.column("dims").to_numpy())])
            own = pa.array([data[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("dims"), own], ["vec_id", "label", "dims", "ints"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    state, cuts = rows.mapInArrow(binary, "vec_id {vec_id}, label {label}, dims int, ints binary".format(**kinds)), None
    for _ in range(config.rounds):
        state = cuts = cut(_assign(state, books, before, config, last=False), "codes", instead_of=cuts)
        books, before = _means(state, books, config), books
    return cut(_assign(state, books, before, config, last=True), "encoded", instead_of=cuts), books


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``, the sum of ``error`` over equal labels (nulls together).

    Labels above a thousandth of the rows, at most a thousand, come back by a broadcast join; so do all where
    they are few. The rest have no hot key."""
    sums = cut(rows.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    size = sums.agg(F.count("*").alias("labels"), F.sum("n").alias("rows")).first()
    same = F.col("l").eqNullSafe(F.col("label"))
    if size["labels"] <= FEW_LABELS:
        return rows.join(F.broadcast(sums), same).drop("l", "n")
    hot = F.col("n") * 1000 > size["rows"]
    joined = rows.join(F.broadcast(sums.where(hot)), same, "left")
    rest = joined.where(F.col("n").isNull()).drop("l", "n", "label_error").join(sums.where(~hot), same)
    return joined.where(F.col("n").isNotNull()).drop("l", "n").unionByName(rest.drop("l", "n"))


def fingerprint(books: Books) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(str(c) for book in books for entry in book.tolist() for c in entry).encode()).hexdigest()


def compress(vectors: DataFrame, config: CodeConfig = CodeConfig()) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 (of the codebooks for the vector's length)."""
    rows, books = encode(vectors, config)
    sha = F.lit(None).cast("string")
    if books:
        sha = F.element_at(F.create_map(*(F.lit(x) for d, own in books.items() for x in (d, fingerprint(own)))), F.col("dims"))
    return with_label_error(rows).select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))


def oracle_sql(config: CodeConfig = CodeConfig()) -> str:
    """For vectors of one length that the parts divide, and distinct vec_ids."""
    parts = []
    for r in range(config.rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT rid, p.part, any_value(x) AS x, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'j': j}}) AS m FROM p JOIN b{r} b ON p.part = b.part GROUP BY rid, p.part)""")
        if r < config.rounds:
            parts.append(f"""m{r} AS (SELECT part, j, list(v ORDER BY i) AS c FROM (SELECT part, m.j AS j, i, floor(sum(x[i]) / count(*)) AS v FROM a{r}, (SELECT unnest(range(1, w + 1)) AS i FROM w) GROUP BY part, m.j, i) GROUP BY part, j),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.j, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.j = m.j)""")
    last = config.rounds
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({config.scale} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT max(len(e)) // {config.parts} AS w FROM v),
p AS MATERIALIZED (SELECT rid, vec_id, part, e[part * w + 1:(part + 1) * w] AS x FROM v, w, (SELECT unnest(range({config.parts})) AS part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS j, x AS c FROM p QUALIFY j < {config.entries}),
{', '.join(parts)},
r AS (SELECT rid, string_agg(printf('%02x', m.j), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{last} GROUP BY rid),
s AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY part, j, i)) AS h FROM b{last}, (SELECT unnest(range(1, w + 1)) AS i FROM w))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN r USING (rid), s"""
