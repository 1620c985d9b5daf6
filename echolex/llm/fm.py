"""Factorisation machines over hashed text features.

score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

The bracket is the sum-of-squares identity, so all pairwise interactions cost one pass over a text's features. Every
feature is present or absent in a text (x_i is 0 or 1), however often it occurs, so long texts are not diluted.

Training uses a bounded sample of labelled rows (``max_rows``, the rows with the smallest hash of their id in each
class): the sample's features, not its texts, come to one task, where Adam fits the selected features; the driver gets
the weights only. Scoring covers whole texts in Arrow batches; the model is broadcast and its size is fixed by ``n_features``.

Defined cases: null text is empty and gets the score of a text without features; labels that are null, or whose doc_id
is null, are not learned from; of several labels of one doc_id the largest counts; with no labelled row, or a single
class, the score is the smoothed share of label 1 (one half without rows). Repeated rows are scored each. Other
columns of the input are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolex.llm import kernels as K
from echolex.llm.scratch import arrow_rows

#: Features of some texts: for each, its text's row and its id below 2**hash_bits.
Featurizer = Callable[[list[bytes], int], tuple[np.ndarray, np.ndarray]]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by 5. A null id, which no label has, is one of
    them."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


@dataclass(frozen=True)
class FMConfig:
    hash_bits: int = 20
    n_features: int = 4096
    rank: int = 8
    min_df: int = 4
    max_rows: int = 4000  # of each class
    epochs: int = 150
    rate: float = 0.05
    l2_linear: float = 2e-4
    l2_pairs: float = 2e-3
    seed: int = 7


@dataclass
class FMModel:
    hash_bits: int
    slot: np.ndarray  # feature id -> row of weights, or -1
    w0: float
    w: np.ndarray
    v: np.ndarray
    report: dict = field(default_factory=dict)

    @staticmethod
    def of(hash_bits: int, chosen: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray, report: dict | None = None) -> FMModel:
        """From what is sent: the features' ids in order instead of a slot for every id."""
        slot = np.full(1 << hash_bits, -1, np.int32)
        slot[chosen] = np.arange(len(chosen))
        return FMModel(hash_bits, slot, w0, w, v, report or {})

    def sent(self) -> tuple[int, np.ndarray, float, np.ndarray, np.ndarray]:
        return self.hash_bits, np.flatnonzero(self.slot >= 0).astype(np.int32), self.w0, self.w, self.v

    def logits(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """One logit a text; ``feature`` may repeat within a text."""
        at = self.slot[feature]
        keep = at >= 0
        key = np.unique(doc[keep].astype(np.int64) * len(self.w) + at[keep]) if keep.any() else np.zeros(0, np.int64)
        doc, at = np.divmod(key, max(1, len(self.w)))
        out = np.full(n, self.w0)
        if len(doc):
            begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            rows = self.v[at]
            total = np.add.reduceat(rows, begin)
            squares = np.add.reduceat(rows * rows, begin)
            out[doc[begin]] += np.add.reduceat(self.w[at], begin) + 0.5 * (total * total - squares).sum(1)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(features: list[np.ndarray], y: np.ndarray, config: FMConfig = FMConfig()) -> FMModel:
    """Fits on texts given by their distinct feature ids. Equal texts count once; features are chosen by chi-square."""
    n_ids = 1 << config.hash_bits
    seen: dict[bytes, int] = {}
    for i, x in enumerate(features):
        seen.setdefault(x.tobytes() + bytes([int(y[i])]), i)
    rows = sorted(seen.values())
    features, y = [features[i] for i in rows], np.asarray([y[i] for i in rows], np.float64)
    n, pos = len(y), y.sum()
    empty = FMModel(config.hash_bits, np.full(n_ids, -1, np.int32), float(np.log((pos + 1) / (n - pos + 1))), np.zeros(0), np.zeros((0, config.rank)), {"rows": n})
    if not n or pos in (0, n):
        return empty
    flat, doc = np.concatenate(features), np.repeat(np.arange(n), [len(x) for x in features])
    df = np.bincount(flat, minlength=n_ids).astype(np.float64)
    df1 = np.bincount(flat[y[doc] == 1], minlength=n_ids).astype(np.float64)
    expected = df * pos / n
    spread = expected * (1 - pos / n) * (1 - df / n)
    chi = np.where((df >= config.min_df) & (spread > 0), (df1 - expected) ** 2 / np.maximum(spread, 1e-9), 0)
    chosen = np.argsort(-chi, kind="stable")[: config.n_features]
    chosen = np.sort(chosen[chi[chosen] > 6.6])  # one in a hundred by chance
    if not len(chosen):
        return empty
    slot = np.full(n_ids, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    keep = slot[flat] >= 0
    doc, at = doc[keep], slot[flat[keep]]
    by_feature = np.argsort(at, kind="stable")
    f_doc, f_at = doc[by_feature], at[by_feature]
    f_begin = np.flatnonzero(np.concatenate([[True], f_at[1:] != f_at[:-1]]))
    d_begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    d_row, f_row = doc[d_begin], f_at[f_begin]
    rng = np.random.default_rng(config.seed)
    params = [np.zeros(1), np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), config.rank))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    for t in range(1, config.epochs + 1):
        w0, w, v = params
        total = np.zeros((n, config.rank))
        total[d_row] = np.add.reduceat(v[at], d_begin)
        squares, linear = np.zeros(n), np.zeros(n)
        squares[d_row] = np.add.reduceat((v * v).sum(1)[at], d_begin)
        linear[d_row] = np.add.reduceat(w[at], d_begin)
        p = sigmoid(w0[0] + linear + 0.5 * ((total * total).sum(1) - squares))
        g = weight * (p - y) / n
        gw, gv = np.zeros_like(w), np.zeros_like(v)
        gw[f_row] = np.add.reduceat(g[f_doc], f_begin)
        gv[f_row] = np.add.reduceat(g[f_doc, None] * total[f_doc], f_begin) - v[f_row] * gw[f_row, None]
        grads = [np.array([g.sum()]), gw + config.l2_linear * w, gv + config.l2_pairs * v]
        rate = config.rate * min(1.0, 2 * (1 - (t - 1) / config.epochs))
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.99 * second[i] + 0.01 * grad * grad
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-8)
    w0, w, v = params
    return FMModel(config.hash_bits, slot, float(w0[0]), w, v, {"rows": n, "positive": int(pos), "features": len(chosen)})


def sample(docs: DataFrame, labels: DataFrame, label: str, config: FMConfig) -> DataFrame:
    """The labelled rows to learn from: (text, y), at most ``max_rows`` of each class, never held-out ones."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id"))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    halves = [known.where(F.col("_y") == y).orderBy(F.xxhash64(F.lit(config.seed), "_id"), "_id").limit(config.max_rows) for y in (0, 1)]
    # at most 2 * max_rows small rows: a bounded broadcast
    chosen = F.broadcast(halves[0].unionByName(halves[1]))
    return docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(chosen, "_id").select("_id", "_text", "_y")


def train(docs: DataFrame, labels: DataFrame, label: str, featurize: Featurizer, config: FMConfig = FMConfig()) -> FMModel:
    """Learns ``labels.<label>`` from ``docs``. One task gets the bounded sample's feature ids and fits; the driver gets the weights."""
    arrow_rows(docs.sparkSession)
    bits = config.hash_bits

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = K.as_bytes(batch.column("_text")), []
            for a, b in K.slices(texts):
                doc, feature = featurize(texts[a:b], bits)
                key = np.unique(doc.astype(np.int64) << bits | feature)
                cuts = np.searchsorted(key, np.arange(b - a + 1, dtype=np.int64) << bits)
                ids = (key & ((1 << bits) - 1)).astype(np.int32)
                out += [ids[cuts[i] : cuts[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.int64()), pa.array(out, pa.binary()), batch.column("_y").cast(pa.int32())], ["id", "f", "y"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for x in batches for row in zip(*(x.column(c).to_pylist() for c in ("id", "y", "f")), strict=True)), key=lambda r: r[:3])
        model = fit([np.frombuffer(f, np.int32) for _, _, f in rows], np.array([y for _, y, _ in rows], np.int32), config)
        _, chosen, w0, w, v = model.sent()
        cells = [pa.array([chosen.tobytes()], pa.binary()), pa.array([w0]), pa.array([w.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.array([json.dumps(model.report)])]
        yield pa.RecordBatch.from_arrays(cells, ["chosen", "w0", "w", "v", "report"])

    rows = sample(docs, labels, label, config).mapInArrow(features, "id long, f binary, y int").repartition(1)
    got = rows.mapInArrow(fitted, "chosen binary, w0 double, w binary, v binary, report string").collect()  # one row of bounded size
    if not got:  # a sample that is known to be empty makes no task
        return fit([], np.zeros(0, np.int32), config)
    v = np.frombuffer(got[0]["v"]).reshape(-1, config.rank)
    return FMModel.of(bits, np.frombuffer(got[0]["chosen"], np.int32), got[0]["w0"], np.frombuffer(got[0]["w"]), v, json.loads(got[0]["report"]))


def score(docs: DataFrame, model: FMModel, featurize: Featurizer, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.sent())
    scored = docs.select("doc_id", "text").mapInArrow(_scorer(shared, featurize, ["doc_id"]), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: FMModel, featurize: Featurizer, threshold: float, above: bool) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold`` (``above``) or below it."""
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.sent())
    names = docs.columns
    whole = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index('text')}"
    run = _scorer(shared, featurize, list(whole.columns), text)
    scored = whole.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema) + ", score double")
    good = F.col("score") >= threshold
    return scored.where(good if above else ~good).drop("score").toDF(*names)


def _scorer(shared, featurize: Featurizer, columns: list[str], text: str = "text"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = FMModel.of(*shared.value)
        for batch in batches:
            texts = K.as_bytes(batch.column(text))
            z = [model.logits(*featurize(texts[a:b], model.hash_bits), b - a) for a, b in K.slices(texts)]
            scores = sigmoid(np.concatenate(z)) if z else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(scores, pa.float64())], [*columns, "score"])

    return run
