"""The trained gate: a calibrated logistic classifier over twenty features of a proposal.

Scoring is a Column expression. ``fit`` collects the features of at most ``max_rows`` labelled proposals (those with the
smallest hash of their key), because twenty weights need no more; the bound is a parameter. ``fit_all`` descends over all of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolex.operators import measures
from echolex.sources.checkpoints import written

# The features, in the order in which a gate's weights stand.
FEATURES = (
    "norm_distance margin exact_reading_match span_morae term_morae mora_ratio span_chars n_candidates unknown_ratio reading_ambiguity log_term_weight "
    "span_has_kanji span_has_katakana span_all_hiragana span_is_glossary_surface span_is_common_word span_is_proper_noun boundary_left boundary_right lm_delta"
).split()


@dataclass(frozen=True)
class Gate:
    weights: tuple[float, ...] = (0.0,) * len(FEATURES)
    bias: float = 0.0
    threshold: float = 0.5
    platt: tuple[float, float] = (1.0, 0.0)
    mean: tuple[float, ...] = (0.0,) * len(FEATURES)
    scale: tuple[float, ...] = (1.0,) * len(FEATURES)
    metadata: dict = field(default_factory=dict)

    def probability(self, features: dict[str, Column]) -> Column:
        """Of an edit to be safe; 0 for a span that is a glossary surface. Without weights: the hand-set gate's."""
        if not any(self.weights):
            return measures.heuristic_gate(features)
        z = F.lit(0.0)
        for name, w, m, s in zip(FEATURES, self.weights, self.mean, self.scale, strict=True):
            z = z + (features.get(name, F.lit(0.0)) - m) / (s or 1.0) * w
        a, b = self.platt
        p = 1 / (1 + F.exp(-(a * (z + self.bias) + b)))
        return F.when(features.get("span_is_glossary_surface", F.lit(0.0)) >= 1.0, 0.0).otherwise(p)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as out:
            json.dump({"version": 1, "kind": "logistic", "features": FEATURES} | asdict(self), out, ensure_ascii=False, indent=2)


def load(path: str) -> Gate:
    """A saved gate; one with other features, or in another order, is an error."""
    with open(path, encoding="utf-8") as file:
        own = json.load(file)
    if own.get("features") and list(own["features"]) != FEATURES:
        raise ValueError(f"the gate's features are {own['features']}, not {FEATURES}")
    n = len(FEATURES)
    return Gate(tuple(own["weights"]), own.get("bias", 0.0), own.get("threshold", 0.5), tuple(own.get("platt", (1.0, 0.0))), tuple(own.get("mean", [0.0] * n)), tuple(own.get("scale", [1.0] * n)), own.get("metadata", {}))


@dataclass(frozen=True)
class FitConfig:
    l2: float = 1.0
    epochs: int = 400
    rate: float = 0.5
    negative_weight: float = 3.0
    held_out: float = 0.25
    calibration_epochs: int = 600
    calibration_rate: float = 0.05
    seed: int = 0
    max_rows: int = 200_000


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def fit(decisions: DataFrame, key: list[str], config: FitConfig = FitConfig(), gate: Gate = Gate(), held: Column | None = None) -> Gate:
    """A gate trained on rows with ``features`` (a struct) and ``label`` (1: repair), in order of ``key``.

    Gradient descent on rows weighted by class, then the scores' calibration on rows held out (from eight on): those that ``held`` says, else
    drawn. At most ``max_rows`` rows come to the driver; ``fit_all`` takes all."""
    own = [F.coalesce(F.col(f"features.{n}").cast("double"), F.lit(0.0)).alias(n) for n in FEATURES]
    kept = (F.lit(False) if held is None else held).alias("_held")
    chosen = decisions.select(*key, *own, F.col("label").cast("double").alias("label"), kept).orderBy(F.xxhash64(*key), *key).limit(config.max_rows)
    table = chosen.toPandas().sort_values(key, kind="stable")
    if not len(table):
        raise ValueError("no decisions to train on")
    x, y = table[FEATURES].to_numpy(np.float64), table["label"].to_numpy()
    order = np.random.default_rng(config.seed).permutation(len(y))
    aside = max(1, int(len(y) * config.held_out)) if len(y) > 8 else 0
    held, used = (order[:aside], order[aside:]) if held is None else (np.flatnonzero(table["_held"]), np.flatnonzero(~table["_held"]))
    mean, scale = x[used].mean(0), x[used].std(0)
    scale[scale < 1e-8] = 1.0
    z, t = (x[used] - mean) / scale, y[used]
    weight = np.where(t > 0.5, 1.0, config.negative_weight)
    weight /= weight.mean()
    w, b = np.zeros(len(FEATURES)), 0.0
    for epoch in range(config.epochs):
        wrong = (_sigmoid(z @ w + b) - t) * weight
        step = config.rate / (1 + 0.01 * epoch)
        w, b = w - step * (z.T @ wrong + config.l2 * w) / len(t), b - step * wrong.mean()
    a, c = 1.0, 0.0
    if len(held) >= 8:
        s = (x[held] - mean) / scale @ w + b
        for _ in range(config.calibration_epochs):
            wrong = _sigmoid(a * s + c) - y[held]
            a, c = a - config.calibration_rate * float((wrong * s).mean()), c - config.calibration_rate * float(wrong.mean())
    p = _sigmoid(a * ((x - mean) / scale @ w + b) + c)
    report = {"n_train": len(t), "n_positive": int(y.sum()), "accuracy": float(((p >= 0.5) == (y > 0.5)).mean()), "log_loss": float(-np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)))}
    return replace(gate, weights=tuple(w.tolist()), bias=float(b), platt=(float(a), float(c)), mean=tuple(mean.tolist()), scale=tuple(scale.tolist()), metadata=gate.metadata | {"training": report})


WIDTH = len(FEATURES)


def _blocks(decisions: DataFrame, key: list[str], held: Column) -> DataFrame:
    """Features, labels and whether rows are held out, a row for each batch of decisions, written once: each round reads them."""
    own = [F.coalesce(F.col(f"features.{n}").cast("double"), F.lit(0.0)).alias(n) for n in FEATURES]
    rows = decisions.select(*own, F.col("label").cast("double").alias("label"), held.cast("double").alias("held"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
                yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["table"])

    return written(rows.mapInArrow(pack, "table binary"))


def _summed(blocks: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``of(features, labels, held)``, a vector: each task's own first, then those of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column(0).to_pylist():
                table = np.frombuffer(value, np.float64).reshape(-1, WIDTH + 2)
                own = of(table[:, :WIDTH], table[:, WIDTH], table[:, WIDTH + 1] > 0)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    rows = blocks.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])


def fit_all(decisions: DataFrame, key: list[str], config: FitConfig = FitConfig(), gate: Gate = Gate(), held: Column | None = None) -> Gate:
    """As ``fit``, on all rows, however many: each round is a Spark job that adds up the tasks' gradients, and only sums of as many
    numbers as there are features come to the driver.

    ``held``: which rows are kept for the calibration; as a rule ``held_out`` of them by a hash of their key. The weights are those of
    descending on the driver with the same rows held out, but for the order of sums."""
    if held is None:
        held = F.pmod(F.xxhash64(*key, F.lit(config.seed)), F.lit(1_000_000)) < int(config.held_out * 1_000_000)
    blocks = _blocks(decisions, key, held)
    first = _summed(blocks, lambda x, y, h: np.concatenate([[len(y), h.sum(), y.sum()], x[~h].sum(0), [(y[~h] > 0.5).sum()]]))
    if not len(first):
        raise ValueError("no decisions to train on")
    n, aside, positive = first[0], first[1], first[2]
    used = n - aside
    mean = first[3 : 3 + WIDTH] / used
    scale = np.sqrt(_summed(blocks, lambda x, y, h: ((x[~h] - mean) ** 2).sum(0)) / used)
    scale[scale < 1e-8] = 1.0
    heavy = config.negative_weight
    unit = (first[-1] + heavy * (used - first[-1])) / used  # the mean weight
    w, b = np.zeros(WIDTH), 0.0

    def gradient(w: np.ndarray, b: float) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        def of(x: np.ndarray, y: np.ndarray, h: np.ndarray) -> np.ndarray:
            z, t = (x[~h] - mean) / scale, y[~h]
            wrong = (_sigmoid(z @ w + b) - t) * np.where(t > 0.5, 1.0, heavy) / unit
            return np.concatenate([z.T @ wrong, [wrong.sum()]])

        return of

    for epoch in range(config.epochs):
        total = _summed(blocks, gradient(w, b))
        step = config.rate / (1 + 0.01 * epoch)
        w, b = w - step * (total[:-1] + config.l2 * w) / used, b - step * total[-1] / used
    a, c = 1.0, 0.0

    def calibration(a: float, c: float) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        def of(x: np.ndarray, y: np.ndarray, h: np.ndarray) -> np.ndarray:
            s = (x[h] - mean) / scale @ w + b
            wrong = _sigmoid(a * s + c) - y[h]
            return np.array([(wrong * s).sum(), wrong.sum()])

        return of

    if aside >= 8:
        for _ in range(config.calibration_epochs):
            total = _summed(blocks, calibration(a, c)) / aside
            a, c = a - config.calibration_rate * float(total[0]), c - config.calibration_rate * float(total[1])

    def measured(x: np.ndarray, y: np.ndarray, h: np.ndarray) -> np.ndarray:
        p = _sigmoid(a * ((x - mean) / scale @ w + b) + c)
        return np.array([((p >= 0.5) == (y > 0.5)).sum(), -(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)).sum()])

    right, loss = _summed(blocks, measured)
    report = {"n_train": int(used), "n_positive": int(positive), "accuracy": float(right / n), "log_loss": float(loss / n)}
    return replace(gate, weights=tuple(w.tolist()), bias=float(b), platt=(float(a), float(c)), mean=tuple(mean.tolist()), scale=tuple(scale.tolist()), metadata=gate.metadata | {"training": report})


def sweep(scored: DataFrame, steps: int = 100) -> DataFrame:
    """A row for each threshold 0..1: accepted, repairs, damages, neutrals, and the rates of correction (of all repairs), damage
    (of all spans that were right) and damaging edits, for rows (probability, outcome: repair, damage, neutral or no-op).

    Rows are first counted by the largest threshold that they reach, so what is summed over thresholds is small."""
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    # the largest i with probability >= i / steps, in doubles
    near = F.least(F.greatest(F.round(F.col("probability") * steps).cast("int"), F.lit(0)), F.lit(steps))
    reach = F.when(F.col("probability") >= near / steps, near).otherwise(near - 1)
    counts = scored.groupBy(reach.alias("reach")).agg(F.count("*").alias("n"), is_("repair").alias("repairs"), is_("damage").alias("damages"), is_("damage", "no-op").alias("right"))
    totals = counts.agg(F.sum("repairs").alias("all_repairs"), F.sum("right").alias("all_right"))
    thresholds = scored.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("i"))
    # at most steps + 1 rows on each side
    met = thresholds.join(F.broadcast(counts), F.col("reach") >= F.col("i"), "left").groupBy("i").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "repairs", "damages")))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return met.join(F.broadcast(totals)).select(
        (F.col("i") / steps).alias("threshold"), F.col("n").alias("accepted"), "repairs", "damages", (F.col("n") - F.col("repairs") - F.col("damages")).alias("neutrals"),
        rate("repairs", "all_repairs").alias("correction_rate"), rate("damages", "all_right").alias("damage_rate"), rate("damages", "n").alias("edit_damage_rate"),
    )


def pick_threshold(points: DataFrame, most_damage: float = 0.01, tolerance: float = 0.02) -> DataFrame:
    """One row, ``threshold``: the highest whose damage rate is allowed and whose correction rate is within ``tolerance`` of the
    best allowed one; without an allowed one, the highest of all (1 without any)."""
    allowed = F.col("damage_rate") <= most_damage
    best = points.agg(F.max(F.when(allowed, F.col("correction_rate"))).alias("best"))
    fair = allowed & ((F.col("best") <= 0) | (F.col("correction_rate") >= F.col("best") * (1 - tolerance) - 1e-9))
    return points.join(F.broadcast(best)).agg(F.coalesce(F.max(F.when(fair, F.col("threshold"))), F.max("threshold"), F.lit(1.0)).alias("threshold"))
