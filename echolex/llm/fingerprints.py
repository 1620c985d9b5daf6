"""Document fingerprints: MinHash by many universal hash permutations over word shingles, in vectorised numpy.

A text's shingles are its runs of ``k`` words (fewer words: the whole sequence), as 32-bit hashes x. Each permutation
is x -> a*x + b modulo 2**32 with odd a; its minimum, mixed, gives one byte of the fingerprint. The likeness of two
fingerprints is the share of equal bytes, less what chance makes equal (1/256). A text without words has the empty
fingerprint; two such are alike by 1, one of them and another text by 0.

``fingerprint_edits`` also compares each text with an edit that takes its end from the next document. Documents meet
their successors by ranges of doc_id: each range gets the first document of the next range besides its own rows, so
texts are shuffled once and no task holds more than a range.

``near_duplicates`` joins bands of the signatures in Spark and verifies Jaccard similarity on full sets, by the steps
of ``minhash``.

Defined cases: null text is empty; rows are in order of doc_id (null first), then of text, so that repeated ids have a
defined successor; after the last row comes the first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolex.llm import kernels as K
from echolex.llm import minhash
from echolex.llm.scratch import arrow_rows

PERMUTATIONS = 128
SHINGLE = 5
RANGE_BYTES = 16 << 20  # of texts in a range of doc_id
_rng = np.random.default_rng(271828)
_A = _rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def minima(unique: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation over a set of 64-bit hashes that is not empty."""
    x = (unique >> np.uint64(32)).astype(np.uint32)
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(x), 1024):
        value = x[begin : begin + 1024, None] * _A
        value += _B
        np.minimum(least, value.min(0), out=least)
    return K.mix(least.astype(np.uint64))


def signature(unique: np.ndarray, m: int = PERMUTATIONS) -> np.ndarray:
    """Sixteen bits of each minimum, as registers for ``minhash``."""
    if not len(unique):
        return np.full(m, minhash.EMPTY, np.uint16)
    return np.minimum((minima(unique) & np.uint64(0xFFFF)).astype(np.uint16), np.uint16(0xFFFE))[:m]


def fingerprint(unique: np.ndarray) -> bytes:
    return (minima(unique) & np.uint64(0xFF)).astype(np.uint8).tobytes() if len(unique) else b""


def likeness(a: bytes, b: bytes) -> float:
    if not a or not b:
        return float(a == b)
    share = float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())
    return max(0.0, (share - 1 / 256) / (1 - 1 / 256))


def edited(own: str, after: str) -> str:
    """``own`` with its last half (rounded down) replaced by as many code points from the start of ``after``."""
    half = len(own) // 2
    return own[: len(own) - half] + after[:half]


def _ranges(docs: DataFrame, partitions: int) -> DataFrame:
    """Columns target, halo, key, doc_id, text: rows dealt by ranges of doc_id, with each range's successor as halo."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"))
    keys = keyed.select("key")
    cuts = np.unique(np.array(keys.approxQuantile("key", [i / partitions for i in range(1, partitions)], 0.25 / partitions)))

    @F.pandas_udf("int")
    def home(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy().astype(np.float64), "right").astype(np.int32))

    # a row a range: at most ``partitions`` rows
    first = {int(x["target"]): int(x["key"]) for x in keys.groupBy(home("key").alias("target")).agg(F.min("key").alias("key")).collect()}
    order = sorted(first)
    before = {first[t]: order[i - 1] for i, t in enumerate(order)}
    starts = np.array(sorted(before), np.int64)
    prior = np.array([before[int(x)] for x in starts], np.int32)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def targets(key: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, key.to_numpy().astype(np.float64), "right")
        at = np.minimum(np.searchsorted(starts, key.to_numpy()), max(0, len(starts) - 1))
        return pd.Series([[int(t), int(prior[i])] if starts[i] == k else [int(t)] for t, i, k in zip(own, at, key, strict=True)])

    dealt = keyed.select(F.posexplode(targets("key")).alias("halo", "target"), "key", "doc_id", "text")
    return dealt.repartition(partitions, "target").sortWithinPartitions("target", "halo", "key", "text")


def fingerprint_edits(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    spark = docs.sparkSession
    arrow_rows(spark)
    if partitions is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # target, halo, id, text, fingerprint: it waits for its successor
        for batch in batches:
            texts = batch.column("text").to_pylist()
            prints = [fingerprint(x) for x in K.shingle_sets([x.encode() for x in texts], SHINGLE)]
            rows = list(zip(batch.column("target").to_pylist(), batch.column("halo").to_pylist(), batch.column("doc_id").to_pylist(), texts, prints, strict=True))
            done = [(x, y) for x, y in zip([held, *rows] if held else rows, rows if held else rows[1:], strict=False) if not x[1] and x[0] == y[0]]
            held = rows[-1] if rows else held
            edits = [edited(x[3], y[3]).encode() for x, y in done]
            new = [fingerprint(x) for x in K.shingle_sets(edits, SHINGLE)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[2] for x, _ in done], pa.int64()),
                    pa.array([len(x[3]) for x, _ in done], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
                    pa.array([x[4].hex() for x, _ in done], pa.string()),
                    pa.array([f.hex() for f in new], pa.string()),
                    pa.array([likeness(x[4], f) for (x, _), f in zip(done, new, strict=True)], pa.float64()),
                    pa.array([likeness(x[4], y[4]) for x, y in done], pa.float64()),
                ],
                names,
            )

    out = _ranges(docs, partitions).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


def near_duplicates(docs: DataFrame, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked by signature bands and verified Jaccard similarity.

    Bands of four values: a pair at 0.8 shares none of the 32 with a chance of 5e-8."""
    return minhash.near_duplicates(docs, minhash.MinHashConfig(k=SHINGLE, threshold=threshold, rows=4, bands=PERMUTATIONS // 4, make=signature))
