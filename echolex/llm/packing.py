"""Best-fit packing of tokenised documents into sequences of a fixed length.

Lengths are whole numbers up to the capacity, so a count for each length (at most ``capacity`` rows) says all that
best-fit decreasing needs to know: the driver packs the counts, never documents. Open bins are kept by their remaining
capacity, and a segment tree over the capacities finds the tightest that is large enough in logarithmic time, for as
many equal pieces as fit there at once. The plan is a bounded list of runs ("pieces of length L with ranks a..b go to
bins from c on, m a bin, from offset o"), which tasks apply to whole partitions of pieces.

A piece's rank among equal lengths is its place in its partition plus the counts of earlier partitions, a sum over
(length, partition) counts; no task holds all pieces of a length.

Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``: the string of a special token in a text is that token.

Defined cases: null or empty text is the end token alone; documents longer than the capacity are cut, the last piece
being the rest; repeated rows are packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolex.llm import kernels as K
from echolex.llm.scratch import arrow_rows, cut


class SegmentTree:
    """Sums of open bins over remaining capacities 0..n-1; finds the smallest capacity >= a length with an open bin."""

    def __init__(self, n: int):
        self.size = 1 << max(1, (n - 1).bit_length())
        self.sums = [0] * (2 * self.size)

    def add(self, at: int, count: int) -> None:
        at += self.size
        while at:
            self.sums[at] += count
            at >>= 1

    def first(self, at: int) -> int | None:
        node = at + self.size
        if self.sums[node]:
            return at
        while node > 1:
            if not node & 1 and self.sums[node + 1]:
                node += 1
                while node < self.size:
                    node *= 2
                    if not self.sums[node]:
                        node += 1
                return node - self.size
            node >>= 1
        return None


@dataclass(frozen=True)
class Run:
    length: int
    rank: int  # of the first piece
    count: int
    bin: int  # the first bin
    each: int  # pieces a bin
    offset: int  # of the first piece in each bin


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Run]:
    """Packs ``counts[length]`` pieces of each length, longest first, each into the tightest open bin that holds it."""
    tree = SegmentTree(capacity + 1)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # remaining -> runs of bins (first, count)
    runs, bins = [], 0

    def put(remaining: int, first: int, count: int) -> None:
        if count and remaining:
            open_bins.setdefault(remaining, []).append((first, count))
            tree.add(remaining, count)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.first(length)
            if room is None:
                room, first, have = capacity, bins, -(-left // (capacity // length))
                bins += have
            else:
                first, have = open_bins[room].pop()
                tree.add(room, -have)
            each = room // length
            full = min(have, left // each)
            if full:
                runs.append(Run(length, rank, full * each, first, each, capacity - room))
                put(room - each * length, first, full)
            used, rest = full, left - full * each
            rank, left = rank + full * each, rest
            if rest and used < have:  # the last bin gets fewer
                runs.append(Run(length, rank, rest, first + used, rest, capacity - room))
                put(room - rest * length, first + used, 1)
                used, left = used + 1, 0
            put(room, first + used, have - used)
    return runs


_MARKS = ".,;:!?#$%&*|"
_LOWER = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_plain = re.compile(f"[a-z{_LOWER}]+").fullmatch


def _parts(word: str) -> tuple[str, ...]:
    """A blank-free string as parts that the tokenizer separates anyway: letters, and the marks after them.

    The tokenizer composes and lower-cases first: a string whose letters do not all stay letters by that (İ becomes i
    and a mark, which joins the marks after it), or that may hold a special token, is left whole."""
    letters = word.rstrip(_MARKS)
    if word.isascii():
        if letters == word or not letters.isalpha():
            return (word if "<|" in word else word.lower(),)
        return (letters.lower(), word[len(letters) :])
    if letters == word or not letters.isalpha() or not unicodedata.normalize("NFC", letters).lower().isalpha():
        return (word,)
    return (letters, word[len(letters) :])


@functools.lru_cache(2)
def _encoder(path: str, most: int = 500_000):
    """Token ids of texts as bytes of little-endian unsigned 32-bit numbers.

    The tokenizer lower-cases and splits at white space, and between letters and marks, before anything else, so a
    text's ids are those of its parts in order. Words are looked up once a batch; those met lately (``most`` to twice
    as many) are remembered across batches. Composed lower-case letters are what the tokenizer's first steps leave as
    they are, so such parts go to its merges at once, in its alphabet of bytes."""
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    merges, alphabet = tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    spelled = {ord(c): alphabet.pre_tokenize_str(c)[0][0] for c in _LOWER}
    known: dict[str, bytes] = {"": b""}
    older: dict[str, bytes] = {}

    def learn(words: list[str]) -> None:
        nonlocal known, older
        if len(known) > most:
            known, older = {"": b""}, known
        words = [w for w in words if w not in known]
        known.update((w, older[w]) for w in words if w in older)
        new = {w: _parts(w) for w in words if w not in older}
        missing = {p for parts in new.values() for p in parts if p not in known}
        rest = [p for p in missing if not _plain(p)]
        for part in missing.difference(rest):
            known[part] = array("I", [x.id for x in merges.tokenize(part.translate(spelled))]).tobytes()
        for part, got in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[part] = array("I", got.ids).tobytes()
        for word, parts in new.items():
            known[word] = b"".join(map(known.__getitem__, parts))

    def encode(texts: pa.Array) -> Iterator[memoryview]:
        rows = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words = rows.flatten().dictionary_encode()
        each = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        learn(each)
        ids = pa.array(list(map(known.__getitem__, each)), pa.large_binary()).take(words.indices)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
        at = ends[rows.offsets.to_numpy()]
        data = memoryview(ids.buffers()[2] or b"")
        for begin, end in itertools.pairwise(at.tolist()):
            yield data[begin:end]

    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with its partition and its rank among equal lengths there."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, ranks = _encoder(tokenizer), np.zeros(capacity + 1, np.int64)
        partition, tail = TaskContext.get().partitionId(), np.array([end], "<u4").tobytes()
        for batch in batches:
            rows, out = [], []
            for row, ids in enumerate(encode(batch.column("text"))):
                total = len(ids) // 4 + 1
                for i, start in enumerate(range(0, total, capacity)):
                    length = min(capacity, total - start)
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    out.append((i, start, length, zlib.crc32(tail, crc) if start + length == total else crc, ranks[length]))
                    ranks[length] += 1
                    rows.append(row)
            cols = np.array(out, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(cols[:, 0].astype(np.int32)), *(pa.array(cols[:, j]) for j in range(1, 5)), pa.array(np.full(len(cols), partition, np.int32))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "partition"],
            )

    schema = T.StructType([docs.schema["doc_id"]]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("rank", "long").add("partition", "integer")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    spark = docs.sparkSession
    cuts = cut(pieces(docs, tokenizer, capacity, end), "pieces")
    counts = cut(cuts.groupBy("partition", "length").agg(F.count("*").alias("n")), "counts")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("partition", "length", earlier.alias("base"))
    # at most ``capacity`` rows
    totals = {int(x["length"]): int(x["n"]) for x in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(best_fit_decreasing(totals, capacity), key=lambda r: (r.length, r.rank))
    shared = spark.sparkContext.broadcast(np.array([(r.length, r.rank, r.bin, r.each, r.offset) for r in runs], np.int64).reshape(-1, 5))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        longest = int(plan[:, 1].max()) + 1 if len(plan) else 1
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            # runs are in order of (length, rank); ranks past the last run's start stay within their length
            keys = plan[:, 0] * longest + plan[:, 1]
            at = np.searchsorted(keys, length * longest + np.minimum(rank, longest - 1), "right") - 1
            into = rank - plan[at, 1]
            sequence = plan[at, 2] + into // plan[at, 3]
            offset = plan[at, 4] + into % plan[at, 3] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = T.StructType([docs.schema["doc_id"]]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("sequence_id", "long").add("offset", "long")
    # the counts grow with the partitions: no broadcast, and a (partition, length) is a small key
    return cuts.join(base.hint("merge"), ["partition", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "base").mapInArrow(place, schema)
