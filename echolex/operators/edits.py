"""Edits of texts: which of overlapping ones to apply, applying them, and what they did to a reference."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolex.operators.groups import in_batches

DIAGONAL = T.ArrayType(T.StructType().add("i", "integer").add("j", "integer").add("same", "boolean"))


def heaviest(start: list[int], end: list[int], score: list[float]) -> list[int]:
    """Places of the half-open intervals that together score most without overlap; touching ones may both stay.

    Intervals are taken in order of (end, start); one is used only where that is better by more than 1e-12."""
    order = sorted(range(len(start)), key=lambda i: (end[i], start[i]))
    ends, best, link = [end[i] for i in order], [0.0], [(-1, 0)]
    for k, i in enumerate(order):
        before = bisect_right(ends, start[i], 0, k)
        used = best[before] + score[i]
        take = used > best[k] + 1e-12
        best.append(used if take else best[k])
        link.append((i, before) if take else (-1, k))
    chosen, k = [], len(order)
    while k:
        i, k = link[k]
        if i >= 0:
            chosen.append(i)
    return chosen[::-1]


def heaviest_of_each(begin: np.ndarray, start: np.ndarray, end: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of what ``heaviest`` takes of each group; groups stand one after another and begin at ``begin``. A step goes
    on by one interval in every group that has as many."""
    size = np.diff(np.append(begin, len(start)))
    group = np.repeat(np.arange(len(begin)), size)
    order = np.lexsort((start, end, group))
    _, rank = np.unique(np.concatenate([start, end]), return_inverse=True)
    wide = int(rank.max(initial=0)) + 1
    s, e = rank[: len(start)][order] + group * wide, rank[len(start) :][order] + group * wide
    k = np.arange(len(start)) - begin[group]
    before = np.minimum(np.searchsorted(e, s, "right") - begin[group], k)
    score, first = score[order], begin + np.arange(len(begin))  # a group has a sum more than intervals
    best, take = np.zeros(len(start) + len(begin)), np.zeros(len(start), bool)
    large = np.argsort(-size, kind="stable")
    many = np.searchsorted(-size[large], -np.arange(int(size.max(initial=0))), "left")  # groups with more intervals than each number
    for n, live in enumerate(many.tolist()):
        g = large[:live]
        i, to = begin[g] + n, first[g]
        used, old = best[to + before[i]] + score[i], best[to + n]
        take[i] = used > old + 1e-12
        best[to + n + 1] = np.where(take[i], used, old)
    chosen, g, at = [], np.flatnonzero(size), size[size > 0]
    while len(g):
        i = begin[g] + at - 1
        chosen.append(i[take[i]])
        at = np.where(take[i], before[i], at - 1)
        g, at = g[at > 0], at[at > 0]
    return order[np.sort(np.concatenate(chosen))] if chosen else np.zeros(0, np.int64)


def resolve_overlaps(edits: DataFrame) -> DataFrame:
    """The heaviest rows without overlap in each text; rows have doc_id, start, end, score and others. A task holds whole texts' edits."""

    def run(table: pa.Table, begin: np.ndarray) -> pa.Table:
        start, end, score = (table.column(c).to_numpy() for c in ("start", "end", "score"))
        return table.take(pa.array(heaviest_of_each(begin, start, end, score.astype(np.float64))))

    return in_batches(edits, "doc_id", run, edits.schema)


def edit_score(probability: Column, nd: Column, start: Column, end: Column) -> Column:
    """Confident, close and long edits first."""
    return probability + 0.5 * (1.0 - nd) + 0.10 * F.log1p(F.greatest(F.lit(0), end - start))


def splice(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, text with its edits (start, end, replacement, nd, tau and, where given, raw and max_raw; no overlaps) applied.
    An edit beyond a bound raises."""
    within = F.col("nd") <= F.col("tau") + 1e-9
    if {"raw", "max_raw"} <= set(edits.columns):
        within = within & (F.col("raw") <= F.col("max_raw") + 1e-9)
    bound = F.when(within, F.col("replacement")).otherwise(F.raise_error(F.lit("hard phonetic constraint violated")))
    own = edits.groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("start", "end", bound.alias("new"))))).alias("edits"))
    put = lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["new"], F.substring(t, e["end"] + 1, F.length(t)))
    joined = docs.select("doc_id", "text").join(own, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("edits").isNull(), F.col("text")).otherwise(F.aggregate("edits", F.col("text"), put)).alias("text"))


def _columns(masks: list[int], ones: int, rise: int, fall: int) -> Iterator[tuple[int, int, int]]:
    """Columns of the edit matrix as bits of whole numbers, a bit for each of a's places (Myers, 1999; Hyyro, 2003): where the
    distance is that of the place before in both texts, and where it rises and falls by one from the place before in a."""
    for mask in masks:
        level = ((((mask & rise) + rise) ^ rise) | mask | fall) & ones
        up = ((fall | ~(level | rise)) << 1 | 1) & ones
        down = (level & rise) << 1 & ones
        rise, fall = (down | ~(level | up)) & ones, up & level
        yield level, rise, fall


def diagonal(a: str, b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in both, and whether they are equal, of the characters that a cheapest alignment puts together.

    A column of the edit matrix is a few whole numbers with a bit for each character of ``a``. One column in sqrt(len(b)) is kept; those
    between are made again on the way back. So memory is len(a) * sqrt(len(b)) / 4 bytes: some 10 MB for texts of 120,000 characters."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    n, m = len(x), len(y)
    if not n or not m:
        return (np.zeros(0, np.int32),) * 3
    order = np.argsort(x, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(x[order]) != 0]))
    places: dict[int, int] = {}
    for own in np.split(order, begin[1:]):
        bits = np.zeros(n, np.uint8)
        bits[own] = 1
        places[int(x[own[0]])] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    masks, ones, step = [places.get(c, 0) for c in y.tolist()], (1 << n) - 1, max(1, int(m**0.5))
    kept, rise, fall = [], ones, 0
    for at in range(0, m, step):
        kept.append((rise, fall))
        for _, rise, fall in _columns(masks[at : at + step], ones, rise, fall):
            pass
    i, j, out = n, m, []
    for k in range(len(kept) - 1, -1, -1):
        first = k * step
        block = [(c[0], c[1]) for c in _columns(masks[first : first + step], ones, *kept[k])]
        while i and j > first:
            level, rise = block[j - 1 - first]
            same = bool(x[i - 1] == y[j - 1])
            if same or not level >> (i - 1) & 1:
                i, j = i - 1, j - 1
                out.append((i, j, same))
            elif rise >> (i - 1) & 1:
                i -= 1
            else:
                j -= 1
    found = np.array(out[::-1], np.int32).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


@F.arrow_udf(DIAGONAL)
def aligned(a: pa.Array, b: pa.Array) -> pa.Array:
    """Pairs of characters that an alignment of least cost matches or substitutes; among equal ones it prefers, from
    the end, these, then a's own characters, then b's."""
    pairs = [None if x is None or y is None else diagonal(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
    sizes = np.array([0 if p is None else len(p[0]) for p in pairs], np.int64)
    flat = [np.concatenate([np.zeros(0, np.int32), *(p[k] for p in pairs if p is not None)]) for k in range(3)]
    values = pa.StructArray.from_arrays([pa.array(flat[0], pa.int32()), pa.array(flat[1], pa.int32()), pa.array(flat[2].astype(bool))], ["i", "j", "same"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values, mask=pa.array([p is None for p in pairs], pa.bool_()))


def matched_places(reference: str, hypothesis: str) -> Column:
    """Places of the reference whose characters the hypothesis has."""
    return F.transform(F.filter(aligned(reference, hypothesis), lambda p: p["same"]), lambda p: p["i"])


WORD = 64  # bits of a column of short texts
TOGETHER = 2048  # pairs of short texts whose columns stand side by side


def _codes(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, WORD) of code points, and lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), WORD), pad, np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(WORD)[None, :] < size[:, None]] = flat
    return out, size


def _matched(a: list[str], b: list[str]) -> np.ndarray:
    """Of pairs of texts up to ``WORD`` long: a bit for each place of ``a`` that ``diagonal`` finds equal, all pairs a column at a time."""
    (x, i), (y, j) = _codes(a, 0xFFFFFFFE), _codes(b, 0xFFFFFFFF)
    n, one = len(a), np.uint64(1)
    ones = np.where(i == WORD, ~np.uint64(0), (one << np.minimum(i, WORD - 1).astype(np.uint64)) - one)
    rise, fall, levels, rises = ones.copy(), np.zeros(n, np.uint64), [], []
    for k in range(int(j.max(initial=0))):
        mask = np.packbits(x == y[:, k : k + 1], axis=1, bitorder="little").view("<u8")[:, 0]
        level = ((((mask & rise) + rise) ^ rise) | mask | fall) & ones
        up = ((fall | ~(level | rise)) << one | one) & ones
        down = (level & rise) << one & ones
        rise, fall = (down | ~(level | up)) & ones, up & level
        levels.append(level)
        rises.append(rise)
    out, at = np.zeros(n, np.uint64), np.flatnonzero((i > 0) & (j > 0))
    levels, rises = np.array(levels).reshape(-1, n), np.array(rises).reshape(-1, n)
    while len(at):
        own, col = i[at] - 1, j[at] - 1
        bit = own.astype(np.uint64)
        same = x[at, own] == y[at, col]
        both = same | (levels[col, at] >> bit & one == 0)
        out[at] |= same.astype(np.uint64) << bit
        left = ~both & (rises[col, at] >> bit & one == 1)
        i[at] -= both | left
        j[at] -= ~left
        at = at[(i[at] > 0) & (j[at] > 0)]
    return out


def _damage(reference: list[str], baseline: list[str], corrected: list[str]) -> np.ndarray:
    """(texts, 3) of correct before, broken and fixed places."""
    out = np.zeros((len(reference), 3), np.int64)
    longest = np.array([max(map(len, t)) for t in zip(reference, baseline, corrected, strict=True)] or [0])
    short = np.flatnonzero(longest[: len(reference)] <= WORD)
    for a in range(0, len(short), TOGETHER):
        own = short[a : a + TOGETHER]
        r, b, c = ([t[k] for k in own.tolist()] for t in (reference, baseline, corrected))
        before, after = _matched(r, b), _matched(r, c)
        out[own] = np.stack([np.bitwise_count(z) for z in (before, before & ~after, after & ~before)], 1)
    for k in np.flatnonzero(longest[: len(reference)] > WORD).tolist():
        before, after = (i[same.astype(bool)] for i, _, same in (diagonal(reference[k], t[k]) for t in (baseline, corrected)))
        kept = len(np.intersect1d(before, after, assume_unique=True))
        out[k] = len(before), len(before) - kept, len(after) - kept
    return out


@F.arrow_udf(T.StructType().add("correct_before", "long").add("broken", "long").add("fixed", "long"))
def damage(reference: pa.Array, baseline: pa.Array, corrected: pa.Array) -> pa.Array:
    """How many characters of a reference a hypothesis has, and how many of them a correction breaks and adds; null where a text
    that this needs is null. Places themselves stay in the row's call."""
    rows = [x.to_pylist() for x in (reference, baseline, corrected)]
    counts = _damage(*([x or "" for x in r] for r in rows))
    none = [np.array([x is None for x in r], bool) for r in rows]
    first, rest = none[0] | none[1], none[0] | none[1] | none[2]
    columns = [pa.array(counts[:, k], pa.int64(), mask=m) for k, m in ((0, first), (1, rest), (2, rest))]
    return pa.StructArray.from_arrays(columns, ["correct_before", "broken", "fixed"])


def char_damage(rows: DataFrame) -> DataFrame:
    """One row for all (reference, baseline, corrected): correct_before, broken, fixed characters, damage_rate (0 of none)."""
    own = rows.select(damage("reference", "baseline", "corrected").alias("d"))
    sums = own.agg(*(F.coalesce(F.sum(f"d.{c}"), F.lit(0)).cast("long").alias(c) for c in ("correct_before", "broken", "fixed")))
    return sums.withColumn("damage_rate", F.coalesce(F.try_divide(F.col("broken").cast("double"), F.col("correct_before")), F.lit(0.0)))


def classify_edit(reference: Column, before: Column, after: Column) -> Column:
    """repair, damage or neutral, by the edit distance to the reference."""
    b, a = F.levenshtein(reference, before), F.levenshtein(reference, after)
    return F.when(a < b, "repair").when(a > b, "damage").otherwise("neutral")


def classify_span_edits(rows: DataFrame) -> DataFrame:
    """``rows`` (reference, baseline, start, end, replacement) with ``outcome``: no-op, damage, repair or neutral.

    The span is held against the part of the reference that it aligns to, where their lengths are about equal; else, or
    if neither text equals that part, the whole texts' distances decide."""
    inside = F.filter(aligned("baseline", "reference"), lambda p: (p["i"] >= F.col("start")) & (p["i"] < F.col("end")))
    own = rows.withColumn("_j", F.transform(inside, lambda p: p["j"])).withColumn("_old", F.substring("baseline", F.col("start") + 1, F.col("end") - F.col("start")))
    own = own.withColumn("_ref", F.when(F.size("_j") > 0, F.substring("reference", F.array_min("_j") + 1, F.array_max("_j") - F.array_min("_j") + 1)))
    trusted = F.abs(F.length("_ref") - F.length("_old")) <= F.greatest(F.lit(1), F.floor(F.length("_old") / 2))
    after = F.concat(F.substring("baseline", F.lit(1), F.col("start")), "replacement", F.substring("baseline", F.col("end") + 1, F.length("baseline")))
    outcome = F.when(F.col("replacement") == F.col("_old"), "no-op").when(trusted & (F.col("_old") == F.col("_ref")), "damage").when(trusted & (F.col("replacement") == F.col("_ref")), "repair")
    return own.withColumn("outcome", outcome.otherwise(classify_edit(F.col("reference"), F.col("baseline"), after))).drop("_j", "_old", "_ref")
