"""Fill-in-middle transformation by a byte automaton.

One table-driven automaton reads a text's UTF-8 bytes. Its states are those of the sentinels' prefix tree together with
whether a unit (a line with its end) begins at the next byte; bytes of one effect form a class, continuation bytes one of
their own. Pass one runs it over all bytes and emits how often each transition was taken; units, code points and sentinels
are sums of these counts. Pass two finds the bytes at which the prefix and the middle end. A state depends only on the last
few bytes (the longest sentinel's length), so a slice of texts runs in many lanes at once, each warmed up on the bytes before
it. Texts above ``BLOCK`` bytes go through block by block; pass two then reads only the blocks that the cuts are in.

Forms: ``plain`` (the text as it is) for empty texts, texts with a sentinel, and those that the rate leaves out; ``psm`` and
``spm`` put the suffix before the middle, with the prefix first or second. Which, and where the cuts are, follows from the
SHA-256 of seed and doc_id alone, so a lost task gives the same output again.

Defined cases: a null text is empty; a null doc_id is written as nothing before it is hashed; rows that repeat a doc_id are
transformed each by its own text; an empty table gives no rows; other columns are not read. Texts are UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolex.llm.kernels import as_bytes, slices
from echolex.llm.scratch import arrow_rows

BLOCK = 1 << 22
END = 0xFF  # no byte of UTF-8; stands between texts


@dataclass(frozen=True)
class FimConfig:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    percent: int = 100  # of the texts that are rearranged
    spm_percent: int = 50  # of these
    seed: int = 7

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


@dataclass(frozen=True)
class Automaton:
    """``table[state * classes + class]`` is the next state; a transition's number is that place in the table."""

    sentinels: tuple[bytes, ...]

    @cached_property
    def _built(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        prefixes = {s[:n] for s in self.sentinels for n in range(len(s) + 1)}
        states, table, at = [(b"", True)], [], 0  # (longest suffix read that a sentinel begins with, does a unit begin here)
        while at < len(states):
            seen, row = states[at][0], []
            for byte in range(256):
                if byte == END:
                    row.append(0)
                    continue
                own = seen + bytes([byte])
                while own not in prefixes:
                    own = own[1:]
                to = (own, byte == 0x0A)
                if to not in states:
                    states.append(to)
                row.append(states.index(to))
            table.append(row)
            at += 1
        full = np.array(table)
        byte = np.arange(256)
        kinds = np.vstack([full, (byte & 0xC0) == 0x80, byte == END])
        columns, classes = np.unique(kinds, axis=1, return_inverse=True)
        wide = columns.shape[1]
        hit = np.array([any(own.endswith(s) for s in self.sentinels if s) for own, _ in states])
        begins = np.array([new for _, new in states])
        end, lead = columns[-1].astype(bool), ~columns[-2].astype(bool) & ~columns[-1].astype(bool)
        effects = np.zeros((3, len(states) * wide), bool)  # of a transition: it begins a unit, is a code point, ends a sentinel
        for s in range(len(states)):
            for c in range(wide):
                effects[:, s * wide + c] = begins[s] & ~end[c], lead[c], hit[columns[s, c]]
        return columns[: len(states)].ravel().astype(np.uint16), classes.ravel().astype(np.uint16), effects, begins, wide

    @property
    def effects(self) -> np.ndarray:
        return self._built[2]

    def run(self, raw: np.ndarray, before: bytes = b"") -> np.ndarray:
        """The number of the transition that each byte takes; ``before`` holds the bytes ahead of them (none: a text begins)."""
        table, classes, _, _, wide = self._built
        memory, n = max(1, *map(len, self.sentinels)), len(raw)
        lanes = max(1, min(4096, n // 256))
        steps = -(-n // lanes) if n else 0
        padded = np.full(memory + lanes * steps, END, np.uint8)
        padded[memory : memory + n] = raw
        if before := before[-memory:]:
            padded[memory - len(before) : memory] = np.frombuffer(before, np.uint8)
        kinds = classes[padded]
        state = np.zeros(lanes, np.uint16)
        for t in range(memory):
            state = table[state * wide + kinds[t : t + lanes * steps : steps][:lanes]] if steps else state
        own = np.ascontiguousarray(kinds[memory:].reshape(lanes, steps).T)
        for t in range(steps):
            own[t] += state * wide
            state = table[own[t]]
        return own.T.ravel()[:n]


def _short(texts: list[bytes], draws: list[tuple[int, int]], machine: Automaton) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(units, sentinels, place and code points at the end of the prefix, the same of the middle) of each text of a slice."""
    effects = machine.effects
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    taken = machine.run(np.frombuffer(bytes([END]).join([*texts, b""]), np.uint8))
    doc = np.repeat(np.arange(len(texts)), sizes + 1)
    width = effects.shape[1]
    counts = np.bincount(doc * width + taken, minlength=len(texts) * width).reshape(len(texts), width)
    units, hits = (counts @ effects[i].astype(np.int64) for i in (0, 2))
    begins, lead, unit = np.flatnonzero(effects[0][taken]), effects[1][taken], np.concatenate([[0], np.cumsum(units)])
    for i, draw in enumerate(draws):
        out = [int(units[i]), int(hits[i])]
        for k in sorted(d % (int(units[i]) + 1) for d in draw):
            place = int(begins[unit[i] + k] - first[i]) if k < units[i] else int(sizes[i])
            out += [place, int(np.count_nonzero(lead[first[i] : first[i] + place]))]
        yield tuple(out)


def _long(text: bytes, draw: tuple[int, int], machine: Automaton) -> tuple[int, int, int, int, int, int]:
    """The same of one text, with no more than a block's transitions in memory."""
    effects, width = machine.effects, machine.effects.shape[1]
    blocks = range(0, len(text), BLOCK)
    run = lambda at: machine.run(np.frombuffer(text, np.uint8, min(BLOCK, len(text) - at), at), text[max(0, at - 64) : at])
    counts = np.array([np.bincount(run(at), minlength=width) for at in blocks])
    each = counts @ effects.T.astype(np.int64)  # units, code points and sentinels of each block
    units, hits = int(each[:, 0].sum()), int(each[:, 2].sum())
    out = [units, hits]
    for k in sorted(d % (units + 1) for d in draw):
        if k == units:
            out += [len(text), int(each[:, 1].sum())]
            continue
        b = int(np.searchsorted(np.cumsum(each[:, 0]), k, "right"))
        taken = run(blocks[b])
        place = int(np.flatnonzero(effects[0][taken])[k - int(each[:b, 0].sum())])
        out += [blocks[b] + place, int(each[:b, 1].sum()) + int(np.count_nonzero(effects[1][taken[:place]]))]
    return tuple(out)


def arranged(texts: list[bytes], draws: list[tuple[int, int, int, int]], config: FimConfig) -> Iterator[tuple[int, str, int | None, int | None, bytes]]:
    """(units, form, code points of the prefix and of the middle, output) of each text; ``draws``: its four random numbers."""
    machine = Automaton(tuple(s.encode() for s in config.sentinels))
    p, s, m = machine.sentinels
    for begin, end in slices(texts):
        own = [d[:2] for d in draws[begin:end]]
        long = end - begin == 1 and len(texts[begin]) > BLOCK
        found = [_long(texts[begin], own[0], machine)] if long else _short(texts[begin:end], own, machine)
        for text, (_, _, h3, h4), (units, hits, a, chars_a, b, chars_b) in zip(texts[begin:end], draws[begin:end], found, strict=True):
            if not text or hits or h3 % 100 >= config.percent:
                yield units, "plain", None, None, text
            elif h4 % 100 < config.spm_percent:
                yield units, "spm", chars_a, chars_b - chars_a, b"".join([s, text[b:], p, text[:a], m, text[a:b]])
            else:
                yield units, "psm", chars_a, chars_b - chars_a, b"".join([p, text[:a], s, text[b:], m, text[a:b]])


def fill_in_middle(docs: DataFrame, config: FimConfig = FimConfig()) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for every row of ``docs`` (doc_id, text)."""
    arrow_rows(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{config.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            draws = list(zip(*(batch.column(f"h{i}").to_pylist() for i in range(4)), strict=True))
            texts, done = as_bytes(batch.column("text")), 0
            for begin, end in slices(texts, 1 << 26):  # a batch of long texts goes out in parts
                rows = list(zip(*arranged(texts[begin:end], draws[begin:end], config), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, end - begin), *map(pa.array, rows, kinds)], names)
                done = end

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", *map(draw, range(4))).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return rows.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, config: FimConfig = FimConfig()) -> Column:
    """The text that ``output`` was made from: its parts are taken apart at the sentinels and put in order."""
    p, s, m = config.sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(one) + len(second) + 1, F.length(rest))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substring(rest, F.length(two) + len(m) + 1, F.length(rest))

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def digests(docs: DataFrame, config: FimConfig = FimConfig()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of the output and of the text restored from it."""
    rows = fill_in_middle(docs, config)
    back = restored(F.col("output"), F.col("form"), config)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def oracle_sql(config: FimConfig = FimConfig()) -> str:
    p, s, m = config.sentinels
    draws = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{config.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS l, {draws} FROM d),
c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM u),
p AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR h3 % 100 >= {config.percent} THEN 'plain' WHEN h4 % 100 < {config.spm_percent} THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(l[1:a], '') AS x, array_to_string(l[a + 1:b], '') AS y, array_to_string(l[b + 1:], '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || x || '{s}' || z || '{m}' || y ELSE '{s}' || z || '{p}' || x || '{m}' || y END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE x || y || z END) AS restored_sha256 FROM p"""
