"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is the sequence of its leaf blocks (``html_blocks``). A block's features are its ancestor tags, the words of their
class and id attributes, its parent, its length, link share, punctuation and place; transitions depend on the pair of
labels and on whether both blocks have the same parent. All elements around a block count, at any depth. The field is trained by maximum likelihood on labelled pages
(``html_pages``) and decoded by Viterbi; blocks labelled main are joined in page order.

Text: character references are decoded, white space inside a block is one space, blocks are joined by one newline. A
line break is white space. Scripts, styles, comments, and the contents of template, noscript and iframe, which a page does not show
beside its text, are no blocks; formulas and drawings are text like any other. Headings inside the article belong to it.

Defined cases: null or empty html, and pages without main blocks, have the empty text; repeated rows are extracted
each; unclosed and unmatched tags are repaired as browsers do in the main; an unfinished tag at the end is dropped; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from echolex.llm.html_blocks import PLACES, Block, blocks, place
from echolex.llm.html_pages import training_pages
from echolex.llm.scratch import arrow_rows

DIMENSIONS = PLACES
_WORD = re.compile(r"[a-z]+")
_id = place


@functools.lru_cache(20_000)
def _path_features(inside: int, last: str | None) -> tuple[int, ...]:
    """Of all elements that a block stands in, and of the last one."""
    names, found = [], set()
    if last is not None:
        tag, _, words = last.partition(" ")
        names = [f"parent {tag}", *(f"parent word {w}" for w in _WORD.findall(words))]
    while inside:
        low = inside & -inside
        found.add(low.bit_length() - 1)
        inside ^= low
    return tuple(sorted(found | {_id(x) for x in names}))


@functools.lru_cache(2_000)
def _shape(length: int, linked: int, end: str, place: int, first: bool) -> tuple[int, ...]:
    return (_id("bias"), _id(f"length {length}"), _id(f"linked {linked}"), _id(f"end {end}"), _id(f"place {place}"), _id(f"first {first}"), _id(f"length {length} linked {linked}"))


def features(page: list[Block]) -> list[tuple[int, ...]]:
    out = []
    for i, b in enumerate(page):
        last = b.text[-1]
        end = last if last in ".?!:," else "other"
        shape = _shape(min(len(b.text).bit_length(), 11), 4 * b.linked // max(1, len(b.text)), end, 4 * i // len(page), i == 0)
        mark = (_id("copyright"),) if b.text[0] == "©" or b.text.startswith("Copyright") else ()
        out.append(_path_features(b.inside, b.path[-1] if b.path else None) + shape + mark)
    return out


def same_parent(page: list[Block]) -> list[int]:
    """1 where a block has the parent of the block before it (without the last element: siblings)."""
    return [0] + [int(a.above == b.above) for a, b in zip(page, page[1:], strict=False)]


class Field:
    """Weights: ``unary`` (features, 2 labels), ``pair`` (same parent or not, label before, label)."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not page:
            return []
        found = features(page)
        flat = np.fromiter((i for f in found for i in f), np.int64)
        begin = np.cumsum([0] + [len(f) for f in found][:-1])
        scores = np.add.reduceat(self.unary[flat], begin).tolist()
        pair, same = self.pair.tolist(), same_parent(page)
        back = []
        a, b = scores[0]
        for t in range(1, len(page)):
            w = pair[same[t]]
            a0, b0, a1, b1 = a + w[0][0], b + w[1][0], a + w[0][1], b + w[1][1]
            back.append((int(b0 > a0), int(b1 > a1)))
            a, b = max(a0, b0) + scores[t][0], max(a1, b1) + scores[t][1]
        labels = [int(b > a)]
        for x in reversed(back):
            labels.append(x[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = 80, rate: float = 0.1, l2: float = 1e-4) -> Field:
    """Maximum likelihood with Adam; expectations by forward and backward passes over all pages at once."""
    pages = [x for x in pages if x[0]]
    n, longest = len(pages), max(len(p) for p, _ in pages)
    rows, ids = [], []
    same, gold, there = (np.zeros((n, longest), np.int64) for _ in range(3))
    for i, (page, labels) in enumerate(pages):
        for t, f in enumerate(features(page)):
            rows += [i * longest + t] * len(f)
            ids += f
        same[i, : len(page)], gold[i, : len(page)], there[i, : len(page)] = same_parent(page), labels, 1
    rows, ids = np.array(rows), np.array(ids)
    params = [np.zeros((DIMENSIONS, 2)), np.zeros((2, 2, 2))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    each, total = np.arange(n), there.sum()

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, epochs + 1):
        unary, pair = params
        score = np.zeros((n * longest, 2))
        for y in (0, 1):
            score[:, y] = np.bincount(rows, unary[ids, y], n * longest)
        score = score.reshape(n, longest, 2)
        edge = pair[same]  # (n, longest, before, label)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            new = logsum(ahead[:, t - 1, :, None] + edge[:, t], 1) + score[:, t]
            ahead[:, t] = np.where(there[:, t, None] == 1, new, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = logsum(edge[:, t + 1] + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(there[:, t + 1, None] == 1, new, 0)
        z = logsum(ahead[:, -1], 1)
        p = np.exp(ahead + behind - z[:, None, None]) * there[:, :, None]
        p[each[:, None], np.arange(longest)[None, :], gold] -= there
        g_unary = np.stack([np.bincount(ids, p.reshape(-1, 2)[rows, y], DIMENSIONS) for y in (0, 1)], 1)
        both = np.exp(ahead[:, :-1, :, None] + edge[:, 1:] + (score + behind)[:, 1:, None, :] - z[:, None, None, None]) * there[:, 1:, None, None]
        np.add.at(both, (each[:, None], np.arange(longest - 1)[None, :], gold[:, :-1], gold[:, 1:]), -there[:, 1:].astype(float))
        g_pair = np.stack([(both * (same[:, 1:] == s)[:, :, None, None]).sum((0, 1)) for s in (0, 1)])
        for i, grad in enumerate((g_unary / total + l2 * unary, g_pair / total + l2 * pair)):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.99 * second[i] + 0.01 * grad * grad
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Field(*params)


def labelled(n: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """Training pages as blocks with labels: each block takes the label of the piece whose text it is."""
    out = []
    for page, pieces in training_pages(n, seed):
        found = blocks(page)
        wanted = [(b.text, y) for markup, y in pieces for b in blocks(markup)]
        if [b.text for b in found] == [x for x, _ in wanted]:
            out.append((found, [y for _, y in wanted]))
    return out


@functools.lru_cache(4)
def default_field(n: int = 600, seed: int = 11) -> Field:
    return train(labelled(n, seed))


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, y in zip(found, field.decode(found), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    arrow_rows(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast((field or default_field()).__dict__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(**shared.value)
        for batch in batches:
            texts = [main_text(x, own) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"]]).add("text", "string").add("n_chars", "long")
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
