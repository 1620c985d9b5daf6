"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata (see ``fm``).

Structure statistics are shares of a text's bytes, words and lines (capitals, symbols, separators, digits, distinct
words, the commonest word, distinct lines, punctuation, mean word length); metadata is the text's own length in bytes
and words. Each is cut at fixed edges and enters as one present feature, so the machine learns which combinations mark
junk. Labels, lang, source and doc_id are no inputs. Scores of 0.3 or more predict label 1. Every case that ``fm``
defines holds here.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from echolex.llm import fm
from echolex.llm import kernels as K

CONFIG = fm.FMConfig(n_features=512, min_df=20)
THRESHOLD = 0.3

_SHARES = np.array([0.002, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])
_SIZES = 2.0 ** np.arange(1, 24)
_WORD_SIZES = np.array([1, 2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 14])


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_KINDS = [_class(bytes(range(65, 91))), _class(b"#$%&*@^~=+<>{}[]\\_/"), _class(b"|"), _class(b"!"), _class(b"0123456789"), _class(b".,;:?"), _class(b"\n"), _class(bytes(range(128, 256)))]


def _largest(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of distinct keys and the count of its commonest key."""
    distinct, most = np.zeros(n), np.zeros(n)
    if len(doc):
        order = np.lexsort((key, doc))
        d, k = doc[order], key[order]
        begin = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])]))
        counts = np.diff(np.concatenate([begin, [len(d)]]))
        distinct += np.bincount(d[begin], minlength=n)
        np.maximum.at(most, d[begin], counts)
    return distinct, most


def statistics(words: K.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a value for each text and the edges at which it is cut."""
    n, size = words.n, np.maximum(words.sizes, 1)
    stop = words.first + words.sizes
    out = []
    for kind in _KINDS:
        sums = np.concatenate([[0], np.cumsum(kind[words.raw])])
        out.append(((sums[stop] - sums[words.first]) / size, _SHARES))
    count = np.maximum(words.counts, 1)
    distinct, most = _largest(words.doc, words.hashes(), n)
    out += [(distinct / count, _SHARES), (most / count, _SHARES)]
    lines = np.ones(256, bool)
    lines[10] = False
    ends = words.raw == 10
    ends[stop] = True  # the blank after each text
    last = np.flatnonzero(ends)
    begin = np.concatenate([[0], last[:-1] + 1])
    doc = np.searchsorted(words.first, begin, "right") - 1
    some = last > begin
    line = words.hashes(begin[some], last[some])
    n_lines = np.maximum(np.bincount(doc[some], minlength=n), 1)
    distinct, _ = _largest(doc[some], line, n)
    out.append((distinct / n_lines, _SHARES))
    letters = np.bincount(words.doc, weights=words.end - words.start, minlength=n)
    out += [(letters / count, _WORD_SIZES), (words.counts.astype(float), _SIZES), (words.sizes.astype(float), _SIZES), (words.counts / n_lines, _SIZES)]
    return out


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    words = K.Words(texts, K.LETTERS)
    docs, ids = [words.doc], [words.hashes()]
    for i, (value, edges) in enumerate(statistics(words)):
        docs.append(np.arange(words.n))
        ids.append(K.mix(np.digitize(value, edges).astype(np.uint64) + np.uint64((i + 1) << 32)))
    return np.concatenate(docs), (np.concatenate(ids) >> np.uint64(64 - bits)).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, config: fm.FMConfig = CONFIG) -> fm.FMModel:
    return fm.train(docs, labels, "quality", features, config)


def score(docs: DataFrame, labels: DataFrame, config: fm.FMConfig = CONFIG) -> DataFrame:
    """doc_id, held_out, score, predicted (1: good) of every row."""
    return fm.score(docs, train(docs, labels, config), features, THRESHOLD)


def remove(docs: DataFrame, model: fm.FMModel) -> DataFrame:
    """``docs`` without the rows of low quality."""
    return fm.keep(docs, model, features, THRESHOLD, above=True)
