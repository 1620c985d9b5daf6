"""Toxicity: a factorisation machine over hashed terms (see ``fm``).

Terms are words of ASCII letters, digits and bytes of other characters, A-Z lower-cased, and the first four, five and
six bytes of longer words, so that inflected insults share a feature. Pairwise weights let a pair such as an insult
with a mention of a group count for more than its parts. Rows scored 0.5 or more are toxic. Every case that ``fm``
defines holds here.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from echolex.llm import fm
from echolex.llm import kernels as K

CONFIG = fm.FMConfig()
THRESHOLD = 0.5


def terms(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    words = K.Words(texts, K.LETTERS)
    length = words.end - words.start
    docs, ids = [words.doc], [words.hashes()]
    for n in (4, 5, 6):
        long = length > n
        docs.append(words.doc[long])
        ids.append(words.hashes(words.start[long], words.start[long] + n) ^ np.uint64(n << 40))
    return np.concatenate(docs), (np.concatenate(ids) >> np.uint64(64 - bits)).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, config: fm.FMConfig = CONFIG) -> fm.FMModel:
    return fm.train(docs, labels, "toxic", terms, config)


def score(docs: DataFrame, labels: DataFrame, config: fm.FMConfig = CONFIG) -> DataFrame:
    """doc_id, held_out, score, predicted (1: toxic) of every row."""
    return fm.score(docs, train(docs, labels, config), terms, THRESHOLD)


def remove(docs: DataFrame, model: fm.FMModel) -> DataFrame:
    """``docs`` without the rows that are toxic."""
    return fm.keep(docs, model, terms, THRESHOLD, above=False)
