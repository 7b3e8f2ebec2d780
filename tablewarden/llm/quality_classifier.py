"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text are the hashed lower-cased words, their shapes and pairs of consecutive words; a pair of equal
words is one feature whatever the word ("back-reference"), as repetition is what matters there. Counts are divided by
their Euclidean norm, so long and short texts weigh the same. Scoring is a sparse dot product per text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.text import CACHE_ENTRIES, Vocabulary, examples, held_out, mix, numbered, owners, sampled_features, score_udf, smallest

SHAPES = ((re.compile(rb"[A-Z]"), b"A"), (re.compile(rb"[a-z\x80-\xff]"), b"a"), (re.compile(rb"[0-9]"), b"9"))
SAME_PAIR, EMPTY_TEXT = 0xFFFFFFFF, 0xFFFFFFFE


def shape(word: bytes) -> bytes:
    """Classes of the characters, runs written once: ``Ab-12`` is ``Aa-9``."""
    for pattern, mark in SHAPES:
        word = pattern.sub(mark, word)
    return re.sub(rb"(.)\1+", rb"\1", word)[:12]


class Features:
    """Hashed sparse features of a slice of texts: (columns, values, start of each text)."""

    def __init__(self, bits: int):
        self.mask, self.cache = np.uint64((1 << bits) - 1), {}

    def _hashes(self, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        cache, plain, shapes = self.cache, [], []
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        for word in vocabulary:
            known = cache.get(word)
            if known is None:
                known = cache[word] = (zlib.crc32(word.lower()), zlib.crc32(shape(word)))
            plain.append(known[0])
            shapes.append(known[1])
        return np.array(plain, np.uint64), np.array(shapes, np.uint64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vocabulary = Vocabulary()
        ids, ends = numbered(texts, vocabulary)
        n, owner = len(texts), owners(ends)
        plain, shapes = self._hashes(vocabulary)
        first = np.flatnonzero(owner[1:] == owner[:-1]) if len(ids) else np.empty(0, np.int64)
        left, right = plain[ids[first]], plain[ids[first + 1]]
        pairs = np.where(left == right, mix(np.uint64([SAME_PAIR]), 3), mix(left, right) + np.uint64(3))
        empty = np.flatnonzero(np.diff(ends) == 0)
        column = np.concatenate([mix(plain[ids], 1), mix(shapes[ids], 2), pairs, mix(np.full(len(empty), EMPTY_TEXT, np.uint64), 4)])
        text = np.concatenate([owner, owner, owner[first], empty]).astype(np.uint64)
        key, count = np.unique((text << np.uint64(32)) | (column & self.mask), return_counts=True)
        text, column = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        value = np.log1p(count)
        value /= np.sqrt(np.bincount(text, weights=value * value, minlength=n))[text]
        return column, value, np.searchsorted(text, np.arange(n + 1))


@dataclass(frozen=True)
class QualityModel:
    """Weights over ``2**bits`` hashed features and a bias."""

    weights: np.ndarray
    bias: float
    bits: int

    def scorer(self):
        features = Features(self.bits)

        def score(texts: list[str]) -> np.ndarray:
            column, value, ends = features(texts)
            text = np.repeat(np.arange(len(texts)), np.diff(ends))
            z = self.bias + np.bincount(text, weights=self.weights[column] * value, minlength=len(texts))
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return score

    def column(self, text: Column) -> Column:
        """Score in (0, 1) of each text; empty and null texts get that of a text without words."""
        return score_udf(self.scorer)(text)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """Per-coordinate FTRL-proximal over (label, columns, values), in a fixed pseudo-random order."""
    size = (1 << bits) + 1  # the last coordinate is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weight(c: np.ndarray) -> np.ndarray:
        zc = z[c]
        return np.where(np.abs(zc) <= l1, 0.0, -(zc - np.sign(zc) * l1) / ((beta + np.sqrt(n[c])) / alpha + l2))

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, columns, values = rows[i]
            c, v = np.append(columns, size - 1), np.append(values, 1.0)
            w = weight(c)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -30, 30))) - label) * v
            sigma = (np.sqrt(n[c] + g * g) - np.sqrt(n[c])) / alpha
            z[c] += g - sigma * w
            n[c] += g * g
    w = weight(np.arange(size))
    return w[:-1].astype(np.float32), float(w[-1])


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rows_per_class: int = 3000,
    bits: int = 17,
    epochs: int = 5,
    alpha: float = 0.3,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.05,
) -> QualityModel:
    """Fits the model on at most ``rows_per_class`` labelled rows of each class outside the held-out fold.

    The sample is the ids with the smallest hash, so it is the same however the tables are partitioned. Executors turn
    the sampled texts (whole ones) into sparse features; the driver receives only those of the bounded sample, one
    row for each sampled id and class: of rows with one id the text with the least hash. An id that is labelled 0 and 1 is an example of both. Rows
    whose label is null, or neither 0 nor 1, are ignored. With one class only, or no labels, the model's score is the
    share of label 1 (0.5 without labels).
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    sample = None
    for y in (0, 1):
        part = smallest(known.where(F.col("y") == y), "id", rows_per_class).withColumn("y", F.lit(y))
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def make():
        features = Features(bits)

        def rows_of(part: list[str]) -> list[tuple]:
            column, value, ends = features(part)
            return [(column[a:b], value[a:b].astype(np.float32)) for a, b in zip(ends[:-1], ends[1:], strict=True)]

        return rows_of

    found = examples(sampled_features(texts, "y", make, {"columns": pa.list_(pa.int32()), "values": pa.list_(pa.float32())}))
    rows = [(y, columns, values) for y, _, columns, values in sorted(found, key=lambda row: (row[1], row[0]))]
    ys = [y for y, _, _ in rows]
    if len(set(ys)) < 2:
        share = min(max(float(np.mean(ys)) if ys else 0.5, 1e-6), 1 - 1e-6)
        return QualityModel(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))), bits)
    weights, bias = ftrl(rows, bits, epochs, alpha, beta, l1, l2)
    share = known.agg(F.avg("y")).first()[0]  # the sample's classes are balanced, the labels' are not
    share, sampled = min(max(share, 1e-3), 1 - 1e-3), float(np.mean(ys))
    bias += float(np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)))
    return QualityModel(weights, bias, bits)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold), one row per input row; other columns are ignored.

    A null or empty text has the score of a text without words, a very long one is scored whole, equal texts have equal
    scores, a row without an id is not held out; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), model.column(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
