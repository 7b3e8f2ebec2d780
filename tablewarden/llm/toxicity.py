"""Toxicity: non-negative positive-unlabelled learning.

A text's features are the hashed lower-cased words (letters and digits) and the first four and five characters of
longer words, each present or not. Confirmed toxic texts are the positives; a sample of all texts, labels unseen, is
the unlabelled set. With class prior p the risk is ``p * R_p(+) + max(0, R_u(-) - p * R_p(-))``: when the corrected
negative part falls below zero, the step is taken the other way, so the model cannot profit from memorising positives.
A text's logit is a bias plus the weights of its few strongest features, as a few words make a text toxic however
long it is. Weights are never negative: no word makes up for an insult.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.text import CACHE_ENTRIES, examples, held_out, sampled_features, score_udf, smallest

WORD = re.compile(r"\w+")
#: Features that count towards a text's logit.
STRONGEST = 3


class Presence:
    """Distinct hashed features of each text: word, first four and first five characters."""

    def __init__(self, bits: int):
        self.mask, self.cache = (1 << bits) - 1, {}

    def _of(self, word: str) -> tuple[int, ...]:
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
            raw = [word] + [f"{word[:n]}~" for n in (4, 5) if len(word) > n]
            known = self.cache[word] = tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) & self.mask for x in raw)
        return known

    def __call__(self, text: str) -> np.ndarray:
        found = [c for word in set(WORD.findall(text.lower())) for c in self._of(word)]
        return np.unique(np.array(found, np.int64))


def strongest(weights: np.ndarray, columns: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, text of each) of the ``STRONGEST`` largest positive weights of each text; ties to smaller columns."""
    w = weights[columns]
    good = np.flatnonzero(w > 0)
    text = np.searchsorted(ends, good, "right") - 1
    order = np.lexsort((columns[good], -w[good], text))
    text, good = text[order], good[order]
    top = np.arange(len(text)) - np.searchsorted(text, text) < STRONGEST
    return columns[good[top]], text[top]


def logits(weights: np.ndarray, bias: float, columns: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bias plus the strongest weights of each text."""
    column, text = strongest(weights, columns, ends)
    return bias + np.bincount(text, weights=weights[column], minlength=len(ends) - 1)


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the hashed features that have one, a bias and the class prior that training assumed."""

    columns: np.ndarray
    values: np.ndarray
    bias: float
    bits: int
    prior: float

    def scorer(self):
        presence, weights = Presence(self.bits), np.zeros(1 << self.bits, np.float32)
        weights[self.columns] = self.values

        def score(texts: list[str]) -> np.ndarray:
            rows = [presence(t) for t in texts]
            ends = np.cumsum([0, *map(len, rows)])
            z = logits(weights, self.bias, np.concatenate(rows), ends)
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return score

    def column(self, text: Column) -> Column:
        """Score in (0, 1) of each text; empty and null texts get that of a text without words."""
        return score_udf(self.scorer)(text)


def texts_with(rows: list[np.ndarray], size: int) -> np.ndarray:
    """Texts that hold each feature; a row has its features once."""
    out = np.zeros(size, np.int64)
    for columns in rows:
        out[columns] += 1
    return out


def start_weights(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, smoothing: float = 4.0, margin: float = 1.0) -> np.ndarray:
    """Smoothed log ratio of a feature's share of positives to that of negatives, the latter being the unlabelled share
    less what the prior gives to positives; less 1, and 0 where that is negative, so that chance features start off."""
    p, u = (texts_with(rows, size) / len(rows) for rows in (positive, unlabelled))
    negative = np.maximum(u - prior * p, 0) / (1 - prior)
    small = smoothing / len(positive)
    return np.maximum(np.log((p + small) / (negative + small)) - margin, 0)


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], bits: int, prior: float, epochs: int, rate: float, l1: float, batch: int = 256) -> tuple[np.ndarray, float]:
    """Minimises the non-negative risk with the logistic loss: AdaGrad steps on the strongest features of each text,
    with an L1 proximal step after each batch."""
    size = (1 << bits) + 1
    w, seen = np.zeros(size), np.full(size, 1e-2)
    w[:-1] = start_weights(positive, unlabelled, size - 1, prior)
    w[-1] = -3.0
    rng = np.random.default_rng(0)
    steps = max(1, (len(unlabelled) + batch - 1) // batch)

    def stack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ends = np.cumsum([0, *map(len, rows)])
        column, text = strongest(w, np.concatenate(rows).astype(np.int64), ends)
        return column, text, w[-1] + np.bincount(text, weights=w[column], minlength=len(rows))

    def soft(z: np.ndarray) -> np.ndarray:
        return np.logaddexp(0, z)

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for s in range(steps):
            p = [positive[p_order[i % len(p_order)]] for i in range(s * batch, s * batch + batch)]
            u = [unlabelled[i] for i in u_order[s * batch : (s + 1) * batch]]
            (pc, pt, zp), (uc, ut, zu) = stack(p), stack(u)
            if soft(zu).mean() - prior * soft(zp).mean() >= 0:
                gp, gu = -prior / len(p) * np.ones(len(p)), sigmoid(zu) / len(u)  # loss(+) - loss(-) has slope -1
            else:
                gp, gu = prior * sigmoid(zp) / len(p), -sigmoid(zu) / len(u)
            touched, at = np.unique(np.concatenate([pc, uc]), return_inverse=True)
            grad = np.zeros(len(touched))  # counts of nothing would be integers
            grad += np.bincount(at[: len(pc)], weights=gp[pt], minlength=len(touched)) + np.bincount(at[len(pc) :], weights=gu[ut], minlength=len(touched))
            touched, grad = np.append(touched, size - 1), np.append(grad, gp.sum() + gu.sum())
            touched, grad = touched[grad != 0], grad[grad != 0]
            seen[touched] += grad**2
            step = rate / np.sqrt(seen[touched])
            new = w[touched] - step * grad
            shrunk = np.maximum(new - step * l1, 0)
            w[touched] = np.where(touched == size - 1, new, shrunk)
    return w[:-1].astype(np.float32), float(w[-1])


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    positives: int = 2000,
    unlabelled: int = 6000,
    prior: float | None = None,
    bits: int = 20,
    epochs: int = 60,
    rate: float = 0.3,
    l1: float = 5e-4,
) -> ToxicityModel:
    """Fits on at most ``positives`` toxic and ``unlabelled`` other sampled texts outside the held-out fold.

    Both samples are the ids with the smallest hash. ``prior`` is the share of toxic texts; if not given, it is that
    among the labelled rows outside the held-out fold. Executors turn whole texts into features and only those of the
    bounded samples come to the driver, one row for each sampled id: of rows with one id the text with the least hash.
    An id that is labelled more than once is one positive if any of its labels is 1. Without positives or without unlabelled texts every score is the prior. Rows
    without an id or whose label is null, or neither 0 nor 1, teach nothing; a very long text is one row of features.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    if prior is None:
        prior = known.agg(F.avg("y")).first()[0]
    prior = min(max(0.1 if prior is None else float(prior), 1e-4), 1 - 1e-4)
    pos = smallest(known.where("y = 1"), "id", positives).withColumn("kind", F.lit(1))
    ids = docs.select(F.col(id_col).alias("id"))
    unl = smallest(ids.where(~held_out(F.col("id"))), "id", unlabelled).withColumn("kind", F.lit(0))
    sample = F.broadcast(pos.unionByName(unl))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id").select("id", "kind", "text")

    def make():
        presence = Presence(bits)
        return lambda part: [(presence(t),) for t in part]

    found = examples(sampled_features(texts, "kind", make, {"columns": pa.list_(pa.int32())}))
    groups = [[columns for k, _, columns in found if k == kind] for kind in (1, 0)]
    if not groups[0] or not groups[1]:
        return ToxicityModel(np.empty(0, np.int64), np.empty(0, np.float32), float(np.log(prior / (1 - prior))), bits, prior)
    weights, bias = fit_nnpu(*groups, bits, prior, epochs, rate, l1)
    kept = np.flatnonzero(weights)
    return ToxicityModel(kept, weights[kept], bias, bits, prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold), one row per input row; other columns are ignored.

    A null or empty text has the score of a text without words, a very long one is scored whole, equal texts have equal
    scores, a row without an id is not held out; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), model.column(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
