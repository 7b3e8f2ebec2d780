"""Quality rules: length-normalised log-likelihood ratio of hashed n-grams, after a few fixed text rules.

Two multinomials over ``2**bits`` hashed word n-grams (words and pairs, lower-cased, with a pair of equal words as one
event): the target is counted on trusted texts, the raw one on every text of the corpus. A text is kept if the mean of
``log(target / raw)`` over its n-grams reaches a fixed threshold, so the verdict is the same for a text wherever it
stands. Raw counts come from all documents: each task sends one row per n-gram hash it has met.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.text import CACHE_ENTRIES, Vocabulary, mix, numbered, owners, per_text, slices
from tablewarden.operators.membership import possible, with_possible
from tablewarden.session import cut

SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Grams:
    """Hashed n-grams of a slice of texts: (hash of each, text of each). A text without words has none."""

    def __init__(self, bits: int):
        self.mask, self.cache = np.uint64((1 << bits) - 1), {}

    def __call__(self, vocabulary: Vocabulary, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        hashes = np.empty(len(vocabulary), np.uint64)
        for i, word in enumerate(vocabulary):
            known = self.cache.get(word)
            if known is None:
                known = self.cache[word] = zlib.crc32(word.lower())
            hashes[i] = known
        word = hashes[ids]
        first = np.flatnonzero(owner[1:] == owner[:-1])
        left, right = word[first], word[first + 1]
        pair = np.where(left == right, np.uint64(0), mix(left, right))
        grams = np.concatenate([mix(word, 1), mix(pair, 2)]) & self.mask
        return grams.astype(np.int64), np.concatenate([owner, owner[first]])


def repeated_words(ids: np.ndarray, owner: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window of ``window`` words found at least twice in that text, first included.

    Windows are numbered exactly, by doubling: equal numbers of two halves make equal numbers of the whole."""
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    number, position = ids.astype(np.int64), np.arange(len(ids))
    length = 1
    while length < window:
        inside = np.flatnonzero(owner[: max(0, len(number) - length)] == owner[length : len(number)]) if len(number) > length else np.empty(0, np.int64)
        both = np.full(len(number), -1, np.int64)
        ok = inside[(number[inside] >= 0) & (number[inside + length] >= 0)]
        if len(ok):
            base = np.int64(number.max() + 1)
            _, both[ok] = np.unique(number[ok] * base + number[ok + length], return_inverse=True)
        number, length = both, 2 * length
    at = position[number >= 0]
    if not len(at):
        return np.zeros(n, np.int64)
    base = np.int64(number.max() + 1)
    _, inverse, count = np.unique(owner[at] * base + number[at], return_inverse=True, return_counts=True)
    start = at[count[inverse] > 1]
    marks = np.zeros(len(ids) + 1, np.int64)
    np.add.at(marks, start, 1)
    np.add.at(marks, start + window, -1)
    return per_text(np.cumsum(marks[:-1]) > 0, owner, n).astype(np.int64)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n") if "\n" in text else ():
        if line in seen:
            n += 1
        elif line.encode("utf-8", "surrogatepass").split():
            seen.add(line)
    return n


@dataclass(frozen=True)
class RatioModel:
    """``log(target / raw)`` of every n-gram hash."""

    ratio: np.ndarray
    bits: int


def _gram_counts(texts: DataFrame, bits: int) -> DataFrame:
    """(gram, n), and n_trusted if the texts (first column) come with a boolean ``trusted``: counts of each hash, of which a
    task sends one row."""
    marked = "trusted" in texts.columns
    fields = ["n", "n_trusted"][: 1 + marked]

    def count(batches):
        grams, total = Grams(bits), np.zeros((len(fields), 1 << bits), np.int64)
        for batch in batches:
            start = 0
            for part in slices(batch.column(0)):
                vocabulary = Vocabulary()
                ids, ends = numbered(part, vocabulary)
                gram, text = grams(vocabulary, ids, owners(ends))
                total[0] += np.bincount(gram, minlength=1 << bits)
                if marked:
                    trusted = batch.column("trusted")[start : start + len(part)].to_numpy(zero_copy_only=False)
                    total[1] += np.bincount(gram[trusted[text]], minlength=1 << bits)
                start += len(part)
        met = np.flatnonzero(total[0])
        yield pa.record_batch({"gram": pa.array(met, pa.int32())} | {f: pa.array(total[i][met], pa.int64()) for i, f in enumerate(fields)})

    counted = texts.mapInArrow(count, "gram int, " + ", ".join(f"{f} long" for f in fields))
    return counted.groupBy("gram").agg(*[F.sum(f).alias(f) for f in fields])


def _vector(counts: DataFrame, bits: int) -> np.ndarray:
    """The counts as an array, a row for each of several; at most ``2**bits`` rows come to the driver."""
    table = counts.toArrow()
    out = np.zeros((table.num_columns - 1, 1 << bits))
    for row, field in zip(out, table.column_names[1:], strict=True):
        row[table.column("gram").to_numpy()] = table.column(field).to_numpy()
    return out if len(out) > 1 else out[0]


def with_trusted(texts: DataFrame, trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((text, trusted) of all rows, texts of the other trusted rows), of texts (id, text) and distinct trusted ids.

    A first filter has the trusted ids, a second one those other ids of the texts that the first lets through; only ids are
    shuffled to find these. A row that passes the first and not the second is trusted for certain and marked where it stands;
    one that passes both, about one in a hundred, is joined."""
    trusted = trusted.where("id IS NOT NULL")
    passed = possible(texts.select("id").where("id IS NOT NULL"), [F.col("id")], trusted, ["id"])
    wrong = cut(passed.distinct().join(trusted, "id", "left_anti"))
    marked = with_possible(texts, [F.col("id")], trusted, ["id"], "_first")
    marked = with_possible(marked, [F.col("id")], wrong, ["id"], "_second").withColumn("_first", F.col("_first") & F.col("id").isNotNull())
    doubtful = marked.where("_first AND _second").join(trusted, "id", "left_semi").select("text")
    return marked.select("text", (F.col("_first") & ~F.col("_second")).alias("trusted")), doubtful


def fit_ratio(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    bits: int = 16,
    smoothing: float = 0.5,
) -> RatioModel:
    """Counts the raw multinomial on all texts and the target on all trusted ones (label 1). The target is smoothed
    towards the raw one with ``smoothing`` times its own weight, so an n-gram never met in it has the same ratio at
    every size, and a corpus repeated has the model of the corpus. Both are counted in one pass, see ``with_trusted``. Rows
    with a trusted id all count, an id that has several labels once. Where nothing is trusted the ratio is 0 everywhere."""
    trusted = labels.where(F.col(label_col).cast("int") == 1).select(F.col(id_col).alias("id"))
    trusted = cut(trusted.distinct())
    marked, doubtful = with_trusted(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), trusted)
    raw, target = _vector(_gram_counts(marked, bits), bits)
    target += _vector(_gram_counts(doubtful, bits), bits)
    if not raw.sum() or not target.sum():
        return RatioModel(np.zeros(1 << bits, np.float32), bits)
    lift = (target / target.sum()) / (np.maximum(raw, 1) / raw.sum())
    return RatioModel(np.log((lift + smoothing) / (1 + smoothing)).astype(np.float32), bits)


def judge(
    docs: DataFrame,
    model: RatioModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = -0.1,
    min_words: int = 20,
    max_repeat: float = 0.3,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_ratio, base_failed, kept.

    A text fails the base rules with fewer than ``min_words`` words, or with more than ``max_repeat`` of its words in
    repeated windows; others are kept if ``log_ratio >= threshold``. A null text has no words, a text without words a
    ratio of 0; a very long text is judged whole. One row per input row, repeated rows and rows without an id included;
    an empty table gives no rows; other columns are ignored.
    """
    fields = [*BASE, "log_ratio"]

    def rows(batches):
        grams = Grams(model.bits)
        for batch in batches:
            start = 0
            for part in slices(batch.column("text")):
                vocabulary = Vocabulary()
                ids, ends = numbered(part, vocabulary)
                n, owner = len(part), owners(ends)
                chars = np.fromiter((len(w) - sum(0x80 <= b < 0xC0 for b in w) if not w.isascii() else len(w) for w in vocabulary), np.int64, len(vocabulary))
                gram, text = grams(vocabulary, ids, owner)
                total = per_text(model.ratio[gram].astype(np.float64), text, n)
                out = {
                    "n_words": np.diff(ends),
                    "word_chars": per_text(chars[ids], owner, n).astype(np.int64),
                    "n_symbols": np.array([len(SYMBOLS.findall(t)) for t in part], np.int64),
                    "n_dup_lines": np.array([duplicate_lines(t) for t in part], np.int64),
                    "n_repeat_words": repeated_words(ids, owner, n),
                    "log_ratio": total / np.maximum(np.bincount(text, minlength=n), 1),
                }
                ids_of = batch.column("doc_id")[start : start + n]
                yield pa.record_batch({"doc_id": ids_of, **{k: pa.array(out[k]) for k in fields}})
                start += n

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    judged = source.mapInArrow(rows, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", log_ratio double")
    share = F.lit(round(100 * max_repeat)) * F.col("n_words")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > share)
    judged = judged.withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))
