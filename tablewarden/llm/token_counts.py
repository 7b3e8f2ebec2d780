"""Token counts from per-document pre-token frequencies, without materialising ids.

1. Every task counts its words and cuts each distinct one into pre-tokens; their sums give each distinct pre-token with its frequency in the corpus.
2. The tokenizer is run once on each distinct pre-token; (pretoken, n, pieces) is written to the shared folder.
3. Documents are read again as pre-token frequencies and joined to the pieces. The most frequent pre-tokens
   (``head_rows`` at most, so the size is bounded) are joined inside the tasks, from a broadcast; the other ones by a
   shuffle on the pre-token, in which no key is frequent, as all frequent keys are in the head.
4. A sum per document.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.bpe import PLAIN_PIECE, PLAIN_TEXT, Encoder, Remembered, spec_of
from tablewarden.llm.text import CACHE_ENTRIES, Vocabulary, slices
from tablewarden.session import cut

#: Distinct words that a task holds before it sends their counts on.
FLUSH = 300_000


class Splitter:
    """Texts to units, and units to pre-tokens. A unit is a run without white space of a plain text, or a pre-token of
    another text behind a NUL; units repeat, so each distinct one is cut into pre-tokens once."""

    def __init__(self, path: str):
        self.spec = spec_of(path)
        self.pretokens = Encoder(self.spec).pretokens

    def __call__(self, text: str) -> tuple[list[str], int]:
        """(units, number of special strings) of a text."""
        special = self.spec.special
        if special is None or "<" not in text:
            return self._of(text), 0
        parts = special.split(text)
        return [p for part in parts for p in self._of(part)], len(parts) - 1

    def _of(self, text: str) -> list[str]:
        return text.split() if PLAIN_TEXT.fullmatch(text) else ["\0" + p for p in self.pretokens(text)]

    @staticmethod
    def cut(unit: str) -> list[str]:
        """The pre-tokens of a unit."""
        return [unit[1:]] if unit[0] == "\0" else PLAIN_PIECE.findall(unit.lower())


@lru_cache(maxsize=4)
def piece_counter(path: str):
    """The library's tokenizer for whole pre-tokens: the file's model behind its byte-level step alone."""
    from tokenizers import Tokenizer

    data = json.load(open(path, encoding="utf-8"))
    steps = data["pre_tokenizer"]["pretokenizers"]
    data |= {"normalizer": None, "pre_tokenizer": steps[-1], "added_tokens": [], "truncation": None, "padding": None}
    return Tokenizer.from_str(json.dumps(data))


def pretoken_pieces(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(pretoken, n, pieces): every distinct pre-token of the corpus, its frequency and its number of tokens."""

    def count(batches):
        split, seen, total = Splitter(path), Vocabulary(), np.zeros(0, np.int64)

        def rows():
            found: dict[str, int] = {}
            for unit, n in zip(seen, total.tolist(), strict=False):
                for pretoken in split.cut(unit):
                    found[pretoken] = found.get(pretoken, 0) + n
            return pa.record_batch({"pretoken": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

        for batch in batches:
            for part in slices(batch.column(0)):
                ids = []
                for text in part:
                    units = split(text)[0]
                    ids.append(np.fromiter(map(seen.__getitem__, units), np.int64, len(units)))
                new = np.bincount(np.concatenate(ids), minlength=len(total))
                new[: len(total)] += total
                total = new
                if len(seen) > FLUSH:
                    yield rows()
                    seen, total = Vocabulary(), np.zeros(0, np.int64)
        yield rows()

    def pieces(batches):
        tokenizer = piece_counter(path)
        for batch in batches:
            found = tokenizer.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(e) for e in found], pa.int32())], ["pretoken", "n", "pieces"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "pretoken string, n long")
    distinct = counted.groupBy("pretoken").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(pieces, "pretoken string, n long, pieces int")


def frequent(known: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` of the most frequent pre-tokens: those from a frequency class up, of eight classes to a doubling.

    The classes are counted first (some hundreds of numbers), so no task has to sort or gather candidates of all
    partitions."""
    level = F.floor(F.log2("n") * 8)
    counts = known.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = None, 0
    for row in sorted(counts, key=lambda r: -r["level"]):
        total += row["n"]
        if total > rows:
            break
        least = row["level"]
    return known.where(F.lit(False) if least is None else level >= least)


def count_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    head_rows: int = 200_000,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), one row per input row.

    A null text counts as an empty one: no bytes, no tokens. Special strings inside a text are one token each. Rows
    with equal or null ids stay apart; an empty table gives no rows; other columns are ignored. A very long text is
    handled by itself, as its pre-tokens with their frequencies. Rows are told apart by task and position, so ``docs``
    should be a written table (or another input that a retried task reads in the same order).
    """
    spark = docs.sparkSession
    known = cut(pretoken_pieces(docs, path, text_col))
    top = frequent(known, head_rows).select("pretoken", "pieces").toArrow()
    head = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def frequencies(batches):
        split, pieces = Splitter(path), head.value

        def known_size(unit: str) -> tuple[int, tuple[str, ...]]:
            """Tokens of the unit's pre-tokens in the head, and its other pre-tokens."""
            sizes = [(p, pieces.get(p, 0)) for p in split.cut(unit)]
            return sum(n for _, n in sizes), tuple(p for p, n in sizes if not n)

        cache = Remembered(known_size, CACHE_ENTRIES)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            start = 0
            for part in slices(batch.column("text")):
                cache.trim()
                seen, texts, special = Vocabulary(), [], []
                for text in part:
                    units, n = split(text)
                    texts.append(np.fromiter(map(seen.__getitem__, units), np.int64, len(units)))
                    special.append(n)
                units = list(map(cache.__getitem__, seen))
                size = np.fromiter((n for n, _ in units), np.int64, len(units))
                rare = np.fromiter((bool(r) for _, r in units), bool, len(units))
                ids, owner = np.concatenate(texts), np.repeat(np.arange(len(part)), [len(t) for t in texts])
                sums = np.array(special, np.int64)
                if len(ids):
                    sums += np.bincount(owner, weights=size[ids], minlength=len(part)).astype(np.int64)
                n = len(part)
                yield pa.record_batch(
                    {
                        "row": pa.array(np.arange(row, row + n)),
                        "doc_id": batch.column("doc_id")[start : start + n],
                        "n_bytes": pa.array([len(t.encode("utf-8")) for t in part], pa.int64()),
                        "tokens": pa.array(sums),
                        "pretoken": pa.array([f"\0{i}" for i in range(row, row + n)]),  # joins nothing, on no common key
                        "freq": pa.array(np.zeros(n, np.int64)),
                    }
                )
                other = rare[ids]
                key, freq = np.unique(owner[other] * max(1, len(units)) + ids[other], return_counts=True)
                if len(key):
                    words = [units[i][1] for i in (key % len(units)).tolist()]
                    times = [len(w) for w in words]
                    rows = np.repeat(key // len(units), times)
                    none = pa.nulls(len(rows), batch.column("doc_id").type)
                    zero = pa.array(np.zeros(len(rows), np.int64))
                    word = pa.array([w for ws in words for w in ws], pa.string())
                    yield pa.record_batch({"row": pa.array(rows + row), "doc_id": none, "n_bytes": zero, "tokens": zero, "pretoken": word, "freq": pa.array(np.repeat(freq, times))})
                start, row = start + n, row + n

    rows = source.mapInArrow(frequencies, f"row long, doc_id {kind}, n_bytes long, tokens long, pretoken string, freq long")
    joined = rows.join(known.select("pretoken", "pieces"), "pretoken", "left")
    tokens = F.col("tokens") + F.col("freq") * F.coalesce("pieces", F.lit(0))
    summed = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
