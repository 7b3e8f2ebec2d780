"""Ranked lexical search: the best documents of each query item by a sum of term weights, whole collection, exact.

One pass over the texts writes small posting rows (id, number of terms, query terms with their counts). Counts over the
whole collection give the weights. A task then takes the posting rows in blocks. For each item it groups the documents of
a block by the mask of the item's terms that they hold (one bit a term, set by OR over the term's documents). The sum of the
largest impacts of a mask's terms bounds the scores of its documents, so masks are evaluated by descending bound until the
bound falls below the last score that is still among the best. Every task returns its best documents of every item; a
ranking per item merges them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.session import cut

#: Bytes that are no part of a term become blanks, A-Z becomes lower case; bytes of other letters stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Different terms of the items that are searched in one pass over the texts; more items take more passes.
PASS_TERMS = 200_000
#: Posting rows whose masks are grouped together.
BLOCK_ROWS = 8192


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term): the different terms of each item, of all rows with its id together."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                terms = sorted(set(terms_of(text.as_py() or b"")))
                ids = pa.concat_arrays([batch.column(0).slice(i, 1)] * len(terms)) if terms else batch.column(0).slice(0, 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.binary())], names=["item_id", "term"])

    return rows.mapInArrow(run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, term binary").distinct()


def postings(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, terms, counts: the number of terms of each text with repeats, and how often it holds which of ``terms``,
    by their places in the list. Texts without terms are left out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: i for i, term in enumerate(terms)}
        for batch in batches:
            n, found, counts, ends = [], [], [], [0]
            for text in batch.column(1):
                words = terms_of(text.as_py() or b"")
                n.append(len(words))
                held = Counter(map(number.get, words))
                held.pop(None, None)
                found.extend(held.keys())
                counts.extend(held.values())
                ends.append(len(found))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (found, counts)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])
            yield out.filter(pc.greater(out.column("n"), 0))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, counts array<int>")


def weight(documents: int, holding: int) -> int:
    """Thousandfold logarithm of how rare a term is."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(counts: np.ndarray, weights: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What each posting adds to a score: ``lengths`` is the number of terms of its document."""
    m = 50 + (50 * lengths * documents) // total
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 20 * m))


class Block:
    """Postings of up to ``BLOCK_ROWS`` documents, by document and by term, with the impact of each."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, impact: np.ndarray):
        self.n = len(ends) - 1
        doc = np.repeat(np.arange(self.n), np.diff(ends))
        self.ends, self.terms, self.impact = ends, terms, impact
        by = np.argsort(terms, kind="stable")
        known, starts = np.unique(terms[by], return_index=True)
        bounds = np.append(starts, len(terms))
        self.place = {t: (a, b) for t, a, b in zip(known.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)}
        self.docs = doc[by]
        largest = np.maximum.reduceat(impact[by], starts) if len(terms) else np.empty(0, np.int64)
        self.largest = dict(zip(known.tolist(), largest.tolist(), strict=True))

    def masks(self, terms: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents with a term, in groups of one mask; where each group starts; bound on the scores of each group)."""
        words = np.zeros((-(-len(terms) // 64), self.n), np.uint64)
        for bit, term in enumerate(terms):
            a, b = self.place[term]
            words[bit >> 6][self.docs[a:b]] |= np.uint64(1 << (bit & 63))
        hit = np.flatnonzero(words.any(axis=0))
        words = words[:, hit]
        by = np.lexsort(words) if len(words) > 1 else np.argsort(words[0], kind="stable")
        words = words[:, by]
        new = np.ones(len(by), bool)
        new[1:] = (words[:, 1:] != words[:, :-1]).any(axis=0)
        starts = np.flatnonzero(new)
        bound = np.zeros(len(starts), np.int64)
        for bit, term in enumerate(terms):
            bound += self.largest[term] * ((words[bit >> 6][starts] >> np.uint64(bit & 63)) & np.uint64(1)).astype(np.int64)
        return hit[by], starts, bound

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of documents: ``wanted`` tells which terms count."""
        lengths = self.ends[docs + 1] - self.ends[docs]
        first = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum()) - np.repeat(first - self.ends[docs], lengths)
        return np.add.reduceat(np.where(wanted[self.terms[at]], self.impact[at], 0), first)

    def best(self, terms: list[int], wanted: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that can be among the ``k`` best, where ``least`` is known to be needed."""
        terms = [t for t in terms if t in self.place]
        if not terms:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        docs, starts, bound = self.masks(terms)
        sizes = np.diff(np.append(starts, len(docs)))
        order = np.argsort(-bound, kind="stable")
        filled = np.cumsum(sizes[order])
        found, scores, done = [], np.empty(0, np.int64), 0
        while done < len(order) and bound[order[done]] >= max(least, 1):
            reach = np.searchsorted(filled, (filled[done - 1] if done else 0) + 4 * k) + 1
            part = order[done:reach]
            part = part[bound[part] >= max(least, 1)]
            lengths = sizes[part]
            rows = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths - starts[part], lengths)
            found.append(docs[rows])
            scores = np.append(scores, self.scores(docs[rows], wanted))
            done += len(part)
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        found = np.concatenate(found) if found else np.empty(0, np.int64)
        keep = scores >= max(least, 1)
        return found[keep], scores[keep]


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", pass_terms: int = PASS_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item among all documents, exact.

    Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z in lower case. With N texts
    that hold a term, L terms in all of them and df texts holding a term, the term weighs w = floor(1000 ln((2 N + 2) /
    (2 df + 1))); a text with n terms, tf of them this one, adds w * ((10**9 tf) div (1000 tf + 20 m)) where m is
    50 + (50 n N) div L. Every different term of an item counts once. Only scores above 0 are ranked; equal scores go by
    ascending id, a null id last. Rows of ``items`` with one id (null is one) are one item of all their terms; rows of
    ``docs`` with one id are documents of their own. Null and empty texts hold no terms, so they are never found, and an
    item without terms finds nothing. Empty tables give no rows. Other columns don't matter.

    Only posting rows are written and nothing but each task's ``k`` best rows an item is shuffled. What the driver and the
    tasks hold are the different terms of the items, ``pass_terms`` of them at a time: where the items have more, they
    are searched in several passes over the texts.
    """
    spark = docs.sparkSession
    pairs = cut(item_terms(items, item_id_col, item_text_col))
    passes = max(1, -(-pairs.count() // pass_terms))
    if passes > 1:
        pairs = pairs.withColumn("pass", F.pmod(F.xxhash64("item_id"), F.lit(passes)))
    found = None
    for number in range(passes):
        mine = pairs.where(F.col("pass") == number).drop("pass") if passes > 1 else pairs
        part = one_pass(docs, mine, k, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def one_pass(docs: DataFrame, pairs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, doc_id, score: the best rows that each task found."""
    terms = sorted(bytes(r.term) for r in pairs.select("term").distinct().collect())
    number = {term: i for i, term in enumerate(terms)}
    asked: dict = {}
    for r in pairs.collect():
        asked.setdefault(r.item_id, []).append(number[bytes(r.term)])
    queries = [(item, sorted(wanted)) for item, wanted in asked.items()]
    rows = cut(postings(docs, terms, id_col, text_col))
    documents, total = rows.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(terms), np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[r.term] = weight(documents, r["count"])
    item_kind, doc_kind = pairs.schema["item_id"].dataType, rows.schema["doc_id"].dataType
    out_schema = pa.schema([("item", pa.int32()), ("doc_id", rows.limit(0).toArrow().schema.field("doc_id").type), ("score", pa.int64())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Block]]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                held = batch.column("terms").flatten().to_numpy().astype(np.int64)
                sizes = pc.list_value_length(batch.column("terms")).to_numpy()
                lengths = np.repeat(batch.column("n").to_numpy(), sizes)
                counts = batch.column("counts").flatten().to_numpy().astype(np.int64)
                value = impacts(counts, weights[held], lengths, documents, total)
                yield batch.column("doc_id"), Block(held, np.concatenate([[0], np.cumsum(sizes)]), value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        wanted = np.zeros(max(1, len(terms)), bool)
        for ids, block in blocks(batches):
            for i, (_, asked) in enumerate(queries):
                mine = best[i]
                wanted[asked] = True
                at, scores = block.best(asked, wanted, k, -mine[-1][0] if len(mine) == k else 1)
                wanted[asked] = False
                if len(at):
                    named = ids.take(pa.array(at)).to_pylist()
                    mine += [(-score, doc is None, doc) for score, doc in zip(scores.tolist(), named, strict=True)]
                    mine.sort(key=lambda x: x[:2] if x[1] else x)
                    del mine[k:]
        columns = zip(*[(i, doc, -score) for i, mine in enumerate(best) for score, _, doc in mine], strict=True)
        columns = list(columns) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out_schema.types, strict=True)], schema=out_schema)

    spark = docs.sparkSession
    scored = rows.mapInArrow(run, f"item int, doc_id {doc_kind.simpleString()}, score bigint")
    names = spark.createDataFrame(list(enumerate(item for item, _ in queries)), f"item int, item_id {item_kind.simpleString()}")
    return scored.join(names, "item").select("item_id", "doc_id", "score")
