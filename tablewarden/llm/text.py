"""Helpers shared by the text operators: Arrow slices of bounded size, words as integers, hashed features."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are handled at once inside a task; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Entries of a cache inside a Python worker before it is emptied.
CACHE_ENTRIES = 250_000


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[str]]:
    """Consecutive texts of at most ``limit`` bytes together; a null text is an empty one."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield [t or "" for t in texts[start:i].to_pylist()]
            start, total = i, 0
        total += size
    if start < len(texts):
        yield [t or "" for t in texts[start:].to_pylist()]


class Vocabulary(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


class HashCache(dict):
    """32-bit hash of a word (bytes), remembered; emptied by ``trim`` so that it stays bounded."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = zlib.crc32(word)
        return value

    def trim(self) -> None:
        if len(self) > CACHE_ENTRIES:
            self.clear()


def words_of(text: str) -> list[bytes]:
    """Maximal runs without space or \\x09-\\x0D, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def numbered(texts: list[str], vocabulary: dict) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words in order, start of each text's words with a closing end)."""
    parts, ends = [], [0]
    look = vocabulary.__getitem__
    for text in texts:
        words = words_of(text)
        parts.append(np.fromiter(map(look, words), np.int64, len(words)))
        ends.append(ends[-1] + len(words))
    return (np.concatenate(parts) if parts else np.empty(0, np.int64)), np.array(ends)


def mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of two unsigned numbers."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def owners(ends: np.ndarray) -> np.ndarray:
    """Number of the text that each word belongs to."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each text."""
    return np.bincount(owner, weights=values, minlength=n) if len(values) else np.zeros(n)


def score_udf(make: Callable[[], Callable[[list[str]], np.ndarray]]):
    """A column function double <- text; ``make`` is called once a task and gives the function on a slice of texts."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = make()
        for texts in batches:
            parts = [score(part) for part in slices(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")


def fold(doc_id: Column, folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no training may see; a row without an id has no label and isn't held out."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def smallest(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """``limit`` distinct keys with the smallest hash: a bounded sample that doesn't depend on the partitioning.

    Histograms of the hash's leading bits first tell up to which hash the sample goes, at most ``limit`` keys too far;
    so what the last task sorts is bounded by ``limit``, however many partitions there are."""
    keys = rows.where(F.col(key).isNotNull()).select(key).distinct()
    value = F.xxhash64(F.col(key))
    return keys.where(value <= hash_bound(keys, value, limit)).orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(limit)


def hash_bound(rows: DataFrame, value: Column, limit: int, bits: int = 12) -> int:
    """A number up to which ``value`` (hashes of distinct keys, signed) has ``limit`` rows, or up to ``limit`` more.

    Each round counts the rows by their next ``bits`` bits (4096 numbers) inside the range where the limit falls."""
    least = -(1 << 63)
    low, width, needed = least, 64, limit
    while width:
        top, width = width, max(0, width - bits)
        step = F.shiftrightunsigned(value.bitwiseXOR(F.lit(least)), width).bitwiseAND(F.lit((1 << (top - width)) - 1))
        inside = rows.where(value.between(low, low + (1 << top) - 1))
        counts = {r.step: r.n for r in inside.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for at in sorted(counts):
            if counts[at] >= needed:
                break
            needed -= counts[at]
        else:
            return -1 - least
        low += at << width
        if counts[at] <= limit:
            break
    return low + (1 << width) - 1


def spans(n: Column, size: int = 4096) -> Column:
    """The numbers 0 to n - 1 as (first, last) spans of at most ``size``, so that no row has to hold them all."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long") - 1, F.lit(0).cast("long")), F.lit(size).cast("long"))
    return F.transform(starts, lambda a: F.struct(a.alias("first"), F.least(a + (size - 1), n - 1).alias("last")))


def sampled_features(rows: DataFrame, mark: str, make: Callable[[], Callable[[list[str]], list[tuple]]], fields: dict[str, pa.DataType]) -> pa.Table:
    """(id as text, mark, the fields) of the rows (id, mark, text), one row for each id and mark.

    Of several rows with one id the text with the least hash is the example, whatever the partitioning. A task keeps one
    example for each id and mark, so what it holds and what comes to the driver is bounded by the ids that were sampled,
    however many rows share one. ``make`` is called once a task and gives the function from texts to tuples of fields."""
    rows = rows.select("id", mark, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, best, seen = make(), {}, None
        for batch in batches:
            seen, start = batch, 0
            keys = list(zip(batch.column("id").to_pylist(), batch.column(mark).to_pylist(), strict=True))
            for part in slices(batch.column("text")):
                fresh = {}
                for i, text in enumerate(part):
                    key, value = keys[start + i], xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                    if key not in best or value < best[key][0]:
                        best[key], fresh[key] = (value, None), i
                for key, row in zip(fresh, features([part[i] for i in fresh.values()]) if fresh else [], strict=True):
                    best[key] = (best[key][0], row)
                start += len(part)
        if best:
            ids, marks = zip(*best, strict=True)
            columns = {"id": pa.array(ids, seen.column("id").type), mark: pa.array(marks, pa.int32()), "hash": pa.array([v for v, _ in best.values()], pa.int64())}
            yield pa.record_batch(columns | {n: pa.array([row[i] for _, row in best.values()], t) for i, (n, t) in enumerate(fields.items())})

    spark_types = {pa.list_(pa.int32()): "array<int>", pa.list_(pa.float32()): "array<float>"}
    made = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {mark} int, hash long, {', '.join(f'{n} {spark_types[t]}' for n, t in fields.items())}")
    one = made.groupBy("id", mark).agg(F.min_by(F.struct(*fields), "hash").alias("f"))
    return one.select(F.col("id").cast("string").alias("id"), mark, *[f"f.{n}" for n in fields]).toArrow()


def examples(table: pa.Table) -> list[tuple]:
    """(mark, id, the fields) of each row of ``sampled_features``, sorted by mark and id. The fields are views of the table's
    lists, so that the driver holds the features once."""
    found = []
    for batch in table.to_batches():
        ids, marks, *fields = batch.columns
        found += zip(marks.to_pylist(), ids.to_pylist(), *map(_views, fields), strict=True)
    return sorted(found, key=lambda row: row[:2])


def _views(lists: pa.ListArray) -> list[np.ndarray]:
    """The lists as arrays that share their memory."""
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
