"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is split into ``blocks`` blocks. Two fingerprints that differ in at most ``sure`` bits agree
on at least ``blocks - sure`` whole blocks, so each choice of that many blocks is a key and every such pair shares one
of them. Fingerprints are joined on these keys and their Hamming distance is verified. Equal fingerprints are one class
from the start, so copies cost nothing. A key that many different fingerprints share is split the same way once more,
over its free bits, so that a run holds at most the fingerprints that differ in the bits left free then (65,536 by
default); each run gives only the links of a spanning forest.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.components import connected_components
from tablewarden.llm.text import slices
from tablewarden.operators.membership import with_possible
from tablewarden.session import cut

#: Shingles whose bits are counted at a time.
SHINGLES = 1 << 16
#: Fingerprints of a key above which it is split over its free bits.
CELL = 2048
#: Parts in which the classes of one component are joined to its id.
SALTS = 16


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Unsigned: a bit is 1 if set in more than half of the shingles' XXH64. No words: 0."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES):
        part = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + SHINGLES], ends[at : at + SHINGLES], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def text_key(text: Column) -> Column:
    """A hash of the whole text; that of an empty one for null."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, key, fp): the fingerprint of every whole text as a signed long; a null text has no words."""
    source = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            start = 0
            for part in slices(batch.column("text")):
                values = np.array([fingerprint(t, words) for t in part], np.uint64).view(np.int64)
                whole = slice(start, start + len(part))
                yield pa.record_batch({"doc_id": batch.column("doc_id")[whole], "key": batch.column("key")[whole], "fp": pa.array(values)})
                start += len(part)

    return source.mapInArrow(run, f"doc_id {kind}, key long, fp long")


def masks(blocks: int, sure: int, given: int = 0) -> list[int]:
    """Bit masks of every choice of ``blocks - sure`` blocks of the bits outside ``given``, with ``given``; the blocks'
    sizes differ by at most one bit."""
    if not 0 <= sure < blocks <= 64:
        raise ValueError("blocks must be more than the bits that may differ")
    free = [1 << i for i in range(64) if not given >> i & 1]
    edges = [len(free) * i // blocks for i in range(blocks + 1)]
    whole = [sum(free[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [given + sum(c) for c in combinations(whole, blocks - sure)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def forest(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints at ``max_bits`` or fewer differing bits, breadth first."""
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[node]) <= max_bits
            new = left[near]
            a += [fp[node]] * len(new)
            b += fp[new].tolist()
            queue += new.tolist()
            left = left[~near]
    return np.array(a, np.uint64), np.array(b, np.uint64)


def run_links(key: np.ndarray, fp: np.ndarray, max_bits: int, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal (consecutive) keys: all of them in short runs, a spanning forest of long ones."""
    change = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(change, len(key)))
    of, length = np.repeat(np.arange(len(size)), size), np.repeat(size, size)
    keep = (length > 1) & (length <= small)
    f, r = fp[keep], of[keep]
    a, b = [], []
    for step in range(1, min(small, max(size[size <= small], default=1))):
        same = np.flatnonzero(r[step:] == r[:-step])
        close = same[np.bitwise_count(f[same] ^ f[same + step]) <= max_bits]
        a.append(f[close])
        b.append(f[close + step])
    for i in np.flatnonzero(size > small):
        x, y = forest(fp[change[i] : change[i] + size[i]], max_bits)
        a.append(x)
        b.append(y)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(distinct: DataFrame, max_bits: int = 3, blocks: int = 6) -> DataFrame:
    """(u, v) between different fingerprints (column fp), enough to connect all that are within ``max_bits``."""
    chosen = masks(blocks, max_bits)
    finer = F.array(*[F.array(*[F.lit(_signed(m)) for m in masks(blocks, max_bits, given)]) for given in chosen])
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(chosen)])
    rows = distinct.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", F.xxhash64("k.t", "k.key").alias("key"))
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    rows = rows.join(large, "key", "left")
    split = F.transform(finer[F.col("t")], lambda m: F.xxhash64("key", m, F.col("fp").bitwiseAND(m)))
    rows = rows.select("fp", F.explode(F.when(F.col("n").isNull(), F.array("key")).otherwise(split)).alias("cell"))
    rows = rows.repartition("cell").sortWithinPartitions("cell")

    def run(batches):
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch.column("cell").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(key):
                continue
            whole = np.searchsorted(key, key[-1])  # the last run may go on in the next batch
            yield found(key[:whole], fp[:whole])
            key, fp = key[whole:], fp[whole:]
        yield found(key, fp)

    def found(key, fp):
        a, b = run_links(key, fp, max_bits) if len(key) else (fp, fp)
        edges = np.unique(np.stack([a.view(np.int64), b.view(np.int64)], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        return pa.record_batch({"u": pa.array(edges[:, 0]), "v": pa.array(edges[:, 1])})

    edges = rows.select("cell", "fp").mapInArrow(run, "u long, v long")
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    max_bits: int = 3,
    blocks: int = 6,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id that can be reached over links.

    Texts without words, null ones included, have fingerprint zero and link like any other. One row per input row,
    repeated rows included; other columns are ignored. A component of which every id is null has a null component_id.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(classes.select("fp"), max_bits, blocks))
    out = placed_rows(prints, classes, roots)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def placed_rows(prints: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of ``prints`` (doc_id, fp), given the least id of each class and the linked classes'
    components."""
    placed = cut(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", "root"))
    linked = placed.where("root IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    groups = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    alone = placed.where("root IS NULL").select("fp", F.col("least").alias("component_id"))
    classes = linked.join(groups, ["root", "salt"]).select("fp", "component_id").unionByName(alone)
    return prints.join(classes.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3, blocks: int = 6) -> DataFrame:
    """The input rows without near-duplicates: of each component one row stays, see ``kept_rows``."""
    prints = cut(fingerprints(docs, id_col, text_col, words))
    classes = least_rows(prints)
    roots = connected_components(links(classes.select("fp"), max_bits, blocks))
    return kept_rows(docs, prints, classes, roots, id_col, text_col)


def least_rows(prints: DataFrame, *more: Column) -> DataFrame:
    """(fp, first) of each class: the least (no id, doc_id, text key) of its rows, and the columns of ``more``."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    return prints.groupBy("fp").agg(F.min(row).alias("first"), *more)


def kept_rows(docs: DataFrame, prints: DataFrame, classes: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept: of each component the row of the least id, rows without an id
    after all others, rows of one id by a hash of the text. Rows equal in id and text count as one (any of them).

    Rows are told apart by id and text, so a document stays whatever else has its id. ``prints`` (doc_id, key) has a row
    per row of ``docs``: it tells which rows go or are repeated. A filter of those passes all other rows straight on; only
    texts of rows that may go or be repeated are shuffled, after equal rows of a task have been merged."""
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select("first", F.coalesce("root", "fp").alias("group"))
    kept = placed.groupBy("group").agg(F.min("first").alias("first")).select(F.struct("first.doc_id", "first.key").alias("_kept"))
    kept = cut(kept)
    counted = prints.groupBy(F.struct("doc_id", "key").alias("_kept")).agg(F.count(F.lit(1)).alias("n"))
    gone = counted.join(kept, "_kept", "left_anti").unionByName(counted.where("n > 1")).select("_kept.doc_id", "_kept.key").distinct()
    gone = cut(gone)
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key")).alias("_kept"), F.struct("*").alias("_row"))
    rows = with_possible(rows, [F.col("_kept.doc_id"), F.col("_kept.key")], gone, ["doc_id", "key"], "_doubt")
    straight = rows.where("NOT _doubt").select("_row")
    doubtful = rows.where("_doubt").select("_kept", "_row").dropDuplicates(["_kept"]).join(kept, "_kept", "left_semi").select("_row")
    return straight.unionByName(doubtful).select("_row.*")
