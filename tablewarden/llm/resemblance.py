"""Near-duplicates by several SimHashes, each link verified on whole shingle sets.

A text is its set of word shingles (64-bit hashes); texts of equal sets are one class. A class has ``FAMILIES``
independently seeded 64-bit SimHashes, each with a key for every choice of ``BLOCKS - SURE`` of its blocks: a pair that differs
in at most ``SURE`` bits of any one of them meets in a cell, and most pairs beyond that do, as they have ``FAMILIES``
chances. A row of a key holds all fingerprints; pairs within ``LIMIT`` bits over all of them are candidates, and a candidate
is a link if the Jaccard similarity of the two whole sets reaches the threshold. Sets are made from the texts of candidates
only.

A run of a key in which candidates outnumber its members is dense and written down by its members instead, so no run gives
more rows than it has members, and runs of the same members, of whatever keys, are written once. Members get a parity sketch: one bit per bucket of shingle hashes, set where a set has an odd number of shingles. Two sketches
differ in no more bits than the sets in shingles, so a pair whose sketches differ too much is no link, and most others
are. A forest over the candidates that remain is verified, and then all of them that the links found leave apart: no
link between two components is lost, and a group of copies costs one pair per member and key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm import simhash
from tablewarden.llm.components import connected_components
from tablewarden.llm.text import mix, slices
from tablewarden.operators.membership import possible
from tablewarden.session import cut, forget

FAMILIES, BLOCKS, SURE = 4, 8, 6
#: Differing bits of all fingerprints together up to which a pair is verified: three deviations above the mean at 0.8.
LIMIT = 56
#: Members of a run up to which all its pairs are compared at once.
SMALL = 256
#: Candidates per member above which a run is dense: at 1 a run is written as pairs or as members, whichever are fewer.
DENSE = 1
#: Bits of a parity sketch.
SKETCH_BITS = 2048
#: Rows that a task makes of its classes' keys.
KEYED_ROWS = 400_000
#: Nodes of which a task remembers how its links connect them, before it forgets them.
FOREST_NODES = 500_000
#: Keys of one fingerprint.
KEYS = comb(BLOCKS, BLOCKS - SURE)
PRINTS = [f"f{j}" for j in range(FAMILIES)]


def shingles(text: str, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 of the text's shingles; a text with fewer words is one shingle, one without words none."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n))


def class_of(grams: np.ndarray) -> int:
    """A hash of the whole set, signed; 0 for the empty one."""
    return simhash._signed(xxhash.xxh64_intdigest(grams.tobytes())) if len(grams) else 0


def fingerprint_family(grams: np.ndarray) -> np.ndarray:
    """One fingerprint per seed: a bit is 1 if set in more than half of the reseeded shingle hashes."""
    out = np.zeros(FAMILIES, np.uint64)
    for j in range(FAMILIES if len(grams) else 0):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(grams), simhash.SHINGLES):
            part = mix(grams[at : at + simhash.SHINGLES], np.uint64(j + 1))
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[j] = np.packbits(2 * counts > len(grams), bitorder="little").view("<u8")[0]
    return out


def parity_sketch(grams: np.ndarray) -> bytes:
    """Of the buckets of the set's hashes: the parity of the number of shingles in each."""
    odd = np.bincount((grams % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def described(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, key, fp, f0..) of every whole text: text key, class and fingerprints."""
    source = docs.select(F.col(id_col).alias("doc_id"), simhash.text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            start = 0
            for part in slices(batch.column("text")):
                sets = [shingles(t, words) for t in part]
                prints = np.stack([fingerprint_family(s) for s in sets]).view(np.int64)
                columns = {c: batch.column(c)[start : start + len(part)] for c in ("doc_id", "key")} | {"fp": pa.array([class_of(s) for s in sets], pa.int64())}
                yield pa.record_batch(columns | {c: pa.array(np.ascontiguousarray(prints[:, j])) for j, c in enumerate(PRINTS)})
                start += len(part)

    return source.mapInArrow(run, f"doc_id {kind}, key long, fp long, {', '.join(f'{c} long' for c in PRINTS)}")


def sets_of(docs: DataFrame, text_col: str, words: int, needed: DataFrame, n_needed: int) -> DataFrame:
    """(fp, size, sketch, grams, f0..) of the classes in ``needed`` (fp, key: a text key of the class, f0..): the shingle sets
    (8 bytes each), their sizes and parity sketches, once a class.

    Texts aren't shuffled: a filter of the keys passes those that are needed, and few others, and a task sends a class once."""
    texts = docs.select(simhash.text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    texts = possible(texts, [F.col("key")], needed.select("key"), ["key"], n_needed)

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            start = 0
            for part in slices(batch.column("text")):
                keys = batch.column("key")[start : start + len(part)].to_pylist()
                fresh = [i for i, k in enumerate(keys) if k not in sent and not sent.add(k)]
                sets = [shingles(part[i], words) for i in fresh]
                columns = {"fp": pa.array([class_of(s) for s in sets], pa.int64()), "size": pa.array(map(len, sets), pa.int64())}
                columns |= {"sketch": pa.array([parity_sketch(s) for s in sets], pa.binary())}
                yield pa.record_batch(columns | {"grams": pa.array([s.tobytes() for s in sets], pa.binary())})
                start += len(part)
                if len(sent) > FOREST_NODES:
                    sent.clear()

    made = texts.mapInArrow(run, "fp long, size long, sketch binary, grams binary")
    once = made.groupBy("fp").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("grams").alias("grams"))
    return once.join(needed.drop("key"), "fp")


def close_pairs(prints: np.ndarray, limit: int, most: int, block: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, near) of one long run, some rows at a time: all pairs (positions) within ``limit`` bits, none if they are
    more than ``most``, and whether each member has any."""
    n, near = prints.shape[1], np.zeros(prints.shape[1], bool)
    a, b, found = [near.nonzero()[0]], [near.nonzero()[0]], 0
    for at in range(0, n, block):
        bits = np.bitwise_count(prints[:, at : at + block, None] ^ prints[:, None, at + 1 :]).sum(axis=0, dtype=np.uint16)
        x, y = np.nonzero((bits <= limit) & (np.arange(at + 1, n) > np.arange(at, at + bits.shape[0])[:, None]))
        near[x + at] = near[y + at + 1] = True
        found += len(x)
        if found <= most:
            a.append(x + at)
            b.append(y + at + 1)
    if found > most:
        a, b = a[:1], b[:1]
    return np.concatenate(a), np.concatenate(b), near


def run_candidates(key: np.ndarray, node: np.ndarray, prints: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, dense): candidate pairs of nodes inside the runs of equal (consecutive) keys that are not dense, and the
    positions of the members of those that are, as far as they have a candidate; ``prints`` has a row per fingerprint."""
    change = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(change, len(key)))
    run_of, length = np.repeat(np.arange(len(size)), size), np.repeat(size, size)
    at = np.flatnonzero((length > 1) & (length <= SMALL))
    p, r = prints[:, at], run_of[at]
    a, b = [at[:0]], [at[:0]]
    for step in range(1, max(size[size <= SMALL], default=1)):
        same = np.flatnonzero(r[step:] == r[:-step])
        if not len(same):
            break
        bits = np.bitwise_count(p[:, same] ^ p[:, same + step]).sum(axis=0, dtype=np.int64)
        close = same[bits <= limit]
        a.append(at[close])
        b.append(at[close + step])
    a, b = np.concatenate(a), np.concatenate(b)
    many = (np.bincount(run_of[a], minlength=len(size)) > DENSE * size)[run_of[a]]
    dense = [np.unique(np.concatenate([a[many], b[many]]))]
    a, b = [a[~many]], [b[~many]]
    for i in np.flatnonzero(size > SMALL):
        x, y, near = close_pairs(prints[:, change[i] : change[i] + size[i]], limit, DENSE * size[i])
        a.append(x + change[i])
        b.append(y + change[i])
        if near.any() and not len(x):
            dense.append(near.nonzero()[0] + change[i])
    return node[np.concatenate(a)], node[np.concatenate(b)], np.concatenate(dense)


class Members:
    """The members of one dense run, in an order that is the same in every run."""

    def __init__(self, node: np.ndarray, size: np.ndarray, prints: np.ndarray, sketch: np.ndarray, share: float, limit: int = LIMIT):
        order = np.argsort(mix(node, 3), kind="stable")
        self.node, self.size, self.prints, self.sketch = node[order], size[order], prints[:, order], sketch[order]
        self.order, self.share, self.limit = order, share, limit

    def near(self, at: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that may be links of ``at``: few differing bits, and sketches that differ in no more bits
        than the sets of a link in shingles."""
        bits = np.bitwise_count(self.prints[:, others] ^ self.prints[:, at : at + 1]).sum(axis=0, dtype=np.int64)
        others = others[bits <= self.limit]
        differ = np.bitwise_count(self.sketch[others] ^ self.sketch[at]).sum(axis=1, dtype=np.int64)
        return others[differ <= self.share * (self.size[others] + self.size[at])]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the candidates, breadth first from the first member on."""
        left = np.arange(len(self.node))
        a, b = [left[:0]], [left[:0]]
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop(0)
                new = self.near(at, left)
                a.append(np.full(len(new), at))
                b.append(new)
                queue += new.tolist()
                left = np.setdiff1d(left, new, assume_unique=True)
        return self.node[np.concatenate(a)], self.node[np.concatenate(b)]

    def apart(self, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All candidates whose roots differ."""
        root, every = root[self.order], np.arange(len(self.node))
        a, b = [every[:0]], [every[:0]]
        for at in every:
            new = self.near(at, every[at + 1 :][root[at + 1 :] != root[at]])
            a.append(np.full(len(new), at))
            b.append(new)
        return self.node[np.concatenate(a)], self.node[np.concatenate(b)]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct (lesser, greater) pairs of signed nodes."""
    a, b = a.view(np.int64), b.view(np.int64)
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)


def by_run(batches, columns: list[str], together: bool = True) -> Iterator[list[np.ndarray]]:
    """Batches sorted by their first column as arrays that hold whole runs; with ``together`` false, one run at a time."""
    held = None
    for batch in batches:
        new = [_array(batch.column(c)) for c in columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if len(held[0]):
            whole = np.searchsorted(held[0], held[0][-1])  # the last run may go on in the next batch
            if whole:
                yield from _runs([c[:whole] for c in held], together)
            held = [c[whole:] for c in held]
    if held is not None and len(held[0]):
        yield from _runs(held, together)


def _array(column: pa.Array) -> np.ndarray:
    """Numbers as they are, byte strings of one length as rows of 64-bit words."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)
    return column.to_numpy()


def _runs(rows: list[np.ndarray], together: bool) -> Iterator[list[np.ndarray]]:
    if together:
        yield rows
        return
    change = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1
    yield from zip(*[np.split(c, change) for c in rows], strict=True)


def keyed_rows(classes: DataFrame, family: int, n: int) -> DataFrame:
    """(key, fp, f0..): a row for each class and key of one fingerprint. A key is the chosen blocks behind the number of the
    choice."""
    width, choices = np.uint64(64 // BLOCKS), list(combinations(range(BLOCKS), BLOCKS - SURE))
    mask = np.uint64((1 << (64 // BLOCKS)) - 1)
    classes = classes.repartition(max(1, -(-n * KEYS // KEYED_ROWS)), "fp")  # a class becomes a row per key: few tasks would each write a large part

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                own = batch.column(PRINTS[family]).to_numpy().view(np.uint64)
                keys = []
                for i, blocks in enumerate(choices):
                    key = np.full(len(own), family * KEYS + i, np.uint64)
                    for b in blocks:
                        key = key << width | own >> np.uint64(b) * width & mask
                    keys.append(key)
                columns = [np.tile(batch.column(c).to_numpy(), len(choices)) for c in ("fp", *PRINTS)]
                yield pa.record_batch([pa.array(x) for x in (np.concatenate(keys).view(np.int64), *columns)], ["key", "fp", *PRINTS])

    return classes.select("fp", *PRINTS).mapInArrow(run, f"key long, fp long, {', '.join(f'{c} long' for c in PRINTS)}")


def candidates(classes: DataFrame) -> DataFrame:
    """(u, v, cell) of classes (columns fp, f0..): pairs u < v within ``LIMIT`` bits, without a cell, and the members u of
    dense cells, without v. The keys of one fingerprint are a pass."""
    n = classes.count()
    return reduce(DataFrame.unionByName, [cut(family_candidates(classes, j, n)) for j in range(FAMILIES)]).distinct()


def family_candidates(classes: DataFrame, family: int, n: int) -> DataFrame:
    """``candidates`` by the keys of one fingerprint."""
    keyed = keyed_rows(classes, family, n)
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > simhash.CELL)
    large = cut(large.select("key", F.ceil(F.col("n") / simhash.CELL).cast("int").alias("cells")))
    rows = keyed.join(F.broadcast(large), "key", "left")  # at most a key per CELL rows
    cells = F.coalesce("cells", F.lit(1))
    group = F.pmod(F.xxhash64("fp"), cells).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), cells - 1), lambda j: F.least(group, j) * 1_000_000 + F.greatest(group, j))
    rows = rows.select("fp", *PRINTS, "key", "cells", F.explode(pairs).alias("cell"))
    rows = rows.select(F.when(F.col("cells").isNull(), F.col("key")).otherwise(F.xxhash64("key", "cell")).alias("cell"), "fp", *PRINTS)
    rows = rows.repartition("cell").sortWithinPartitions("cell")

    def run(batches):
        for cell, node, *prints in by_run(batches, ["cell", "fp", *PRINTS]):
            a, b, dense = run_candidates(cell, node.view(np.uint64), np.stack(prints).view(np.uint64))
            edges, none = _pairs(a, b), pa.nulls(len(dense), pa.int64())
            yield pa.record_batch([pa.array(edges[:, 0]), pa.array(edges[:, 1]), pa.nulls(len(edges), pa.int64())], ["u", "v", "cell"])
            yield pa.record_batch([pa.array(node[dense]), none, pa.array(same_members(cell[dense], node[dense]))], ["u", "v", "cell"])

    return rows.mapInArrow(run, "u long, v long, cell long").distinct()


def same_members(cell: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each row a name of its cell that depends on the members alone: cells of the same nodes become one."""
    cells, of = np.unique(cell, return_inverse=True)
    name = np.zeros(len(cells), np.uint64)
    np.add.at(name, of, mix(node.view(np.uint64), 5))
    return name[of].view(np.int64)


MEMBER = ["size", *PRINTS, "sketch"]


def dense_pairs(members: DataFrame, least: float, roots: DataFrame | None = None) -> DataFrame:
    """(u, v), u < v, of the dense cells (members: cell, fp and what ``MEMBER`` names): a forest of the candidates in
    each, or, given the roots of the links found so far, all candidates whose roots differ."""
    rows = members.withColumn("root", F.lit(0).cast("long"))
    if roots is not None:
        rows = members.join(roots, members["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    rows = rows.select("cell", "fp", "root", *MEMBER).repartition("cell").sortWithinPartitions("cell")
    share, first = (1 - least) / (1 + least) + 1e-12, roots is None

    def run(batches):
        for _, node, root, size, *prints, sketch in by_run(batches, ["cell", "fp", "root", *MEMBER], together=False):
            run_of = Members(node, size, np.stack(prints).view(np.uint64), sketch, share)
            edges = _pairs(*(run_of.forest() if first else run_of.apart(root)))
            yield pa.record_batch([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of the pairs whose whole shingle sets (columns fp, grams) have a Jaccard similarity of at least ``least``, enough to
    connect all of them: a task leaves out a pair that its links before have connected already, without looking at it."""

    def run(batches):
        group: dict[int, int] = {}  # of the links of this task, so that only those that connect anew go on

        def top(x: int) -> int:
            while (up := group.get(x, x)) != x:
                group[x] = group.get(up, up)
                x = up
            return x

        for batch in batches:
            keep, ends = [], zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True)
            for i, (ends_of, x, y) in enumerate(zip(ends, batch.column("gu"), batch.column("gv"), strict=True)):
                u, v = map(top, ends_of)
                if u == v:
                    continue
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= least * (len(x) + len(y) - both):
                    keep.append(i)
                    group[u] = v
            yield pa.record_batch([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("u", "v")], ["u", "v"])
            if len(group) > FOREST_NODES:
                group.clear()

    half = pairs.join(sets.select(F.col("fp").alias("u"), F.col("grams").alias("gu")), "u")
    return half.join(sets.select(F.col("fp").alias("v"), F.col("grams").alias("gv")), "v").select("u", "v", "gu", "gv").mapInArrow(run, "u long, v long")


def similar_roots(docs: DataFrame, classes: DataFrame, text_col: str, words: int, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """((node, root) of the linked classes, tables to delete once it has been used).

    A first pass verifies a pair of each candidate with its least partner, and a forest of each dense cell; a second one
    all candidates that the links found leave in two components."""
    found = cut(candidates(classes.where("fp <> 0").select("fp", *PRINTS)))
    sparse = found.where("v IS NOT NULL").select("u", "v")
    dense = found.where("v IS NULL").select("cell", F.col("u").alias("fp"))
    nodes = sparse.select(F.col("u").alias("fp")).unionByName(sparse.select(F.col("v").alias("fp"))).unionByName(dense.select("fp")).distinct()
    needed = cut(classes.select("fp", F.col("first.key").alias("key"), *PRINTS).join(nodes, "fp", "left_semi"))
    sets = cut(sets_of(docs, text_col, words, needed, needed.count()))
    members = cut(dense.join(sets.select("fp", *MEMBER), "fp"))
    partner = sparse.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    pairs = cut(partner.unionByName(dense_pairs(members, least)).distinct())
    links = cut(verified(pairs, sets, least))
    roots = cut(connected_components(links))
    apart = sparse.join(roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left").join(roots.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left")
    apart = apart.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")
    more = cut(apart.unionByName(dense_pairs(members, least, roots)).distinct().join(pairs, ["u", "v"], "left_anti"))
    new = cut(verified(more, sets, least))
    if not new.isEmpty():  # a node and its root stand for the links found before
        roots = connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(new))
    return roots, [sets, found, needed, members, pairs, links, more, new]


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """The input rows without near-duplicates: of each component of verified links one row stays, see
    ``simhash.kept_rows``. Texts of equal shingle sets are one class, texts without words (null ones too) another; a text
    with fewer words than a shingle is one shingle. An empty table stays empty; other columns are kept, whatever their
    names."""
    whole = cut(described(docs, id_col, text_col, words))
    classes = cut(simhash.least_rows(whole, *[F.min(c).alias(c) for c in PRINTS]))
    roots, used = similar_roots(docs, classes, text_col, words, least)
    for table in used:
        forget(table)
    return simhash.kept_rows(docs, whole, classes, roots, id_col, text_col)
