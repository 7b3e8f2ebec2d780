"""Approximate nearest neighbours by learned partitions.

On a bounded sample: the exact neighbour graph, its balanced partition (recursive halving along the graph's smoothed
order with exchange passes), and a softmax classifier that learns a vector's part. All vectors are then put into their
most probable part, and a query is routed to its several most probable parts, where candidates are ranked by the exact
cosine in double precision. Parts are dealt out in blocks of bounded size, so a part that holds a third of all vectors
is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.text import smallest
from tablewarden.session import cut, forget

#: Vectors of a part in one block, and queries that meet them at a time.
BLOCK_ROWS, QUERY_ROWS = 8192, 512


@dataclass(frozen=True)
class Router:
    """Softmax over the parts: ``weights`` has a row per part, the last column is the bias."""

    weights: np.ndarray
    mean: np.ndarray

    def logits(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.weights[:, :-1].T + self.weights[:, -1]

    def parts(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` most probable parts of each vector, most probable first."""
        return np.argsort(-self.logits(unit), axis=1, kind="stable")[:, :n]


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` nearest other rows of each row, a block of rows at a time."""
    out = np.empty((len(unit), k), np.int64)
    for at in range(0, len(unit), 1024):
        near = unit[at : at + 1024] @ unit.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at : at + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def halve(graph: np.ndarray, rows: np.ndarray, unit: np.ndarray, passes: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of equal size (to one row) with few edges between them."""
    place = np.full(len(graph), -1)
    place[rows] = np.arange(len(rows))
    local = place[graph[rows]]
    inside = local >= 0
    centred = unit[rows] - unit[rows].mean(axis=0)
    axis = np.linalg.svd(centred, full_matrices=False)[2][0]
    score = centred @ axis
    half = len(rows) // 2
    for _ in range(passes):
        side = np.full(len(rows), -1.0)
        side[np.argsort(score, kind="stable")[half:]] = 1.0
        out = np.where(inside, side[local], 0.0).sum(axis=1)
        into = np.bincount(local[inside], weights=np.repeat(side, inside.sum(axis=1)), minlength=len(rows))
        score = out + into + 0.5 * side  # where a row's neighbours are; ties stay
    order = np.argsort(score, kind="stable")
    return rows[np.sort(order[:half])], rows[np.sort(order[half:])]


def balanced_partition(graph: np.ndarray, unit: np.ndarray, depth: int) -> np.ndarray:
    """Part of each row, of 2**depth parts."""
    groups = [np.arange(len(graph))]
    for _ in range(depth):
        groups = [h for g in groups for h in halve(graph, g, unit)]
    part = np.empty(len(graph), np.int64)
    for number, rows in enumerate(groups):
        part[rows] = number
    return part


def fit_softmax(unit: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, epochs: int = 25, rate: float = 0.5, decay: float = 1e-5) -> Router:
    """Gradient steps with momentum towards the parts of a row and its neighbours (soft targets)."""
    target = np.zeros((len(unit), parts))
    for column in (part, *(part[graph[:, j]] for j in range(graph.shape[1]))):
        target[np.arange(len(unit)), column] += 1
    target /= target.sum(axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    x = np.concatenate([unit - mean, np.ones((len(unit), 1))], axis=1)
    w, velocity = np.zeros((parts, x.shape[1])), 0.0
    rng = np.random.default_rng(0)
    for epoch in range(epochs):
        order, step = rng.permutation(len(x)), 8 * rate / (1 + epoch / 10)
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            z = x[rows] @ w.T
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            velocity = 0.9 * velocity - step * ((p - target[rows]).T @ x[rows] / len(rows) + decay * w)
            w = w + 0.1 * velocity
    return Router(w, mean)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): rows with an id and a vector that is not null, empty or zero and has only finite numbers."""
    v = F.col("vector")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(v, lambda x: x != 0))


def units(column: pa.Array) -> np.ndarray:
    rows = np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.empty((0, 1))
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def one_per_id(rows: DataFrame) -> DataFrame:
    """The rows with one per vec_id, the least vector of each; a table without repeated ids is not shuffled."""
    repeated = cut(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"))
    if repeated.isEmpty():
        forget(repeated)
        return rows
    least = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return rows.join(repeated, "vec_id", "left_anti").unionByName(least)


def depth_for(rows: int) -> int:
    """Halvings for a table: parts grow in number with it, as far as the sample can tell them apart."""
    return min(7, max(5, (rows // 768).bit_length() - 1))


def fit_router(vectors: DataFrame, sample_rows: int, depth: int, k: int = 10) -> Router | None:
    """Fits on the ``sample_rows`` vectors with the smallest hash of their id; None if they are too few to part.

    The bounded sample (8192 x 64 doubles are 4 MB) is worked on where it arrives, on the driver."""
    chosen = F.broadcast(smallest(vectors, "vec_id", sample_rows))
    sample = vectors.join(chosen, "vec_id", "left_semi").toArrow().sort_by("vec_id")
    if sample.num_rows < 4 << depth:
        return None
    unit = units(sample.column("vector").combine_chunks())
    unit = np.unique(unit, axis=0)  # a very common vector is one row of the graph
    if len(unit) < 4 << depth:
        return None
    graph = neighbour_graph(unit, k)
    return fit_softmax(unit, graph, balanced_partition(graph, unit, depth), 1 << depth)


def _top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best per query of (query, candidate, score): rows ordered by query, score down, id up."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
    keep = rank <= k
    return query[keep], ids[keep], score[keep]


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    probe_share: float = 0.65,
    sample_rows: int = 8192,
    depth: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query by exact cosine; ties to the smaller id.

    ``queries`` has the same columns as ``vectors``; a row with the query's own id is no candidate of it. Vectors that
    are null, empty, zero, or hold null or non-finite numbers take no part, nor do rows without an id, nor vectors of
    another length than most have (of lengths that are as frequent, the greater). Of rows with one id the one with the least vector stands for all. Queries probe their
    most probable parts, a share ``probe_share`` of the ``2**depth`` (by default more for larger tables); every vector is
    indexed. A query that finds fewer than ``k`` there asks all parts, so it gets fewer only where there are no more; with
    too few vectors to part, every vector is a candidate. Each part is cut into blocks of about ``BLOCK_ROWS`` vectors
    by a hash of the id, and each block meets the part's queries in slices, so no task holds a whole part. Scores are
    summed in one order, so equal vectors tie.
    """
    base, asking = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    length = base.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    if length is not None:
        base, asking = (rows.where(F.size("vector") == length["n"]) for rows in (base, asking))
    base, asking = one_per_id(base), one_per_id(asking)
    depth = depth_for(base.count()) if depth is None else depth
    router = fit_router(base, sample_rows, depth)

    def routed(rows: DataFrame, n: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                parts = np.zeros((batch.num_rows, 1), np.int64)
                if router is not None and batch.num_rows:
                    parts = router.parts(units(batch.column("vector")), n)
                flat = pa.array(np.repeat(np.arange(len(parts)), parts.shape[1]))
                yield pa.record_batch([batch.column("vec_id").take(flat), batch.column("vector").take(flat), pa.array(parts.ravel(), pa.int32())], ["vec_id", "vector", "part"])

        return rows.select(F.col("vec_id").cast("long"), "vector").mapInArrow(run, "vec_id long, vector array<double>, part int")

    placed = routed(base, 1)
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per part
    blocks = F.broadcast(counts.select("part", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")))
    placed = placed.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))

    def asked(rows: DataFrame, n: int) -> DataFrame:
        """(query_id, vec_id, score): the best of each block that ``n`` parts of each query have."""
        sides = routed(rows, n).join(blocks, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        both = placed.select("part", "block", F.lit(True).alias("candidate"), "vec_id", "vector")
        both = both.unionByName(sides.select("part", "block", F.lit(False).alias("candidate"), "vec_id", "vector"))
        both = both.repartition("part", "block").sortWithinPartitions("part", "block", F.desc("candidate"))
        return both.mapInArrow(lambda batches: met(batches, k), "query_id long, vec_id long, score double")

    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(near: DataFrame) -> DataFrame:
        return near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if router is None:
        return best(asked(asking, 1))
    near = cut(best(asked(asking, math.ceil(probe_share * (1 << depth)))))
    enough = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    short = cut(asking.select(F.col("vec_id").cast("long"), "vector").join(enough, "vec_id", "left_anti"))
    if short.isEmpty():
        return near
    return near.join(enough, near["query_id"] == enough["vec_id"], "left_semi").unionByName(best(asked(short, 1 << depth)))


def met(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best candidates of each query in each block; a block's candidates come before its queries."""
    place, ids, rows = None, [], []
    for batch in batches:
        part, block = batch.column("part").to_numpy(), batch.column("block").to_numpy()
        candidate = batch.column("candidate").to_numpy(zero_copy_only=False)
        unit, vec_id = units(batch.column("vector")), batch.column("vec_id").to_numpy()
        change = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0) | (np.diff(candidate.astype(int)) != 0)) + 1
        for a, b in zip(np.append(0, change), np.append(change, len(part)), strict=True):
            if a == b:
                continue
            if place != (part[a], block[a]):
                place, ids, rows = (part[a], block[a]), [], []
            if candidate[a]:
                ids.append(vec_id[a:b])
                rows.append(unit[a:b])
                continue
            if not ids:
                continue
            ids, rows = [np.concatenate(ids)], [np.concatenate(rows)]
            for at in range(a, b, QUERY_ROWS):
                upto = min(b, at + QUERY_ROWS)
                yield block_best(vec_id[at:upto], unit[at:upto], ids[0], rows[0], k)


def block_best(asked_ids: np.ndarray, asked_rows: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pa.RecordBatch:
    """Candidates are chosen by a matrix product with a margin, then scored by a sum of fixed order."""
    score = asked_rows @ rows.T
    score[asked_ids[:, None] == ids[None, :]] = -np.inf
    few = min(k, len(ids))
    bound = np.partition(score, len(ids) - few, axis=1)[:, len(ids) - few]
    q, c = np.nonzero((score >= bound[:, None] - 1e-12) & np.isfinite(score))
    exact = np.concatenate([(asked_rows[q[i : i + 65536]] * rows[c[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536)] or [np.empty(0)])
    query, found, value = _top(asked_ids[q], ids[c], exact, k)
    return pa.record_batch({"query_id": pa.array(query), "vec_id": pa.array(found), "score": pa.array(value)})
