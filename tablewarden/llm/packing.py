"""Variable-capacity best-fit packing of documents into sequences of a few permitted lengths.

Pieces are placed longest first into the open bin with the least room that still takes them. When none does, a bin is
opened; at the end each bin shrinks to the smallest permitted length that holds its contents. Which openings pay off
depends on the mix of lengths, so every choice of the length that each length class opens is packed (120 for five
lengths) and the cheapest final result is taken: the lengths are optimised jointly.

Documents are dealt by a hash of their id and length into groups of about ``group_rows`` rows, each packed by itself;
the cost is one set of part-filled bins a group. Of equal rows, each 4096 are dealt together.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.text import spans

CAPACITIES = (1024, 2048, 4096, 8192, 16384)


def sequence_cost(capacity: int, overhead: int = 128, attention: int = 65536) -> float:
    """Cost of a sequence: its tokens, a fixed overhead, and attention that grows with the square of the length."""
    return capacity + overhead + capacity * capacity / attention


def place(lengths: list[int], sizes: list[int], opens: dict[int, int]) -> tuple[list[int], list[int], list[int]]:
    """Best fit where a piece that fits no open bin opens ``opens[c]``, c being the least size that holds it."""
    opened, at, offsets, room = [], [], [], []
    for length in lengths:
        i = bisect_left(room, (length, -1))
        if i < len(room):
            left, number = room.pop(i)
        else:
            left = opens[sizes[bisect_left(sizes, length)]]
            number = len(opened)
            opened.append(0)
        at.append(number)
        offsets.append(opened[number])
        opened[number] += length
        if left > length:
            insort(room, (left - length, number))
    return at, offsets, [sizes[bisect_left(sizes, used)] for used in opened]


def cheapest(lengths: list[int], sizes: list[int], policies: Iterable[dict[int, int]], cost: Callable[[int], float]) -> tuple[list[int], list[int], list[int]]:
    best = None
    for opens in policies:
        packed = place(lengths, sizes, opens)
        total = sum(map(cost, packed[2]))
        if best is None or total < best[0]:
            best = (total, packed)
    return best[1] if best else ([], [], [])


def pack(lengths: list[int], capacities: tuple[int, ...], cost: Callable[[int], float]) -> tuple[list[int], list[int], list[int]]:
    """Best fit with the cheapest cap on openings: (bin of each piece, offset of each piece, length of each bin).

    Pieces must be at most the largest capacity and come in the order in which they are to be placed. Under a cap, a
    piece opens the size of the least cost per token. Among caps of equal cost the smaller one is taken."""
    sizes = sorted(set(capacities))
    caps = [c for c in sizes if c >= max(lengths, default=0)]
    policies = ({s: min((c for c in sizes if s <= c <= cap), key=lambda c: (cost(c) / c, c)) for s in sizes if s <= cap} for cap in caps)
    return cheapest(lengths, sizes, policies, cost)


def joint_policies(lengths: list[int], sizes: list[int]) -> list[dict[int, int]]:
    """Every choice of the size that each length class that occurs opens; smaller sizes come first."""
    classes = sorted({sizes[bisect_left(sizes, n)] for n in lengths})
    return [dict(zip(classes, choice, strict=True)) for choice in product(*[[c for c in sizes if c >= s] for s in classes])]


def pack_jointly(lengths: list[int], capacities: tuple[int, ...], cost: Callable[[int], float]) -> tuple[list[int], list[int], list[int]]:
    """Like ``pack``, with the cheapest of all ``joint_policies``, which hold those of every cap."""
    sizes = sorted(set(capacities))
    return cheapest(lengths, sizes, joint_policies(lengths, sizes), cost)


def pack_documents(
    docs: DataFrame,
    length: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacities: tuple[int, ...] = CAPACITIES,
    cost: Callable[[int], float] = sequence_cost,
    group_rows: int = 32_768,
) -> DataFrame:
    """doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_length: where every token of every document goes.

    ``length`` is the number of tokens of a row; by default the UTF-8 bytes of the text plus one end mark, the length
    for a byte-level model (a null text has the end mark alone). A document longer than the largest capacity is cut
    into full pieces of that capacity, each a bin of its own, and a rest; piece numbers count from 0, ``start`` is the
    piece's first token in the document. Rows with a length of 0 or less take no part. Repeated rows are packed as
    often as they occur. ``bin_id`` is unique over all groups. Texts are never shuffled, only ids and lengths.
    """
    length = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1 if length is None else length
    largest = max(capacities)
    rows = docs.select(F.col(id_col).alias("doc_id"), length.cast("long").alias("length")).where("length > 0")
    kind = rows.schema["doc_id"].dataType.simpleString()
    groups = max(1, -(-docs.count() // group_rows))
    rows = rows.groupBy("doc_id", "length").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.select("doc_id", "length", F.explode(spans(F.col("copies"))).alias("span"))
    group = F.pmod(F.xxhash64("doc_id", "length", "span.first"), F.lit(groups)).cast("int")
    rows = rows.select("doc_id", "length", (F.col("span.last") - F.col("span.first") + 1).alias("copies"), group.alias("group"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending")])
        table = table.take(np.repeat(np.arange(len(table)), table.column("copies").to_numpy()))
        group = table.column("group")[0].as_py()
        ids, sizes = table.column("doc_id").to_pylist(), table.column("length").to_pylist()
        full = [divmod(n, largest) for n in sizes]
        rest = sorted(((n, i) for i, (_, n) in enumerate(full) if n), key=lambda x: (-x[0], x[1]))
        at, offsets, final = pack_jointly([n for n, _ in rest], capacities, cost)
        out = [(ids[i], whole, whole * largest, n, at[k], offsets[k], final[at[k]]) for k, (n, i) in enumerate(rest) for whole in [full[i][0]]]
        number = len(final)
        for i, (whole, _) in enumerate(full):
            for piece in range(whole):
                out.append((ids[i], piece, piece * largest, largest, number, 0, largest))
                number += 1
        doc, piece, start, n, bins, offset, size = zip(*out, strict=True)
        long = pa.int64()
        return pa.table(
            {
                "doc_id": pa.array(doc, table.column("doc_id").type),
                "piece": pa.array(piece, long),
                "start": pa.array(start, long),
                "n_tokens": pa.array(n, long),
                "bin_id": pa.array([(group << 32) + b for b in bins], long),
                "bin_offset": pa.array(offset, long),
                "bin_length": pa.array(size, long),
            }
        )

    columns = "piece long, start long, n_tokens long, bin_id long, bin_offset long, bin_length long"
    rows = rows.repartition(groups, "group")  # else small rows bring many groups, each of some seconds, into one task
    return rows.groupBy("group").applyInArrow(run, f"doc_id {kind}, {columns}")
