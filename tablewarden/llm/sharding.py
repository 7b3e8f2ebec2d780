"""Hierarchical weighted hash tree: a row descends region, rack and shard levels by weighted hash draws.

At every level each child gets the draw ``-ln(u) / weight`` with ``u`` a hash of (key, child); the smallest draw wins,
so a child is chosen in proportion to its weight and a change of one weight moves rows only into or out of that
child. A new shard is opened under a region of its own, so that it takes rows only into itself; a new shard inside an
old region would change that region's weight and also refill its old shards (movement stays inside that subtree).

Everything is built-in column expressions; the only shuffles carry (key, size, checksum) rows, never texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.text import spans


@dataclass(frozen=True)
class Leaf:
    """One shard with the subtree that holds it."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


def topology(shards: int, base: int = 8, racks_per_region: int = 2, shards_per_rack: int = 2) -> list[Leaf]:
    """The first ``base`` shards fill racks and regions; each later shard opens a region of its own."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    leaves = []
    for s in range(shards):
        rack = s // shards_per_rack
        region, rack = (f"r{rack // racks_per_region}", f"k{rack}") if s < base else (f"new{s}", f"new{s}")
        leaves.append(Leaf(s, region, rack))
    return leaves


def _draw(key: list[Column], node: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(*key, F.lit(node)), 11).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 53))) / F.lit(weight)


def _pick(key: list[Column], children: dict[str, tuple[float, Column]]) -> Column:
    """Value of the child with the smallest draw; ties go to the smaller name."""
    if len(children) == 1:
        return next(iter(children.values()))[1]
    drawn = [F.struct(_draw(key, name, w).alias("d"), F.lit(name).alias("n")) for name, (w, _) in children.items()]
    name = F.least(*drawn)["n"]
    out = None
    for child, (_, value) in sorted(children.items()):
        out = F.when(name == child, value) if out is None else out.when(name == child, value)
    return out


def shard_column(key: list[Column], leaves: list[Leaf]) -> Column:
    """Shard of each row, decided by the key and the tree alone. A null key is a key like any other."""
    if any(not (leaf.weight > 0 and math.isfinite(leaf.weight)) for leaf in leaves):
        raise ValueError("weights must be positive")
    tree: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in leaves:
        tree.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    regions = {}
    for region, racks in tree.items():
        kids = {}
        for rack, members in racks.items():
            shards = {f"{region}/{rack}/{m.shard}": (m.weight, F.lit(m.shard)) for m in members}
            kids[f"{region}/{rack}"] = (sum(m.weight for m in members), _pick(key, shards))
        regions[region] = (sum(w for w, _ in kids.values()), _pick(key, kids))
    return _pick(key, regions).cast("int")


def shard_rows(
    docs: DataFrame,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    slot_buckets: int = 1024,
    leaves: list[Leaf] | None = None,
    grown: list[Leaf] | None = None,
) -> DataFrame:
    """Places every row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length plus 1 (null text: 1, checksum 0). ``slot`` numbers the rows of a shard from 0
    without gaps: rows are numbered inside ``slot_buckets`` hash buckets of a shard, and the buckets' offsets come
    from a running sum over their counts (a table of shards x buckets rows, which bounds what is broadcast). Rows
    that are equal in id, size and checksum are counted first and then numbered in spans of at most 4096, each in a
    bucket of its own hash, so a key that holds a third of the rows is spread over the buckets. An empty table gives no
    rows; other columns of the input are ignored.
    """
    leaves, grown = leaves or topology(shards), grown or topology(shards + 1)
    doc_id = F.col(id_col)
    rows = docs.select(
        doc_id.alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.select("doc_id", "size", "text_crc32", F.explode(spans(F.col("copies"))).alias("span"))
    rows = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("span.first").alias("number"),
        (F.col("span.last") - F.col("span.first") + 1).alias("copies"),
        shard_column([F.col("doc_id")], leaves).alias("shard"),
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "span.first"), F.lit(slot_buckets)).cast("int").alias("bucket"),
    )
    buckets = rows.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32", "number")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    rows = rows.join(F.broadcast(buckets), ["shard", "bucket"])
    start = F.col("offset") + F.col("first")
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(start, start + F.col("copies") - 1)).alias("slot"),
        shard_column([F.col("doc_id")], grown).alias("grown_shard"),
    )
