"""What to rebuild upstream of changed partitions: ranges of keys carried along lineage edges, each through the mapping of
its edge, and merged where they meet.

A range is (first, last) in time, ``last`` exclusive, cut to the partitions of its node; null ends are open, as for a node
without partitions. So a month of a daily source is one row and not thirty, and the ways through a graph that meet again
are one row as well."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.keys import GRAINS, STEPS, key_end, key_start, partition_key
from tablewarden.operators import graphs
from tablewarden.session import cut, forget

_TRUNC = {"hourly": "HOUR", "daily": "DAY", "weekly": "WEEK", "monthly": "MONTH", "yearly": "YEAR"}
OPEN_FIRST, OPEN_LAST = "0001-01-01 00:00:00", "9999-12-31 00:00:00"


def by_grain(grain: Column, make: Callable[[str], Column]) -> Column:
    """A column per grain, null for a node without partitions."""
    out = F.when(grain == GRAINS[0], make(GRAINS[0]))
    for name in GRAINS[1:]:
        out = out.when(grain == name, make(name))
    return out


def unit(grain: Column) -> Column:
    return by_grain(grain, lambda g: F.lit(_TRUNC[g]))


def steps(grain: Column, n: Column) -> Column:
    """``n`` partitions as (months, days, hours)."""
    part = lambda sizes: by_grain(grain, lambda g: F.lit(sizes.get(g, 0))) * n
    sizes = {"months": {"monthly": 1, "yearly": 12}, "days": {"daily": 1, "weekly": 7}, "hours": {"hourly": 1}}
    return F.struct(*[F.coalesce(part(s), F.lit(0)).alias(name) for name, s in sizes.items()])


def later(moment: str, by: str) -> Column:
    """A moment moved by a struct of ``steps``; most edges move by none."""
    parts = {name: F.col(f"{by}.{name}") for name in ("months", "days", "hours")}
    none = reduce(lambda a, b: a & b, [c == 0 for c in parts.values()])
    return F.when(none, F.col(moment)).otherwise(F.col(moment) + F.make_interval(**parts))


def by_unit(unit: str, hour: str, rest: dict[str, str]) -> Column:
    """SQL of each unit; whole days are moved as dates."""
    days = " ".join(f"WHEN '{name}' THEN CAST({text} AS TIMESTAMP_NTZ)" for name, text in rest.items())
    return F.expr(f"CASE {unit} WHEN 'HOUR' THEN {hour} {days} END")


def floor_to(moment: str, unit: str) -> Column:
    """Start of the partition that holds a moment; the unit may differ by row."""
    day = f"CAST({moment} AS DATE)"
    rest = {"DAY": day} | {u: f"trunc({day}, '{u}')" for u in ("WEEK", "MONTH", "YEAR")}
    return by_unit(unit, f"CAST(date_trunc('HOUR', {moment}) AS TIMESTAMP_NTZ)", rest)


def after(start: str, unit: str) -> Column:
    """Start of the partition after the one that starts there."""
    day = f"CAST({start} AS DATE)"
    rest = {"DAY": f"date_add({day}, 1)", "WEEK": f"date_add({day}, 7)", "MONTH": f"add_months({day}, 1)", "YEAR": f"add_months({day}, 12)"}
    return by_unit(unit, f"{start} + INTERVAL 1 HOUR", rest)


def key_range(ranges: DataFrame, grain: str) -> DataFrame:
    """(first, last) of each row's (start_key, end_key), both inclusive keys of the column ``grain``."""
    first = by_grain(F.col(grain), lambda g: key_start(F.col("start_key"), g))
    last = by_grain(F.col(grain), lambda g: key_end(F.col("end_key"), g))
    return ranges.withColumns({"first": first, "last": last})


def merge_ranges(ranges: DataFrame, by: list[str], **kept: Column) -> DataFrame:
    """Overlapping and touching ranges (first, last) of each group as one row, with aggregates of the merged rows. Equal
    ranges are made one before the sort, so a group holds as many rows as it has different ranges."""
    ends = {"first": OPEN_FIRST, "last": OPEN_LAST}
    closed = ranges.withColumns({c: F.coalesce(c, F.lit(v).cast("timestamp_ntz")) for c, v in ends.items()})
    aggregates = [c.alias(n) for n, c in kept.items()]
    once = closed.groupBy(*by, *ends).agg(*aggregates) if kept else closed.select(*by, *ends).distinct()
    order = Window.partitionBy(*by).orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = once.withColumn("opens", F.coalesce(F.col("first") > before, F.lit(True)).cast("int"))
    islands = opens.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy(*by, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), *aggregates).drop("island")
    return out.withColumns({c: F.nullif(F.col(c), F.lit(v).cast("timestamp_ntz")) for c, v in ends.items()})


def upstream_ranges(targets: DataFrame, edges: DataFrame, specs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(target, node, first, last, depth): what each target's range needs of every node upstream of it.

    ``targets`` is (target, start_key, end_key) in keys of the target's own grain, several rows a target if it has several
    ranges; ``edges`` (src, dst), with ``mapping`` and ``n`` where they are declared; ``specs`` (node, grain). A hop goes
    from dst to src: a ``window`` of n reaches n - 1 partitions further back, an ``offset`` moves by n, any other mapping
    keeps the time; then the range is widened to whole partitions of src, which is the identity for equal grains and an
    aggregation where they nest. What a node without partitions needs or gives is open on both sides.

    Where edges have no cycle and ``max_depth`` is null, nodes take turns by their level, so that each is asked once.
    Otherwise breadth first: a round carries the ranges that the rounds before haven't covered yet, so what several ways
    ask of a node is carried once, and a graph with cycles ends as soon as nothing new is asked. A window on a cycle asks for more
    in every round: bound it by ``max_depth``. ``depth`` is the smallest number of hops to the node. The target itself is
    never among its nodes."""
    known_columns = {"mapping": "string", "n": "int"}
    hops = edges.select("src", "dst", *[F.col(c) if c in edges.columns else F.lit(None).cast(k).alias(c) for c, k in known_columns.items()]).where("src <> dst").distinct()
    grains = specs.select("node", "grain")
    hops = hops.join(grains.select(F.col("node").alias("src"), F.col("grain").alias("up")), "src", "left")
    hops = hops.join(grains.select(F.col("node").alias("dst"), F.col("grain").alias("down")), "dst", "left")
    moves = {"back": F.when(F.col("mapping") == "window", 1 - F.col("n")).when(F.col("mapping") == "offset", F.col("n")), "on": F.when(F.col("mapping") == "offset", F.col("n"))}
    moves = {name: steps(F.col("down"), n) for name, n in moves.items()}
    hops = cut(hops.select("src", "dst", unit(F.col("up")).alias("unit"), *[c.alias(n) for n, c in moves.items()]))
    start = targets.join(grains.withColumnRenamed("node", "target"), "target", "left")
    start = key_range(start, "grain").select("target", F.col("target").alias("node"), "first", "last")
    levels = graphs.levels_of(hops.select(F.col("dst").alias("at"), F.col("src").alias("to")).distinct()) if max_depth is None else None
    if levels is not None:
        return ranges_by_levels(start, hops, levels)
    by = ["target", "node"]
    frontier = cut(merge_ranges(start, by))
    known, depth = None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        asked = frontier.join(hops, F.col("node") == F.col("dst")).where(F.col("src") != F.col("target"))
        asked = carried(asked.withColumn("node", F.col("src")), "target", "node")
        asked = merge_ranges(asked, by)
        if known is not None:
            have = known.select("target", "node", F.col("first").alias("have_first"), F.col("last").alias("have_last"))
            covers = (F.col("have_first").isNull() | (F.col("have_first") <= F.col("first"))) & (F.col("have_last").isNull() | (F.col("have_last") >= F.col("last")))
            same = (asked["target"] == have["target"]) & (asked["node"] == have["node"])
            asked = asked.join(have, same & covers, "left_anti")
        new = cut(asked)
        forget(frontier)
        if new.isEmpty():
            break
        rows = new.withColumn("depth", F.lit(depth))
        merged = rows if known is None else known.unionByName(rows)
        before, known = known, cut(merge_ranges(merged, by, depth=F.min("depth")))
        if before is not None:
            forget(before)
        frontier = new
    if known is None:
        return frontier.where("false").withColumn("depth", F.lit(0))
    nearest = known.groupBy(*by).agg(F.min("depth").alias("depth"))
    return known.drop("depth").join(nearest, by)


def carried(asked: DataFrame, *kept: str) -> DataFrame:
    """(kept, first, last): ranges (first, last) of a node moved along the edge (unit, back, on) beside them."""
    asked = asked.select(*kept, "unit", later("first", "back").alias("first"), later("last", "on").alias("end"))
    asked = asked.select(*kept, "unit", "end", floor_to("first", "unit").alias("first"), floor_to("end", "unit").alias("low"))
    return asked.select(*kept, "first", F.when(F.col("low") < F.col("end"), after("low", "unit")).otherwise(F.col("low")).alias("last"))


def ranges_by_levels(start: DataFrame, hops: DataFrame, levels: DataFrame) -> DataFrame:
    """``upstream_ranges`` of an acyclic graph."""
    by, ends = ["target", "node"], {"first": OPEN_FIRST, "last": OPEN_LAST}

    def merge(rows: DataFrame) -> DataFrame:
        closed = rows.withColumns({c: F.coalesce(c, F.lit(v).cast("timestamp_ntz")) for c, v in ends.items()})
        spans = closed.groupBy(*by).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("first").alias("late"), F.min("last").alias("early"), F.min("depth").alias("depth"))
        # ranges that all share a point, or touch in it, are one; others are merged in their order
        spans = cut(spans)
        apart = spans.where("late > early").select(*by, "depth")
        one = spans.where("late <= early").select(*by, "depth", *[F.nullif(F.col(c), F.lit(v).cast("timestamp_ntz")).alias(c) for c, v in ends.items()])
        if apart.isEmpty():
            return one
        return one.unionByName(cut(merge_ranges(rows.drop("depth").join(apart, by), [*by, "depth"])))

    first = start.withColumn("depth", F.lit(0))
    move = lambda on: carried(on.withColumn("depth", F.col("depth") + 1), "target", "to", "depth", "level_to")
    edges = hops.withColumnsRenamed({"dst": "at", "src": "to"})
    found = graphs.by_levels(first, edges, levels, merge, move)
    return found.where("depth > 0").select(*by, "first", "last", "depth")


def named(ranges: DataFrame, specs: DataFrame) -> DataFrame:
    """Adds start_key and end_key, inclusive keys of the node's grain; null where a range is open."""
    keyed = ranges.join(specs.select("node", "grain"), "node", "left")
    final = by_grain(F.col("grain"), lambda g: F.col("last") - F.expr(STEPS[g]))
    return keyed.withColumns(
        {"start_key": by_grain(F.col("grain"), lambda g: partition_key(F.col("first"), g)), "end_key": by_grain(F.col("grain"), lambda g: partition_key(final, g))}
    )


def rebuild_ranges(targets: DataFrame, edges: DataFrame, specs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(target, node, execution_order, start_key, end_key) of ``upstream_ranges``: the furthest nodes come first."""
    ranges = upstream_ranges(targets, edges, specs, max_depth)
    deepest = ranges.groupBy("target").agg(F.max("depth").alias("deepest"))
    out = named(ranges, specs).join(deepest, "target")
    return out.select("target", "node", (F.col("deepest") - F.col("depth")).alias("execution_order"), "start_key", "end_key")


def rebuild_keys(targets: DataFrame, edges: DataFrame, specs: DataFrame, completed: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(target, node, execution_order, key): the single partitions of ``rebuild_ranges`` that are not in ``completed``
    (node, key). A range is spread to keys only here, once for all targets that need it; open ranges have no keys."""
    ranges = upstream_ranges(targets, edges, specs, max_depth)
    deepest = ranges.groupBy("target").agg(F.max("depth").alias("deepest"))
    closed = merge_ranges(ranges.where("first IS NOT NULL AND last IS NOT NULL"), ["node"]).join(specs.select("node", "grain"), "node")
    moments = by_grain(F.col("grain"), lambda g: F.sequence(F.col("first"), F.col("last") - F.expr(STEPS[g]), F.expr(STEPS[g])))
    days = closed.select("node", "grain", F.explode(moments).alias("at"))
    days = days.select("node", "at", by_grain(F.col("grain"), lambda g: partition_key(F.col("at"), g)).alias("key"))
    missing = days.join(completed.select("node", "key"), ["node", "key"], "left_anti")
    ordered = ranges.join(deepest, "target")
    inside = (missing["node"] == ordered["node"]) & (missing["at"] >= ordered["first"]) & (missing["at"] < ordered["last"])
    return ordered.join(missing, inside).select("target", ordered["node"], (F.col("deepest") - F.col("depth")).alias("execution_order"), "key")
