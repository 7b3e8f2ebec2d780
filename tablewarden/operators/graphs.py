"""Building blocks for deep graphs: contraction of chains, several rounds in one plan, components, reach sketches.

Most of the depth of a deep lineage is in chains, nodes with one edge in and one edge out. Their inner nodes point to the
node before them; pointers are doubled, so a chain of 1,000 takes ten rounds, and what is left is walked by weighted edges.
Where a walk over single edges is unavoidable, several steps are one plan: each step is a join and a grouping on the node,
with an edge of each node to itself that keeps its row, so a step refers to the one before it once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.session import cut, delete, forget, scratch_path

#: Steps of a walk that are planned and run together between two written rounds.
STEPS_A_ROUND = 6


def chains(step: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Inner nodes of chains of (at, to), which must be distinct and without loops, and the nodes of rings.

    The first table is (node, head, hops, parent, first): ``head`` is the node before the chain, ``hops`` edges back,
    ``parent`` the node right before, ``first`` the first node of the chain. Nodes of ``keep`` (node) are never inner nodes. The second is (node, least): nodes of rings,
    cycles of inner nodes only, with the smallest node of the ring."""
    into = step.groupBy(F.col("to").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("at").alias("parent")).where("n_in = 1")
    out = step.groupBy(F.col("at").alias("node")).agg(F.count(F.lit(1)).alias("n_out")).where("n_out = 1")
    inner = into.join(out, "node").select("node", "parent")
    inner = inner if keep is None else inner.join(keep.select("node"), "node", "left_anti")
    pointers = cut(inner.select("node", F.col("parent").alias("head"), F.lit(1).alias("hops"), "parent", F.col("node").alias("first"), F.least("node", "parent").alias("least")))
    n, reach = pointers.count(), 1
    while True:
        ahead = pointers.select(F.col("node").alias("head"), F.col("head").alias("far"), F.col("hops").alias("more"), F.col("first").alias("far_first"), F.col("least").alias("far_least"))
        moved = pointers.join(ahead, "head", "left")
        if reach > n or moved.where("far IS NOT NULL").isEmpty():
            break
        doubled = moved.select("node", F.coalesce("far", "head").alias("head"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), "parent", F.coalesce("far_first", "first").alias("first"), F.least("least", "far_least").alias("least"))
        before, pointers = pointers, cut(doubled)
        forget(before)
        reach *= 2
    inside = pointers.select(F.col("node").alias("head"))
    rings = pointers.join(inside, "head", "left_semi").select("node", "least")
    return pointers.join(inside, "head", "left_anti").select("node", "head", "hops", "parent", "first"), rings


def contracted(step: DataFrame, inner: DataFrame) -> DataFrame:
    """(at, to, hops, last): the edges between nodes that are no inner nodes, ``last`` being the node before ``to``."""
    outer = step.join(inner.select(F.col("node").alias("to")), "to", "left_anti")
    joined = outer.join(inner.select(F.col("node").alias("at"), "head", F.col("hops").alias("before")), "at", "left")
    return joined.select(F.coalesce("head", "at").alias("at"), "to", (F.coalesce("before", F.lit(0)) + 1).alias("hops"), F.col("at").alias("last"))


def walk_contracted(step: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    """(source, node, depth, parent) like a walk hop by hop from each of ``seeds`` (source), in as many rounds as the
    contracted graph has hops. A longer way of fewer hops may be found first: a pair is walked again when it improves."""
    inner, rings = chains(step, seeds.select(F.col("source").alias("node")))
    inner = cut(inner)
    edges = cut(contracted(step.join(rings.select(F.col("node").alias("to")), "to", "left_anti"), inner))
    kind = dict(step.dtypes)["at"]
    best = seeds.select("source", F.col("source").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent"))
    frontier = best.select("source", "node", "depth")
    while True:
        ways = frontier.join(edges, frontier["node"] == edges["at"]).select("source", F.col("to").alias("node"), (F.col("depth") + F.col("hops")).alias("depth"), F.col("last").alias("parent"))
        ways = ways.where("node <> source" if max_depth is None else f"node <> source AND depth <= {max_depth}")
        before = best.select("source", "node", F.col("depth").alias("known"))
        merged = best.unionByName(ways).groupBy("source", "node").agg(F.min(F.struct("depth", "parent")).alias("best"))
        merged = merged.select("source", "node", "best.*").join(before, ["source", "node"], "left")
        last, best = best, cut(merged.withColumn("moved", F.coalesce(F.col("depth") < F.col("known"), F.lit(True))))
        forget(last)
        frontier = best.where("moved").select("source", "node", "depth")
        if frontier.isEmpty():
            break
        best = carried(best, ["source", "node", "depth", "parent"])
    best = best.select("source", "node", "depth", "parent")
    heads = best.select("source", F.col("node").alias("head"), "depth")
    between = heads.join(inner, "head").select("source", "node", (F.col("depth") + F.col("hops")).alias("depth"), "parent")
    between = between if max_depth is None else between.where(F.col("depth") <= max_depth)
    return best.where("node <> source").unionByName(between)


def carried(table: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of a table of ``cut`` that ``forget`` can still delete."""
    out = table.select(*columns)
    out._scratch = table._scratch
    return out


def steps_in_rounds(state: DataFrame, one: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame, int], bool]) -> tuple[list[DataFrame], int]:
    """Runs ``one`` (state, number) again and again, ``STEPS_A_ROUND`` of them in a plan, until ``done`` (written state,
    steps so far). Returns the states written, the last of which is final."""
    written, number = [], 0
    while True:
        for _ in range(STEPS_A_ROUND):
            state = one(state, number)
            number += 1
        state = cut(state)
        written.append(state)
        if done(state, number):
            return written, number


def longest_ways(nodes: DataFrame, step: DataFrame) -> DataFrame:
    """(node, level): hops of the longest way that ends in each of ``nodes`` (node); ``step`` (at, to) is distinct. A node
    gets its level once all nodes before it have theirs; what never gets one is on a cycle or behind one, an error.

    Chains are contracted first where half of the nodes are inside of one."""
    found = longest_outside(step)
    out = nodes.select("node").distinct().join(found, "node", "left")
    return out.select("node", F.coalesce("level", F.lit(0)).alias("level"))


def longest_outside(step: DataFrame) -> DataFrame:
    """(node, level) of every node of (at, to)."""
    step = cut(step)
    inner, rings = chains(step) if deep(step) else (None, None)
    if rings is not None and not rings.isEmpty():
        raise ValueError("the graph has a cycle")
    edges = step.select("at", "to", F.lit(1).alias("hops")) if inner is None else cut(contracted(step, inner).select("at", "to", "hops"))
    needs = edges.groupBy(F.col("to").alias("node")).agg(F.count(F.lit(1)).alias("needed"))
    itself = edges.select(F.col("at").alias("node")).union(edges.select("to")).distinct().join(needs, "node", "left").select(F.col("node").alias("at"), F.col("node").alias("to"), F.lit(0).alias("hops"), F.coalesce("needed", F.lit(0)).alias("needed"), F.lit(True).alias("itself"))
    links = edges.join(needs.withColumnRenamed("node", "to"), "to").select("at", "to", "hops", "needed", F.lit(False).alias("itself"))
    hops = cut(itself.unionByName(links))
    start = hops.where("itself AND needed = 0").select(F.col("at").alias("node"), F.lit(0).cast("long").alias("met"), F.lit(0).alias("level"), F.lit(0).alias("turn"))

    def one(state: DataFrame, turn: int) -> DataFrame:
        on = state.join(hops, F.col("node") == F.col("at")).where(F.col("itself") | (F.col("turn") == turn))
        on = on.select(
            F.col("to").alias("node"),
            F.when(F.col("itself"), F.col("met")).otherwise(F.lit(1)).alias("met"),
            (F.col("level") + F.col("hops")).alias("level"),
            F.when(F.col("itself"), F.col("turn")).alias("turn"),
            "needed",
        )
        grouped = on.groupBy("node").agg(F.sum("met").alias("met"), F.max("level").alias("level"), F.max("turn").alias("turn"), F.max("needed").alias("needed"))
        ready = F.coalesce("turn", F.when(F.col("met") == F.col("needed"), F.lit(turn + 1)))
        return grouped.select("node", "met", "level", ready.alias("turn"))

    # a node that has passed its level on is done: only its written row stays
    finished, turn, state = [], 0, start
    while True:
        first = turn
        for turn in range(first, first + STEPS_A_ROUND):
            state = one(state, turn)
        turn += 1
        written = cut(state)
        finished.append(written.where((F.col("turn") >= first) & (F.col("turn") < turn)).select("node", "level"))
        state = written.where(F.col("turn").isNull() | (F.col("turn") >= turn))
        if state.where("turn IS NOT NULL").isEmpty():
            break
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    if not state.isEmpty() or out.count() < hops.where("itself").count():
        raise ValueError("the graph has a cycle")
    if inner is None:
        return out
    heads = out.select(F.col("node").alias("head"), "level")
    return out.unionByName(heads.join(inner, "head").select("node", (F.col("level") + F.col("hops")).alias("level")))


def levels_of(step: DataFrame) -> DataFrame | None:
    """(node, level) of every node of (at, to), written, so that edges lead to larger levels only; null if there is a cycle."""
    try:
        return cut(longest_outside(step))
    except ValueError:
        return None


def by_levels(first: DataFrame, hops: DataFrame, levels: DataFrame, merge: Callable[[DataFrame], DataFrame], move: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows carried along the edges of an acyclic graph, each node's at once: ``first`` (node, ...) and what ``move`` makes
    of merged rows joined with ``hops`` (at, to, ...) wait by the level of their node; when its turn comes, all have
    arrived, ``merge`` makes one written table of them, and they are carried on. So nothing is asked twice and no round looks at
    those before. Returns the merged rows of all nodes."""
    spark = first.sparkSession
    known, waiting = scratch_path(spark, "hops"), scratch_path(spark, "waiting")
    level = lambda name: levels.select(F.col("node").alias(name), F.col("level").alias(f"level_{name}"))
    # both levels of an edge by two joins of edges, so that a level's rows need no join to learn their next level
    hops.join(level("at"), "at").join(level("to"), "to").write.partitionBy("level_at").parquet(known)
    hop_type = T.StructType([*hops.schema.fields, T.StructField("level_to", T.IntegerType()), T.StructField("level_at", T.IntegerType())])
    begun = first.join(levels, "node")
    begun.write.partitionBy("level").parquet(waiting)
    row_type = T.StructType([*[f for f in begun.schema.fields if f.name != "level"], T.StructField("level", T.IntegerType())])
    out = []
    for now in range((levels.agg(F.max("level")).first()[0] or 0) + 1):
        here = spark.read.schema(row_type).parquet(waiting).where(F.col("level") == now).drop("level")
        found = merge(here)
        out.append(found)
        on = spark.read.schema(hop_type).parquet(known).where(F.col("level_at") == now).drop("level_at")
        moved = move(found.join(on, found["node"] == on["at"]).drop("node", "at"))
        moved.withColumnsRenamed({"to": "node", "level_to": "level"}).select(*[f.name for f in row_type]).write.mode("append").partitionBy("level").parquet(waiting)
        delete(spark, f"{waiting}/level={now}")
    return reduce(DataFrame.unionByName, out)


def deep(step: DataFrame) -> bool:
    """Whether at least half of the nodes are inside of chains: then contraction pays."""
    ends = step.select(F.col("at").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(step.select(F.col("to").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    degrees = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    n, inside = degrees.agg(F.count(F.lit(1)), F.coalesce(F.sum(((F.col("out") == 1) & (F.col("into") == 1)).cast("int")), F.lit(0))).first()
    return 2 * inside >= n > 0


def spread_least(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the smallest label of the nodes from which each node can be reached, itself included. ``edges``
    (at, to), ``labels`` (node, label) of all nodes."""
    itself = labels.select(F.col("node").alias("at"), F.col("node").alias("to"))
    hops = cut(edges.select("at", "to").unionByName(itself).distinct())
    state = labels.select("node", "label", F.col("label").alias("before"))

    def one(state: DataFrame, _: int) -> DataFrame:
        on = state.join(hops, F.col("node") == F.col("at")).select(F.col("to").alias("node"), "label", F.when(F.col("at") == F.col("to"), F.col("label")).alias("before"))
        return on.groupBy("node").agg(F.min("label").alias("label"), F.max("before").alias("before"))

    written, _ = steps_in_rounds(state, one, lambda s, _: s.where("label < before").isEmpty())
    for table in (*written[:-1], hops):
        forget(table)
    return written[-1].select("node", "label")


def strong_components(step: DataFrame) -> DataFrame:
    """(node, component) of every node of (at, to): nodes that reach each other have one component, named by the smallest
    of them; all others are their own.

    Inner nodes of chains are taken out first: one belongs to the component of the chain's ends if they share one. Then
    in turns: nodes without an edge in or without one out are alone; every other node takes the smallest node that
    reaches it as its colour; those of a colour that reach its namesake are its component. Edges between different
    colours and those of found components are left out, until no edge is left."""
    every = step.select(F.col("at").alias("node")).union(step.select("to")).distinct()
    step = cut(step.where("at <> to").distinct())
    inner, rings = chains(step)
    inner, rings = cut(inner), cut(rings)
    edges = cut(contracted(step.join(rings.select(F.col("node").alias("to")), "to", "left_anti"), inner).select("at", "to").where("at <> to").distinct())
    found = [rings.select("node", F.col("least").alias("component"))]
    while not edges.isEmpty():
        kept = edges
        for _ in range(2):
            kept = kept.join(edges.select(F.col("to").alias("at")).distinct(), "at", "left_semi")
            kept = kept.join(edges.select(F.col("at").alias("to")).distinct(), "to", "left_semi")
        kept = cut(kept.select("at", "to"))
        if kept.isEmpty():
            break
        nodes = kept.select(F.col("at").alias("node")).union(kept.select("to")).distinct()
        colours = cut(spread_least(kept, nodes.select("node", F.col("node").alias("label"))).withColumnRenamed("label", "colour"))
        ends = kept.join(colours.withColumnsRenamed({"node": "at", "colour": "c"}), "at").join(colours.withColumnsRenamed({"node": "to", "colour": "d"}), "to")
        same = cut(ends.where("c = d").select("at", "to"))
        # backwards from the namesake inside of its colour: a label 0 spreads against the edges
        seeds = colours.select("node", F.when(F.col("node") == F.col("colour"), F.lit(0)).otherwise(F.lit(1)).alias("label"))
        back = spread_least(same.select(F.col("to").alias("at"), F.col("at").alias("to")), seeds).where("label = 0").select("node")
        members = cut(colours.join(back, "node", "left_semi").select("node", F.col("colour").alias("component")))
        found.append(members)
        taken = members.select("node")
        rest = same.join(taken.withColumnRenamed("node", "at"), "at", "left_anti").join(taken.withColumnRenamed("node", "to"), "to", "left_anti")
        edges = cut(rest.select("at", "to"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = cut(out)
    # a chain from a node back into its component belongs to it
    exits = step.join(inner.select(F.col("node").alias("at"), "head", "first"), "at").join(inner.select(F.col("node").alias("to")), "to", "left_anti")
    ends = exits.join(out.select(F.col("node").alias("head"), F.col("component").alias("a")), "head", "left").join(out.select(F.col("node").alias("to"), F.col("component").alias("b")), "to", "left")
    closed = cut(ends.select("first", "head", F.coalesce("a", "head").alias("component"), F.coalesce("b", "to").alias("b")).where("component = b").drop("b"))
    rows = out.unionByName(closed.select(F.col("head").alias("node"), "component")).unionByName(inner.drop("head").join(closed, "first").select("node", "component"))
    # the smallest node of a component may be inside of a chain
    least = rows.groupBy("component").agg(F.min("node").alias("least"))
    named = rows.join(least, "component").groupBy("node").agg(F.min("least").alias("component"))
    return every.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def reach_sketches(step: DataFrame, lg_k: int = 12) -> DataFrame:
    """(node, sketch): a HyperLogLog sketch of all nodes that each node of (at, to) with an edge out can reach. Sketches are
    merged against the edges, several steps a round, until no estimate changes: a node has one row however much it
    reaches, and merging twice changes nothing, so cycles need no care."""
    near = step.groupBy(F.col("at").alias("node")).agg(F.hll_sketch_agg("to", F.lit(lg_k)).alias("sketch"))
    itself = near.select(F.col("node").alias("at"), F.col("node").alias("to"))
    hops = cut(step.select("at", "to").unionByName(itself).distinct())
    state = cut(near)

    def one(state: DataFrame, _: int) -> DataFrame:
        return state.select(F.col("node").alias("to"), "sketch").join(hops, "to").groupBy(F.col("at").alias("node")).agg(F.hll_union_agg("sketch").alias("sketch"))

    while True:
        later = state
        for number in range(STEPS_A_ROUND):
            later = one(later, number)
        later = cut(later)
        estimates = later.select("node", F.hll_sketch_estimate("sketch").alias("now")).join(state.select("node", F.hll_sketch_estimate("sketch").alias("then")), "node")
        done = estimates.where("now <> then").isEmpty()
        forget(state)
        state = later
        if done:
            forget(hops)
            return state
