"""Lineage questions on an edge table (src, dst), for many start nodes at once.

Everything that needs more than one hop goes through ``expand``: breadth-first rounds of joins in which a node keeps
its smallest depth per start. Each round is written to the shared folder, which cuts the lineage and survives lost
executors; a round holds only new pairs, so cycles end by themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.operators import graphs
from tablewarden.session import cut, forget

#: Levels up to which a closure takes nodes by level; deeper graphs are doubled or walked.
SHALLOW = 64
#: Ways that a task of ``lineage_paths`` may hold in a hash table.
HASHED_WAYS = 250_000


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """(at, to): the way to walk; ``down`` follows edges, ``up`` goes against them, ``both`` does either."""
    down = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    up = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"))
    return {"down": down, "up": up}[direction] if direction != "both" else down.unionByName(up)


def expand(edges: DataFrame, starts: DataFrame, direction: str = "down", max_depth: int | None = None) -> DataFrame:
    """(source, node, depth, parent): all nodes that can be reached from each start (column source), at their smallest
    depth and with the smallest parent there. The start itself is never among them.

    Few starts walk hop by hop, along contracted chains where most nodes are inside of chains. Where at least half of the
    nodes are starts, the reach of all of them is doubled in each round instead, so that a graph of depth 1000 takes ten
    rounds."""
    step = oriented(edges, direction).where("at <> to").distinct()
    seeds = starts.select("source").distinct()
    if 2 * seeds.count() >= step.select("at").distinct().count():
        return doubled(step, max_depth).join(seeds, "source", "left_semi")
    if (max_depth is None or max_depth > 16) and graphs.deep(step):
        return graphs.walk_contracted(step, seeds, max_depth)
    return walked(step, seeds, max_depth)


def doubled(step: DataFrame, max_depth: int | None) -> DataFrame:
    """The reach of every node of (at, to). Of a shortest way of k + 1 to 2 k hops, the first k hops lead to a node at
    depth k and the others are a shortest way from there, so one join of the two finds all of them."""
    first = step.select(F.col("at").alias("source"), F.col("to").alias("node"), F.lit(1).alias("depth"), F.col("at").alias("parent"))
    known, depth = cut(first if max_depth is None or max_depth > 0 else first.where("false")), 1
    while max_depth is None or depth < max_depth:
        far = known.where(F.col("depth") == depth).select("source", F.col("node").alias("via"))
        on = known.select(F.col("source").alias("via"), "node", (F.col("depth") + depth).alias("depth"), "parent")
        ways = far.join(on if max_depth is None else on.where(F.col("depth") <= max_depth), "via").where("node <> source")
        ways = ways.groupBy("source", "node", "depth").agg(F.min("parent").alias("parent"))
        ways = ways.groupBy("source", "node").agg(F.min("depth").alias("depth"), F.min_by("parent", "depth").alias("parent"))
        new = cut(ways.join(known.select("source", "node"), ["source", "node"], "left_anti"))
        if new.isEmpty():
            break
        known = known.unionByName(new)
        depth *= 2
    return known


def walked(step: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    frontier = seeds.select("source", F.col("source").alias("node"))
    kind = dict(frontier.dtypes)["node"]
    found: list[DataFrame] = []
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = frontier.join(step, frontier["node"] == step["at"]).where(F.col("to") != F.col("source"))
        reached = reached.groupBy("source", F.col("to").alias("node")).agg(F.min("at").alias("parent"))
        if found:
            known = reduce(DataFrame.unionByName, found).select("source", "node")
            reached = reached.join(known, ["source", "node"], "left_anti")
        reached = cut(reached.select("source", "node", F.lit(depth).alias("depth"), "parent"))
        if reached.isEmpty():
            break
        found.append(reached)
        frontier = reached.select("source", "node")
    if not found:
        return frontier.where("false").select("source", "node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent"))
    return reduce(DataFrame.unionByName, found)


def shallow_levels(step: DataFrame, seeds: DataFrame) -> DataFrame | None:
    """Levels (node, level) of (at, to) where ``seeds`` (source) are at least half of its nodes and it has no cycle and few
    levels: then all closures are made node by node, each pair once; else null."""
    if 2 * seeds.select("source").distinct().count() < step.select("at").distinct().count():
        return None
    levels = graphs.levels_of(step)
    return None if levels is None or (levels.agg(F.max("level")).first()[0] or 0) > SHALLOW else levels


def closure(step: DataFrame, levels: DataFrame) -> DataFrame:
    """(source, node, depth) of all nodes of (at, to), which has ``levels``."""
    first = step.select(F.col("at").alias("source"), F.col("to").alias("node"), F.lit(1).alias("depth"))
    merge = lambda rows: cut(rows.groupBy("source", "node").agg(F.min("depth").alias("depth")))
    return graphs.by_levels(first, step, levels, merge, lambda on: on.withColumn("depth", F.col("depth") + 1))


def neighbours(edges: DataFrame, starts: DataFrame, direction: str) -> DataFrame:
    """(source, node): direct neighbours."""
    step = oriented(edges, direction)
    return starts.select("source").distinct().join(step, F.col("source") == F.col("at")).select("source", F.col("to").alias("node")).distinct()


def ancestors(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    return expand(edges, starts, "up", max_depth).select("source", "node", "depth")


def descendants(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    return expand(edges, starts, "down", max_depth).select("source", "node", "depth")


def neighbourhood(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Distinct edges met when walking from the starts in either direction, of up to ``max_depth`` hops each."""
    seeds = starts.select("source").distinct()
    sides = []
    for direction, near, far in (("up", "dst", "src"), ("down", "src", "dst")):
        reach = expand(edges, seeds, direction, max_depth).select("node", "depth")
        near_nodes = seeds.select(F.col("source").alias("node")).unionByName(reach.where(F.lit(True) if max_depth is None else F.col("depth") < max_depth).select("node")).distinct()
        sides.append(edges.join(near_nodes, edges[near] == near_nodes["node"], "left_semi"))
    return sides[0].unionByName(sides[1]).distinct()


def full_lineage(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """source, n_upstream, max_upstream, n_downstream, max_downstream (zeros where there is none)."""
    out = starts.select("source").distinct()
    step = cut(oriented(edges, "up").where("at <> to").distinct())
    levels = shallow_levels(step, out)
    if levels is not None:  # what is upstream of one is downstream of the other
        reach = closure(step, levels)
        sides = {"upstream": reach, "downstream": reach.select(F.col("node").alias("source"), "depth")}
    else:
        sides = {name: expand(edges, starts, way) for way, name in (("up", "upstream"), ("down", "downstream"))}
    for name, reach in sides.items():
        side = reach.groupBy("source").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.max("depth").alias(f"max_{name}"))
        out = out.join(side, "source", "left")
    return out.na.fill(0)


def distances(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, hops): length of the shortest way from a to b along edges, null if there is none, 0 for a = b."""
    reach = expand(edges, pairs.select(F.col("a").alias("source")), "down").select(F.col("source").alias("a"), F.col("node").alias("b"), "depth")
    joined = pairs.select("a", "b").distinct().join(reach, ["a", "b"], "left")
    return joined.select("a", "b", F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("depth")).alias("hops"))


def reachable(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return distances(edges, pairs).select("a", "b", F.col("hops").isNotNull().alias("reachable"))


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, path): the nodes of a shortest way, of ties the one with the smaller parents; null if there is none.

    Jump pointers (source, node) to the node 2**k hops back are joined with themselves, level by level, up to the longest
    way that is asked for. From the ends of all pairs they then lead to all nodes between, the longest jumps first: a way
    of 1,000 hops takes ten rounds each. With many pairs on a graph of few levels only nodes between the levels of a pair
    are visited instead."""
    asked = pairs.select("a", "b").distinct()
    step = cut(oriented(edges, "up").where("at <> to").distinct())
    levels = shallow_levels(step, pairs.select(F.col("a").alias("source")))
    if levels is not None:
        return paths_between(step, levels, cut(asked))
    reach = expand(edges, pairs.select(F.col("a").alias("source")), "down")
    far = asked.join(reach.select(F.col("source").alias("a"), F.col("node").alias("b"), "depth"), ["a", "b"], "left")
    far = cut(far.select("a", "b", F.col("b").alias("at"), F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("depth")).alias("depth")))
    points = cut(far.where("depth IS NOT NULL"))
    longest = points.agg(F.max("depth")).first()[0] or 0
    jumps = [cut(reach.select(F.col("source").alias("a"), F.col("node").alias("at"), "depth", F.col("parent").alias("to")))] if longest else []
    while longest >> len(jumps):
        hops, last = 1 << len(jumps), jumps[-1]
        on = last.select("a", F.col("at").alias("to"), F.col("to").alias("end"))
        jumps.append(cut(last.where(F.col("depth") >= hops).join(on, ["a", "to"]).select("a", "at", "depth", F.col("end").alias("to"))))
    for level in reversed(range(len(jumps))):
        back = jumps[level].select("a", "at", "to")
        more = points.where(F.col("depth") >= 1 << level).join(back, ["a", "at"]).select("a", "b", F.col("to").alias("at"), (F.col("depth") - (1 << level)).alias("depth"))
        points = cut(points.unionByName(more))
        forget(jumps[level])
    ordered = F.array_sort(F.collect_list(F.struct("depth", "at")))
    paths = points.groupBy("a", "b").agg(F.transform(ordered, lambda p: p["at"]).alias("path"))
    return far.select("a", "b").join(paths, ["a", "b"], "left")


def paths_between(step: DataFrame, levels: DataFrame, asked: DataFrame) -> DataFrame:
    """``shortest_paths`` by levels, from b up along (at, to): a way never comes to a below a's level, so others end there.
    Of the ways from b to a node the shortest goes on, of ties the first in order of their nodes."""
    top = levels.select(F.col("node").alias("a"), F.col("level").alias("top"))
    way = F.struct(F.lit(0).alias("depth"), F.array("b").alias("nodes"))
    low = levels.select(F.col("node").alias("b"), F.col("level").alias("low"))
    first = asked.join(top, "a").join(low, "b").where("low < top").select("a", "b", "top", F.col("b").alias("node"), way.alias("way"))

    def move(on: DataFrame) -> DataFrame:
        on = on.where((F.col("level_to") < F.col("top")) | (F.col("to") == F.col("a")))
        return on.withColumn("way", F.struct((F.col("way.depth") + 1).alias("depth"), F.concat("way.nodes", F.array("to")).alias("nodes")))

    found = graphs.by_levels(first, step, levels, lambda rows: cut(rows.groupBy("a", "b", "top", "node").agg(F.min("way").alias("way"))), move)
    paths = found.where("node = a").select("a", "b", F.reverse("way.nodes").alias("path"))
    return asked.join(paths, ["a", "b"], "left").select("a", "b", F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.col("path")).alias("path"))


def common(edges: DataFrame, pairs: DataFrame, direction: str) -> DataFrame:
    """(a, b, node): nodes in the closures of both a and b, ``up`` for ancestors, ``down`` for descendants.

    Where one of a pair is in the closure of the other, that one's whole closure is in both; of other pairs the smaller
    closure is looked up in the other, so neither the larger one nor nested ones move with their pairs."""
    asked = cut(pairs.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    seeds = asked.select(F.col("a").alias("source")).unionByName(asked.select(F.col("b").alias("source")))
    step = cut(oriented(edges, "up").where("at <> to").distinct())
    levels = shallow_levels(step, seeds)
    if levels is None:
        reach = cut(expand(edges, seeds, direction).select("source", "node"))
    else:
        reach = closure(step, levels).select(*([F.col("node").alias("source"), F.col("source").alias("node")] if direction == "down" else ["source", "node"]))
    sizes = cut(reach.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    sized = asked.join(sizes.select(F.col("source").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("source").alias("b"), F.col("n").alias("n_b")), "b")
    over, under = reach.select(F.col("source").alias("a"), F.col("node").alias("b"), F.lit(True).alias("over")), reach.select(F.col("source").alias("b"), F.col("node").alias("a"), F.lit(True).alias("under"))
    sized = sized.join(over, ["a", "b"], "left").join(under, ["a", "b"], "left")
    # (inner, outer): all of inner's closure counts if nested, else what outer's has too
    nested = F.col("over").isNotNull() | F.col("under").isNotNull() | (F.col("a") == F.col("b"))
    left = F.when(F.col("over").isNotNull(), False).when(nested, True).otherwise(F.col("n_a") <= F.col("n_b"))
    sized = cut(sized.select("a", "b", F.when(left, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(left, F.col("b")).otherwise(F.col("a")).alias("outer"), nested.alias("nested")))
    inside = sized.where("nested").join(reach, "source").where("node <> outer OR a = b").select("a", "b", "node")
    tried = sized.where("NOT nested").join(reach, "source").select("a", "b", "outer", "node")
    met = tried.join(reach.withColumnRenamed("source", "outer"), ["outer", "node"]).select("a", "b", "node")
    return inside.unionByName(met)


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def cycles(edges: DataFrame) -> DataFrame:
    """(node): what remains after nodes without incoming or without outgoing edges are taken off again and again: nodes
    on cycles or between them; empty for an acyclic graph. Self-loops count."""
    rest, n = cut(edges.select("src", "dst").distinct()), None
    while True:
        count = rest.count()
        if count in (n, 0):
            break
        n = count
        before = rest
        kept = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        rest = cut(kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        forget(before)
    return rest.select(F.col("src").alias("node")).distinct()


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): the longest way from a root; a cycle is an error.

    Several levels are one round, and chains are contracted where most nodes are inside of one (``graphs``)."""
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct()
    return graphs.longest_ways(nodes, step)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges: nodes that depend on each other have the smallest of them as their
    component, others themselves."""
    return graphs.strong_components(oriented(edges, "down"))


def impact_estimate(edges: DataFrame, starts: DataFrame, direction: str = "down", lg_k: int = 12) -> DataFrame:
    """(source, affected): about how many nodes a change reaches, without their closure: a sketch a node, merged along the
    edges. At 12 bits the standard error is 1.6 %, small counts are exact; on a cycle a start counts itself."""
    step = oriented(edges, direction).where("at <> to").distinct()
    sketches = graphs.reach_sketches(step, lg_k)
    counts = sketches.select(F.col("node").alias("source"), F.hll_sketch_estimate("sketch").alias("affected"))
    return starts.select("source").distinct().join(counts, "source", "left").na.fill(0)


def impact(edges: DataFrame, starts: DataFrame, transitive: bool = False) -> DataFrame:
    """(source, affected): number of nodes that a change reaches, by one hop or by all."""
    reach = descendants(edges, starts) if transitive else neighbours(edges, starts, "down")
    counts = reach.groupBy("source").agg(F.count(F.lit(1)).alias("affected"))
    return starts.select("source").distinct().join(counts, "source", "left").na.fill(0)


def lineage_paths(edges: DataFrame, starts: DataFrame, max_depth: int = 10, text: str | None = None) -> DataFrame:
    """(source, node, depth, path): one row per simple way of up to ``max_depth`` hops upstream. Ways multiply where
    they meet again, so the depth bound is part of the question. With ``text`` the path is the nodes joined by it.

    Ways of the first half of the hops are walked and written; a longer way is one of just as many hops, continued by a
    way of the other half from the node where it ends, so the most frequent rows take one join and are never written."""
    step = cut(oriented(edges, "up").where("at <> to").distinct())
    half = max_depth // 2
    heads = walked_ways(step, starts.select(F.col("source").alias("begin")).distinct(), half or max_depth, text)
    begun = F.array("begin") if text is None else F.concat(F.col("begin").cast("string"), F.lit(text))
    rest = "way" if text is None else "text"
    found = [h.select(F.col("begin").alias("source"), "node", "depth", F.concat(begun, rest).alias("path")) for h in heads]
    if half:
        middle = heads[-1].where(F.size("way") == half)
        tails = cut(reduce(DataFrame.unionByName, walked_ways(step, middle.select(F.col("node").alias("begin")).distinct(), max_depth - half, text)))
        per_node = tails.groupBy("begin").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        tails = tails.select(F.col("begin").alias("at"), "node", F.col("depth").alias("more"), F.col(rest).alias("rest"), F.col("way").alias("on"), F.array_min("way").alias("low"), F.array_max("way").alias("high"))
        path = F.concat(begun, rest) if text is None else F.concat(begun, rest, F.lit(text))
        middle = middle.select(F.col("begin").alias("source"), F.col("node").alias("at"), path.alias("path"), F.concat(F.array("begin"), "way").alias("way"))
        middle = middle.withColumns({"least": F.array_min("way"), "most": F.array_max("way")})
        if 0 < (per_node["most"] or 0) <= HASHED_WAYS:
            # a hash table instead of a sort of both sides, of at most about HASHED_WAYS ways and those of one node more
            parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-per_node["all"] // HASHED_WAYS))
            middle, tails = middle.repartition(parts, "at"), tails.repartition(parts, "at").hint("shuffle_hash")
        # no node twice: told by the ends of both halves where they lie apart, else node by node
        apart = (F.col("high") < F.col("least")) | (F.col("low") > F.col("most")) | ~F.arrays_overlap("way", "on")
        found.append(middle.join(tails, "at").where(apart).select("source", "node", (F.col("more") + half).alias("depth"), F.concat("path", "rest").alias("path")))
    return reduce(DataFrame.unionByName, found).select("source", "node", "depth", "path")


def walked_ways(step: DataFrame, begins: DataFrame, hops: int, text: str | None) -> list[DataFrame]:
    """(begin, node, depth, way) of each number of hops, written: the simple ways from each of ``begins`` (begin) along
    (at, to); ``way`` is without its begin, and again as one ``text``."""
    kind = dict(step.dtypes)["at"]
    ways = begins.select("begin", F.col("begin").alias("node"), F.expr(f"CAST(array() AS array<{kind}>)").alias("way"), F.lit("").alias("text"))
    found = []
    for depth in range(1, hops + 1):
        on = ways.join(step, ways["node"] == step["at"]).where((F.col("to") != F.col("begin")) & ~F.array_contains("way", F.col("to")))
        name = F.lit(None).cast("string") if text is None else F.col("to").cast("string") if depth == 1 else F.concat_ws(text, "text", F.col("to").cast("string"))
        ways = cut(on.select("begin", F.col("to").alias("node"), F.lit(depth).alias("depth"), F.concat("way", F.array("to")).alias("way"), name.alias("text")))
        found.append(ways)
        if ways.isEmpty():
            break
    return found or [ways.withColumn("depth", F.lit(0)).where("false")]


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, n_duplicates, n_self_loops."""
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    counted = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
        F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n"))), F.lit(0)).alias("n_self_loops"),
    )
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(counted)


def discover_upstream(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int, cap: int | None = 100) -> DataFrame:
    """(source, node, name, depth) upstream of each start, the furthest first, at most ``cap`` a start; a start that
    depends on itself is a row of depth 0 named as an error."""
    from pyspark.sql import Window

    reach = ancestors(edges, starts, max_depth).join(nodes.select("node", "name"), "node")
    rank = Window.partitionBy("source").orderBy(F.desc("depth"), "node")
    rows = reach.withColumn("place", F.row_number().over(rank))
    rows = rows if cap is None else rows.where(F.col("place") <= cap)
    loops = edges.where("src = dst").select(F.col("src").alias("source")).distinct().join(starts.select("source").distinct(), "source", "left_semi")
    loops = loops.select("source", F.col("source").alias("node"), F.lit("self-dependency").alias("name"), F.lit(0).alias("depth"), F.lit(0).alias("place"))
    return rows.select("source", "node", "name", "depth", "place").unionByName(loops)


def propagate_failure(edges: DataFrame, status: DataFrame, waiting: tuple[str, ...] = ("pending", "waiting_upstream")) -> DataFrame:
    """(node, state, new_state) of nodes whose state changes: what waits anywhere below a failed node fails with it."""
    failed = status.where("state = 'failed'").select(F.col("node").alias("source"))
    below = spread(edges, failed)
    return status.join(below, "node", "left_semi").where(F.col("state").isin(*waiting)).withColumn("new_state", F.lit("upstream_failed"))


def spread(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node): everything below any of the starts. One set of visited nodes, however many starts there are."""
    step = oriented(edges, "down").distinct()
    frontier = starts.select(F.col("source").alias("node")).distinct()
    found: list[DataFrame] = []
    while True:
        reached = frontier.join(step, frontier["node"] == step["at"]).select(F.col("to").alias("node")).distinct()
        if found:
            reached = reached.join(reduce(DataFrame.unionByName, found), "node", "left_anti")
        reached = cut(reached)
        if reached.isEmpty():
            break
        found.append(reached)
        frontier = reached
    return reduce(DataFrame.unionByName, found) if found else reached


def visible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are among the nodes."""
    keys = nodes.select("node").distinct()
    seen = edges.join(keys, edges["src"] == keys["node"], "left_semi")
    return seen.join(keys, seen["dst"] == keys["node"], "left_semi")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, missing): edges that name an unknown node, once for each unknown end."""
    keys = nodes.select("node").distinct()
    lost = [edges.join(keys, edges[end] == keys["node"], "left_anti").select("src", "dst", F.lit(end).alias("missing")) for end in ("src", "dst")]
    return lost[0].unionByName(lost[1])


def dependencies_of(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(source, direction, node, name): direct neighbours with their names, both ways."""
    sides = [neighbours(edges, starts, d).withColumn("direction", F.lit(n)) for d, n in (("up", "upstream"), ("down", "downstream"))]
    return sides[0].unionByName(sides[1]).join(nodes.select("node", "name"), "node").select("source", "direction", "node", "name")


def graph_export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): nodes and the visible edges as JSON rows."""
    out = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(F.col("node").alias("id"), "name")).alias("json"))
    inside = visible_edges(edges, nodes)
    return out.unionByName(inside.select(F.lit("edge").alias("kind"), F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"))).alias("json")))
