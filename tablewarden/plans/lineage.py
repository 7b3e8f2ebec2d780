"""Queries of the lineage graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.operators import lineage as g
from tablewarden.plans.base import Plans

plan = Plans()
QUERIES, ORACLES = plan.queries, plan.oracles


def closure(near: str, far: str, depth: int = 40, starts: str = "starts", edges: str = "edges") -> str:
    """Recursive SQL for (source, node, depth) with the smallest depth; the set semantics of UNION end it."""
    return f"""WITH RECURSIVE walk AS (SELECT source, source AS node, 0 AS depth FROM {{{starts}}}
        UNION SELECT w.source, e.{far}, w.depth + 1 FROM walk w JOIN {{{edges}}} e ON e.{near} = w.node WHERE w.depth < {depth}),
        reach AS (SELECT source, node, min(depth) AS depth FROM walk WHERE node <> source GROUP BY ALL)"""


UP, DOWN = closure("dst", "src"), closure("src", "dst")
PAIR_STARTS = DOWN.replace("FROM {starts}", "FROM (SELECT a AS source FROM {pairs} UNION SELECT b FROM {pairs})")
PAIR_STARTS_UP = UP.replace("FROM {starts}", "FROM (SELECT a AS source FROM {pairs} UNION SELECT b FROM {pairs})")


@plan("lin_neighbors", "SELECT DISTINCT source, 'up' AS way, src AS node FROM {starts} JOIN {edges} ON dst = source UNION SELECT source, 'down', dst FROM {starts} JOIN {edges} ON src = source")
def _(t):
    sides = [g.neighbours(t["edges"], t["starts"], d).select("source", F.lit(d).alias("way"), "node") for d in ("up", "down")]
    return sides[0].unionByName(sides[1])


@plan("lin_ancestors", f"{UP} SELECT * FROM reach")
def _(t):
    return g.ancestors(t["edges"], t["starts"])


@plan("lin_descendants", f"{closure('src', 'dst', 3)} SELECT * FROM reach")
def _(t):
    return g.descendants(t["edges"], t["starts"], 3)


@plan(
    "lin_neighborhood",
    f"""{closure('dst', 'src', 2)}, down AS (SELECT source, dst FROM {{starts}} JOIN {{edges}} ON src = source)
    SELECT DISTINCT e.src, e.dst FROM {{edges}} e WHERE e.dst IN (SELECT node FROM walk WHERE depth < 2) OR e.src IN (SELECT source FROM {{starts}} UNION SELECT dst FROM down)""",
)
def _(t):
    return g.neighbourhood(t["edges"], t["starts"], 2)


@plan(
    "lin_full",
    f"""{UP}, walk2 AS (SELECT source, source AS node, 0 AS depth FROM {{starts}} UNION SELECT w.source, e.dst, w.depth + 1 FROM walk2 w JOIN {{edges}} e ON e.src = w.node WHERE w.depth < 40),
    reach2 AS (SELECT source, node, min(depth) AS depth FROM walk2 WHERE node <> source GROUP BY ALL)
    SELECT source, (SELECT count(*) FROM reach r WHERE r.source = s.source) AS n_upstream, coalesce((SELECT max(depth) FROM reach r WHERE r.source = s.source), 0) AS max_upstream,
    (SELECT count(*) FROM reach2 r WHERE r.source = s.source) AS n_downstream, coalesce((SELECT max(depth) FROM reach2 r WHERE r.source = s.source), 0) AS max_downstream FROM {{starts}} s""",
)
def _(t):
    return g.full_lineage(t["edges"], t["starts"])


@plan(
    "lin_shortest_path",
    f"""{PAIR_STARTS}, best AS (SELECT r.source, r.node, min(e.src) AS parent FROM reach r JOIN {{edges}} e ON e.dst = r.node
        LEFT JOIN reach q ON q.source = r.source AND q.node = e.src WHERE e.src <> r.node AND coalesce(q.depth, CASE WHEN e.src = r.source THEN 0 END) = r.depth - 1 GROUP BY ALL),
    back AS (SELECT a, b, b AS at, CAST(b AS VARCHAR) AS path FROM {{pairs}}
        UNION ALL SELECT k.a, k.b, x.parent, x.parent || '>' || k.path FROM back k JOIN best x ON x.source = k.a AND x.node = k.at WHERE k.at <> k.a)
    SELECT a, b, (SELECT k.path FROM back k WHERE k.a = p.a AND k.b = p.b AND k.at = k.a) AS path FROM {{pairs}} p""",
)
def _(t):
    paths = g.shortest_paths(t["edges"], t["pairs"])
    return paths.select("a", "b", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@plan("lin_reachable", f"{PAIR_STARTS} SELECT a, b, depth IS NOT NULL OR a = b AS reachable FROM {{pairs}} LEFT JOIN reach ON source = a AND node = b")
def _(t):
    return g.reachable(t["edges"], t["pairs"])


@plan("lin_distance", f"{PAIR_STARTS} SELECT a, b, CASE WHEN a = b THEN 0 ELSE depth END AS hops FROM {{pairs}} LEFT JOIN reach ON source = a AND node = b")
def _(t):
    return g.distances(t["edges"], t["pairs"])


@plan("lin_common_ancestors", f"{PAIR_STARTS_UP} SELECT a, b, x.node FROM {{pairs}} JOIN reach x ON x.source = a JOIN reach y ON y.source = b AND y.node = x.node")
def _(t):
    return g.common(t["edges"], t["pairs"], "up")


@plan("lin_common_descendants", f"{PAIR_STARTS} SELECT a, b, x.node FROM {{pairs}} JOIN reach x ON x.source = a JOIN reach y ON y.source = b AND y.node = x.node")
def _(t):
    return g.common(t["edges"], t["pairs"], "down")


@plan("lin_roots", "SELECT node FROM {nodes} WHERE node NOT IN (SELECT dst FROM {edges})")
def _(t):
    return g.roots(t["nodes"].select("node"), t["edges"])


@plan("lin_leaves", "SELECT node FROM {nodes} WHERE node NOT IN (SELECT src FROM {edges})")
def _(t):
    return g.leaves(t["nodes"].select("node"), t["edges"])


@plan("lin_acyclic", "SELECT true AS acyclic, count(*) AS n_edges FROM {edges}")
def _(t):
    left = g.cycles(t["edges"]).agg((F.count(F.lit(1)) == 0).alias("acyclic"))
    return left.crossJoin(t["edges"].agg(F.count(F.lit(1)).alias("n_edges")))


@plan(
    "lin_cycles",
    """WITH RECURSIVE walk AS (SELECT src AS a, dst AS b FROM {cyclic} UNION SELECT w.a, c.dst FROM walk w JOIN {cyclic} c ON c.src = w.b),
    round AS (SELECT a AS node FROM walk WHERE a = b)
    SELECT node FROM (SELECT b AS node FROM walk WHERE a IN (SELECT node FROM round) UNION SELECT node FROM round)
    INTERSECT SELECT node FROM (SELECT a AS node FROM walk WHERE b IN (SELECT node FROM round) UNION SELECT node FROM round)""",
)
def _(t):
    return g.cycles(t["cyclic"])


@plan(
    "lin_topo_levels",
    """WITH RECURSIVE walk AS (SELECT node, 0 AS level FROM {nodes} WHERE node NOT IN (SELECT dst FROM {edges})
    UNION SELECT e.dst, w.level + 1 FROM walk w JOIN {edges} e ON e.src = w.node) SELECT node, max(level) AS level FROM walk GROUP BY node""",
)
def _(t):
    return g.topological_levels(t["nodes"], t["edges"])


@plan("lin_impact", f"{DOWN} SELECT source, (SELECT count(*) FROM reach r WHERE r.source = s.source) AS affected FROM {{starts}} s")
def _(t):
    return g.impact(t["edges"], t["starts"], transitive=True)


@plan(
    "lin_components",
    """WITH RECURSIVE walk AS (SELECT src AS a, dst AS b FROM {cyclic} UNION SELECT w.a, c.dst FROM walk w JOIN {cyclic} c ON c.src = w.b),
    mates AS (SELECT x.a AS node, x.b AS mate FROM walk x JOIN walk y ON y.a = x.b AND y.b = x.a), n AS (SELECT src AS node FROM {cyclic} UNION SELECT dst FROM {cyclic})
    SELECT n.node, coalesce(least(n.node, min(mate)), n.node) AS component FROM n LEFT JOIN mates ON mates.node = n.node GROUP BY n.node""",
)
def _(t):
    return g.components(t["cyclic"])


@plan("lin_impact_estimate")
def _(t):
    return g.impact_estimate(t["edges"], t["starts"])


@plan("lin_impact_direct", "SELECT source, count(DISTINCT dst) AS affected FROM {starts} LEFT JOIN {edges} ON src = source GROUP BY source")
def _(t):
    return g.impact(t["edges"], t["starts"])


@plan(
    "lin_paths",
    """WITH RECURSIVE walk AS (SELECT source, source AS node, 0 AS depth, CAST(source AS VARCHAR) AS path FROM {starts}
    UNION ALL SELECT w.source, e.src, w.depth + 1, w.path || '>' || e.src FROM walk w JOIN {edges} e ON e.dst = w.node WHERE w.depth < 10)
    SELECT source, node, depth, path FROM walk WHERE depth > 0""",
)
def _(t):
    return g.lineage_paths(t["edges"], t["starts"], text=">")


@plan("lin_stats", "SELECT (SELECT count(*) FROM {nodes}) AS n_nodes, count(*) AS n_edges, CAST(count(*) - count(DISTINCT (src, dst)) AS BIGINT) AS n_duplicates, count(*) FILTER (src = dst) AS n_self_loops FROM (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part UNION ALL SELECT p_partkey // 3, p_partkey FROM part)")
def _(t):
    edges = t.sql("SELECT p_partkey DIV 2 AS src, p_partkey AS dst FROM {part} UNION ALL SELECT p_partkey DIV 3, p_partkey FROM {part}")
    return g.graph_stats(t["nodes"], edges)


@plan(
    "lin_discover_upstream",
    f"""{closure('dst', 'src', 10)}, ranked AS (SELECT source, reach.node, name, depth, row_number() OVER (PARTITION BY source ORDER BY depth DESC, reach.node) AS place FROM reach JOIN {{nodes}} n ON n.node = reach.node)
    SELECT * FROM ranked WHERE place <= 100""",
)
def _(t):
    return g.discover_upstream(t["nodes"], t["edges"], t["starts"], 10)


STATUS = "SELECT node, CASE node % 13 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'waiting_upstream' ELSE 'running' END AS state FROM {nodes}"


@plan(
    "lin_propagate_failure",
    f"""WITH RECURSIVE s AS ({STATUS}), walk AS (SELECT dst AS node FROM {{edges}} WHERE src IN (SELECT node FROM s WHERE state = 'failed') UNION SELECT e.dst FROM walk w JOIN {{edges}} e ON e.src = w.node)
    SELECT node, state, 'upstream_failed' AS new_state FROM s WHERE state IN ('pending', 'waiting_upstream') AND node IN (SELECT node FROM walk)""",
)
def _(t):
    return g.propagate_failure(t["edges"], t.sql(STATUS))


@plan("lin_export", """SELECT 'node' AS kind, chr(123) || '"id":' || node || ',"name":"' || name || '"' || chr(125) AS json FROM {nodes} WHERE tenant_id = 4
    UNION ALL SELECT 'edge', chr(123) || '"from":' || src || ',"to":' || dst || chr(125) FROM {edges} WHERE src % 9 = 4 AND dst % 9 = 4""")
def _(t):
    return g.graph_export(t["nodes"].where("tenant_id = 4"), t["edges"])


@plan("flt_visible_edges", "SELECT src, dst FROM {edges} WHERE src % 9 < 6 AND dst % 9 < 6")
def _(t):
    return g.visible_edges(t["edges"], t["nodes"].where("tenant_id < 6"))


@plan("join_dangling_deps", "SELECT src, dst, 'src' AS missing FROM {edges} WHERE src % 5 = 0 UNION ALL SELECT src, dst, 'dst' FROM {edges} WHERE dst % 5 = 0")
def _(t):
    return g.dangling(t["nodes"].where("node % 5 <> 0"), t["edges"])


@plan(
    "join_dependencies_of",
    "SELECT DISTINCT source, 'upstream' AS direction, src AS node, name FROM {starts} JOIN {edges} ON dst = source JOIN {nodes} ON node = src UNION SELECT source, 'downstream', dst, name FROM {starts} JOIN {edges} ON src = source JOIN {nodes} ON node = dst",
)
def _(t):
    return g.dependencies_of(t["nodes"], t["edges"], t["starts"])


@plan(
    "agg_depth_distribution",
    f"{UP} SELECT CASE WHEN d >= 4 THEN '4+' ELSE CAST(d AS VARCHAR) END AS depth, count(*) AS n FROM (SELECT source, max(depth) AS d FROM reach GROUP BY source) GROUP BY 1",
)
def _(t):
    deepest = g.ancestors(t["edges"], t["starts"]).groupBy("source").agg(F.max("depth").alias("d"))
    return deepest.groupBy(F.when(F.col("d") >= 4, F.lit("4+")).otherwise(F.col("d").cast("string")).alias("depth")).agg(F.count(F.lit(1)).alias("n"))


PLAN_STARTS = "SELECT node AS source FROM {nodes} WHERE node % 100 = 37"


@plan(
    "part_backfill_plan",
    f"""{closure('dst', 'src', 4).replace('FROM {starts}', f'FROM ({PLAN_STARTS})')}, deepest AS (SELECT source, max(depth) AS m FROM reach GROUP BY source),
    days AS (SELECT DISTINCT o_orderdate FROM orders), done AS (SELECT DISTINCT o_orderdate, o_custkey % 50 AS node FROM orders WHERE o_orderstatus = 'F')
    SELECT source AS target, reach.node, m - depth AS execution_order, strftime(days.o_orderdate, '%Y-%m-%d') AS key FROM reach JOIN deepest USING (source) CROSS JOIN days
    LEFT JOIN done ON done.o_orderdate = days.o_orderdate AND done.node = reach.node WHERE done.node IS NULL""",
)
def _(t):
    from tablewarden.operators.partitions import backfill_plan

    upstream = g.ancestors(t["edges"], t.sql(PLAN_STARTS), 4).withColumnRenamed("source", "target")
    key = F.date_format("o_orderdate", "yyyy-MM-dd").alias("key")
    done = t["orders"].where("o_orderstatus = 'F'").select((F.col("o_custkey") % 50).alias("node"), key).distinct()
    return backfill_plan(upstream, upstream.select("node").distinct().crossJoin(t["orders"].select(key).distinct()), done)
