"""Deep graphs: chains of 1,000, components, levels, walks and reach sketches against plain Python."""

import random
import time
from collections import defaultdict, deque

import pytest

from tablewarden.operators import graphs, lineage


def frame(spark, pairs, names="at long, to long"):
    return spark.createDataFrame(pairs, names)


def reach(pairs, source):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
    seen, queue = {source: 0}, deque([source])
    while queue:
        n = queue.popleft()
        for m in near[n]:
            if m not in seen:
                seen[m] = seen[n] + 1
                queue.append(m)
    return seen


def shape(seed):
    """A random part, chains into and out of it, two rings."""
    rng = random.Random(seed)
    pairs = {(rng.randrange(20), rng.randrange(20)) for _ in range(rng.randint(15, 30))}
    pairs |= {(100 + j, 101 + j) for j in range(9)} | ({(109, 100)} if seed % 2 else {(109, 3), (5, 100)})
    return sorted(pairs | {(200, 201), (201, 200), (300, 301), (301, 302), (302, 300), (7, 50), (50, 51), (51, 7)})


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    pairs = shape(seed)
    far = {n: reach(pairs, n) for n in {x for p in pairs for x in p}}
    want = {n: min(m for m in far[n] if n in far[m]) for n in far}
    assert {r.node: r.component for r in graphs.strong_components(frame(spark, pairs)).collect()} == want


def test_contracted_walk(spark):
    pairs = [p for p in shape(2) if p[0] != p[1]]
    sources = [0, 5, 104, 300]
    want = {(s, n): d for s in sources for n, d in reach(pairs, s).items() if n != s}
    seeds = frame(spark, [(s,) for s in sources], "source long")
    found = graphs.walk_contracted(frame(spark, pairs), seeds, None).collect()
    assert {(r.source, r.node): r.depth for r in found} == want and len(found) == len(want)
    assert all(r.parent in reach(pairs, r.source) and (r.parent, r.node) in pairs for r in found)
    plain = lineage.walked(frame(spark, pairs), seeds, None).collect()
    assert {(r.source, r.node): r.parent for r in plain} == {(r.source, r.node): r.parent for r in found}
    near = graphs.walk_contracted(frame(spark, pairs), seeds, 4).collect()
    assert {(r.source, r.node): r.depth for r in near} == {k: d for k, d in want.items() if d <= 4}


@pytest.mark.parametrize("tail", [0, 60])
def test_levels(spark, tail):
    rng = random.Random(tail)
    pairs = sorted({tuple(sorted(rng.sample(range(25), 2))) for _ in range(45)} | {(30 + i, 31 + i) for i in range(tail)} | {(0, 30), (30 + tail, 24)})
    want = {n: 0 for n in range(100)}
    for _ in range(100):
        for a, b in pairs:
            want[b] = max(want[b], want[a] + 1)
    step = frame(spark, pairs)
    assert graphs.deep(step) == (tail > 0)
    found = graphs.longest_ways(frame(spark, [(n,) for n in range(100)], "node long"), step)
    assert {r.node: r.level for r in found.collect()} == want
    for loop in [(24, 0), (3, 3), (500, 500)]:
        with pytest.raises(ValueError):
            graphs.longest_ways(frame(spark, [(1,)], "node long"), frame(spark, [*pairs, loop]))


def test_chains_of_a_thousand_take_few_rounds(spark):
    edges = frame(spark, [(i, i + 1) for i in range(1000)], "src long, dst long")
    started = time.time()
    paths = lineage.shortest_paths(edges, frame(spark, [(0, 1000), (3, 1)], "a long, b long")).collect()
    assert {r.a: r.path for r in paths} == {0: list(range(1001)), 3: None}
    levels = lineage.topological_levels(frame(spark, [(i,) for i in range(1001)], "node long"), edges).collect()
    assert all(r.node == r.level for r in levels)
    back = edges.unionByName(frame(spark, [(1000, 400)], "src long, dst long"))
    assert lineage.components(back).where("component = 400").count() == 601
    assert time.time() - started < 240


def test_sketched_impact_is_near_the_exact_one(spark):
    edges = spark.read.parquet("/root/testdata/sf0.01/part.parquet").selectExpr("p_partkey DIV 2 AS src", "p_partkey AS dst").where("src > 0")
    starts = edges.selectExpr("src AS source").distinct()
    exact = {r.source: r.affected for r in lineage.impact(edges, starts, transitive=True).collect()}
    about = lineage.impact_estimate(edges, starts)
    assert all(abs(r.affected - exact[r.source]) <= max(1, 0.05 * exact[r.source]) for r in about.collect())
    assert "union" not in about._jdf.queryExecution().toString().lower().replace("hll_union", "")  # no closure, a row a node
