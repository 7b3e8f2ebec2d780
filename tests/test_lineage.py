"""Graph shapes: chain, diamond, two-node cycle, triangle, self-loop; random graphs against plain Python."""

import random
from collections import deque

import pytest

from tablewarden.operators import lineage as g


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def starts_of(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "source long")


def test_cycle_never_returns_the_start(spark):
    edges = edges_of(spark, [(1, 2), (2, 3), (3, 1), (4, 4)])
    found = {(r.source, r.node): r.depth for r in g.descendants(edges, starts_of(spark, 1, 4)).collect()}
    assert found == {(1, 2): 1, (1, 3): 2}
    assert {r.node for r in g.cycles(edges).collect()} == {1, 2, 3, 4}


def test_depth_zero_is_none(spark):
    assert g.descendants(edges_of(spark, [(1, 2)]), starts_of(spark, 1), 0).count() == 0


def test_paths(spark):
    edges = edges_of(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)])
    pairs = spark.createDataFrame([(1, 5), (5, 1), (2, 2)], "a long, b long")
    assert {(r.a, r.b): r.path for r in g.shortest_paths(edges, pairs).collect()} == {(1, 5): [1, 2, 4, 5], (5, 1): None, (2, 2): [2]}
    assert {(r.a, r.b): r.hops for r in g.distances(edges, pairs).collect()} == {(1, 5): 3, (5, 1): None, (2, 2): 0}


def test_levels(spark):
    nodes = spark.createDataFrame([(n,) for n in range(1, 6)], "node long")
    assert {r.node: r.level for r in g.topological_levels(nodes, edges_of(spark, [(1, 2), (2, 3), (1, 3)])).collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0}
    with pytest.raises(ValueError):
        g.topological_levels(nodes, edges_of(spark, [(1, 2), (2, 1)]))


def test_random_graph(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    want = {}
    for s in (0, 5, 9):
        seen, queue = {s: 0}, deque([s])
        while queue:
            n = queue.popleft()
            for m in near.get(n, ()):
                if m not in seen:
                    seen[m] = seen[n] + 1
                    queue.append(m)
        want |= {(s, n): d for n, d in seen.items() if n != s}
    assert {(r.source, r.node): r.depth for r in g.descendants(edges_of(spark, pairs), starts_of(spark, 0, 5, 9)).collect()} == want


def test_compatible_mappings(spark):
    from tablewarden.operators import partitions as p

    specs = spark.createDataFrame([(1, "daily"), (2, "daily"), (3, "monthly"), (4, "custom"), (5, "custom"), (6, "range")], "node int, grain string")
    rows = [
        (1, 2, "identity", None, None, None), (1, 3, "identity", None, None, "incompatible: daily to monthly"), (4, 5, "identity", None, None, None),
        (1, 3, "aggregate", "daily", "monthly", None), (1, 3, "aggregate", "hourly", "monthly", "incompatible: daily to monthly"),
        (3, 1, "aggregate", "monthly", "daily", "no aggregation from monthly to daily"), (1, 2, "window", "daily", "daily", None),
        (1, 3, "offset", "daily", "daily", "incompatible: daily to monthly"), (1, 9, "window", "daily", "daily", "incompatible: daily to none"),
        (3, 4, "custom", None, None, None),
    ]
    edges = spark.createDataFrame([r[:5] for r in rows], "src int, dst int, mapping string, up_grain string, down_grain string")
    got = sorted((tuple(r) for r in p.check_compatible(edges, specs).collect()), key=str)
    assert got == sorted(((*r[:3], r[5]) for r in rows), key=str)
    pairs = spark.createDataFrame([(4, 5), (6, 6), (4, 6), (1, 3), (1, 9)], "src int, dst int")
    inferred = {(r.src, r.dst): (r.mapping, r.reason) for r in p.infer_mapping(pairs, specs, without=None).collect()}
    assert inferred == {(4, 5): ("identity", None), (6, 6): ("identity", None), (4, 6): (None, "custom does not map to range"), (1, 3): ("aggregate", None), (1, 9): (None, "not partitioned")}


def test_paths_are_joined_from_halves(spark):
    """Simple ways on a graph with cycles, loops and repeated edges, against plain Python, as arrays and as texts."""
    rng = random.Random(8)
    pairs = [(rng.randrange(9), rng.randrange(9)) for _ in range(22)] + [(3, 3), (100, 4), (100, 4)]
    into = {}
    for a, b in set(pairs):
        into.setdefault(b, []).append(a)
    edges, starts = edges_of(spark, pairs), starts_of(spark, *range(9), 77)
    for limit in (1, 2, 5, 6):
        want, ways = [], [(s,) for s in range(9)]
        for _ in range(limit):
            ways = [(*w, a) for w in ways for a in into.get(w[-1], ()) if a not in w]
            want += ways
        found = g.lineage_paths(edges, starts, limit)
        assert sorted((tuple(r.path), r.source, r.node, r.depth) for r in found.collect()) == sorted((w, w[0], w[-1], len(w) - 1) for w in want)
        named = g.lineage_paths(edges, starts, limit, text=" > ").collect()
        assert sorted(r.path for r in named) == sorted(" > ".join(map(str, w)) for w in want)


def test_longest_paths_take_one_join(spark):
    """All hops but those of the written halves are one join, however deep the bound."""
    found = g.lineage_paths(edges_of(spark, [(n // 2, n) for n in range(2, 200)]), starts_of(spark, 190, 191), 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sum(plan.count(name) for name in ("SortMergeJoin", "ShuffledHashJoin", "BroadcastHashJoin")) == 1
    assert max(r.depth for r in found.collect()) == 7


def ways_down(pairs, nodes):
    """Shortest ways from each node as {(a, b): nodes}, ties to the smaller parents, counted from the end."""
    into = {}
    for a, b in set(pairs):
        into.setdefault(b, set()).add(a)
    near = {}
    for a, b in set(pairs):
        near.setdefault(a, set()).add(b)
    out = {}
    for s in nodes:
        depth, queue = {s: 0}, deque([s])
        while queue:
            n = queue.popleft()
            for m in near.get(n, ()):
                if m not in depth:
                    depth[m] = depth[n] + 1
                    queue.append(m)
        for b in depth:
            way = [b]
            while way[0] != s:
                way.insert(0, min(p for p in into[way[0]] if depth.get(p) == depth[way[0]] - 1))
            out[s, b] = way
    return out


def layered(rng, n):
    """Edges without a cycle whose ids are in no order of their levels."""
    ids = rng.sample(range(100, 100 + n), n)
    return ids, [(ids[i], ids[j]) for j in range(1, n) for i in rng.sample(range(j), min(j, rng.randrange(4)))] + [(ids[0], ids[0])]


def test_both_ways_from_one_closure(spark, monkeypatch):
    ids, pairs = layered(random.Random(1), 40)
    want = {}
    for (a, b), way in ways_down(pairs, ids).items():
        for row, at in ((a, 2), (b, 0)):
            x = want.setdefault(row, [0, 0, 0, 0])
            x[at], x[at + 1] = x[at] + (a != b), max(x[at + 1], len(way) - 1)
    edges, starts = edges_of(spark, pairs), starts_of(spark, *ids[:-3])
    monkeypatch.setattr(g, "expand", lambda *_: pytest.fail("walked once more"))
    found = {r.source: [r.n_upstream, r.max_upstream, r.n_downstream, r.max_downstream] for r in g.full_lineage(edges, starts).collect()}
    assert found == {n: want[n] for n in ids[:-3]}
    monkeypatch.undo()
    ring = edges_of(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    assert {r.source: (r.n_upstream, r.n_downstream) for r in g.full_lineage(ring, starts_of(spark, 1, 2, 3, 4)).collect()} == {1: (2, 3), 2: (2, 3), 3: (2, 3), 4: (3, 0)}


def test_paths_visit_nodes_between_their_ends(spark, monkeypatch):
    ids, pairs = layered(random.Random(2), 30)
    want = ways_down(pairs, ids)
    edges, every = edges_of(spark, pairs), [(a, b) for a in [*ids, 7] for b in [*ids, 7]]
    asked = spark.createDataFrame(every + every[:3] + [(None, ids[0])], "a long, b long")
    monkeypatch.setattr(g, "expand", lambda *_: pytest.fail("all closures"))
    found = {(r.a, r.b): r.path for r in g.shortest_paths(edges, asked).collect()}
    assert found == {p: want.get(p, [7] if p == (7, 7) else None) for p in every} | {(None, ids[0]): None}


@pytest.mark.parametrize("extra", [[], [1]])
def test_common_of_nested_and_other_pairs(spark, extra):
    ids, pairs = layered(random.Random(3), 26)
    pairs = pairs + [(b, a) for a, b in pairs[:2] for _ in extra]  # without and with a cycle
    reach = {}
    for (a, b) in ways_down(pairs, ids):
        if a != b:
            reach.setdefault(a, set()).add(b)
    every = [(a, b) for a in ids for b in ids]
    edges, asked = edges_of(spark, pairs), spark.createDataFrame([*every, *every[:5], (7, ids[0]), (None, 1)], "a long, b long")
    found = g.common(edges, asked, "down")
    assert sorted(map(tuple, found.collect())) == sorted((a, b, n) for a, b in every for n in reach.get(a, set()) & reach.get(b, set()))
    up = {(a, b, n) for a, b in every for n in ids if a in reach.get(n, ()) and b in reach.get(n, ())}
    assert {tuple(r) for r in g.common(edges, asked, "up").collect()} == up
    # nested pairs take their rows from one closure: only the others are looked up in a second one
    moved = found._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT nested" in moved
