"""Ranges carried through composed mappings."""

import random

import pytest

from tablewarden.operators import rebuild as r


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def ranges(spark, targets, edges, specs, depth=None):
    t = frame(spark, targets, "target string, start_key string, end_key string")
    e = frame(spark, edges, "src string, dst string, mapping string, n int")
    s = frame(spark, specs, "node string, grain string")
    rows = r.rebuild_ranges(t, e, s, depth).collect()
    return sorted((x.target, x.node, x.execution_order, x.start_key, x.end_key) for x in rows)


SPECS = [("month", "monthly"), ("day", "daily"), ("hour", "hourly"), ("year", "yearly"), ("week", "weekly")]


def test_month_over_days_and_hours(spark):
    edges = [("day", "month", None, None), ("hour", "day", "aggregate", None), ("year", "day", None, None), ("week", "month", None, None)]
    assert ranges(spark, [("month", "2024-02", "2024-02")], edges, SPECS) == [
        ("month", "day", 1, "2024-02-01", "2024-02-29"),
        ("month", "hour", 0, "2024-02-01 00:00:00", "2024-02-29 23:00:00"),
        ("month", "week", 1, "2024-W05", "2024-W09"),  # weeks do not nest in months: all that overlap
        ("month", "year", 0, "2024", "2024"),
    ]


def test_windows_and_offsets_compose_and_meet(spark):
    specs = [(n, "daily") for n in "abcd"]
    edges = [("b", "a", "window", 7), ("c", "a", "offset", -1), ("d", "b", "identity", None), ("d", "c", "offset", -20)]
    assert ranges(spark, [("a", "2024-03-10", "2024-03-10")], edges, specs) == [
        ("a", "b", 1, "2024-03-04", "2024-03-10"),
        ("a", "c", 1, "2024-03-09", "2024-03-09"),
        ("a", "d", 0, "2024-02-18", "2024-02-18"),
        ("a", "d", 0, "2024-03-04", "2024-03-10"),
    ]
    edges[-1] = ("d", "c", "window", 9)
    assert ranges(spark, [("a", "2024-03-10", "2024-03-10")], edges, specs)[-1] == ("a", "d", 0, "2024-03-01", "2024-03-10")


def test_open_ranges_cycles_and_depth(spark):
    specs = [("a", "daily"), ("b", "daily"), ("c", None)]
    edges = [("b", "a", "window", 2), ("a", "b", "window", 2), ("c", "b", None, None), ("a", "c", None, None)]
    assert ranges(spark, [("b", "2024-01-05", "2024-01-05")], edges, specs) == [("b", "a", 0, None, None), ("b", "c", 0, None, None)]
    loop = [("b", "a", "window", 2), ("c", "b", "window", 2), ("b", "c", "window", 2)]
    three = ranges(spark, [("a", "2024-01-05", "2024-01-05")], loop, [(n, "daily") for n in "abc"], 3)
    assert three == [("a", "b", 1, "2024-01-02", "2024-01-05"), ("a", "c", 0, "2024-01-03", "2024-01-05")]
    assert ranges(spark, [("a", "2024-01-05", "2024-01-05")], loop[:1], specs, 0) == []


def test_several_ranges_of_a_target_and_keys(spark):
    edges = [("day", "month", None, None)]
    asked = [("month", "2024-01", "2024-01"), ("month", "2024-02", "2024-02"), ("month", "2024-06", "2024-06")]
    assert [x[3:] for x in ranges(spark, asked, edges, SPECS)] == [("2024-01-01", "2024-02-29"), ("2024-06-01", "2024-06-30")]
    done = frame(spark, [("day", f"2024-01-{d:02}") for d in range(1, 31)] + [("month", "2024-01")], "node string, key string")
    t = frame(spark, asked, "target string, start_key string, end_key string")
    e = frame(spark, edges, "src string, dst string, mapping string, n int")
    keys = r.rebuild_keys(t, e, frame(spark, SPECS, "node string, grain string"), done).collect()
    assert len(keys) == 1 + 29 + 30 and {(k.target, k.node, k.execution_order) for k in keys} == {("month", "day", 0)}
    assert min(k.key for k in keys) == "2024-01-31"


def test_levels_ask_each_node_once(spark, monkeypatch):
    """A graph without cycles is walked by levels: the same ranges as breadth first, and no round merges those before."""
    rng = random.Random(5)
    kinds = [("identity", None), ("window", 3), ("offset", -2), ("offset", 400), (None, None)]
    nodes = [f"n{i:02}" for i in range(24)]
    specs = [(n, rng.choice(["hourly", "daily", "weekly", "monthly", "yearly", None] if i else ["daily"])) for i, n in enumerate(nodes)]
    edges = [(nodes[j], nodes[i], *rng.choice(kinds)) for i in range(23) for j in rng.sample(range(i + 1, 24), min(3, 23 - i))] + [("n05", "n05", None, None)]
    form = {"hourly": "2024-02-29 13:00:00", "daily": "2024-02-29", "weekly": "2024-W09", "monthly": "2024-02", "yearly": "2024", None: None}
    asked = [(n, form[g], form[g]) for n, g in specs[:6]] + [("n00", "2024-05-01", "2024-05-03"), ("nowhere", "2024", "2024")]
    t, e, s = frame(spark, asked, "target string, start_key string, end_key string"), frame(spark, edges, "src string, dst string, mapping string, n int"), frame(spark, specs, "node string, grain string")
    rows = lambda depth: sorted((str(tuple(x)) for x in r.rebuild_ranges(t, e, s, depth).collect()))
    want = rows(100)
    merged, merge = [], r.merge_ranges
    monkeypatch.setattr(r, "merge_ranges", lambda *a, **k: merged.append(1) or merge(*a, **k))
    assert rows(None) == want and len(want) > 60
    assert len(merged) < 24  # at most one a level, for ranges that lie apart; breadth first takes two a round
    monkeypatch.undo()
    chain = [(f"c{i + 1}", f"c{i}", None, None) for i in range(6)]
    monkeypatch.setattr(r, "merge_ranges", lambda *a, **k: pytest.fail("merged"))
    assert len(ranges(spark, [("c0", "2024-01-05", "2024-01-05")], chain, [(f"c{i}", "daily") for i in range(7)])) == 6
    assert ranges(spark, [], chain, [("c0", "daily")]) == []


def test_keys_by_levels(spark, monkeypatch):
    """Single keys of targets whose ways meet again: those of the walk breadth first, without its rounds over all ranges."""
    specs = [(n, g) for n, g in zip("abcdef", ["monthly", "daily", "weekly", "daily", None, "yearly"], strict=True)]
    edges = [("b", "a", None, None), ("c", "a", None, None), ("d", "b", "window", 3), ("d", "c", None, None), ("e", "d", None, None), ("f", "d", None, None), ("f", "a", None, None)]
    t = frame(spark, [("a", "2024-01", "2024-02"), ("b", "2024-02-01", "2024-02-02"), ("f", "2024", "2024")], "target string, start_key string, end_key string")
    e, s = frame(spark, edges, "src string, dst string, mapping string, n int"), frame(spark, specs, "node string, grain string")
    done = frame(spark, [("d", "2024-01-30"), ("b", "2024-02-01")], "node string, key string")
    want = sorted(map(tuple, r.rebuild_keys(t, e, s, done, 100).collect()))
    merged, merge = [], r.merge_ranges
    monkeypatch.setattr(r, "merge_ranges", lambda *a, **k: merged.append(1) or merge(*a, **k))
    assert sorted(map(tuple, r.rebuild_keys(t, e, s, done).collect())) == want and len(want) > 130
    assert len(merged) == 1  # of all targets' ranges of a node, once
