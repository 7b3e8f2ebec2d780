"""Ordered state, rates, histograms and the streaming twins."""

import random

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import ledger, observe
from tablewarden.plans.base import Tables
from tablewarden.session import scratch_path
from tablewarden.streaming import jobs as s

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("chunk", [1, 2, 4096])
def test_ewma(spark, chunk):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1000.0, 2000.0, 2000.0])], "k string, i int, v double")
    assert ledger.ewma(df, "k", ["i"], "v", 0.5, chunk).first().asDict() == {"k": "a", "ewma": 1750.0, "n": 3}


def test_ewma_resumes(spark):
    rows = [(k, i, float((i * 7919 + len(str(k))) % 100)) for k in ("a", "bb", None) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    whole = {r.k: (round(r.ewma, 9), r.n) for r in ledger.ewma(df, "k", ["i"], "v", 0.3, 8).collect()}
    before = ledger.ewma(df.where("i < 13 AND k IS DISTINCT FROM 'bb'"), "k", ["i"], "v", 0.3, 8)
    rest = df.where("i >= 13 OR k = 'bb'")
    assert {r.k: (round(r.ewma, 9), r.n) for r in ledger.ewma(rest, "k", ["i"], "v", 0.3, 8, before).collect()} == whole
    same = ledger.ewma(df.where("false"), "k", ["i"], "v", 0.3, 8, before)
    assert {tuple(r) for r in same.collect()} == {tuple(r) for r in before.collect()}


def test_numbers_go_on_over_partitions(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 'x' ELSE 'hot' END AS k", "id AS t")
    got = ledger.numbered(df, "k", ["t"], "i", parts=7).collect()
    for k in ("x", "hot"):
        mine = sorted((r.i, r.t) for r in got if r.k == k)
        assert [i for i, _ in mine] == list(range(len(mine))) and [t for _, t in mine] == sorted(t for _, t in mine)


def test_state_machines(spark):
    def bad(states, moves):
        df = spark.createDataFrame([(1, i, s, i) for i, s in enumerate(states)], "k int, event_id int, state string, ts int")
        return [r.event_id for r in ledger.invalid_transitions(df, "k", ["ts"], moves).orderBy("ts").collect()]

    assert bad(["pending", "running", "timeout"], ledger.RUN_MOVES) == []
    assert bad(["pending", "cancelled"], ledger.RUN_MOVES) == [1]
    assert bad(["running", "waiting_upstream", "pending", "running", "paused", "resuming", "failed"], ledger.BACKFILL_MOVES) == [6]


def test_histogram_quantile_edges(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", 99.0)], "k string, v double")
    hist = observe.histogram(df, "v", [1, 10], ["k"])
    got = {r.k: r.quantile for r in observe.histogram_quantile(hist, 0.5, ["k"]).collect()}
    assert got == {"a": 0.5, "b": 10.0}


def test_counter_reset(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([5.0, 8.0, 2.0, 3.0])], "k int, t int, v double")
    assert observe.increase(df, ["k"], "t", "v").first()["increase"] == 6.0


def test_job_state(spark):
    df = spark.createDataFrame([(1, "failed"), (1, "failed"), (2, "failed"), (2, "completed"), (3, "pending")], "job_id int, state string")
    assert {r.job_id: r.final_state for r in ledger.job_progress(df).collect()} == {1: "failed", 2: "completed", 3: "running"}


def test_streams_equal_batches(spark):
    t = Tables(spark, DATA)
    events = t["events"].select("user_id", "ts", "event_id", "value")
    live = s.run_available(s.running_ewma(s.event_stream(spark, events), "user_id"))
    batch = ledger.ewma(events, "user_id", ["ts", "event_id"], "value")
    assert {r.user_id: round(r.ewma, 6) for r in live.collect()} == {r.user_id: round(r.ewma, 6) for r in batch.collect()}
    log = t["transitions"]
    machine = s.Machine("job_id", end_s=10**9, ttl_s=10**9)
    live = s.run_available(s.forbidden_moves(s.event_stream(spark, log, files=3), "job_id", machine=machine))
    batch = ledger.invalid_transitions(log, "job_id", ["ts", "event_id"])
    assert {r.event_id for r in live.collect()} == {r.event_id for r in batch.collect()}


def test_one_key_with_a_third_of_all_rows(spark):
    """Rows before, numbers and ranks go over range partitions: no task holds the hot key's rows."""
    rng = random.Random(4)
    log = [(1 if i % 3 == 0 else rng.randrange(2, 200), i * 7 % 3001, rng.choice(["pending", "running", "paused", "succeeded"])) for i in range(3000)]
    df = spark.createDataFrame(log, "k int, ts int, state string").repartition(5)
    found = ledger.with_previous(df, ["k"], ["ts"], ["state", "ts"], "prev", parts=12)
    want, last = {}, {}
    for k, ts, state in sorted(log):
        want[k, ts] = last.get(k)
        last[k] = (state, ts)
    assert {(r.k, r.ts): tuple(r.prev) if r.prev else None for r in found.collect()} == want
    sizes = [r["count"] for r in ledger.running_totals(df, ["k"], ["ts"], F.lit(1), "n", 12).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1000
    jobs = df.selectExpr("ts AS job_id", "k % 5 - 2 AS priority", "state", "ts % 4 AS execution_order", "timestamp_ntz'2024-01-01' AS created_at", "timestamp_ntz'2024-01-01' AS heartbeat_at")
    jobs = jobs.withColumn("priority", F.when(F.col("priority") != 2, F.col("priority")))
    ranked = ledger.backlog_rank(jobs, "2024-01-01 00:00:30").collect()
    order = sorted(ranked, key=lambda r: (r["class"], r.priority is None, -(r.priority or 0), r.execution_order, r.job_id))
    assert [r["rank"] for r in order] == list(range(1, len(order) + 1)) and len(order) == sum(s == "pending" for _, _, s in log)


def test_overlaps_in_cells(spark, monkeypatch):
    """Pairs of blocks find the pairs of all, each once, however small blocks and slices are; no pair is shuffled."""
    rng = random.Random(6)
    rows = [(j, rng.choice([1, 1, 1, 2, None]), rng.choice(["pending", "paused", "failed"]), [rng.choice(["x", None, *"abcdefghijk"]) for _ in range(rng.randrange(5))]) for j in range(150)]
    rows += [(j + 1000, 3, "running", ["one"]) for j in range(3)] + [(2000, 3, "running", []), (2001, 4, "running", ["z"])] + rows[:9]
    jobs = spark.createDataFrame(rows, "job_id long, asset_id int, state string, partition_keys array<string>")
    keys = {}
    for j, asset, state, found in rows:
        if asset is not None and state != "failed":
            keys.setdefault((asset, j), set()).update(k for k in found if k is not None)
    want = sorted((x, a, b, len(keys[x, a] & keys[y, b])) for x, a in keys for y, b in keys if x == y and a < b and keys[x, a] & keys[y, b])
    for block, cells in ((4096, 2_000_000), (7, 40), (1, 9)):
        monkeypatch.setattr(ledger, "OVERLAP_BLOCK", block)
        monkeypatch.setattr(ledger, "OVERLAP_CELLS", cells)
        pairs = ledger.overlapping_backfills(jobs)
        assert sorted(map(tuple, pairs.select("asset_id", "a", "b", "n_keys").collect())) == want
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "HashAggregate(keys=[asset_id" not in plan.split("FlatMapGroupsInArrow")[0]
    named = jobs.selectExpr("concat('j', job_id) AS job_id", "asset_id", "state", "partition_keys")
    found = {tuple(r) for r in ledger.overlapping_backfills(named).select("asset_id", "a", "b", "n_keys").collect()}
    assert found == {(x, *sorted((f"j{a}", f"j{b}")), n) for x, a, b, n in want}


def test_ewma_is_that_of_single_steps(spark, monkeypatch):
    """Bit by bit the average of one step after the other, whatever the chunks, over long and resumed groups; the 1 GB
    row whose ninth digit an ulp decides."""
    rng = random.Random(4)
    prices = [481821.71, 487458.88, 309740.86, 355345.96, 384229.83]
    long = [rng.uniform(900, 500_000) for _ in range(3000)]
    values = {"prices": prices, "long": long, "flat": [0.1] * 700, None: long[:50], "endless": [1.0, float("inf"), *long[:40]], "odd": [float("inf"), 2.0, float("-inf"), 1.0]}
    rows = [(k, i, v) for k, xs in values.items() for i, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "k string, i int, v double").persist()

    def steps(xs, alpha, e=None):
        for x in xs:
            e = x if e is None else alpha * x + (1 - alpha) * e
        return e

    for alpha, chunk, gather in ((0.5, 4096, 1 << 20), (0.5, 2, 1 << 20), (0.3, 500, 1000), (0.05, 200, 400)):
        monkeypatch.setattr(ledger, "EWMA_GATHER", gather)
        want = {k: repr(steps(xs, alpha)) for k, xs in values.items()}
        assert {r.k: repr(r.ewma) for r in ledger.ewma(df, "k", ["i"], "v", alpha, chunk).collect()} == want
        before = ledger.ewma(df.where("i < 3"), "k", ["i"], "v", alpha, chunk)
        assert {r.k: repr(r.ewma) for r in ledger.ewma(df.where("i >= 3"), "k", ["i"], "v", alpha, chunk, before).collect()} == want
    assert round(60000 / steps(prices, 0.5), 9) == 0.157791321


def test_averages_of_batches(spark):
    """Averages go on from batch to batch as one series of steps; keys without a value have none; no call a key."""
    rows = [(u, u * 7 + 500 * i, 10 * u + i, float(u + i * i)) for u in range(60) for i in range(1 + u % 9)] + [(500, 1, 1, None), (None, 2, 2, 4.0), (None, 2999, 3, 6.0)]
    events = spark.createDataFrame(rows, "user_id long, s long, event_id long, value double").selectExpr("user_id", "timestamp_seconds(s) AS ts", "event_id", "value")
    want = {}
    for u, _, _, v in sorted(rows, key=lambda r: (r[1], r[2])):
        e, n = want.get(u, (None, 0))
        want[u] = (e, n) if v is None else (v if e is None else 0.3 * v + 0.7 * e, n + 1)
    path = scratch_path(spark, "averages")
    each, batches = s.ewma_batches(path, "user_id"), []

    def noted(batch, number):
        batches.append(number)
        each(batch, number)
        if number == 1:
            each(batch, number)  # run again

    s.run_available(s.event_stream(spark, events, files=4), each=noted)
    assert len(batches) > 2
    found = s.newest_averages(spark, path, events.schema["user_id"])
    assert {r.user_id: (r.ewma, r.n) for r in found.collect()} == want
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
