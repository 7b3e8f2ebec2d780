"""Interval joins, pruned reads, observed writes, membership filters and rolling sketches."""

import random
from bisect import bisect_left, bisect_right

from pyspark.sql import functions as F

from tablewarden.operators import intervals, membership, observe
from tablewarden.operators import quality as q
from tablewarden.session import scratch_path
from tablewarden.sources import tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def spans(rng, n):
    out = []
    for i in range(n):
        low = rng.choice([rng.uniform(-50, 50), float(rng.randint(-40, 40))])
        out.append((i, low, low + rng.choice([0.0, 1.0, rng.uniform(0, 3), rng.uniform(0, 200), 0.25])))
    return out


def test_values_in_ranges(spark):
    rng = random.Random(2)
    ranges = [*spans(rng, 80), (900, 5.0, 5.0), (901, 7.0, 3.0)]
    values = [(i, rng.choice([rng.uniform(-60, 80), float(rng.randint(-50, 50))])) for i in range(300)] + [(500, None), (501, 1e9)]
    df = spark.createDataFrame(values, "v_id int, v double")
    table = spark.createDataFrame(ranges, "r_id int, low double, high double")
    want = sorted((i, r) for i, v in values for r, a, b in ranges if v is not None and a <= v < b)
    joined = intervals.join_values(df, "v", table)
    assert sorted((r.v_id, r.r_id) for r in joined.collect()) == want
    assert "NestedLoop" not in plan_of(joined) and "Cartesian" not in plan_of(joined)
    left = intervals.join_values(df, "v", table, how="left").collect()
    lonely = {i for i, _ in values} - {i for i, _ in want}
    assert sorted((r.v_id, r.r_id) for r in left if r.r_id is not None) == want and {r.v_id for r in left if r.r_id is None} == lonely
    assert intervals.join_values(df, "v", table.where("low >= high")).count() == 0


def test_ten_thousand_bounds(spark):
    bounds = spark.range(10_000).selectExpr("concat('b', id) AS bucket", "id * 7.0D AS low", "id * 7.0D + 5 AS high")
    found = intervals.bucket_by_table(spark.range(20_000).selectExpr("id * 3.5D AS v"), "v", bounds)
    assert "NestedLoop" not in plan_of(found)
    for r in found.sample(0.02, 1).collect():
        assert r.bucket == (f"b{int(r.v // 7)}" if r.v % 7 < 5 else None)


def test_overlapping_ranges(spark):
    rng = random.Random(8)
    rows = [(i % 3, *r) for i, r in enumerate(spans(rng, 120))]
    df = spark.createDataFrame(rows, "k int, id int, low double, high double")
    want = {(x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3]}
    found = intervals.overlapping_ranges(df, ["k"], "id", "low", "high")
    got = [(r.k, r.a, r.b) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "NestedLoop" not in plan_of(found)


def test_reads_open_named_partitions_only(spark):
    df = spark.range(1000).selectExpr("id", "concat('k', id % 20) AS part")
    path = scratch_path(spark, "pruned")
    assert {r.part: r.row_count for r in tables.materialize(df, path, "part").collect()} == {f"k{i}": 50 for i in range(20)}
    named = tables.read_partitions(spark, path, df.schema, "part", ["k3", "k7"])
    assert "PartitionFilters: [part" in plan_of(named)
    assert named.select(F.input_file_name()).distinct().count() == 2 and named.count() == 100
    keys = spark.createDataFrame([("k3", 1), ("k4", 2), ("none", 1)], "part string, n int").where("n = 1")
    joined = tables.read_partitions(spark, path, df.schema, "part", keys)
    assert "dynamicpruning" in plan_of(joined) and joined.count() == 50


def test_written_rows_are_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(x):
        seen.add(1)
        return x

    df = spark.range(100).select(F.udf(note, "long")("id").alias("id"), F.when(F.col("id") < 90, F.col("id") % 3).alias("part"))
    path = scratch_path(spark, "once")
    counts = {r.part: r.row_count for r in tables.materialize(df, path, "part").collect()}
    assert counts == {0: 30, 1: 30, 2: 30, None: 10} and seen.value == 100
    more = spark.range(7).selectExpr("id", "1L AS part")
    assert {r.part: r.row_count for r in tables.materialize(more, path, "part").collect()} == {1: 7}
    assert tables.partitioned(spark, path, df.schema, "part").count() == 77
    assert tables.materialize(more.where("false"), path, "part").count() == 0


def test_membership_loses_nothing(spark):
    reference = spark.range(0, 200_000, 2).withColumnRenamed("id", "key")
    marked = membership.with_possible(spark.range(100_000), [F.col("id")], reference, ["key"], "maybe")
    even, odd = (marked.where(f"id % 2 = {i} AND maybe").count() for i in (0, 1))
    assert even == 50_000 and odd < 1_500
    assert membership.possible(spark.range(10), [F.col("id")], reference.where("false"), ["key"]).count() == 0
    small = spark.range(10).selectExpr("CAST(id AS INT) AS id")
    assert membership.possible(small, [F.col("id")], reference, ["key"]).where("id % 2 = 0").count() == 5  # types differ


def test_long_lists_of_accepted_values(spark):
    accepted = q.accepted_table(spark, [f"v{i}" for i in range(100_000)], "string")
    df = spark.range(3000).selectExpr("CASE WHEN id % 100 = 0 THEN NULL WHEN id % 7 = 0 THEN concat('w', id) ELSE concat('v', id) END AS c")
    wrong = df.where("c LIKE 'w%'").count()
    for nulls, bad in (("skip", wrong), ("fail", wrong + 30)):
        r = q.run_suite(df, [q.AcceptedIn(name="c", column="c", reference=accepted, ref_column="value", nulls=nulls)]).first()
        assert (r.kind, r.outcome, r.failed_count, r.total_count) == ("accepted_values", "failed", bad, 3000)
    good = q.run_suite(df.where("c LIKE 'v%'"), [q.AcceptedIn(name="c", column="c", reference=accepted, ref_column="value")]).first()
    assert good.outcome == "passed"


def test_rolling_quantiles_are_near_in_rank(spark):
    events = spark.range(60_000).selectExpr("timestamp_seconds(id * 2) AS ts", "pow(rand(3), 3) * 1000 AS value", "id % 10 < 7 AS hot")
    events = events.withColumn("value", F.when(F.col("value") > 1, F.col("value"))).persist()
    found = observe.rolling_quantiles(observe.bucket_sketches(events, "ts", "value", ["hot"], 300), ["hot"], [300, 3600, 21600], 300, [0.5, 0.95])
    rows = sorted((r.ts.timestamp(), r.hot, r.value) for r in events.where("value IS NOT NULL").collect())
    checked = 0
    for r in found.where("bucket % 3000 = 0").collect():
        inside = sorted(v for t, h, v in rows if h == r.hot and r.bucket + 300 - r.window_s <= t < r.bucket + 300)
        assert r.n == len(inside)
        for value, rank in ((r.p50, 0.5), (r.p95, 0.95)):
            assert bisect_left(inside, value) / len(inside) - 0.015 <= rank <= bisect_right(inside, value) / len(inside) + 0.015
        checked += 1
    assert checked > 100
