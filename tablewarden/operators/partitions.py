"""Partition calendars, mappings between upstream and downstream keys, gaps, readiness, plans, mapped roll-ups.

A mapping is a DataFrame (downstream_key, upstream_key); everything after it is joins. Mappings have one row per pair of
keys, so they are small beside the facts; facts are aggregated by upstream key before they meet a mapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.keys import GRAINS, STEPS, key_end, key_start, partition_key, shift_key

#: (finer, coarser) pairs that aggregate exactly.
AGGREGATES = (("hourly", "daily"), ("daily", "weekly"), ("daily", "monthly"), ("monthly", "yearly"))


def spine(spark: SparkSession, grain: str, start: str, end: str, end_exclusive: bool = False, align: str = "monday", limit: int | None = None) -> DataFrame:
    """(key) for every partition between two dates or times, inclusive. ``align="start"`` steps weeks from the start
    date and names each by that date; ``limit`` refuses longer calendars."""
    trunc = {"hourly": "HOUR", "daily": "DAY", "weekly": "WEEK", "monthly": "MONTH", "yearly": "YEAR"}[grain]
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    if grain != "weekly" or align == "monday":
        first = F.date_trunc(trunc, first).cast("timestamp_ntz")
    moments = F.when(first <= last, F.sequence(first, last, F.expr(STEPS[grain])))
    out = spark.range(1).select(F.explode(moments).alias("at"))
    if end_exclusive:
        out = out.where(F.col("at") < last)
    key = F.date_format("at", "yyyy-MM-dd") if grain == "weekly" and align == "start" else partition_key(F.col("at"), grain)
    out = out.select(key.alias("key"))
    if limit is not None and out.count() > limit:
        raise ValueError(f"more than {limit} partitions")
    return out


def static_keys(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string")


def dynamic_keys(df: DataFrame, key: Column) -> DataFrame:
    """Keys found in the data."""
    return df.select(key.alias("key")).where(F.col("key").isNotNull()).distinct()


def multi_spine(**dims: DataFrame) -> DataFrame:
    """All combinations of several key tables (column key) as one JSON key: a product by definition."""
    names = sorted(dims)
    tables = [dims[n].select(F.col("key").cast("string").alias(n)) for n in names]
    return reduce(DataFrame.crossJoin, tables).select(F.to_json(F.struct(*names)).alias("key"))


def range_bucket(value: Column, bounds: list[tuple[str, Column, Column]]) -> Column:
    """Name of the first range with lower <= value < upper."""
    out = None
    for name, low, high in bounds:
        test = (value >= low) & (value < high)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out


def custom_key(expression: str) -> Column:
    """A key from a SQL expression."""
    return F.expr(expression)


def _pairs(keys: DataFrame, upstream: Column) -> DataFrame:
    return keys.select(F.col("key").alias("downstream_key"), upstream.alias("upstream_key"))


def map_identity(keys: DataFrame) -> DataFrame:
    return _pairs(keys, F.col("key"))


def map_offset(keys: DataFrame, n: int, grain: str) -> DataFrame:
    """The key ``n`` steps away."""
    return _pairs(keys, shift_key(F.col("key"), grain, n))


def map_window(keys: DataFrame, n: int, grain: str) -> DataFrame:
    """The key and the ``n - 1`` before it."""
    steps = keys.select("key", F.explode(F.sequence(F.lit(1 - n), F.lit(0))).alias("step"))
    return steps.select(F.col("key").alias("downstream_key"), shift_key(F.col("key"), grain, F.col("step")).alias("upstream_key"))


def map_day_window(keys: DataFrame, first: int, last: int, upstream: DataFrame | None = None) -> DataFrame:
    """Signed day offsets around a daily key, only those that are upstream keys."""
    steps = keys.select("key", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("step"))
    out = steps.select(F.col("key").alias("downstream_key"), shift_key(F.col("key"), "daily", F.col("step")).alias("upstream_key"))
    return out if upstream is None else out.join(upstream.select(F.col("key").alias("upstream_key")), "upstream_key", "left_semi").select("downstream_key", "upstream_key")


def map_aggregate(keys: DataFrame, downstream: str, upstream: str) -> DataFrame:
    """The finer keys inside each coarser one (real month lengths); grains that don't nest exactly are an identity."""
    if (upstream, downstream) not in AGGREGATES:
        return map_identity(keys)
    start, end = key_start(F.col("key"), downstream), key_end(F.col("key"), downstream)
    moments = F.sequence(start, end - F.expr(STEPS[upstream]), F.expr(STEPS[upstream]))
    rows = keys.select("key", F.explode(moments).alias("at"))
    return rows.select(F.col("key").alias("downstream_key"), partition_key(F.col("at"), upstream).alias("upstream_key"))


def map_all(keys: DataFrame, upstream: DataFrame) -> DataFrame:
    """Every upstream key for every key: a product by definition, of two calendars."""
    return keys.select(F.col("key").alias("downstream_key")).crossJoin(upstream.select(F.col("key").alias("upstream_key")))


def map_dimensions(keys: DataFrame, names: dict[str, str]) -> DataFrame:
    """Upstream dimensions taken from downstream ones ({upstream: downstream}); a single one becomes a bare text."""
    source = F.from_json("key", "map<string,string>")
    if len(names) == 1:
        return _pairs(keys, F.try_element_at(source, F.lit(next(iter(names.values())))))
    fields = [F.try_element_at(source, F.lit(names[up])).alias(up) for up in sorted(names)]
    return _pairs(keys, F.to_json(F.struct(*fields)))


#: Kinds of partitions besides the time grains; they map one to one onto their own kind.
OTHER_KINDS = ("range", "custom")


def _rules(spark: SparkSession) -> DataFrame:
    """(up, down, mapping, reason) of every pair of kinds."""
    rows = []
    for up in (*GRAINS, *OTHER_KINDS):
        for down in (*GRAINS, *OTHER_KINDS):
            if up == down:
                rows.append((up, down, "identity", None))
            elif (up, down) in AGGREGATES:
                rows.append((up, down, "aggregate", None))
            elif up in OTHER_KINDS or down in OTHER_KINDS:
                rows.append((up, down, None, f"{up} does not map to {down}"))
            elif GRAINS.index(up) > GRAINS.index(down):
                rows.append((up, down, None, f"{up} upstream is coarser than {down}"))
            else:
                rows.append((up, down, None, f"{up} does not nest in {down}"))
    return F.broadcast(spark.createDataFrame(rows, "up string, down string, mapping string, reason string"))


def infer_mapping(edges: DataFrame, specs: DataFrame, without: str | None = "all") -> DataFrame:
    """Per edge (src, dst): the mapping between the kinds of ``specs`` (node, grain), or the reason why there is none.

    Equal kinds map one to one and a coarser downstream aggregates where the grains nest; a downstream that is finer than
    its upstream, or of another kind, has no mapping. Where a side has no spec the mapping is ``without``; None asks for
    a spec on both sides. One rule row per pair of kinds, joined to the edges."""
    src = specs.select(F.col("node").alias("src"), F.col("grain").alias("up"))
    dst = specs.select(F.col("node").alias("dst"), F.col("grain").alias("down"))
    both = edges.join(src, "src", "left").join(dst, "dst", "left").join(_rules(edges.sparkSession), ["up", "down"], "left")
    unknown = F.col("up").isNull() | F.col("down").isNull()
    reason = F.when(unknown & F.lit(without is None), F.lit("not partitioned")).otherwise(F.col("reason"))
    return both.select("src", "dst", F.when(unknown, F.lit(without)).otherwise(F.col("mapping")).alias("mapping"), reason.alias("reason"))


def check_compatible(edges: DataFrame, specs: DataFrame) -> DataFrame:
    """Edges (src, dst, mapping, and grain or up_grain and down_grain of the mapping) with ``problem``: why the declared
    mapping does not fit the kinds of ``specs`` (node, grain), null if it does.

    identity: equal kinds. aggregate: its upstream grain finer than its downstream one, and both those of the nodes.
    window, offset: both nodes of the mapping's grain. custom: never checked."""
    spark = edges.sparkSession
    finer = [(u, d) for i, u in enumerate(GRAINS) for d in GRAINS[i + 1 :]]
    order = F.broadcast(spark.createDataFrame(finer, "up_grain string, down_grain string").withColumn("finer", F.lit(True)))
    src = specs.select(F.col("node").alias("src"), F.col("grain").alias("up"))
    dst = specs.select(F.col("node").alias("dst"), F.col("grain").alias("down"))
    both = edges.join(src, "src", "left").join(dst, "dst", "left").join(order, ["up_grain", "down_grain"], "left")
    kinds = F.concat(F.coalesce("up", F.lit("none")), F.lit(" to "), F.coalesce("down", F.lit("none")))
    differ = F.concat(F.lit("incompatible: "), kinds)
    fits = F.col("up").eqNullSafe(F.col("up_grain")) & F.col("down").eqNullSafe(F.col("down_grain"))
    problem = (
        F.when(F.col("mapping") == "custom", F.lit(None))
        .when((F.col("mapping") == "identity") & ~F.col("up").eqNullSafe(F.col("down")), differ)
        .when((F.col("mapping") == "aggregate") & F.col("finer").isNull(), F.concat(F.lit("no aggregation from "), F.col("up_grain"), F.lit(" to "), F.col("down_grain")))
        .when(F.col("mapping").isin("aggregate", "window", "offset") & ~fits, differ)
    )
    return both.select("src", "dst", "mapping", problem.alias("problem"))


def resolve_range(ranges: DataFrame, mapping: str, downstream: str, upstream: str, n: int = 0) -> DataFrame:
    """Adds upstream_start and upstream_end to (start_key, end_key), both inclusive."""
    start, end = F.col("start_key"), F.col("end_key")
    if mapping == "offset":
        low, high = shift_key(start, downstream, n), shift_key(end, downstream, n)
    elif mapping == "window":
        low, high = shift_key(start, downstream, 1 - n), end
    elif mapping == "aggregate" and (upstream, downstream) in AGGREGATES:
        low = partition_key(key_start(start, downstream), upstream)
        high = partition_key(key_end(end, downstream) - F.expr(STEPS[upstream]), upstream)
    else:
        low, high = start, end
    return ranges.withColumns({"upstream_start": low, "upstream_end": high})


def mapped_rollup(facts: DataFrame, key: Column, mapping: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """Sums of upstream rows into downstream partitions: facts are summed by upstream key first, then fanned out."""
    daily = facts.groupBy(key.alias("upstream_key")).agg(*[F.sum(c).alias(n) for n, c in aggregates.items()])
    joined = mapping.join(daily, "upstream_key")
    return joined.groupBy("downstream_key").agg(*[F.sum(n).alias(n) for n in aggregates])


def missing_keys(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Expected keys that are not there."""
    return wanted.select("key").distinct().join(done.select("key"), "key", "left_anti")


def blocked(mapping: DataFrame, completed: DataFrame) -> DataFrame:
    """(downstream_key, upstream_key) pairs whose upstream is not completed."""
    return mapping.join(completed.select(F.col("key").alias("upstream_key")), "upstream_key", "left_anti")


def ready_partitions(wanted: DataFrame, mapping: DataFrame, completed: DataFrame) -> DataFrame:
    """Wanted keys whose upstream keys are all completed; without upstream keys they are ready."""
    stop = blocked(mapping, completed).select(F.col("downstream_key").alias("key"))
    return wanted.select("key").distinct().join(stop, "key", "left_anti")


def blocked_reasons(mapping: DataFrame, completed: DataFrame, shown: int = 20) -> DataFrame:
    """key, n_missing, missing: the first missing upstream keys of each blocked partition, in order."""
    from pyspark.sql import Window

    stop = blocked(mapping, completed)
    rank = Window.partitionBy("downstream_key").orderBy("upstream_key")
    few = stop.withColumn("r", F.row_number().over(rank))
    first = F.collect_list(F.when(F.col("r") <= shown, F.col("upstream_key")))
    return few.groupBy(F.col("downstream_key").alias("key")).agg(F.count(F.lit(1)).alias("n_missing"), F.array_join(F.array_sort(first), ",").alias("missing"))


def partition_status(wanted: DataFrame, ledger: DataFrame, mapping: DataFrame, upstream: DataFrame) -> DataFrame:
    """key, status: missing, stale (an upstream partition is newer) or fresh. ``ledger`` and ``upstream``: (key, at)."""
    newest = mapping.join(upstream.select(F.col("key").alias("upstream_key"), F.col("at").alias("up_at")), "upstream_key")
    newest = newest.groupBy(F.col("downstream_key").alias("key")).agg(F.max("up_at").alias("up_at"))
    own = ledger.groupBy("key").agg(F.max("at").alias("at"))
    rows = wanted.select("key").distinct().join(own, "key", "left").join(newest, "key", "left")
    status = F.when(F.col("at").isNull(), "missing").when(F.col("up_at") > F.col("at"), "stale").otherwise("fresh")
    return rows.select("key", status.alias("status"))


def backfill_plan(upstream: DataFrame, wanted: DataFrame, completed: DataFrame) -> DataFrame:
    """target, node, execution_order, key: what to rebuild for each target (target, node, depth of its upstream nodes),
    the furthest first. ``wanted`` is (node, key), ``completed`` (node, key)."""
    deepest = upstream.groupBy("target").agg(F.max("depth").alias("deepest"))
    order = upstream.join(deepest, "target").select("target", "node", (F.col("deepest") - F.col("depth")).alias("execution_order"))
    return wanted.join(completed, ["node", "key"], "left_anti").join(order, "node").select("target", "node", "execution_order", "key")
