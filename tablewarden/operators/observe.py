"""Rates, histograms, quantiles, objectives, alerts and cost over event rows.

Windows over time are computed on buckets: rows are counted per (labels, bucket) first, so a range frame sees a few
bucket rows per series and never the events themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.operators.ledger import with_previous
from tablewarden.session import cut

INF = float("inf")


def bucket_of(ts: Column, seconds: int) -> Column:
    """Start of the bucket, in seconds since 1970."""
    return (F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)) * seconds).cast("long")


def buckets(events: DataFrame, ts: str, seconds: int, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """(by, bucket, measures): sums per bucket."""
    sums = [F.sum(c).alias(n) for n, c in measures.items()]
    return events.groupBy(*by, bucket_of(F.col(ts), seconds).alias("bucket")).agg(*sums)


def trailing(rows: DataFrame, by: list[str], column: str, window_s: int, step_s: int, shift_s: int = 0) -> Column:
    """Sum over the buckets of the last ``window_s`` seconds, the own one included, ``shift_s`` earlier if asked."""
    frame = Window.partitionBy(*by).orderBy("bucket").rangeBetween(-(window_s + shift_s) + step_s, -shift_s)
    return F.coalesce(F.sum(column).over(frame), F.lit(0))


def rolling_rate(events: DataFrame, ts: str, by: list[str], window_s: int, step_s: int) -> DataFrame:
    """(by, bucket, n, rate): events a second over the trailing window."""
    rows = buckets(events, ts, step_s, by, {"n": F.lit(1)})
    return rows.withColumn("rate", trailing(rows, by, "n", window_s, step_s) / window_s)


def throughput_degraded(events: DataFrame, ts: str, by: list[str], short_s: int, long_s: int, back_s: int, step_s: int, limit: float = 0.5) -> DataFrame:
    """Buckets whose short-window rate is below ``limit`` times the long-window rate of ``back_s`` before."""
    rows = buckets(events, ts, step_s, by, {"n": F.lit(1)})
    now = trailing(rows, by, "n", short_s, step_s) / short_s
    then = trailing(rows, by, "n", long_s, step_s, back_s) / long_s
    return rows.withColumns({"now": now, "then": then}).where(F.try_divide("now", "then") < limit)


def alert_intervals(breaches: DataFrame, by: list[str], step_s: int, hold_s: int) -> DataFrame:
    """(by, start, end, n): runs of consecutive breached buckets that last at least ``hold_s`` seconds."""
    order = Window.partitionBy(*by).orderBy("bucket")
    rows = breaches.withColumn("island", F.col("bucket") - F.row_number().over(order) * step_s)
    runs = rows.groupBy(*by, "island").agg(F.min("bucket").alias("start"), (F.max("bucket") + step_s).alias("end"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("end") - F.col("start") >= hold_s).drop("island")


def increase(samples: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """(by, increase) of a counter over its samples; a drop is a reset, after which the counter's own value counts."""
    samples = with_previous(samples.select(*by, ts, value), by, [ts], [value], "_last_one")
    before = F.col(f"_last_one.{value}")
    step = F.when(before.isNull(), 0.0).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    return samples.select(*by, step.alias("step")).groupBy(*by).agg(F.sum("step").alias("increase"))


def histogram(df: DataFrame, value: str, bounds: list[float], by: list[str]) -> DataFrame:
    """(by, le, n, total, sum): cumulative counts up to each bound and infinity."""
    counted = df.groupBy(*by).agg(
        F.array(*[F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in [*sorted(bounds), INF]]).alias("b"),
        F.count(value).alias("total"),
        F.sum(value).alias("sum"),
    )
    return counted.select(*by, "total", "sum", F.inline("b"))


def histogram_quantile(hist: DataFrame, q: float, by: list[str]) -> DataFrame:
    """(by, quantile) by linear interpolation in the bucket where the rank falls. The lowest bucket starts at 0, the
    infinite one gives the last finite bound, an empty histogram null."""
    order = Window.partitionBy(*by).orderBy("le")
    rows = hist.withColumns({"low": F.coalesce(F.lag("le").over(order), F.lit(0.0)), "below": F.coalesce(F.lag("n").over(order), F.lit(0)), "rank": F.lit(q) * F.col("total")})
    inside = F.col("low") + (F.col("le") - F.col("low")) * F.try_divide(F.col("rank") - F.col("below"), F.col("n") - F.col("below"))
    value = F.when(F.col("le") == INF, F.col("low")).otherwise(inside)
    hit = (F.col("n") >= F.col("rank")) & (F.col("total") > 0)
    return rows.groupBy(*by).agg(F.min_by(F.when(hit, value), F.when(hit, F.col("le"))).alias("quantile"))


def quantiles(df: DataFrame, value: str, qs: list[float], by: list[str], approximate: bool = False) -> DataFrame:
    """(by, p50-like columns) by linear interpolation between ranks; null values take no part. ``approximate`` gives
    sketches in one pass.

    The exact form counts equal values first, by range partitions, so no task holds a whole group. Sums of the partitions
    tell which of them hold a rank that is asked for: two for each quantile and group at most, and only those are
    numbered."""
    names = [f"p{round(q * 100)}" for q in qs]
    if approximate:
        return df.groupBy(*by).agg(*[F.percentile_approx(value, q).alias(n) for q, n in zip(qs, names, strict=True)])
    keys = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_count"))
    counted = cut(counted.repartitionByRange(*keys, "_value").withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    sums = counted.groupBy(*keys, "_part").agg(F.sum("_count").alias("_n"))
    sums = sums.withColumns({"_total": F.sum("_n").over(group), "_before": F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    ranks = [r for q in qs for r in (F.floor(F.lit(q) * (F.col("_total") - 1)), F.ceil(F.lit(q) * (F.col("_total") - 1)))]
    holds = reduce(lambda a, b: a | b, [(r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")) for r in ranks])
    held = sums.where(holds).select(*[F.col(c).alias(f"_of_{c}") for c in keys], F.col("_part").alias("_at"), "_before", "_total")
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys], F.col("_part") == F.col("_at"))
    inside = F.sum("_count").over(Window.partitionBy("_part", *keys).orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    upto = counted.join(held, match).withColumn("_upto", inside + F.col("_before"))

    def at(rank: Column) -> Column:
        """The value that holds a rank, if this row does."""
        return F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_count") <= rank), F.col("_value")))

    columns = []
    for i, n in enumerate(names):
        rank = F.lit(qs[i]) * (F.max("_total") - 1)
        low, high = at(ranks[2 * i]), at(ranks[2 * i + 1])
        columns.append((low + (high - low) * (rank - F.floor(rank))).alias(n))
    out = upto.groupBy(*keys).agg(*columns)
    return out.select(*by, *names)


def cap_cardinality(df: DataFrame, column: str, ts: str, n: int = 100) -> DataFrame:
    """The first ``n`` values seen keep their name, all others become ``other``. The kept names are ``n`` rows."""
    first = df.groupBy(column).agg(F.min(ts).alias("_first")).orderBy("_first", column).limit(n).select(F.col(column).alias("_kept"))
    text = F.col(column).cast("string")
    return df.join(F.broadcast(first), F.col(column) == F.col("_kept"), "left").withColumn("capped", F.when(F.col("_kept").isNotNull(), text).otherwise("other")).drop("_kept")


# --- cost


def run_cost(compute_s: Column, memory_gb: Column, storage_gb: Column, egress_gb: Column, prices: dict[str, str]) -> Column:
    """Compute and memory seconds, storage for its share of a month of 730 hours, and egress, as DECIMAL(38, 18). Amounts
    count to four decimals, prices to eight; only the division by the month rounds, half up at 18 decimals."""
    def exact(c: Column) -> Column:
        return c.cast("decimal(12,4)")

    def price(name: str) -> Column:
        return F.lit(prices[name]).cast("decimal(9,8)")

    def whole(c: Column) -> Column:
        return c.cast("decimal(38,0)")

    # In units of the 18th decimal, as whole numbers: a decimal quotient would keep fewer decimals than that.
    month = 3600 * 730
    twice = whole(exact(storage_gb) * 10_000) * whole(exact(compute_s) * 10_000) * whole(price("storage") * 100_000_000) * 200 + month
    units = whole((twice - twice % (2 * month)) / F.lit(2 * month).cast("decimal(38,0)"))
    low = units % 1_000_000_000
    high = whole((units - low) / F.lit(1_000_000_000).cast("decimal(38,0)"))
    storage = [high.cast("decimal(20,0)") * F.lit("0.000000001").cast("decimal(9,9)"), low.cast("decimal(9,0)") * F.lit("0.000000000000000001").cast("decimal(18,18)")]
    total = exact(compute_s) * price("compute") + exact(compute_s) * exact(memory_gb) * price("memory") + exact(egress_gb) * price("egress")
    fits = "decimal(37,18)"  # a sum of decimals has a digit more, and 38 is the most
    return reduce(lambda a, b: (a + b).cast(fits), [c.cast(fits) for c in (total, *storage)]).cast("decimal(38,18)")


def cost_breakdown(costs: DataFrame) -> DataFrame:
    """Cost per workflow, per tenant (workflow null) and in all (both null)."""
    return costs.rollup("tenant_id", "workflow_id").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n"))


def spend_alerts(costs: DataFrame, grain: str, threshold: float) -> DataFrame:
    """Tenants above a spending limit in an hour, day or month."""
    period = F.date_trunc(grain, "started_at").cast("timestamp_ntz").alias("period")
    return costs.groupBy("tenant_id", period).agg(F.sum("cost").alias("spent")).where(F.col("spent") > threshold)


# --- alerts and objectives


def ratio_alert(events: DataFrame, ts: str, by: list[str], bad: Column, step_s: int, limit: float) -> DataFrame:
    """Buckets whose share of bad events is above the limit."""
    rows = buckets(events, ts, step_s, by, {"bad": bad.cast("int"), "n": F.lit(1)})
    return rows.withColumn("ratio", F.try_divide("bad", "n")).where(F.col("ratio") > limit)


def latency_alert(events: DataFrame, ts: str, value: str, by: list[str], q: float, step_s: int, limit: float, approximate: bool = False) -> DataFrame:
    """Buckets whose quantile is above the limit."""
    rows = events.withColumn("bucket", bucket_of(F.col(ts), step_s))
    rows = quantiles(rows, value, [q], [*by, "bucket"], approximate).withColumnRenamed(f"p{round(q * 100)}", "quantile")
    return rows.where(F.col("quantile") > limit)


def absence_alert(events: DataFrame, ts: str, by: list[str], step_s: int, first: int, last: int) -> DataFrame:
    """(by, bucket) without events, of all series seen and all buckets from ``first`` to ``last`` (seconds, inclusive).

    The buckets between two that a series has, and those before its first and after its last one, are generated from the
    series' own buckets; there is no product with a calendar."""
    seen = buckets(events, ts, step_s, by, {"n": F.lit(1)}).select(*by, "bucket")
    order = Window.partitionBy(*by).orderBy("bucket")
    inside = (F.col("bucket") >= first) & (F.col("bucket") <= last)
    edges = seen.select(*by).distinct().withColumn("bucket", F.lit(first - step_s).cast("long"))
    rows = seen.where(inside).unionByName(edges).withColumn("next", F.coalesce(F.lead("bucket").over(order), F.lit(last + step_s - (last - first) % step_s)))
    gaps = rows.where(F.col("next") - F.col("bucket") > step_s)
    return gaps.select(*by, F.explode(F.sequence(F.col("bucket") + step_s, F.col("next") - step_s, F.lit(step_s))).alias("bucket"))


def stuck_alert(events: DataFrame, ts: str, by: list[str], busy: Column, done: Column, step_s: int) -> DataFrame:
    """Buckets with activity of one kind and none of the other."""
    rows = buckets(events, ts, step_s, by, {"busy": busy.cast("int"), "done": done.cast("int")})
    return rows.where((F.col("busy") > 0) & (F.col("done") == 0))


def level_alert(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Groups with more rows than the limit."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)


def sli(good: Column, total: Column) -> Column:
    """Share of good events, null where there are none."""
    return F.try_divide(good, total)


def burn_rate(events: DataFrame, ts: str, by: list[str], bad: Column, objective: float, short_s: int, long_s: int, factor: float, step_s: int) -> DataFrame:
    """(by, bucket, short_burn, long_burn) where both windows burn the error budget faster than ``factor``."""
    rows = buckets(events, ts, step_s, by, {"bad": bad.cast("int"), "n": F.lit(1)})
    budget = 1 - objective

    def burn(window: int) -> Column:
        return F.try_divide(trailing(rows, by, "bad", window, step_s), trailing(rows, by, "n", window, step_s)) / budget

    rows = rows.withColumns({"short_burn": burn(short_s), "long_burn": burn(long_s)})
    return rows.where((F.col("short_burn") > factor) & (F.col("long_burn") > factor)).select(*by, "bucket", "short_burn", "long_burn")


def error_budget(events: DataFrame, by: list[str], bad: Column, objective: float) -> DataFrame:
    """(by, budget_left): 1 - bad share / allowed share."""
    rows = events.groupBy(*by).agg(F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("n"))
    return rows.select(*by, (1 - F.try_divide("bad", "n") / (1 - objective)).alias("budget_left"))


def budget_forecast(left: Column, burn_1h: Column, window_h: float = 720) -> Column:
    """Seconds until the budget is gone at the last hour's burn rate; null at no burn."""
    return F.when(burn_1h > 0, left / (burn_1h / window_h) * 3600)


def budget_status(left: Column) -> Column:
    return F.when(left <= 0, "exhausted").when(left <= 0.25, "at_risk").when(left <= 0.5, "caution").otherwise("healthy")


def sla_status(jobs: DataFrame, as_of: str, by: str = "tenant_id") -> DataFrame:
    """Per tenant: active jobs, jobs past their deadline, and jobs expected to finish after it."""
    now = F.lit(as_of).cast("timestamp_ntz")
    breached = now > F.col("deadline")
    return jobs.groupBy(by).agg(F.count(F.lit(1)).alias("active"), F.count_if(breached).alias("breached"), F.count_if(~breached & (F.col("finish_at") > F.col("deadline"))).alias("at_risk"))


def stale_jobs(jobs: DataFrame, as_of: str, stale_s: float) -> DataFrame:
    return jobs.where((F.col("state") == "running") & (F.col("heartbeat_at") < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(float(stale_s)))))


def rate_limit_audit(requests: DataFrame, ts: str, by: str, window_s: int, limit: int) -> DataFrame:
    """(by, bucket, n, rejected) of fixed windows with more requests than the limit."""
    rows = buckets(requests, ts, window_s, [by], {"n": F.lit(1)})
    return rows.where(F.col("n") > limit).withColumn("rejected", F.col("n") - limit)


def retry_stats(parts: DataFrame, by: list[str]) -> DataFrame:
    return parts.groupBy(*by).agg(F.sum("attempt_count").alias("attempts"), F.count_if(F.col("attempt_count") > 1).alias("retried"), F.count_if(F.col("attempt_count") == 0).alias("new"), F.max("attempt_count").alias("most"))


def long_running(runs: DataFrame, started: str, as_of: str, limit_s: int, n: int = 50) -> DataFrame:
    """Running rows over the limit with their whole minutes, the oldest first."""
    now = F.lit(as_of).cast("timestamp_ntz")
    rows = runs.withColumn("minutes", F.timestamp_diff("MINUTE", F.col(started), now))
    return rows.where(F.timestamp_diff("SECOND", F.col(started), now) > limit_s).orderBy(started, *[c for c in runs.columns if c != started][:1]).limit(n)


def pass_rate(results: DataFrame, ts: str, by: list[str], window_s: int, step_s: int) -> DataFrame:
    """(by, bucket, rate): passed of not skipped over the trailing window."""
    rows = buckets(results.where("outcome <> 'skipped'"), ts, step_s, by, {"good": (F.col("outcome") == "passed").cast("int"), "n": F.lit(1)})
    return rows.select(*by, "bucket", F.try_divide(trailing(rows, by, "good", window_s, step_s), trailing(rows, by, "n", window_s, step_s)).alias("rate"))


def bucket_sketches(events: DataFrame, ts: str, value: str, by: list[str], step_s: int, k: int = 400) -> DataFrame:
    """(by, bucket, sketch): a KLL sketch of the values of each bucket; null values and NaN take no part. One scan serves all
    windows and quantiles, and sketches of later days can be added without reading the earlier ones again."""
    rows = events.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return rows.groupBy(*by, bucket_of(F.col(ts), step_s).alias("bucket")).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def rolling_quantiles(sketches: DataFrame, by: list[str], windows: list[int], step_s: int, qs: list[float], k: int = 400) -> DataFrame:
    """(by, window_s, bucket, n, p50-like columns) over trailing windows (seconds, multiples of ``step_s``) that end with
    each bucket, merged from the buckets' sketches: the rank of a quantile is off by about 1 / k.

    A sketch is sent to the windows that hold its bucket, at most longest window / step rows of a few kB a bucket, and
    groups are (by, window, end), so a label with most of the events is no larger than any other."""

    def places(w: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(w // step_s - 1)), lambda i: F.struct(F.lit(w).alias("window_s"), (i * step_s).alias("later")))

    ends = F.flatten(F.array(*map(places, windows)))
    spread = sketches.select(*by, "bucket", "sketch", F.explode(ends).alias("e")).select(*by, "e.window_s", (F.col("bucket") + F.col("e.later")).alias("bucket"), "sketch", (F.col("e.later") == 0).alias("own"))
    merged = spread.groupBy(*by, "window_s", "bucket").agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.max("own").alias("own")).where("own")
    columns = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(f"p{round(q * 100)}") for q in qs]
    return merged.select(*by, "window_s", "bucket", F.kll_sketch_get_n_double("sketch").alias("n"), *columns)


def windowed_increase(samples: DataFrame, by: list[str], ts: str, value: str, window_s: int, step_s: int) -> DataFrame:
    """(by, bucket, increase) of a counter over the trailing window that ends with each bucket that has a sample. A drop is
    a reset. Steps inside of a bucket and between a bucket's first sample and the last one of the bucket before are
    summed by bucket, so windows over time see a row per bucket."""
    own = bucket_of(F.col(ts), step_s)
    inside = Window.partitionBy(*by, "bucket").orderBy("_at")
    rows = samples.where(F.col(value).isNotNull()).select(*by, own.alias("bucket"), F.col(ts).alias("_at"), F.col(value).cast("double").alias("_v"))
    before = F.lag("_v").over(inside)
    step = F.when(before.isNull(), 0.0).when(F.col("_v") >= before, F.col("_v") - before).otherwise(F.col("_v"))
    summed = rows.withColumn("_step", step).groupBy(*by, "bucket").agg(F.sum("_step").alias("_inside"), F.min_by("_v", "_at").alias("_first"), F.max_by("_v", "_at").alias("_last"))
    last = F.lag("_last").over(Window.partitionBy(*by).orderBy("bucket"))
    joint = F.when(last.isNull(), 0.0).when(F.col("_first") >= last, F.col("_first") - last).otherwise(F.col("_first"))
    grown = summed.select(*by, "bucket", (F.col("_inside") + joint).alias("_grown"))
    return grown.select(*by, "bucket", trailing(grown, by, "_grown", window_s, step_s).alias("increase"))
