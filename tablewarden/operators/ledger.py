"""Analyses of run ledgers: filters, joins, roll-ups, rankings and ordered state."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.session import cut

#: Jobs of a block of ``overlapping_backfills``, and meetings or cells of their square that a task holds at once.
OVERLAP_BLOCK, OVERLAP_CELLS = 4096, 2_000_000
#: Values of a group that ``ewma`` walks through at once where its chunks don't tell their average by themselves.
EWMA_GATHER = 1 << 20
ACTIVE = ("pending", "running", "resuming", "waiting_upstream", "paused")
# The moves that the two state machines allow, and the states that a run does not leave.
RUN_MOVES = (("pending", "running"), ("running", "succeeded"), ("running", "failed"), ("running", "cancelled"), ("running", "timeout"))
RUN_ENDS = ("succeeded", "failed", "cancelled", "timeout")
BACKFILL_MOVES = (
    ("pending", "running"), ("pending", "waiting_upstream"), ("pending", "cancelled"), ("waiting_upstream", "pending"),
    ("waiting_upstream", "failed"), ("waiting_upstream", "cancelled"), ("running", "waiting_upstream"), ("running", "completed"),
    ("running", "failed"), ("running", "cancelled"), ("running", "paused"), ("paused", "resuming"), ("paused", "cancelled"),
    ("resuming", "running"), ("resuming", "cancelled"),
)


# --- filters and paging


def tenant_scope(df: DataFrame, tenant, column: str = "tenant_id") -> DataFrame:
    """Rows of a tenant, and shared rows (null)."""
    return df.where(F.col(column).isNull() | (F.col(column) == F.lit(tenant)))


def newest(df: DataFrame, time: str, key: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the newest rows, ties to the larger key."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000 and offset 0 or more")
    return df.orderBy(F.desc(time), F.desc(key)).offset(offset).limit(limit)


def active_jobs_for(jobs: DataFrame, asset, key: str) -> DataFrame:
    """Active jobs of an asset whose key list has the key."""
    return jobs.where((F.col("asset_id") == F.lit(asset)) & F.col("state").isin(*ACTIVE) & F.array_contains("partition_keys", key))


def enabled_checks(checks: DataFrame) -> DataFrame:
    return checks.where("enabled").orderBy("created_at", "check_id")


def failed_partitions(parts: DataFrame, job) -> DataFrame:
    return parts.where((F.col("job_id") == F.lit(job)) & (F.col("state") == "failed")).orderBy("partition_key", "part_id")


# --- joins


def workflow_assets(membership: DataFrame, assets: DataFrame) -> DataFrame:
    """Members (workflow_id, asset_id, position) with their asset rows."""
    return membership.join(assets, "asset_id").orderBy("workflow_id", "position")


def completed_partitions(wanted: DataFrame, parts: DataFrame, on: list[str]) -> DataFrame:
    """The wanted keys that have a completed row in any job."""
    return wanted.join(parts.where("state = 'completed'").select(*on), on, "left_semi")


def enrich_with_default(facts: DataFrame, dim: DataFrame, on: str, defaults: dict[str, str]) -> DataFrame:
    """Left lookup; what is unknown gets the default. Spark broadcasts the dimension if its size allows."""
    joined = facts.join(dim.select(on, *defaults), on, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def overlapping_backfills(jobs: DataFrame) -> DataFrame:
    """(asset_id, a, b, n_keys): pairs of active jobs of one asset that share keys.

    Pairs are as many as the square of an asset's jobs, so they are made where they are counted and move nowhere: jobs
    are dealt into blocks of about ``OVERLAP_BLOCK``, each two blocks of an asset are a cell, and what moves are the jobs
    with their keys, once a block of their asset."""
    jobs = jobs.where(F.col("state").isin(*ACTIVE) & F.col("asset_id").isNotNull() & F.col("job_id").isNotNull())
    keys = jobs.select("asset_id", "job_id", F.explode("partition_keys").alias("key")).where("key IS NOT NULL")
    keys = cut(keys.groupBy("asset_id", "job_id").agg(F.collect_set("key").alias("keys")))
    blocks = keys.groupBy("asset_id").agg(F.ceil(F.greatest(F.count(F.lit(1)) / OVERLAP_BLOCK, F.sum(F.size("keys")) / OVERLAP_CELLS)).alias("_n"))
    dealt = keys.join(blocks, "asset_id").withColumn("_block", F.expr("pmod(xxhash64(job_id), _n)"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    cell = {"_low": F.least("_block", "_other"), "_high": F.greatest("_block", "_other")}
    by = ["asset_id", *cell]
    # a cell's work is its square, so partitions are as many as cells and not as its bytes ask for
    n_cells = blocks.agg(F.sum(F.expr("_n * (_n + 1) DIV 2"))).first()[0] or 1
    parts = max(int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n_cells, 1000))
    cells = dealt.withColumns(cell).select(*by, "_block", "job_id", "keys").repartition(parts, *by)
    out = T.StructType([T.StructField(n, jobs.schema[c].dataType) for n, c in (("asset_id", "asset_id"), ("a", "job_id"), ("b", "job_id"))])
    return cells.groupBy(*by).applyInArrow(shared_keys, out.add("n_keys", "long"))


def shared_keys(cell: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a cell's jobs with the number of keys that they share. A cell of two blocks pairs the jobs of one with those
    of the other, a cell of one block all of its jobs. Counts are made for some jobs against all others at a time."""
    table = pa.Table.from_batches(cell).sort_by([("_block", "ascending"), ("job_id", "ascending")]).combine_chunks()
    n, asset, ids, lists = len(table), *(table[c].chunk(0) for c in ("asset_id", "job_id", "keys"))
    cross = table["_low"][0] != table["_high"][0]
    base = int(np.sum(table["_block"].to_numpy() == table["_low"][0].as_py())) if cross else 0
    if cross and base in (0, n):
        return
    width, rank = n - base, np.empty(n, np.int64)
    rank[pa.compute.sort_indices(ids).to_numpy()] = np.arange(n)
    key = lists.flatten().dictionary_encode().indices.to_numpy()
    job = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
    by_key = np.argsort(key, kind="stable")  # the jobs of a key in their order, one key after the other
    mates = job[by_key]
    ends = np.cumsum(np.bincount(key))
    if base:  # from the first job of the other block on
        start = (ends - np.bincount(key[job >= base], minlength=len(ends)))[key]
        times = np.where(job < base, ends[key] - start, 0)
    else:  # from the next job on
        start = np.empty(len(key), np.int64)
        start[by_key] = np.arange(1, len(key) + 1)
        times = ends[key] - start
    met = np.concatenate([[0], np.cumsum(times)])
    rows = max(1, OVERLAP_CELLS // width)
    for at in range(0, base or n, rows):
        first, last = np.searchsorted(job, [at, min(at + rows, base or n)])
        counts = np.zeros(rows * width, np.int64)
        while first < last:
            stop = min(max(int(np.searchsorted(met, met[first] + OVERLAP_CELLS, "right")) - 1, first + 1), last)
            some = times[first:stop]
            step = np.arange(met[stop] - met[first]) - np.repeat(met[first:stop] - met[first], some)
            counts += np.bincount((np.repeat(job[first:stop], some) - at) * width + mates[np.repeat(start[first:stop], some) + step] - base, minlength=len(counts))
            first = stop
        hit = np.flatnonzero(counts)
        left, right = hit // width + at, hit % width + base
        turned = rank[left] > rank[right]
        a, b = np.where(turned, right, left), np.where(turned, left, right)
        yield pa.RecordBatch.from_pydict({"asset_id": asset.take(left), "a": ids.take(a), "b": ids.take(b), "n_keys": counts[hit]})


def label_results(results: DataFrame, checks: DataFrame) -> DataFrame:
    """Results with the check's name, or its id where the check is gone."""
    joined = results.join(checks.select("check_id", "name"), "check_id", "left")
    return joined.withColumn("label", F.coalesce("name", F.col("check_id").cast("string"))).drop("name")


def duplicate_names(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose name is registered more than once."""
    twice = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*columns)
    return df.join(twice, columns, "left_semi")


def recent_failures(results: DataFrame, checks: DataFrame, as_of: str, window_s: int, limit: int = 100) -> DataFrame:
    """Failed results of the last ``window_s`` seconds with their check, newest first."""
    end = F.lit(as_of).cast("timestamp_ntz")
    recent = results.where((F.col("outcome") == "failed") & (F.col("executed_at") > end - F.make_dt_interval(secs=F.lit(float(window_s)))) & (F.col("executed_at") <= end))
    return recent.join(checks.select("check_id", "name"), "check_id").orderBy(F.desc("executed_at"), F.desc("result_id")).limit(limit)


def runs_stopped_by_checks(runs: DataFrame, failures: DataFrame) -> DataFrame:
    """Failed runs that have a blocking failure."""
    return runs.where("state = 'failed'").join(failures.select(F.col("result_id").alias("run_id")), "run_id", "left_semi")


# --- roll-ups


def count_by(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def upstream_summary(jobs: DataFrame) -> DataFrame:
    """Per parent: total and completed, failed, running, pending children."""
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("completed", "failed", "running", "pending")]
    return jobs.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.count(F.lit(1)).alias("total"), *states)


def upstream_complete(parents: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, complete): no children, or all of them completed."""
    done = jobs.groupBy(F.col("parent_id").alias("job_id")).agg(F.bool_and(F.col("state") == "completed").alias("all_done"))
    return parents.select("job_id").join(done, "job_id", "left").select("job_id", F.coalesce("all_done", F.lit(True)).alias("complete"))


def failed_children(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.count_if(F.col("state") == "failed").alias("failed_children"))


def outcome_summary(results: DataFrame, by: str) -> DataFrame:
    """Counts of each outcome per group."""
    return results.groupBy(by).pivot("outcome", ["passed", "failed", "error", "skipped"]).agg(F.count(F.lit(1))).na.fill(0)


def failure_rate(failed: Column, checked: Column) -> Column:
    """Percent failed, null where nothing was checked."""
    return F.try_divide(failed * 100.0, checked)


def job_progress(parts: DataFrame) -> DataFrame:
    """Per job: counts, done ratio, remaining, and the final state (failed only if something failed and nothing completed)."""
    counts = parts.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in ("completed", "failed", "skipped")])
    done = F.col("completed") + F.col("failed") + F.col("skipped")
    final = F.when(done < F.col("total"), "running").when((F.col("failed") > 0) & (F.col("completed") == 0), "failed").otherwise("completed")
    return counts.select("*", (done / F.col("total")).alias("ratio"), (F.col("total") - done).alias("remaining"), final.alias("final_state"))


def run_metrics(runs: DataFrame, grain: str) -> DataFrame:
    """Per hour, day, week or month: total, succeeded, failed, mean duration."""
    return runs.groupBy(F.date_trunc(grain, "started_at").cast("timestamp_ntz").alias("bucket")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("state") == "succeeded").alias("succeeded"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.avg("duration_s").alias("avg_duration_s"),
    )


def job_latencies(jobs: DataFrame, created: str, claimed: str, finished: str, by: list[str]) -> DataFrame:
    """Mean and largest seconds from creation to claim, and from claim to the end."""
    def seconds(a: str, b: str) -> Column:
        return F.timestamp_diff("SECOND", F.col(a), F.col(b))

    return jobs.groupBy(*by).agg(
        F.avg(seconds(created, claimed)).alias("avg_claim_s"),
        F.max(seconds(created, claimed)).alias("max_claim_s"),
        F.avg(seconds(claimed, finished)).alias("avg_run_s"),
    )


def asset_summary(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Completed orders per customer: customer_id, customer_name, segment, total_orders, total_amount."""
    done = orders.where("status = 'completed'").groupBy("customer_id").agg(F.count(F.lit(1)).alias("total_orders"), F.sum("amount").alias("total_amount"))
    return enrich_with_default(done, customers, "customer_id", {"customer_name": "Unknown", "segment": "unknown"}).select("customer_id", "customer_name", "segment", "total_orders", "total_amount")


def tree_progress(jobs: DataFrame) -> DataFrame:
    """Per root: children, completed children, percent (whole, 0 when there are none)."""
    kids = jobs.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("job_id")).agg(F.count(F.lit(1)).alias("children"), F.count_if(F.col("state") == "completed").alias("completed"))
    joined = jobs.select("job_id").join(kids, "job_id", "left").na.fill(0)
    return joined.select("*", F.when(F.col("children") > 0, F.expr("completed * 100 DIV children")).otherwise(0).cast("long").alias("percent"))


def error_groups(parts: DataFrame, limit: int = 10) -> DataFrame:
    """Failures by message and attempts, the most frequent first."""
    grouped = parts.where("state = 'failed'").groupBy("error_message", "attempt_count").agg(F.count(F.lit(1)).alias("n"))
    return grouped.orderBy(F.desc("n"), "error_message", "attempt_count").limit(limit)


# --- windows and ordered state


def running_totals(df: DataFrame, by: list[str], order: list[str], weight: Column, name: str, parts: int | None = None) -> DataFrame:
    """Adds the sum of ``weight`` over the rows of the group up to each row, in ``order``. Rows are range-partitioned by
    (group, order) and summed inside their partition; a group that goes over several partitions continues where the one
    before ended, so a group with most of the rows is as many tasks as any other rows. What is summed by group alone is
    a row per partition and group that it holds."""
    keys = [*by, *[c for c in order if c not in by]]
    rows = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    rows = cut(rows.withColumns({"_w": weight, "_part": F.spark_partition_id()}))
    inside = F.sum("_w").over(Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    counts = rows.groupBy(*by, "_part").agg(F.sum("_w").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    match = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(counts[f"_by_{c}"]) for c in by], F.col("_part") == F.col("_at"))
    joined = rows.withColumn(name, inside).join(counts, match)
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop(*[f"_by_{c}" for c in by], "_at", "_before", "_part", "_w")


def numbered(df: DataFrame, by: str, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Numbers the rows of each group from 0 in ``order``."""
    return running_totals(df, [by], order, F.lit(1), name, parts).withColumn(name, F.col(name) - 1)


def with_previous(df: DataFrame, by: list[str], order: list[str], columns: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds the struct ``name`` of ``columns`` of the row before in the group, null for its first row. Rows are
    range-partitioned by (group, order) and looked up inside their partition; only where a group goes on from one partition
    to the next, its last row is handed over: at most one row a partition, which is broadcast. So a group may hold any
    part of the rows."""
    keys = [*by, *[c for c in order if c not in by]]
    rows = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    rows = cut(rows.withColumn("_part", F.spark_partition_id()))
    inside = F.lag(F.struct(*columns)).over(Window.partitionBy("_part", *by).orderBy(*order))
    last = F.max_by(F.struct(*columns), F.struct(*order))
    ends = rows.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_at")).agg(last.alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*[f"_by_{c}" for c in by]).orderBy("_at"))
    crossing = ends.withColumn("_before", before).where(F.col("_before").isNotNull()).drop("_last")
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_part") == F.col("_at"))
    joined = rows.withColumn(name, inside).join(F.broadcast(crossing), match, "left")
    return joined.withColumn(name, F.coalesce(name, "_before")).drop("_part", "_at", "_before", *[f"_by_{c}" for c in by])


def ewma(df: DataFrame, by: str, order: list[str], value: str, alpha: float = 0.3, chunk: int = 4096, initial: DataFrame | None = None) -> DataFrame:
    """(by, ewma, n): e1 = x1, et = alpha * xt + (1 - alpha) * et-1, alpha held to [0.01, 1], to the last bit as these
    steps give it one after the other.

    Rows are numbered inside their group and cut into chunks of ``chunk``, which are gathered as rows. A chunk forgets
    what came before: a step rounds a larger average to none smaller, so where the least and the largest number lead
    through a chunk to the same average, every average does. Only chunks after the last of those, and few that don't
    forget, are walked in order, ``EWMA_GATHER`` values of a group at a time. ``initial`` (by, ewma, n), as this function
    returns it, resumes: only new rows need be given, groups without new rows keep their value; an average without a
    count, or with count 0 or less, is none. Null values are no observations; an infinite average stays."""
    alpha = min(max(alpha, 0.01), 1.0)
    rows = numbered(df.where(F.col(value).isNotNull()).select(by, *[c for c in order if c != by], F.col(value).cast("double").alias("_x")), by, order, "i")
    rows = rows.select(by, F.col("_x").alias("x"), "i").withColumn("c", F.expr(f"i DIV {chunk}"))
    sorted_x = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    chunks = rows.groupBy(by, "c").agg(sorted_x.alias("xs"), F.count(F.lit(1)).alias("n"))
    known = None
    begun, past = F.col("xs")[0], F.lit(0.0)
    if initial is not None:
        known = initial.where("n > 0 AND ewma IS NOT NULL").select(F.col(by).alias("_by"), F.col("ewma").alias("_e"), F.col("n").alias("_n"))
        chunks = chunks.join(known.drop("_n"), chunks[by].eqNullSafe(F.col("_by")) & (F.col("c") == 0), "left").drop("_by")
        begun = F.when(F.col("_e").isNull(), begun).otherwise(alpha * F.col("xs")[0] + (1 - alpha) * F.col("_e"))
        past = F.coalesce("_e", F.lit(0.0))

    def walk(xs: Column, e: Column) -> Column:
        return F.aggregate(xs, e.cast("double"), lambda e, x: F.lit(alpha) * x + F.lit(1 - alpha) * e)

    def endless(x: Column) -> Column:
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(0.0)

    least, largest = (walk(F.col("xs"), F.lit(end)) for end in (-sys.float_info.max, sys.float_info.max))
    first = walk(F.slice("xs", 2, chunk), begun)
    told = F.when(F.col("c") == 0, first).when(least == largest, least)
    chunks = chunks.withColumns({"told": told, "endless": F.aggregate("xs", F.when(F.col("c") == 0, endless(past)).otherwise(0.0), lambda s, x: s + endless(x))})
    chunks = cut(chunks.select(by, "c", "told", "endless", "n", F.when(F.col("told").isNull(), F.col("xs")).alias("xs")))
    last = F.max(F.when(F.col("told").isNotNull(), F.struct("c", "told")))
    groups = chunks.groupBy(by).agg(last.alias("last"), F.max("c").alias("top"), F.sum("n").alias("n"), F.sum("endless").alias("endless"))
    groups = groups.select(by, (F.col("last.c") + 1).alias("at"), F.col("last.told").alias("e"), "top", "n", "endless")
    left, step = groups.agg(F.max(F.col("top") + 1 - F.col("at"))).first()[0] or 0, max(1, EWMA_GATHER // chunk)
    for _ in range(0, left, step):
        untold = chunks.where("told IS NULL").select(F.col(by).alias("_by"), "c", "xs")
        part = untold.join(groups.select(by, "at", "e"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("c") >= F.col("at")) & (F.col("c") < F.col("at") + step))
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("c", "xs"))), lambda s: s["xs"])
        moved = part.groupBy("_by", "e").agg(in_order.alias("xs")).select("_by", walk(F.flatten("xs"), F.col("e")).alias("_moved"))
        groups = groups.join(moved, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
        groups = groups.withColumns({"e": F.coalesce("_moved", "e"), "at": F.col("at") + step}).drop("_moved")
        groups = cut(groups) if left > step else groups
    groups = groups.select(by, F.when(F.col("endless") == 0, F.col("e")).otherwise(F.col("endless")).alias("ewma"), "n")
    if known is None:
        return groups
    both = groups.join(known, groups[by].eqNullSafe(known["_by"]), "full")
    return both.select(F.coalesce(by, "_by").alias(by), F.coalesce("ewma", "_e").alias("ewma"), (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"))


def eta_columns(remaining: Column, average_ms: Column, n: Column) -> dict[str, Column]:
    """seconds_left, reliable (3 observations or more) and per_minute, from an average of n durations."""
    return {
        "seconds_left": remaining * average_ms / 1000,
        "reliable": F.coalesce(n, F.lit(0)) >= 3,
        "per_minute": F.when(average_ms > 0, F.lit(60000.0) / average_ms),
    }


def eta(progress: DataFrame, averages: DataFrame, as_of: str) -> DataFrame:
    """job_id, remaining, seconds_left, finish_at, reliable (3 observations or more), per_minute."""
    joined = progress.select("job_id", "remaining").join(averages, "job_id", "left")
    joined = joined.withColumns(eta_columns(F.col("remaining"), F.col("ewma"), F.col("n")))
    finish = F.lit(as_of).cast("timestamp_ntz") + F.make_dt_interval(secs=F.round("seconds_left").cast("long"))
    return joined.select("job_id", "remaining", "seconds_left", finish.alias("finish_at"), "reliable", "per_minute")


def backlog_rank(jobs: DataFrame, as_of: str, stale_s: int = 120, by: str | None = None) -> DataFrame:
    """Claimable jobs in the order in which they should be claimed: pending, resuming, running with an old heartbeat; then
    higher priority, execution order and age. ``by`` ranks within groups. Ranks are counted over range partitions, so neither
    a large group nor the whole backlog is one task."""
    old = F.col("heartbeat_at") < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(float(stale_s)))
    group = F.when(F.col("state") == "pending", 0).when(F.col("state") == "resuming", 1).when((F.col("state") == "running") & old, 2)
    rows = jobs.withColumn("class", group).where(F.col("class").isNotNull())
    rows = rows.withColumns({"_none": F.col("priority").isNull(), "_down": -F.col("priority")})
    ranked = running_totals(rows, [by] if by else [], ["class", "_none", "_down", "execution_order", "created_at", "job_id"], F.lit(1), "rank")
    return ranked.drop("_none", "_down")


def partition_backlog(parts: DataFrame, max_retries: int = 3) -> DataFrame:
    """Partitions still to do per job: pending first, then failed below the retry limit, by key."""
    open_ = parts.where((F.col("state") == "pending") | ((F.col("state") == "failed") & (F.col("attempt_count") < max_retries)))
    open_ = open_.withColumn("_class", F.when(F.col("state") == "pending", 0).otherwise(1))
    return running_totals(open_, ["job_id"], ["_class", "partition_key", "part_id"], F.lit(1), "position").drop("_class")


def latest_per(df: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in ``order``; Spark drops the others before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def checkpoint(parts: DataFrame) -> DataFrame:
    """The key that each job completed last."""
    return parts.where("state = 'completed'").groupBy("job_id").agg(F.max_by("partition_key", F.struct("updated_at", "part_id")).alias("checkpoint_key"))


def state_pairs(log: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds from_state, the state before, and from_ts."""
    rows = with_previous(log, [by], order, ["state", "ts"], "_from")
    return rows.withColumns({"from_state": F.col("_from.state"), "from_ts": F.col("_from.ts")}).drop("_from")


def invalid_transitions(log: DataFrame, by: str, order: list[str], moves=RUN_MOVES) -> DataFrame:
    """Consecutive states that the machine forbids."""
    allowed = reduce(lambda a, b: a | b, [(F.col("from_state") == a) & (F.col("state") == b) for a, b in moves])
    return state_pairs(log, by, order).where(F.col("from_state").isNotNull() & ~allowed)


def transition_counts(log: DataFrame, by: str, order: list[str]) -> DataFrame:
    return state_pairs(log, by, order).where(F.col("from_state").isNotNull()).groupBy("from_state", "state").agg(F.count(F.lit(1)).alias("n"))


def state_durations(log: DataFrame, by: str, order: list[str], state: str, then: str) -> DataFrame:
    """(by, ts, seconds): time from entering ``state`` until ``then``, where that comes next."""
    rows = state_pairs(log, by, order).where((F.col("from_state") == state) & (F.col("state") == then))
    return rows.select(by, F.col("from_ts").alias("ts"), F.timestamp_diff("SECOND", F.col("from_ts"), F.col("ts")).alias("seconds"))


def partition_listing(parts: DataFrame, limit: int = 50) -> DataFrame:
    """The newest ledger row of each key, by key, with the number of keys in all."""
    latest = latest_per(parts, ["partition_key"], [F.desc("updated_at"), F.desc("part_id")])
    total = parts.select("partition_key").distinct().agg(F.count(F.lit(1)).alias("total"))
    return latest.orderBy("partition_key").limit(limit).crossJoin(total)


def cancel_impact(jobs: DataFrame, parts: DataFrame, roots: DataFrame) -> DataFrame:
    """(job_id, new_state, skipped): what cancelling the roots with their children would do; no change is made."""
    keys = roots.select("job_id")
    hit = jobs.join(keys, "job_id", "left_semi").unionByName(jobs.join(keys.withColumnRenamed("job_id", "parent_id"), "parent_id", "left_semi").select(jobs.columns))
    hit = hit.where(F.col("state").isin(*ACTIVE)).select("job_id").distinct()
    pending = parts.where("state = 'pending'").groupBy("job_id").agg(F.count(F.lit(1)).alias("skipped"))
    return hit.join(pending, "job_id", "left").select("job_id", F.lit("cancelled").alias("new_state"), F.coalesce("skipped", F.lit(0)).alias("skipped"))


def releasable_parents(jobs: DataFrame) -> DataFrame:
    """Waiting parents of which all children are completed."""
    waiting = jobs.where("state = 'waiting_upstream'").select("job_id")
    return upstream_complete(waiting, jobs).where("complete").select("job_id")
