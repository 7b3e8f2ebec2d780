"""Queries of rates, quantiles, objectives, alerts and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.operators import ledger
from tablewarden.operators import observe as o
from tablewarden.plans.base import Plans, Tables

plan = Plans()
QUERIES, ORACLES = plan.queries, plan.oracles

BOUNDS = [0.1, 0.5, 1, 5, 10, 30, 60, 120, 300, 600]
ERROR = "event_type = 'error'"
HOUR, DAY = 3600, 86400


def b(seconds: int, ts: str = "ts") -> str:
    return f"CAST(floor(epoch_us({ts}) / {seconds * 1_000_000}) * {seconds} AS BIGINT)"


PRICES = {"compute": "0.00002400", "memory": "0.00000250", "storage": "0.02600000", "egress": "0.12000000"}


def costs(t: Tables):
    cost = o.run_cost(F.col("duration_s"), F.lit(2), F.col("workflow_id"), F.lit(0.01), PRICES)
    return t["runs"].withColumn("cost", cost)


# Scaled to whole numbers: amounts by 10^4, prices by 10^8. Storage is the only quotient, rounded half up at 18 decimals.
AMOUNT = "CAST(CAST(duration_s AS DECIMAL(12, 4)) * 10000 AS HUGEINT)"
WHOLE = f"({AMOUNT} * 2400 + {AMOUNT} * 2 * 250 + 100 * 12000000)"
STORED = f"((2 * CAST(workflow_id AS HUGEINT) * {AMOUNT} * 2600000 * 1000000 + 2628000) // (2 * 2628000))"
COST = f"({WHOLE} * 1000000 + {STORED})"


@plan("agg_run_cost", f"SELECT run_id, CAST({COST} AS VARCHAR) AS cost FROM {{runs}}")
def _(t):
    """In units of the eighteenth decimal, which no rounding can blur."""
    return costs(t).select("run_id", units("cost"))


def units(column: str):
    return F.regexp_replace(F.regexp_replace(F.col(column).cast("decimal(38,18)").cast("string"), r"\.", ""), "^0+(?=.)", "").alias(column)


@plan("agg_cost_rollup", f"SELECT tenant_id, workflow_id, CAST(sum({COST}) AS VARCHAR) AS cost, count(*) AS n FROM {{runs}} GROUP BY ROLLUP (tenant_id, workflow_id)")
def _(t):
    return o.cost_breakdown(costs(t)).select("tenant_id", "workflow_id", units("cost"), "n")


@plan("agg_spend_alerts", f"SELECT tenant_id, date_trunc('day', started_at)::TIMESTAMP AS period, CAST(sum({COST}) AS VARCHAR) AS spent FROM {{runs}} GROUP BY 1, 2 HAVING sum({COST}) > 4000000000000000")
def _(t):
    return o.spend_alerts(costs(t), "day", 0.004).select("tenant_id", "period", units("spent"))


HIST = "SELECT event_type, CAST(le AS DOUBLE) AS le, count(*) FILTER (value <= le) AS n, count(*) AS total FROM events, (SELECT unnest([0.1, 0.5, 1, 5, 10, 30, 60, 120, 300, 600, 'inf'::DOUBLE]) AS le) GROUP BY event_type, le"


@plan("agg_histogram", HIST.replace("CAST(le AS DOUBLE)", "least(CAST(le AS DOUBLE), 1e300)"))
def _(t):
    return o.histogram(t["events"], "value", BOUNDS, ["event_type"]).select("event_type", F.least("le", F.lit(1e300)).alias("le"), "n", "total")


@plan(
    "agg_histogram_quantile",
    f"""SELECT event_type, round(low + (le - low) * (0.95 * total - below) / (n - below), 6) AS quantile FROM (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS below, row_number() OVER (PARTITION BY event_type, n >= 0.95 * total ORDER BY le) AS r FROM ({HIST}) WINDOW w AS (PARTITION BY event_type ORDER BY le)) WHERE n >= 0.95 * total AND r = 1""",
)
def _(t):
    hist = o.histogram(t["events"], "value", BOUNDS, ["event_type"])
    return o.histogram_quantile(hist, 0.95, ["event_type"]).withColumn("quantile", F.round("quantile", 6))


@plan("agg_quantiles", "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{round(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + " FROM events GROUP BY event_type")
def _(t):
    out = o.quantiles(t["events"], "value", [0.5, 0.9, 0.95, 0.99], ["event_type"])
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99")])


@plan("agg_cap_cardinality", "SELECT CASE WHEN k.user_id IS NULL THEN 'other' ELSE CAST(e.user_id AS VARCHAR) END AS capped, count(*) AS n FROM events e LEFT JOIN (SELECT user_id FROM events GROUP BY 1 ORDER BY min(ts), user_id LIMIT 30) k ON k.user_id = e.user_id GROUP BY 1")
def _(t):
    return ledger.count_by(o.cap_cardinality(t["events"], "user_id", "ts", 30), "capped")


def counted(step: int, by: str = "event_type", extra: str = "", where: str = "") -> str:
    return f"SELECT {by}, {b(step)} AS bucket, count(*) AS n{extra} FROM events {where} GROUP BY 1, 2"


def frame(by: str, low: int, high: int = 0) -> str:
    return f"OVER (PARTITION BY {by} ORDER BY bucket RANGE BETWEEN {low} PRECEDING AND {high} PRECEDING)"


@plan("win_rolling_rate", f"SELECT event_type, bucket, n, round(coalesce(sum(n) {frame('event_type', 6 * HOUR - 300)}, 0) / {6 * HOUR}.0, 9) AS rate FROM ({counted(300)})")
def _(t):
    return o.rolling_rate(t["events"], "ts", ["event_type"], 6 * HOUR, 300).withColumn("rate", F.round("rate", 9))


@plan(
    "win_throughput_degraded",
    f"""SELECT event_type, bucket, n FROM (SELECT *, sum(n) {frame('event_type', HOUR - 900)} / {HOUR}.0 AS now, coalesce(sum(n) {frame('event_type', 4 * HOUR + HOUR - 900, HOUR)}, 0) / {4 * HOUR}.0 AS old FROM ({counted(900)})) WHERE old > 0 AND now / old < 0.5""",
)
def _(t):
    return o.throughput_degraded(t["events"], "ts", ["event_type"], HOUR, 4 * HOUR, HOUR, 900).select("event_type", "bucket", "n")


BREACH = f"SELECT user_id, bucket FROM (SELECT user_id, {b(DAY)} AS bucket, count(*) FILTER ({ERROR}) AS bad FROM events GROUP BY 1, 2) WHERE bad > 0"


@plan("win_alert_intervals", f'SELECT user_id, min(bucket) AS start, max(bucket) + {DAY} AS "end", count(*) AS n FROM (SELECT *, bucket - row_number() OVER (PARTITION BY user_id ORDER BY bucket) * {DAY} AS island FROM ({BREACH})) GROUP BY user_id, island HAVING count(*) >= 2')
def _(t):
    rows = o.buckets(t["events"], "ts", DAY, ["user_id"], {"bad": F.expr(ERROR).cast("int")}).where("bad > 0")
    return o.alert_intervals(rows.select("user_id", "bucket"), ["user_id"], DAY, 2 * DAY)


@plan("obs_rate", f"SELECT event_type, bucket, n, round(n / {HOUR}.0, 9) AS rate FROM ({counted(HOUR)})")
def _(t):
    return o.rolling_rate(t["events"], "ts", ["event_type"], HOUR, HOUR).withColumn("rate", F.round("rate", 9))


@plan("obs_increase", "SELECT user_id, round(sum(CASE WHEN p IS NULL THEN 0 WHEN value >= p THEN value - p ELSE value END), 6) AS increase FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) GROUP BY user_id")
def _(t):
    return o.increase(t["events"], ["user_id"], "ts", "value").withColumn("increase", F.round("increase", 6))


@plan("obs_ratio_alert", f"SELECT user_id, {b(DAY)} AS bucket, CAST(count(*) FILTER ({ERROR}) AS BIGINT) AS bad, count(*) AS n, round(count(*) FILTER ({ERROR}) * 1.0 / count(*), 9) AS ratio FROM events GROUP BY 1, 2 HAVING count(*) FILTER ({ERROR}) * 1.0 / count(*) > 0.3")
def _(t):
    return o.ratio_alert(t["events"], "ts", ["user_id"], F.expr(ERROR), DAY, 0.3).withColumn("ratio", F.round("ratio", 9))


@plan("obs_latency_alert", f"SELECT event_type, {b(DAY)} AS bucket, round(quantile_cont(value, 0.95), 6) AS quantile FROM events GROUP BY 1, 2 HAVING quantile_cont(value, 0.95) > 150")
def _(t):
    return o.latency_alert(t["events"], "ts", "value", ["event_type"], 0.95, DAY, 150).withColumn("quantile", F.round("quantile", 6))


FIRST, LAST = 1704067200, 1704067200 + 29 * DAY


@plan("obs_absence", f"SELECT user_id, CAST(bucket AS BIGINT) AS bucket FROM (SELECT DISTINCT user_id FROM events), generate_series({FIRST}, {LAST}, {DAY}) AS g(bucket) WHERE (user_id, bucket) NOT IN (SELECT (user_id, {b(DAY)}) FROM events)")
def _(t):
    return o.absence_alert(t["events"], "ts", ["user_id"], DAY, FIRST, LAST)


@plan("obs_stuck", f"SELECT user_id, {b(DAY)} AS bucket, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS busy, CAST(0 AS BIGINT) AS done FROM events GROUP BY 1, 2 HAVING count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'purchase') = 0")
def _(t):
    return o.stuck_alert(t["events"], "ts", ["user_id"], F.expr("event_type = 'view'"), F.expr("event_type = 'purchase'"), DAY)


@plan("obs_level_alert", "SELECT tenant_id, state, count(*) AS n FROM {jobs} WHERE state IN ('pending', 'resuming', 'waiting_upstream') GROUP BY ALL HAVING count(*) > 10")
def _(t):
    return o.level_alert(t["jobs"].where("state IN ('pending', 'resuming', 'waiting_upstream')"), ["tenant_id", "state"], 10)


@plan("obs_sli", f"SELECT user_id, round(count(*) FILTER (NOT {ERROR}) * 1.0 / count(*), 9) AS availability, round(count(*) FILTER (value <= 100) * 1.0 / count(*), 9) AS fast FROM events GROUP BY user_id".replace("NOT event_type = 'error'", "event_type <> 'error'"))
def _(t):
    n = F.count(F.lit(1))
    good, fast = F.count_if(F.col("event_type") != "error"), F.count_if(F.col("value") <= 100)
    return t["events"].groupBy("user_id").agg(F.round(o.sli(good, n), 9).alias("availability"), F.round(o.sli(fast, n), 9).alias("fast"))


BURN = f"SELECT user_id % 10 AS service, {b(HOUR)} AS bucket, count(*) AS n, count(*) FILTER ({ERROR}) AS bad FROM events GROUP BY 1, 2"


def burn_sql(window: int) -> str:
    return f"(sum(bad) {frame('service', window - HOUR)} * 1.0 / sum(n) {frame('service', window - HOUR)}) / 0.1"


@plan("obs_burn_rate", f"SELECT service, bucket, round(s, 6) AS short_burn, round(l, 6) AS long_burn FROM (SELECT service, bucket, {burn_sql(2 * HOUR)} AS s, {burn_sql(12 * HOUR)} AS l FROM ({BURN})) WHERE s > 2.001 AND l > 2.001")
def _(t):
    events = t["events"].withColumn("service", F.col("user_id") % 10)
    out = o.burn_rate(events, "ts", ["service"], F.expr(ERROR), 0.9, 2 * HOUR, 12 * HOUR, 2.001, HOUR)
    return out.select("service", "bucket", F.round("short_burn", 6).alias("short_burn"), F.round("long_burn", 6).alias("long_burn"))


LEFT = f"SELECT user_id, 1 - (count(*) FILTER ({ERROR}) * 1.0 / count(*)) / 0.3 AS l FROM events GROUP BY user_id"


@plan("obs_error_budget", f"SELECT user_id, round(l, 6) AS budget_left FROM ({LEFT})")
def _(t):
    return o.error_budget(t["events"], ["user_id"], F.expr(ERROR), 0.7).withColumn("budget_left", F.round("budget_left", 6))


@plan("obs_budget_forecast", f"SELECT user_id, round(CASE WHEN 1 - l > 0 THEN l / ((1 - l) / 720) * 3600 END, 1) AS seconds_left FROM ({LEFT})")
def _(t):
    left = F.col("budget_left")
    rows = o.error_budget(t["events"], ["user_id"], F.expr(ERROR), 0.7)
    return rows.select("user_id", F.round(o.budget_forecast(left, 1 - left), 1).alias("seconds_left"))


@plan("obs_budget_status", f"SELECT user_id, CASE WHEN l <= 0 THEN 'exhausted' WHEN l <= 0.2501 THEN 'at_risk' WHEN l <= 0.5001 THEN 'caution' ELSE 'healthy' END AS status FROM (SELECT user_id, l - 0.0001234 AS l FROM ({LEFT}))".replace("0.2501", "0.25").replace("0.5001", "0.5"))
def _(t):
    rows = o.error_budget(t["events"], ["user_id"], F.expr(ERROR), 0.7)
    return rows.select("user_id", o.budget_status(F.col("budget_left") - 0.0001234).alias("status"))


JOBS = "SELECT *, created_at + INTERVAL 700 DAYS AS deadline, heartbeat_at + INTERVAL 30 DAYS AS finish_at FROM {jobs} WHERE state IN ('pending', 'running', 'resuming', 'waiting_upstream', 'paused')"


@plan("obs_sla_status", f"SELECT tenant_id, count(*) AS active, count(*) FILTER (TIMESTAMP '1998-06-01' > deadline) AS breached, count(*) FILTER (TIMESTAMP '1998-06-01' <= deadline AND finish_at > deadline) AS at_risk FROM ({JOBS}) GROUP BY tenant_id")
def _(t):
    return o.sla_status(t.sql(JOBS), "1998-06-01")


@plan("obs_stale_jobs", "SELECT job_id, heartbeat_at FROM {jobs} WHERE state = 'running' AND heartbeat_at < TIMESTAMP '2001-06-30 23:58:00'")
def _(t):
    return o.stale_jobs(t["jobs"], "2001-07-01 00:00:00", 120).select("job_id", "heartbeat_at")


@plan("obs_rate_limit_audit", f"SELECT user_id, {b(HOUR)} AS bucket, count(*) AS n, count(*) - 2 AS rejected FROM events GROUP BY 1, 2 HAVING count(*) > 2")
def _(t):
    return o.rate_limit_audit(t["events"], "ts", "user_id", HOUR, 2)


@plan("obs_retry_stats", 'SELECT job_id, CAST(sum(attempt_count) AS BIGINT) AS attempts, count(*) FILTER (attempt_count > 1) AS retried, count(*) FILTER (attempt_count = 0) AS "new", max(attempt_count) AS most FROM {parts} GROUP BY job_id')
def _(t):
    return o.retry_stats(t["parts"], ["job_id"])


@plan("obs_long_running", "SELECT o_orderdate, o_orderkey, date_diff('minute', o_orderdate, TIMESTAMP '1995-03-01 10:30:00') AS minutes FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1995-03-01 10:00:00' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def _(t):
    return o.long_running(t["orders"].where("o_orderstatus = 'P'").select("o_orderdate", "o_orderkey"), "o_orderdate", "1995-03-01 10:30:00", 1800)


@plan(
    "dq_pass_rate",
    f"""SELECT check_id, bucket, round(sum(good) {frame('check_id', 6 * DAY)} * 1.0 / sum(n) {frame('check_id', 6 * DAY)}, 9) AS rate FROM (SELECT check_id, {b(DAY, 'executed_at')} AS bucket, count(*) FILTER (outcome = 'passed') AS good, count(*) AS n FROM {{results}} WHERE outcome <> 'skipped' GROUP BY 1, 2)""",
)
def _(t):
    return o.pass_rate(t["results"], "executed_at", ["check_id"], 7 * DAY, DAY).withColumn("rate", F.round("rate", 9))


@plan("obs_rolling_quantiles")
def _(t):
    """Rolling medians and 95th percentiles of one scan; approximate, so a test compares their ranks with the events."""
    sketches = o.bucket_sketches(t["events"], "ts", "value", ["event_type"], HOUR)
    return o.rolling_quantiles(sketches, ["event_type"], [HOUR, 6 * HOUR, DAY], HOUR, [0.5, 0.95])


GROWTH = f"""SELECT event_type, {b(HOUR)} AS bucket, CASE WHEN p IS NULL THEN 0 WHEN value >= p THEN value - p ELSE value END AS step FROM (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM (SELECT event_type, ts, min(event_id) AS event_id, max(value) AS value FROM events GROUP BY 1, 2))"""


@plan("obs_increase_windowed", f"SELECT event_type, bucket, round(sum(step) OVER (PARTITION BY event_type ORDER BY bucket RANGE BETWEEN 18000 PRECEDING AND 0 PRECEDING), 4) AS increase FROM (SELECT event_type, bucket, sum(step) AS step FROM ({GROWTH}) GROUP BY 1, 2)")
def _(t):
    samples = t["events"].groupBy("event_type", "ts").agg(F.max("value").alias("value"))
    return o.windowed_increase(samples, ["event_type"], "ts", "value", 6 * HOUR, HOUR).withColumn("increase", F.round("increase", 4))
