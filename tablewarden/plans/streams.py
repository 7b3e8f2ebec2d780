"""Queries that run a stream over the events table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.operators import quality as q
from tablewarden.plans.base import Plans
from tablewarden.plans.ledger import RUN_LEGAL
from tablewarden.session import scratch_path
from tablewarden.streaming import jobs as s

plan = Plans()
QUERIES, ORACLES = plan.queries, plan.oracles

MARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def naive(*columns):
    return [F.col(c).cast("timestamp_ntz").alias(c) for c in columns]


@plan("str_tumbling", f"SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {MARK}")
def _(t):
    out = s.run_available(s.windowed_counts(s.event_stream(t.spark, t["events"]), "ts", ["event_type"], "1 hour"))
    return out.select("event_type", *naive("start"), "n")


@plan(
    "str_sliding",
    f"""SELECT event_type, w AS start, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * i AS w FROM events, generate_series(0, 2) AS g(i)) GROUP BY 1, 2 HAVING w + INTERVAL 3 HOUR <= {MARK}""",
)
def _(t):
    out = s.run_available(s.windowed_counts(s.event_stream(t.spark, t["events"]), "ts", ["event_type"], "3 hours", "1 hour"))
    return out.select("event_type", *naive("start"), "n")


@plan(
    "str_sessions",
    f"""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
    GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= {MARK}""",
)
def _(t):
    out = s.run_available(s.sessions(s.event_stream(t.spark, t["events"]), "ts", "user_id", "6 hours"))
    return out.select("user_id", *naive("start", "end"), "n")


@plan("str_dedupe", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events) GROUP BY ALL")
def _(t):
    keyed = t["events"].withColumn("d", F.to_date("ts"))
    out = s.run_available(s.dedupe(s.event_stream(t.spark, keyed), "ts", ["user_id", "event_type", "d"]))
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


HOURS = f"SELECT CAST(floor(epoch_us(ts) / 3600000000) * 3600 AS BIGINT) AS bucket, count(*) FILTER (event_type = 'error') AS bad, count(*) AS n FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= {MARK}"


@plan("str_burn_rate", f"SELECT bucket, round(burn, 6) AS burn FROM (SELECT bucket, (sum(bad) OVER w * 1.0 / sum(n) OVER w) / 0.1 AS burn FROM ({HOURS}) WINDOW w AS (ORDER BY bucket RANGE BETWEEN 18000 PRECEDING AND 0 PRECEDING)) WHERE burn > 2.0001")
def _(t):
    """Each batch of closed windows is compared with the windows before it, and writes its alerts."""
    path = scratch_path(t.spark, "burn")
    marked = t["events"].withColumn("bad", F.col("event_type") == "error")
    counts = s.windowed_counts(s.event_stream(t.spark, marked, files=4), "ts", ["bad"], "1 hour")
    s.run_available(counts, each=s.burn_batches(path, 6 * 3600, 3600, 0.1, 2.0001))
    return t.spark.read.schema("bucket long, burn double").parquet(f"{path}/alerts/*").select("bucket", F.round("burn", 6).alias("burn"))


@plan(
    "str_absence",
    f"""SELECT user_id, epoch_us(ts) // 1000 AS last_ms, epoch_us(ts) // 1000 + 43200000 AS fired_ms FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events)
    WHERE after > ts + INTERVAL 12 HOUR OR (after IS NULL AND ts + INTERVAL 12 HOUR < {MARK})""",
)
def _(t):
    return s.run_available(s.silence(s.event_stream(t.spark, t["events"], files=4), "user_id", 12 * 3600))


@plan("str_stuck", f"SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) FILTER (event_type = 'view') AS busy FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= {MARK} AND count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'purchase') = 0")
def _(t):
    out = s.run_available(s.stuck(s.event_stream(t.spark, t["events"], files=3), "ts", "user_id", F.col("event_type") == "view", F.col("event_type") == "purchase", "1 day"))
    return out.select("user_id", *naive("start"), "busy")


@plan(
    "str_ewma",
    """WITH RECURSIVE x AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    e AS (SELECT user_id, i, v AS e FROM x WHERE i = 1 UNION ALL SELECT x.user_id, x.i, 0.3 * x.v + 0.7 * e.e FROM e JOIN x ON x.user_id = e.user_id AND x.i = e.i + 1)
    SELECT user_id, round(arg_max(e, i), 6) AS ewma, max(i) AS n FROM e GROUP BY user_id""",
)
def _(t):
    path, rows = scratch_path(t.spark, "averages"), t["events"].select("user_id", "ts", "event_id", "value")
    s.run_available(s.event_stream(t.spark, rows), each=s.ewma_batches(path, "user_id"))
    return s.newest_averages(t.spark, path, rows.schema["user_id"]).select("user_id", F.round("ewma", 6).alias("ewma"), "n")


@plan(
    "str_eta",
    """WITH RECURSIVE x AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    e AS (SELECT user_id, i, v AS e FROM x WHERE i = 1 UNION ALL SELECT x.user_id, x.i, 0.3 * x.v + 0.7 * e.e FROM e JOIN x ON x.user_id = e.user_id AND x.i = e.i + 1),
    a AS (SELECT user_id, arg_max(e, i) AS m, max(i) AS n FROM e GROUP BY user_id)
    SELECT user_id, n, greatest(user_id % 40 + 60 - n, 0) AS remaining, round(greatest(user_id % 40 + 60 - n, 0) * m / 1000, 6) AS seconds_left, n >= 3 AS reliable, round(60000 / m, 6) AS per_minute FROM a""",
)
def _(t):
    planned = t["events"].select("user_id").distinct().withColumn("total", F.col("user_id") % 40 + 60)
    stream = s.event_stream(t.spark, t["events"], files=3).select("user_id", "ts", "event_id", "value")
    last = s.run_available(s.running_eta(stream, "user_id", planned)).groupBy("user_id").agg(F.max_by(F.struct("n", "remaining", "seconds_left", "reliable", "per_minute"), "n").alias("r"))
    return last.select("user_id", "r.n", "r.remaining", F.round("r.seconds_left", 6).alias("seconds_left"), "r.reliable", F.round("r.per_minute", 6).alias("per_minute"))


@plan("str_quality")
def _(t):
    base = scratch_path(t.spark, "checked")
    checks = [q.InRange(name="value", column="value", low=0.5), q.Accepted(name="type", column="event_type", values=("view", "click", "purchase", "signup"))]
    stream = s.event_stream(t.spark, t["events"], files=3)
    s.run_available(stream, each=s.checked_batches(checks, f"{base}/results", f"{base}/rows"))
    schema = q.RESULT + ", batch int"
    results = t.spark.read.schema(schema).parquet(f"{base}/results/*")
    return results.groupBy("check").agg(F.sum("failed_count").alias("failed_count"), F.sum("total_count").alias("total_count"))


ORACLES["str_quality"] = "SELECT 'value' AS \"check\", CAST(count(*) FILTER (value < 0.5) AS BIGINT) AS failed_count, count(*) AS total_count FROM events UNION ALL SELECT 'type', CAST(count(*) FILTER (event_type = 'error') AS BIGINT), count(*) FROM events"


@plan(
    "str_state_machine",
    f"""SELECT job_id, event_id, from_state, state FROM (SELECT *, lag(state) OVER w AS from_state, lag(ts) OVER w AS since FROM {{transitions}} WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))
    WHERE from_state IS NOT NULL AND (from_state, state) NOT IN ({RUN_LEGAL}) AND ts <= since + CASE WHEN from_state IN ('succeeded', 'failed', 'cancelled', 'timeout') THEN INTERVAL 1 DAY ELSE INTERVAL 30 DAY END""",
)
def _(t):
    return s.run_available(s.forbidden_moves(s.event_stream(t.spark, t["transitions"], files=3), "job_id"))


@plan("str_freshness", f"SELECT user_id, date_trunc('millisecond', max(ts)) AS newest, max(ts) + INTERVAL 6 HOUR >= {MARK} AS fresh FROM events GROUP BY user_id")
def _(t):
    changes = s.run_available(s.freshness(s.event_stream(t.spark, t["events"], files=3), "user_id", 6 * 3600))
    out = s.freshest(changes, "user_id")
    return out.select("user_id", F.timestamp_millis("newest_ms").cast("timestamp_ntz").alias("newest"), "fresh")


MARK2 = "(SELECT least(max(ts) FILTER (event_type = 'view'), max(ts) FILTER (event_type = 'purchase')) - INTERVAL 10 MINUTE FROM events)"


@plan(
    "str_stale_claim",
    f"""SELECT user_id, event_id AS claim_id, ts AS claimed_at FROM events c WHERE event_type = 'view' AND ts + INTERVAL 6 HOUR < {MARK2}
    AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'purchase' AND d.user_id = c.user_id AND d.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOUR)""",
)
def _(t):
    claims = s.event_stream(t.spark, t["events"].where("event_type = 'view'").select("user_id", F.col("event_id").alias("claim_id"), "ts")).withColumnRenamed("ts", "claimed_at")
    done = s.event_stream(t.spark, t["events"].where("event_type = 'purchase'").select("user_id", "ts")).withColumnRenamed("ts", "done_at")
    out = s.run_available(s.stale_claims(claims, done, "user_id", 6 * 3600))
    return out.select("user_id", "claim_id", *naive("claimed_at"))
