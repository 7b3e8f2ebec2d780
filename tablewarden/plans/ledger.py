"""Queries of run ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.operators import ledger as l
from tablewarden.operators import quality as q
from tablewarden.plans.base import Plans, Tables

plan = Plans()
QUERIES, ORACLES = plan.queries, plan.oracles
ACTIVE = ", ".join(f"'{s}'" for s in l.ACTIVE)


@plan("flt_tenant_scope", "SELECT job_id, tenant_id FROM {jobs} WHERE tenant_id IS NULL OR tenant_id = 3")
def _(t):
    return l.tenant_scope(t["jobs"], 3).select("job_id", "tenant_id")


@plan("flt_newest", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 20")
def _(t):
    return l.newest(t["orders"], "o_orderdate", "o_orderkey", 100, 20).select("o_orderkey", "o_orderdate")


def keyed_jobs(t: Tables):
    keys = t["parts"].groupBy("job_id").agg(F.collect_set(F.substring("partition_key", 1, 7)).alias("partition_keys"))
    return t["jobs"].join(keys, "job_id")


@plan("flt_active_for_key", f"SELECT job_id FROM {{jobs}} j WHERE asset_id = 7 AND state IN ({ACTIVE}) AND EXISTS (SELECT 1 FROM {{parts}} p WHERE p.job_id = j.job_id AND substr(partition_key, 1, 7) = '1997-03')")
def _(t):
    return l.active_jobs_for(keyed_jobs(t), 7, "1997-03").select("job_id")


@plan("flt_enabled_checks", "SELECT check_id, name, created_at FROM {checks} WHERE enabled")
def _(t):
    return l.enabled_checks(t["checks"]).select("check_id", "name", "created_at")


@plan("flt_failed_partitions", "SELECT part_id, partition_key FROM {parts} WHERE job_id = 14 AND state = 'failed'")
def _(t):
    return l.failed_partitions(t["parts"], 14).select("part_id", "partition_key")


@plan("join_workflow_assets", "SELECT s_suppkey AS workflow_id, node AS asset_id, position, name FROM (SELECT l_suppkey AS s_suppkey, l_partkey, min(l_orderkey) AS position FROM lineitem GROUP BY 1, 2) JOIN {nodes} ON node = l_partkey")
def _(t):
    membership = t["lineitem"].groupBy(F.col("l_suppkey").alias("workflow_id"), F.col("l_partkey").alias("asset_id")).agg(F.min("l_orderkey").alias("position"))
    return l.workflow_assets(membership, t["nodes"].select(F.col("node").alias("asset_id"), "name")).select("workflow_id", "asset_id", "position", "name")


@plan("join_completed_semi", "SELECT DISTINCT job_id % 50 AS asset_id, partition_key FROM {parts} p WHERE state = 'pending' AND EXISTS (SELECT 1 FROM {parts} d WHERE d.state = 'completed' AND d.job_id % 50 = p.job_id % 50 AND d.partition_key = p.partition_key)")
def _(t):
    parts = t["parts"].withColumn("asset_id", F.col("job_id") % 50)
    return l.completed_partitions(parts.where("state = 'pending'").select("asset_id", "partition_key").distinct(), parts, ["asset_id", "partition_key"])


@plan("join_enrich_default", "SELECT o_orderkey, coalesce(c_name, 'Unknown') AS c_name, coalesce(c_mktsegment, 'unknown') AS c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey")
def _(t):
    facts = t["orders"].withColumnRenamed("o_custkey", "c_custkey")
    return l.enrich_with_default(facts, t["customer"].where("c_custkey % 7 <> 0"), "c_custkey", {"c_name": "Unknown", "c_mktsegment": "unknown"}).select("o_orderkey", "c_name", "c_mktsegment")


@plan(
    "join_backfill_overlap",
    f"""WITH k AS (SELECT DISTINCT j.asset_id, j.job_id, substr(partition_key, 1, 7) AS key FROM {{jobs}} j JOIN {{parts}} p ON p.job_id = j.job_id WHERE j.state IN ({ACTIVE}))
    SELECT x.asset_id, x.job_id AS a, y.job_id AS b, count(*) AS n_keys FROM k x JOIN k y ON x.asset_id = y.asset_id AND x.key = y.key AND x.job_id < y.job_id GROUP BY ALL""",
)
def _(t):
    return l.overlapping_backfills(keyed_jobs(t))


@plan("join_label_results", "SELECT result_id, coalesce(name, check_id) AS label FROM {results} LEFT JOIN {checks} USING (check_id)")
def _(t):
    return l.label_results(t["results"], t["checks"]).select("result_id", "label")


@plan("join_duplicate_names", "SELECT p_partkey FROM part WHERE (p_name, p_brand) IN (SELECT (p_name, p_brand) FROM part GROUP BY p_name, p_brand HAVING count(*) > 1)")
def _(t):
    return l.duplicate_names(t["part"], ["p_name", "p_brand"]).select("p_partkey")


@plan("join_recent_failures", "SELECT result_id, name FROM {results} JOIN {checks} USING (check_id) WHERE outcome = 'failed' AND executed_at > TIMESTAMP '2024-01-19 12:00:00' AND executed_at <= TIMESTAMP '2024-01-20 12:00:00' ORDER BY executed_at DESC, result_id DESC LIMIT 25")
def _(t):
    return l.recent_failures(t["results"], t["checks"], "2024-01-20 12:00:00", 86400, 25).select("result_id", "name")


@plan("join_runs_stopped", "SELECT run_id FROM {runs} WHERE state = 'failed' AND run_id IN (SELECT result_id FROM {results} WHERE blocking AND outcome IN ('failed', 'error') AND severity = 'error')")
def _(t):
    return l.runs_stopped_by_checks(t["runs"], q.blocking_failures(t["results"])).select("run_id")


@plan("agg_count_by_tenant", "SELECT tenant_id, count(*) AS n FROM {jobs} GROUP BY tenant_id")
def _(t):
    return l.count_by(t["jobs"], "tenant_id")


STATES = ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("completed", "failed", "running", "pending"))


@plan("agg_upstream_summary", f"SELECT parent_id, count(*) AS total, {STATES} FROM {{jobs}} GROUP BY parent_id")
def _(t):
    return l.upstream_summary(t["jobs"])


@plan("agg_upstream_complete", "SELECT job_id, coalesce((SELECT bool_and(k.state IN ('completed')) FROM {jobs} k WHERE k.parent_id = j.job_id), true) AS complete FROM {jobs} j")
def _(t):
    return l.upstream_complete(t["jobs"], t["jobs"])


@plan("agg_failed_children", "SELECT parent_id, count(*) FILTER (state = 'failed') AS failed_children FROM {jobs} GROUP BY parent_id")
def _(t):
    return l.failed_children(t["jobs"])


@plan("agg_outcome_summary", "SELECT execution_id, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("passed", "failed", "error", "skipped")) + " FROM {results} GROUP BY execution_id")
def _(t):
    return l.outcome_summary(t["results"], "execution_id")


@plan("agg_failure_rate", "SELECT result_id, round(CASE WHEN total_row_count = 0 THEN NULL ELSE failed_row_count * 100.0 / total_row_count END, 6) AS rate FROM {results}")
def _(t):
    return t["results"].select("result_id", F.round(l.failure_rate(F.col("failed_row_count"), F.col("total_row_count")), 6).alias("rate"))


PROGRESS = """SELECT job_id, count(*) AS total, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed,
    count(*) FILTER (state = 'pending') AS remaining FROM {parts} GROUP BY job_id"""


@plan("agg_job_progress", f"SELECT *, round((completed + failed) * 1.0 / total, 9) AS ratio, CASE WHEN remaining > 0 THEN 'running' WHEN failed > 0 AND completed = 0 THEN 'failed' ELSE 'completed' END AS final_state FROM ({PROGRESS})")
def _(t):
    return l.job_progress(t["parts"]).select("job_id", "total", "completed", "failed", "remaining", F.round("ratio", 9).alias("ratio"), "final_state")


@plan("agg_run_metrics", "SELECT date_trunc('day', started_at)::TIMESTAMP AS bucket, count(*) AS total, count(*) FILTER (state = 'succeeded') AS succeeded, count(*) FILTER (state = 'failed') AS failed, round(avg(duration_s), 6) AS avg_duration_s FROM {runs} GROUP BY 1")
def _(t):
    return l.run_metrics(t["runs"], "day").withColumn("avg_duration_s", F.round("avg_duration_s", 6))


@plan("agg_job_latencies", "SELECT o_orderpriority, round(avg(date_diff('second', o_orderdate, f)), 3) AS avg_claim_s, max(date_diff('second', o_orderdate, f)) AS max_claim_s, round(avg(date_diff('second', f, e)), 3) AS avg_run_s FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS f, max(l_shipdate) AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    lines = t["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("claimed"), F.max("l_shipdate").alias("finished"))
    out = l.job_latencies(t["orders"].join(lines, "o_orderkey"), "o_orderdate", "claimed", "finished", ["o_orderpriority"])
    return out.select("o_orderpriority", F.round("avg_claim_s", 3).alias("avg_claim_s"), "max_claim_s", F.round("avg_run_s", 3).alias("avg_run_s"))


@plan(
    "agg_customer_order_summary",
    "SELECT o_custkey AS customer_id, coalesce(c_name, 'Unknown') AS customer_name, coalesce(c_mktsegment, 'unknown') AS segment, count(*) AS total_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) AS total_amount FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY ALL",
)
def _(t):
    orders = t.sql("SELECT o_custkey AS customer_id, CAST(o_totalprice AS DECIMAL(12, 2)) AS amount, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'open' END AS status FROM {orders}")
    customers = t.sql("SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment FROM {customer} WHERE c_custkey % 7 <> 0")
    q.validate(orders, [q.NotNull(columns=("customer_id", "amount")), q.RowCount(low=1)])
    return l.asset_summary(orders, customers).withColumn("total_amount", F.col("total_amount").cast("double"))


@plan("agg_active_jobs", f"SELECT tenant_id, state, count(*) AS n FROM {{jobs}} WHERE state IN ({ACTIVE}) GROUP BY ALL")
def _(t):
    return l.count_by(t["jobs"].where(F.col("state").isin(*l.ACTIVE)), "tenant_id", "state")


@plan("agg_tree_progress", "SELECT j.job_id, count(k.job_id) AS children, count(*) FILTER (k.state = 'completed') AS completed, CASE WHEN count(k.job_id) > 0 THEN count(*) FILTER (k.state = 'completed') * 100 // count(k.job_id) ELSE 0 END AS percent FROM {jobs} j LEFT JOIN {jobs} k ON k.parent_id = j.job_id GROUP BY j.job_id")
def _(t):
    return l.tree_progress(t["jobs"])


@plan("agg_error_groups", "SELECT error_message, attempt_count, count(*) AS n FROM {parts} WHERE state = 'failed' GROUP BY ALL ORDER BY n DESC, error_message, attempt_count LIMIT 10")
def _(t):
    return l.error_groups(t["parts"])


EWMA = """WITH RECURSIVE x AS (SELECT tenant_id, duration_s AS v, row_number() OVER (PARTITION BY tenant_id ORDER BY started_at, run_id) AS i FROM {runs}),
    e AS (SELECT tenant_id, i, v AS e FROM x WHERE i = 1 UNION ALL SELECT x.tenant_id, x.i, 0.3 * x.v + 0.7 * e.e FROM e JOIN x ON x.tenant_id = e.tenant_id AND x.i = e.i + 1)"""


@plan("win_ewma", f"{EWMA} SELECT tenant_id, round(arg_max(e, i), 6) AS ewma, max(i) AS n FROM e GROUP BY tenant_id")
def _(t):
    return l.ewma(t["runs"], "tenant_id", ["started_at", "run_id"], "duration_s", 0.3, chunk=16).select("tenant_id", F.round("ewma", 6).alias("ewma"), "n")


@plan("win_ewma_resumed", f"{EWMA} SELECT tenant_id, round(arg_max(e, i), 6) AS ewma, max(i) AS n FROM e GROUP BY tenant_id")
def _(t):
    """The runs of the first days, then those of the other days on top of the stored averages."""
    order, split = ["started_at", "run_id"], F.col("started_at") < F.lit("2024-01-18").cast("timestamp_ntz")
    before = l.ewma(t["runs"].where(split), "tenant_id", order, "duration_s", 0.3)
    return l.ewma(t["runs"].where(~split), "tenant_id", order, "duration_s", 0.3, initial=before).select("tenant_id", F.round("ewma", 6).alias("ewma"), "n")


@plan(
    "win_eta",
    f"""WITH RECURSIVE x AS (SELECT job_id, duration_ms AS v, row_number() OVER (PARTITION BY job_id ORDER BY updated_at, part_id) AS i FROM {{parts}} WHERE state = 'completed'),
    e AS (SELECT job_id, i, v AS e FROM x WHERE i = 1 UNION ALL SELECT x.job_id, x.i, 0.5 * x.v + 0.5 * e.e FROM e JOIN x ON x.job_id = e.job_id AND x.i = e.i + 1),
    a AS (SELECT job_id, arg_max(e, i) AS ewma, max(i) AS n FROM e GROUP BY job_id)
    SELECT p.job_id, remaining, CAST(floor(remaining * ewma / 1000 + 0.1371) AS BIGINT) AS seconds_left, coalesce(n, 0) >= 3 AS reliable, round(60000 / ewma, 9) AS per_minute FROM ({PROGRESS}) p LEFT JOIN a USING (job_id)""",
)
def _(t):
    averages = l.ewma(t["parts"].where("state = 'completed'"), "job_id", ["updated_at", "part_id"], "duration_ms", 0.5)
    out = l.eta(l.job_progress(t["parts"]), averages, "2001-08-02 00:00:00")
    return out.select("job_id", "remaining", F.floor(F.col("seconds_left") + 0.1371).alias("seconds_left"), "reliable", (F.round(F.col("per_minute") * 1e9) / 1e9).alias("per_minute"))


AS_OF = "2001-07-01 00:00:00"


@plan(
    "win_backlog_rank",
    f"""SELECT tenant_id, job_id, row_number() OVER (PARTITION BY tenant_id ORDER BY c, priority DESC, execution_order, created_at, job_id) AS rank FROM (SELECT *, CASE WHEN state = 'pending' THEN 0 WHEN state = 'resuming' THEN 1 WHEN state = 'running' AND heartbeat_at < TIMESTAMP '{AS_OF}' - INTERVAL 120 SECOND THEN 2 END AS c FROM {{jobs}}) WHERE c IS NOT NULL""",
)
def _(t):
    return l.backlog_rank(t["jobs"], AS_OF, by="tenant_id").select("tenant_id", "job_id", "rank")


@plan("win_partition_backlog", "SELECT part_id, row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN state = 'pending' THEN 0 ELSE 1 END, partition_key, part_id) AS position FROM {parts} WHERE state = 'pending' OR (state = 'failed' AND attempt_count < 3)")
def _(t):
    return l.partition_backlog(t["parts"]).select("part_id", "position")


@plan("win_latest_partition", "SELECT job_id % 50 AS asset_id, partition_key, arg_max(part_id, part_id) AS part_id FROM {parts} GROUP BY 1, 2")
def _(t):
    parts = t["parts"].withColumn("asset_id", F.col("job_id") % 50)
    return l.latest_per(parts, ["asset_id", "partition_key"], [F.desc("updated_at"), F.desc("part_id")]).select("asset_id", "partition_key", "part_id")


@plan("win_checkpoint", "SELECT job_id, partition_key AS checkpoint_key FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, part_id DESC) AS r FROM {parts} WHERE state = 'completed') WHERE r = 1")
def _(t):
    return l.checkpoint(t["parts"])


RECENT = "SELECT result_id, check_id, asset_id, row_number() OVER (PARTITION BY check_id, asset_id ORDER BY executed_at DESC, result_id DESC) AS r FROM {results}"


@plan("win_recent_results", f"SELECT result_id FROM ({RECENT}) WHERE r <= 3")
def _(t):
    return l.latest_per(t["results"], ["check_id", "asset_id"], [F.desc("executed_at"), F.desc("result_id")], 3).select("result_id")


@plan(
    "dq_check_history",
    "SELECT name, result_id, outcome, round(CASE WHEN total_row_count = 0 THEN NULL ELSE failed_row_count * 100.0 / total_row_count END, 6) AS percent FROM (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY executed_at DESC, result_id DESC) AS r FROM {results}) JOIN {checks} USING (check_id) WHERE r <= 10",
)
def _(t):
    last = l.latest_per(t["results"], ["check_id"], [F.desc("executed_at"), F.desc("result_id")], 10)
    rate = F.round(l.failure_rate(F.col("failed_row_count"), F.col("total_row_count")), 6)
    return last.join(t["checks"], "check_id").select("name", "result_id", "outcome", rate.alias("percent"))


MOVES = "SELECT event_id, job_id, state, ts, lag(state) OVER w AS from_state FROM {transitions} WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)"
# Written out, so that a mistake in the operator's lists shows.
RUN_LEGAL = "('pending', 'running'), ('running', 'succeeded'), ('running', 'failed'), ('running', 'cancelled'), ('running', 'timeout')"
BACKFILL_LEGAL = """('pending', 'running'), ('pending', 'waiting_upstream'), ('pending', 'cancelled'), ('waiting_upstream', 'pending'),
    ('waiting_upstream', 'failed'), ('waiting_upstream', 'cancelled'), ('running', 'waiting_upstream'), ('running', 'completed'), ('running', 'failed'),
    ('running', 'cancelled'), ('running', 'paused'), ('paused', 'resuming'), ('paused', 'cancelled'), ('resuming', 'running'), ('resuming', 'cancelled')"""


@plan("win_invalid_transitions", f"SELECT event_id, from_state, state FROM ({MOVES}) WHERE from_state IS NOT NULL AND (from_state, state) NOT IN ({RUN_LEGAL})")
def _(t):
    return l.invalid_transitions(t["transitions"], "job_id", ["ts", "event_id"]).select("event_id", "from_state", "state")


@plan("win_invalid_backfill_moves", f"SELECT event_id, from_state, state FROM ({MOVES.replace('transitions', 'backfill_log')}) WHERE from_state IS NOT NULL AND (from_state, state) NOT IN ({BACKFILL_LEGAL})")
def _(t):
    return l.invalid_transitions(t["backfill_log"], "job_id", ["ts", "event_id"], l.BACKFILL_MOVES).select("event_id", "from_state", "state")


@plan("win_transition_counts", f"SELECT from_state, state, count(*) AS n FROM ({MOVES}) WHERE from_state IS NOT NULL GROUP BY ALL")
def _(t):
    return l.transition_counts(t["transitions"], "job_id", ["ts", "event_id"])


@plan("win_pause_durations", "SELECT job_id, ts, datesub('second', ts, nt) AS seconds FROM (SELECT *, lead(state) OVER w AS ns, lead(ts) OVER w AS nt FROM {transitions} WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)) WHERE state = 'paused' AND ns = 'running'")
def _(t):
    return l.state_durations(t["transitions"], "job_id", ["ts", "event_id"], "paused", "running")


@plan("topk_partition_listing", "SELECT partition_key, max(part_id) AS part_id, (SELECT count(DISTINCT partition_key) FROM {parts}) AS total FROM {parts} GROUP BY partition_key ORDER BY partition_key LIMIT 50")
def _(t):
    return l.partition_listing(t["parts"]).select("partition_key", "part_id", "total")


@plan(
    "lin_cancel_impact",
    f"""SELECT job_id, 'cancelled' AS new_state, (SELECT count(*) FROM {{parts}} p WHERE p.job_id = j.job_id AND p.state = 'pending') AS skipped FROM {{jobs}} j
    WHERE state IN ({ACTIVE}) AND (job_id IN (3, 12, 60) OR parent_id IN (3, 12, 60))""",
)
def _(t):
    return l.cancel_impact(t["jobs"], t["parts"], t["jobs"].where("job_id IN (3, 12, 60)"))


@plan("lin_releasable_parents", "SELECT job_id FROM {jobs} j WHERE state = 'waiting_upstream' AND coalesce((SELECT bool_and(k.state = 'completed') FROM {jobs} k WHERE k.parent_id = j.job_id), true)")
def _(t):
    return l.releasable_parents(t["jobs"])
