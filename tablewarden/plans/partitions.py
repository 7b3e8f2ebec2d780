"""Queries of partition keys, calendars, mappings and of partitioned sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.functions import keys as k
from tablewarden.operators import intervals as iv
from tablewarden.operators import partitions as p
from tablewarden.plans.base import Plans, Tables
from tablewarden.session import scratch_path
from tablewarden.sources import tables as src

plan = Plans()
QUERIES, ORACLES = plan.queries, plan.oracles

DAY, MONTH, WEEK, HOUR = "'%Y-%m-%d'", "'%Y-%m'", "'%G-W%V'", "'%Y-%m-%d %H:00:00'"


@plan("fn_partition_key", f"SELECT DISTINCT strftime(ts, {HOUR}) AS hourly, strftime(ts, {DAY}) AS daily, strftime(ts, {WEEK}) AS weekly, strftime(ts, {MONTH}) AS monthly, strftime(ts, '%Y') AS yearly FROM (SELECT ts FROM events UNION ALL SELECT o_orderdate FROM orders)")
def _(t):
    times = t["events"].select("ts").unionByName(t["orders"].select(F.col("o_orderdate").alias("ts")))
    return times.select(*[k.partition_key(F.col("ts"), g).alias(g) for g in k.GRAINS]).distinct()


@plan(
    "fn_partition_bounds",
    f"""SELECT strftime(d, {WEEK}) AS week, strftime(min(date_trunc('week', d)), {DAY}) AS week_start, strftime(min(date_trunc('week', d)) + INTERVAL 7 DAY, {DAY}) AS week_end,
    strftime(d, {MONTH}) AS month, strftime(min(date_trunc('month', d)) + INTERVAL 1 MONTH, {DAY}) AS month_end FROM (SELECT DISTINCT o_orderdate AS d FROM orders) GROUP BY 1, 4""",
)
def _(t):
    rows = t["orders"].select(k.partition_key(F.col("o_orderdate"), "weekly").alias("week"), k.partition_key(F.col("o_orderdate"), "monthly").alias("month")).distinct()
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.select(
        "week",
        text(k.key_start(F.col("week"), "weekly")).alias("week_start"),
        text(k.key_end(F.col("week"), "weekly")).alias("week_end"),
        "month",
        text(k.key_end(F.col("month"), "monthly")).alias("month_end"),
    )


@plan(
    "fn_valid_key",
    """SELECT key, try_cast(key AS TIMESTAMP) IS NOT NULL AND regexp_matches(key, '^\\d{4}-\\d{2}-\\d{2}$') AS daily,
    regexp_matches(key, '^\\d{4}-\\d{2}$') AND try_cast(key || '-01' AS TIMESTAMP) IS NOT NULL AND key >= '1996' AND key < '1999-05' AS monthly
    FROM (SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%d-%m') END AS key FROM orders)""",
)
def _(t):
    mixed = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-dd-MM"))
    rows = t["orders"].select(mixed.alias("key")).distinct()
    return rows.select("key", k.valid_key(F.col("key"), "daily").alias("daily"), k.valid_key(F.col("key"), "monthly", "1996", "1999-05").alias("monthly"))


@plan("fn_multi_key", """SELECT DISTINCT '{"date":"' || strftime(o_orderdate, '%Y-%m') || '","status":"' || o_orderstatus || '"}' AS key FROM orders""".replace("{", "' || chr(123) || '", 1).replace('"}', "\"' || chr(125) || '"))
def _(t):
    return t["orders"].select(k.multi_key(status=F.col("o_orderstatus"), date=F.date_format("o_orderdate", "yyyy-MM")).alias("key")).distinct()


@plan("fn_dimension", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS date, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS region FROM orders")
def _(t):
    rows = t["orders"].select(k.multi_key(status=F.col("o_orderstatus"), date=F.date_format("o_orderdate", "yyyy-MM")).alias("key")).distinct()
    return rows.select(*[k.dimension(F.col("key"), n).alias(n) for n in ("date", "status", "region")])


def spine_sql(unit: str, fmt: str, table: str, column: str) -> str:
    """Keys from the first to the last time in the table."""
    ends = f"(SELECT date_trunc('{unit}', min({column})) AS a, max({column}) AS b FROM {table})"
    return f"SELECT strftime(unnest(generate_series(a, b, INTERVAL 1 {unit})), {fmt}) AS key FROM {ends}"


def ends_of(t: Tables, table: str, column: str) -> tuple[str, str]:
    """The first and the last time in a table: one row."""
    a, b = t[table].agg(F.min(column), F.max(column)).first()
    return str(a), str(b)


# Calendars are measured against the data: each key with its number of rows.
COUNTS = {"hourly": ("events", "ts", HOUR), "daily": ("orders", "o_orderdate", DAY), "weekly": ("orders", "o_orderdate", WEEK), "monthly": ("orders", "o_orderdate", MONTH), "yearly": ("orders", "o_orderdate", "'%Y'")}
UNITS = {"hourly": "HOUR", "daily": "DAY", "weekly": "WEEK", "monthly": "MONTH", "yearly": "YEAR"}


def add_spine(grain: str) -> None:
    table, column, fmt = COUNTS[grain]
    sql = f"SELECT key, count({column}) AS n FROM ({spine_sql(UNITS[grain], fmt, table, column)}) s LEFT JOIN {table} ON strftime({column}, {fmt}) = key GROUP BY key"

    @plan(f"part_spine_{grain}", sql)
    def _(t: Tables):
        rows = t[table].groupBy(k.partition_key(F.col(column), grain).alias("key")).agg(F.count(column).alias("n"))
        return p.spine(t.spark, grain, *ends_of(t, table, column)).join(rows, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


for _grain in k.GRAINS:
    add_spine(_grain)


@plan("part_dynamic_keys", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS key FROM orders")
def _(t):
    return p.dynamic_keys(t["orders"], k.partition_key(F.col("o_orderdate"), "monthly"))


def months(t: Tables):
    return p.dynamic_keys(t["orders"], k.partition_key(F.col("o_orderdate"), "monthly"))


def days(t: Tables):
    return p.dynamic_keys(t["orders"], k.partition_key(F.col("o_orderdate"), "daily"))


M = "(SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders)"
D = "(SELECT DISTINCT o_orderdate AS d FROM orders)"
BRACE = "chr(123) || '\"date\":\"' || strftime(m, '%Y-%m') || '\",\"status\":\"' || s || '\"' || chr(125)"


@plan("part_multi_spine", f"SELECT {BRACE} AS key FROM {M}, (SELECT DISTINCT o_orderstatus AS s FROM orders)")
def _(t):
    return p.multi_spine(status=p.dynamic_keys(t["orders"], F.col("o_orderstatus")), date=months(t))


@plan("part_range", "SELECT CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' WHEN o_totalprice < 450000 THEN 'high' END AS bucket, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    bounds = [("low", F.lit(0), F.lit(100_000)), ("mid", F.lit(100_000), F.lit(300_000)), ("high", F.lit(300_000), F.lit(450_000))]
    return t["orders"].groupBy(p.range_bucket(F.col("o_totalprice"), bounds).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@plan("part_custom_expr", "SELECT 'b' || CAST(user_id % 8 AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t["events"].groupBy(p.custom_key("concat('b', user_id % 8)").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@plan("part_map_identity", f"SELECT strftime(m, {MONTH}) AS downstream_key, strftime(m, {MONTH}) AS upstream_key FROM {M}")
def _(t):
    return p.map_identity(months(t))


@plan("part_map_offset", f"SELECT strftime(d, {DAY}) AS downstream_key, strftime(d - INTERVAL 3 DAY, {DAY}) AS upstream_key FROM {D}")
def _(t):
    return p.map_offset(days(t), -3, "daily")


def aggregate_sql(trunc: str, length: str, step: str, down: str, up: str, table: str = "orders", column: str = "o_orderdate") -> str:
    return f"SELECT strftime(s, {down}) AS downstream_key, strftime(unnest(generate_series(s, s + INTERVAL {length} - INTERVAL {step}, INTERVAL {step})), {up}) AS upstream_key FROM (SELECT DISTINCT date_trunc('{trunc}', {column}) AS s FROM {table})"


def add_aggregate(name: str, downstream: str, upstream: str, sql: str, table: str = "orders", column: str = "o_orderdate") -> None:
    @plan(f"part_map_aggregate_{name}", sql)
    def _(t: Tables):
        return p.map_aggregate(p.dynamic_keys(t[table], k.partition_key(F.col(column), downstream)), downstream, upstream)


add_aggregate("hd", "daily", "hourly", aggregate_sql("day", "1 DAY", "1 HOUR", DAY, HOUR, "events", "ts"), "events", "ts")
add_aggregate("dw", "weekly", "daily", aggregate_sql("week", "7 DAY", "1 DAY", WEEK, DAY))
add_aggregate("dm", "monthly", "daily", aggregate_sql("month", "1 MONTH", "1 DAY", MONTH, DAY))
add_aggregate("my", "yearly", "monthly", aggregate_sql("year", "1 YEAR", "1 MONTH", "'%Y'", MONTH))


@plan("part_map_window", f"SELECT strftime(d, {DAY}) AS downstream_key, strftime(d - INTERVAL 1 DAY * i, {DAY}) AS upstream_key FROM {D}, generate_series(0, 6) AS g(i)")
def _(t):
    return p.map_window(days(t), 7, "daily")


@plan("part_map_day_window", f"SELECT strftime(a.d, {DAY}) AS downstream_key, strftime(b.d, {DAY}) AS upstream_key FROM {D} a JOIN (SELECT DISTINCT o_orderdate AS d FROM orders WHERE o_orderkey % 7 = 0) b ON b.d BETWEEN a.d - INTERVAL 2 DAY AND a.d + INTERVAL 1 DAY")
def _(t):
    upstream = p.dynamic_keys(t["orders"].where("o_orderkey % 7 = 0"), k.partition_key(F.col("o_orderdate"), "daily"))
    return p.map_day_window(days(t), -2, 1, upstream)


@plan("part_map_all", f"SELECT strftime(a.m, {MONTH}) AS downstream_key, strftime(b.m, {MONTH}) AS upstream_key FROM {M} a, {M} b")
def _(t):
    return p.map_all(months(t), months(t))


@plan("part_map_dimensions", f"SELECT {BRACE} AS downstream_key, strftime(m, {MONTH}) AS upstream_key FROM {M}, (SELECT DISTINCT o_orderstatus AS s FROM orders)")
def _(t):
    return p.map_dimensions(p.multi_spine(status=p.dynamic_keys(t["orders"], F.col("o_orderstatus")), date=months(t)), {"day": "date"})


GRAIN = "CASE {0} % 6 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' WHEN 3 THEN 'monthly' WHEN 4 THEN 'yearly' END"


@plan(
    "part_infer_mapping",
    f"""WITH g AS (SELECT node, {GRAIN.format('node')} AS grain, CASE node % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 END AS i FROM {{nodes}})
    SELECT src, dst, CASE WHEN u.i IS NULL OR d.i IS NULL THEN 'all' WHEN u.i = d.i THEN 'identity' WHEN (u.i, d.i) IN ((0, 1), (1, 2), (1, 3), (3, 4)) THEN 'aggregate' END AS mapping,
    CASE WHEN u.i IS NULL OR d.i IS NULL OR u.i = d.i OR (u.i, d.i) IN ((0, 1), (1, 2), (1, 3), (3, 4)) THEN NULL WHEN u.i > d.i THEN u.grain || ' upstream is coarser than ' || d.grain ELSE u.grain || ' does not nest in ' || d.grain END AS reason
    FROM {{edges}} LEFT JOIN g u ON u.node = src LEFT JOIN g d ON d.node = dst""",
)
def _(t):
    return p.infer_mapping(t["edges"], t["nodes"].select("node", F.expr(GRAIN.format("node")).alias("grain")))


@plan(
    "part_resolve_range",
    f"""SELECT job_id, strftime(a, {MONTH}) AS start_key, strftime(b, {MONTH}) AS end_key, strftime(date_trunc('month', a), {DAY}) AS upstream_start, strftime(date_trunc('month', b) + INTERVAL 1 MONTH - INTERVAL 1 DAY, {DAY}) AS upstream_end
    FROM (SELECT o_custkey AS job_id, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)""",
)
def _(t):
    ranges = t["orders"].groupBy(F.col("o_custkey").alias("job_id")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    ranges = ranges.select("job_id", k.partition_key(F.col("a"), "monthly").alias("start_key"), k.partition_key(F.col("b"), "monthly").alias("end_key"))
    return p.resolve_range(ranges, "aggregate", "monthly", "daily")


@plan("part_mapped_rollup_weekly", f"SELECT strftime(o_orderdate, {WEEK}) AS downstream_key, count(*) AS n, sum(o_orderkey) AS keys FROM orders GROUP BY 1")
def _(t):
    mapping = p.map_aggregate(p.dynamic_keys(t["orders"], k.partition_key(F.col("o_orderdate"), "weekly")), "weekly", "daily")
    return p.mapped_rollup(t["orders"], k.partition_key(F.col("o_orderdate"), "daily"), mapping, {"n": F.lit(1), "keys": F.col("o_orderkey")})


@plan("part_mapped_rollup_window7", f"SELECT strftime(d, {DAY}) AS downstream_key, count(*) AS n, sum(o_orderkey) AS keys FROM {D} JOIN orders ON o_orderdate BETWEEN d - INTERVAL 6 DAY AND d GROUP BY 1")
def _(t):
    return p.mapped_rollup(t["orders"], k.partition_key(F.col("o_orderdate"), "daily"), p.map_window(days(t), 7, "daily"), {"n": F.lit(1), "keys": F.col("o_orderkey")})


def completed_days(t: Tables):
    return t["orders"].where("o_orderstatus = 'F'").select(k.partition_key(F.col("o_orderdate"), "daily").alias("key")).distinct()


DONE = "(SELECT DISTINCT o_orderdate AS u FROM orders WHERE o_orderstatus = 'F')"


@plan("set_missing_partitions", f"SELECT key FROM ({spine_sql('DAY', DAY, 'orders', 'o_orderdate')}) WHERE key NOT IN (SELECT strftime(o_orderdate, {DAY}) FROM orders WHERE o_orderstatus = 'P')")
def _(t):
    done = t["orders"].where("o_orderstatus = 'P'").select(k.partition_key(F.col("o_orderdate"), "daily").alias("key"))
    return p.missing_keys(p.spine(t.spark, "daily", *ends_of(t, "orders", "o_orderdate")), done)


PAIRS3 = f"(SELECT d, d - INTERVAL 1 DAY * i AS u FROM {D}, generate_series(0, 2) AS g(i))"


@plan("part_ready", f"SELECT strftime(d, {DAY}) AS key FROM {PAIRS3} GROUP BY d HAVING bool_and(u IN (SELECT u FROM {DONE}))")
def _(t):
    return p.ready_partitions(days(t), p.map_window(days(t), 3, "daily"), completed_days(t))


@plan("part_blocked_reasons", f"SELECT strftime(d, {DAY}) AS key, count(*) AS n_missing, string_agg(strftime(u, {DAY}), ',' ORDER BY u) AS missing FROM {PAIRS3} WHERE u NOT IN (SELECT u FROM {DONE}) GROUP BY d")
def _(t):
    return p.blocked_reasons(p.map_window(days(t), 3, "daily"), completed_days(t))


@plan(
    "part_status",
    f"""WITH own AS (SELECT strftime(o_orderdate, {MONTH}) AS key, max(o_orderkey) AS own_at FROM orders WHERE o_orderstatus = 'F' AND month(o_orderdate) <> 7 GROUP BY 1),
    up AS (SELECT strftime(o_orderdate, {MONTH}) AS key, max(o_orderkey) AS up_at FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT strftime(m, {MONTH}) AS key, CASE WHEN own_at IS NULL THEN 'missing' WHEN up_at > own_at THEN 'stale' ELSE 'fresh' END AS status FROM {M} LEFT JOIN own ON own.key = strftime(m, {MONTH}) LEFT JOIN up ON up.key = strftime(m, {MONTH})""",
)
def _(t):
    month, day = k.partition_key(F.col("o_orderdate"), "monthly"), k.partition_key(F.col("o_orderdate"), "daily")
    own = t["orders"].where("o_orderstatus = 'F' AND month(o_orderdate) <> 7").groupBy(month.alias("key")).agg(F.max("o_orderkey").alias("at"))
    up = t["orders"].where("o_orderstatus = 'O'").groupBy(day.alias("key")).agg(F.max("o_orderkey").alias("at"))
    return p.partition_status(months(t), own, p.map_aggregate(months(t), "monthly", "daily"), up)


@plan("part_history", "SELECT job_id, partition_key, state, updated_at FROM {parts} WHERE partition_key = '1996-02-29' ORDER BY job_id")
def _(t):
    return src.read_partition(t["parts"], "partition_key", ["1996-02-29"]).select("job_id", "partition_key", "state", "updated_at")


@plan("src_ragged_json", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def _(t):
    return src.parse_ragged_json(t["events"].select("event_id", "props"), "props", "k BIGINT, missing STRING")


@plan("src_ragged_json_files", "SELECT CASE WHEN event_id % 7 > 0 THEN event_id END AS id, CASE WHEN event_id % 7 > 1 THEN event_id % 100 END AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def _(t):
    path = scratch_path(t.spark, "ragged")
    line = "CASE event_id % 7 WHEN 0 THEN 'not json' WHEN 1 THEN concat('{\"id\": ', event_id, '}') ELSE concat('{\"k\": ', event_id % 100, ', \"more\": [1, {}], \"id\": ', event_id, '}') END"
    t["events"].selectExpr(f"{line} AS value").write.text(path)
    return src.read_ragged_json(t.spark, path, "id BIGINT, k BIGINT, missing STRING")


@plan("src_read_partition", "SELECT o_orderkey, o_totalprice FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN ('1996-02', '1997-11')")
def _(t):
    keyed = t["orders"].withColumn("month", k.partition_key(F.col("o_orderdate"), "monthly"))
    return src.read_partition(keyed, "month", ["1996-02", "1997-11"]).select("o_orderkey", "o_totalprice")


@plan("snk_materialize_roundtrip", "SELECT strftime(o_orderdate, '%Y') AS year, CASE WHEN strftime(o_orderdate, '%Y') = '1997' THEN count(*) FILTER (o_orderstatus = 'F') ELSE count(*) END AS row_count FROM orders GROUP BY strftime(o_orderdate, '%Y')")
def _(t):
    path = scratch_path(t.spark, "orders")
    keyed = t["orders"].withColumn("year", k.partition_key(F.col("o_orderdate"), "yearly"))
    src.materialize(keyed, path, "year")
    src.materialize(keyed.where("year = '1997' AND o_orderstatus = 'F'"), path, "year")
    return t.spark.read.schema(keyed.schema).parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("row_count"))


@plan("snk_check_results", "SELECT CAST(executed_at AS DATE) AS executed_date, count(*) AS n FROM {results} WHERE outcome <> 'skipped' GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "results")
    results = t["results"]
    broken = results.withColumn("outcome", F.when(F.col("outcome") == "skipped", F.lit("unknown")).otherwise(F.col("outcome")))
    return src.append_results(broken, path).groupBy("executed_date").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "snk_append_once",
    """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 300 END AS idem, row_number() OVER (PARTITION BY user_id, event_id % 300 ORDER BY event_id) AS n FROM events WHERE event_id % 2 = 1 OR event_id % 10 = 0),
    old AS (SELECT DISTINCT user_id, event_id % 300 AS idem FROM events WHERE event_id % 7 = 2)
    SELECT event_id, idem IS NULL OR (n = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.user_id = e.user_id AND old.idem = e.idem)) AS created FROM e""",
)
def _(t):
    new = t.sql("SELECT event_id, user_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 300 END AS idem FROM {events} WHERE event_id % 2 = 1 OR event_id % 10 = 0")
    old = t.sql("SELECT user_id, event_id % 300 AS idem FROM {events} WHERE event_id % 7 = 2")
    return src.append_once(new, old, ["user_id", "idem"], ["event_id"]).select("event_id", "created")


@plan("src_catalog_edges", "SELECT 'a' || (p_partkey // 2) AS src, 'a' || p_partkey AS dst FROM part WHERE p_partkey >= 2")
def _(t):
    manifests = t.sql("SELECT concat('a', p_partkey) AS asset, p_brand AS owner, array(concat('a', p_partkey DIV 2), concat('unknown', p_partkey)) AS dependencies FROM {part} WHERE p_partkey >= 1")
    return src.catalog_edges(manifests)[1]


@plan("src_read_partitions_pruned", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN (SELECT strftime(min(o_orderdate), '%Y-%m') FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)")
def _(t):
    """Months of the first pending order of each customer: the keys are known while the query runs only."""
    path = scratch_path(t.spark, "orders")
    keyed = t["orders"].withColumn("month", k.partition_key(F.col("o_orderdate"), "monthly"))
    src.materialize(keyed, path, "month")
    first = t["orders"].where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("at"))
    keys = first.select(k.partition_key(F.col("at"), "monthly").alias("month")).distinct()
    return src.read_partitions(t.spark, path, keyed.schema, "month", keys).select("o_orderkey", "month")


@plan("part_range_table", """WITH bounds AS (SELECT DISTINCT 'b' || CAST(floor(o_totalprice / 50) AS BIGINT) AS bucket, floor(o_totalprice / 50) * 50 AS low, floor(o_totalprice / 50) * 50 + 30 AS high FROM orders)
    SELECT bucket, count(*) AS n FROM lineitem LEFT JOIN bounds ON l_extendedprice >= low AND l_extendedprice < high GROUP BY bucket""")
def _(t):
    """Prices of lines in a table of thousands of bounds, which the prices of orders give; there are gaps."""
    low = F.floor(F.col("o_totalprice") / 50)
    bounds = t["orders"].select(F.concat(F.lit("b"), low.cast("string")).alias("bucket"), (low * 50).alias("low"), (low * 50 + 30).alias("high")).distinct()
    return iv.bucket_by_table(t["lineitem"].select("l_extendedprice"), "l_extendedprice", bounds).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


SPANS_OF = "SELECT o_custkey, o_orderkey, datediff(o_orderdate, DATE '1992-01-01') AS first_day, datediff(o_orderdate, DATE '1992-01-01') + 1 + CASE WHEN o_orderkey % 50 = 0 THEN 400 ELSE o_orderkey % 30 END AS end_day FROM {orders}"


@plan("join_range_overlap", """WITH r AS (SELECT o_custkey, o_orderkey, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS f, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + 1 + CASE WHEN o_orderkey % 50 = 0 THEN 400 ELSE o_orderkey % 30 END AS e FROM orders)
    SELECT x.o_custkey, x.o_orderkey AS a, y.o_orderkey AS b, CAST(least(x.e, y.e) - greatest(x.f, y.f) AS BIGINT) AS shared FROM r x JOIN r y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.f < y.e AND y.f < x.e""")
def _(t):
    return iv.overlapping_ranges(t.sql(SPANS_OF), ["o_custkey"], "o_orderkey", "first_day", "end_day").withColumn("shared", F.col("shared").cast("long"))
