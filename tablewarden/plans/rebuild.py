"""Queries of rebuild plans through composed mappings, and of declared mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.keys import partition_key
from tablewarden.operators import partitions as p
from tablewarden.operators import rebuild as r
from tablewarden.plans.base import Plans, Tables

plan = Plans()
QUERIES, ORACLES = plan.queries, plan.oracles

GRAIN = "CASE {0} % 6 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' WHEN 3 THEN 'monthly' WHEN 4 THEN 'yearly' END"
SPECS = f"SELECT node, {GRAIN.format('node')} AS grain FROM {{nodes}}"
#: Another graph of coarse grains, of which single keys are listed.
COARSE = "SELECT node, CASE node % 4 WHEN 0 THEN 'weekly' WHEN 1 THEN 'monthly' WHEN 2 THEN 'yearly' END AS grain FROM {nodes}"
#: Edges between nodes of one grain are windows, offsets or plain in turn.
DECLARED = "SELECT src, dst, CASE WHEN src % 6 = dst % 6 THEN CASE (src + dst) % 3 WHEN 0 THEN 'window' WHEN 1 THEN 'offset' END END AS mapping, CASE (src + dst) % 3 WHEN 0 THEN 3 ELSE -2 END AS n FROM {edges}"

KEYS = {"hourly": "'%Y-%m-%d %H:00:00'", "daily": "'%Y-%m-%d'", "weekly": "'%G-W%V'", "monthly": "'%Y-%m'", "yearly": "'%Y'"}
UNIT = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}


def case(grain: str, text: str) -> str:
    """SQL with ``@unit``, ``@step`` and ``@key`` of each grain."""
    return "CASE " + grain + "".join(f" WHEN '{g}' THEN {text.replace('@unit', UNIT[g]).replace('@step', '1 ' + UNIT[g]).replace('@key', KEYS[g])}" for g in KEYS) + " END"


#: What the days of each target's orders need, path by path, and then merged.
WALK = f"""WITH RECURSIVE s AS (SPECS), d AS ({DECLARED}),
    ask AS (SELECT node AS target, grain, FIRST(o_orderdate) AS a, max(o_orderdate) AS b FROM s JOIN orders ON o_custkey = node GROUP BY ALL),
    walk AS (SELECT target, target AS node, {case('grain', "date_trunc('@unit', a)")} AS lo, {case('grain', "date_trunc('@unit', b) + INTERVAL @step")} AS hi, 0 AS depth FROM ask
      UNION SELECT target, src, {case('u.grain', "date_trunc('@unit', x)")}, {case('u.grain', "CASE WHEN date_trunc('@unit', y) < y THEN date_trunc('@unit', y) + INTERVAL @step ELSE date_trunc('@unit', y) END")}, depth + 1
      FROM (SELECT w.target, d.src, w.depth,
          CASE mapping WHEN 'window' THEN {case('v.grain', 'lo + INTERVAL @step * (1 - n)')} WHEN 'offset' THEN {case('v.grain', 'lo + INTERVAL @step * n')} ELSE lo END AS x,
          CASE mapping WHEN 'offset' THEN {case('v.grain', 'hi + INTERVAL @step * n')} ELSE hi END AS y
        FROM walk w JOIN d ON d.dst = w.node JOIN s v ON v.node = w.node) h LEFT JOIN s u ON u.node = h.src),
    spans AS (SELECT target, node, coalesce(lo, TIMESTAMP '0001-01-01') AS lo, coalesce(hi, TIMESTAMP '9999-12-31') AS hi, min(depth) AS depth FROM walk WHERE node <> target GROUP BY ALL),
    marked AS (SELECT *, max(hi) OVER (PARTITION BY target, node ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
    islands AS (SELECT *, sum(CASE WHEN before >= lo THEN 0 ELSE 1 END) OVER (PARTITION BY target, node ORDER BY lo, hi) AS island FROM marked),
    ranges AS (SELECT target, node, min(lo) AS lo, max(hi) AS hi, min(min(depth)) OVER (PARTITION BY target, node) AS depth FROM islands GROUP BY target, node, island),
    ordered AS (SELECT target, ranges.node, grain, nullif(lo, TIMESTAMP '0001-01-01') AS lo, nullif(hi, TIMESTAMP '9999-12-31') AS hi, CAST(max(depth) OVER (PARTITION BY target) - depth AS INT) AS execution_order FROM ranges LEFT JOIN s ON s.node = ranges.node)"""


def asked(t: Tables, specs: DataFrame, first: Column):
    """Each node's range of days of the orders of the customer with its number, as keys of its grain."""
    ends = t["orders"].groupBy(F.col("o_custkey").alias("target")).agg(first.alias("a"), F.max("o_orderdate").alias("b"))
    rows = ends.join(specs.withColumnRenamed("node", "target"), "target")
    names = {"start_key": "a", "end_key": "b"}
    return rows.select("target", *[r.by_grain(F.col("grain"), lambda g, c=c: partition_key(F.col(c), g)).alias(n) for n, c in names.items()])


@plan("part_backfill_ranges", WALK.replace("SPECS", SPECS).replace("FIRST", "min") + f" SELECT target, node, execution_order, {case('grain', 'strftime(lo, @key)')} AS start_key, {case('grain', 'strftime(hi - INTERVAL @step, @key)')} AS end_key FROM ordered")
def _(t):
    specs = t.sql(SPECS)
    return r.rebuild_ranges(asked(t, specs, F.min("o_orderdate")), t.sql(DECLARED), specs)


@plan(
    "part_backfill_keys",
    WALK.replace("SPECS", COARSE).replace("FIRST", "max")
    + f""", done AS (SELECT s.node, {case('s.grain', 'strftime(o_orderdate, @key)')} AS key FROM orders JOIN s ON s.node = o_orderkey % 500 WHERE o_orderstatus = 'F'),
    keys AS (SELECT target, node, execution_order, {case('grain', 'strftime(moment, @key)')} AS key
      FROM (SELECT *, unnest(generate_series(lo, hi - INTERVAL 1 DAY, CASE grain WHEN 'weekly' THEN INTERVAL 7 DAY WHEN 'monthly' THEN INTERVAL 1 MONTH ELSE INTERVAL 1 YEAR END)) AS moment FROM ordered WHERE grain IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL))
    SELECT * FROM keys WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.node = keys.node AND done.key = keys.key)""",
)
def _(t):
    specs = t.sql(COARSE)
    done = t["orders"].where("o_orderstatus = 'F'").select((F.col("o_orderkey") % 500).alias("node"), "o_orderdate").join(specs, "node")
    done = done.select("node", r.by_grain(F.col("grain"), lambda g: partition_key(F.col("o_orderdate"), g)).alias("key")).distinct()
    return r.rebuild_keys(asked(t, specs, F.max("o_orderdate")), t.sql(DECLARED), specs, done)


MAPPINGS = f"""SELECT src, dst, CASE (src * 7 + dst) % 5 WHEN 0 THEN 'identity' WHEN 1 THEN 'aggregate' WHEN 2 THEN 'window' WHEN 3 THEN 'offset' ELSE 'custom' END AS mapping,
    CASE WHEN (src * 7 + dst) % 4 = 0 THEN 'daily' ELSE {GRAIN.format('src')} END AS up_grain, CASE WHEN (src * 7 + dst) % 9 = 0 THEN 'monthly' ELSE {GRAIN.format('dst')} END AS down_grain FROM {{edges}}"""


@plan(
    "part_check_compatible",
    f"""WITH s AS ({SPECS}), m AS ({MAPPINGS}), g AS (SELECT unnest(['hourly', 'daily', 'weekly', 'monthly', 'yearly']) AS grain, unnest([0, 1, 2, 3, 4]) AS i),
    j AS (SELECT m.*, u.grain AS up, v.grain AS down, (SELECT i FROM g WHERE g.grain = up_grain) < (SELECT i FROM g WHERE g.grain = down_grain) AS finer FROM m LEFT JOIN s u ON u.node = src LEFT JOIN s v ON v.node = dst)
    SELECT src, dst, mapping, CASE WHEN mapping = 'custom' THEN NULL
      WHEN mapping = 'identity' THEN CASE WHEN up IS NOT DISTINCT FROM down THEN NULL ELSE 'incompatible: ' || coalesce(up, 'none') || ' to ' || coalesce(down, 'none') END
      WHEN mapping = 'aggregate' AND finer IS NOT TRUE THEN 'no aggregation from ' || up_grain || ' to ' || down_grain
      WHEN up IS NOT DISTINCT FROM up_grain AND down IS NOT DISTINCT FROM down_grain THEN NULL
      ELSE 'incompatible: ' || coalesce(up, 'none') || ' to ' || coalesce(down, 'none') END AS problem FROM j""",
)
def _(t):
    return p.check_compatible(t.sql(MAPPINGS), t.sql(SPECS))
