"""Tables, derived fixtures and registration for the query modules.

A fixture is one SQL text that Spark and DuckDB both understand; ``{name}`` stands for a table or another fixture."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

FIXTURES = {
    "runs": f"""SELECT event_id AS run_id, user_id AS tenant_id, {_K} % 7 AS workflow_id,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS state, ts AS started_at,
        value AS duration_s FROM {{events}}""",
    "results": f"""SELECT event_id AS result_id, event_type AS check_id, user_id AS execution_id, {_K} % 7 AS asset_id,
        CASE WHEN event_id % 20 = 0 THEN 'skipped' WHEN event_type = 'error' AND event_id % 6 = 0 THEN 'error'
             WHEN event_type = 'error' OR event_id % 17 = 0 THEN 'failed' ELSE 'passed' END AS outcome,
        CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity,
        event_id % 2 = 0 AS blocking, event_id % 11 AS failed_row_count, event_id % 13 AS total_row_count,
        ts AS executed_at FROM {{events}}""",
    "checks": """SELECT event_type AS check_id, concat('check_', event_type) AS name, event_type <> 'click' AS enabled,
        min(ts) AS created_at FROM {events} WHERE event_type <> 'signup' GROUP BY event_type""",
    "parts": """SELECT o_orderkey AS part_id, o_custkey AS job_id, substr(CAST(o_orderdate AS STRING), 1, 10) AS partition_key,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS state,
        CAST(o_totalprice AS DOUBLE) AS duration_ms, o_orderkey % 4 AS attempt_count, o_orderdate AS updated_at,
        CASE o_orderstatus WHEN 'P' THEN concat('E-', o_orderpriority) END AS error_message FROM {orders}""",
    "jobs": """SELECT job_id, job_id % 21 - 10 AS priority, CAST(floor(job_id / 10) AS BIGINT) AS parent_id, job_id % 50 AS asset_id,
        CASE WHEN job_id % 11 = 0 THEN NULL ELSE job_id % 20 END AS tenant_id,
        CASE job_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'resuming' WHEN 3 THEN 'completed'
             WHEN 4 THEN 'failed' WHEN 5 THEN 'waiting_upstream' ELSE 'paused' END AS state,
        job_id % 5 AS execution_order, min(updated_at) AS created_at, max(updated_at) AS heartbeat_at,
        count(*) AS total, CAST(sum(CASE WHEN state = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS completed
        FROM {parts} GROUP BY job_id""",
    "transitions": """SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running'
        WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'cancelled' ELSE 'paused' END WHEN 'purchase' THEN 'succeeded'
        ELSE CASE WHEN event_id % 3 = 0 THEN 'timeout' ELSE 'failed' END END AS state FROM {events}""",
    "backfill_log": """SELECT user_id AS job_id, ts, event_id, CASE event_id % 8 WHEN 0 THEN 'pending' WHEN 1 THEN 'waiting_upstream' WHEN 2 THEN 'running'
        WHEN 3 THEN 'completed' WHEN 4 THEN 'failed' WHEN 5 THEN 'cancelled' WHEN 6 THEN 'paused' ELSE 'resuming' END AS state FROM {events}""",
    "nodes": "SELECT p_partkey AS node, concat('asset_', CAST(p_partkey AS STRING)) AS name, p_partkey % 9 AS tenant_id FROM {part} WHERE p_partkey >= 1",
    "edges": """SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS src, p_partkey AS dst FROM {part} WHERE p_partkey >= 2
        UNION SELECT CAST(floor(p_partkey / 3) AS BIGINT) AS src, p_partkey AS dst FROM {part} WHERE p_partkey >= 3""",
    "cyclic": """SELECT src, dst FROM {edges} UNION SELECT p_partkey AS src, CAST(floor(p_partkey / 4) AS BIGINT) AS dst
        FROM {part} WHERE p_partkey % 97 = 0 AND p_partkey > 0""",
    "starts": "SELECT node AS source FROM {nodes}",
    "pairs": """SELECT node AS a, node + 50 AS b FROM {nodes} UNION SELECT CAST(floor(node / 8) AS BIGINT) AS a, node AS b FROM {nodes}""",
}


class Tables:
    """Tables and fixtures by name, read from one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name not in FIXTURES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(FIXTURES[name])

    def sql(self, text: str) -> DataFrame:
        """SQL with ``{name}`` for tables and fixtures."""
        return self.spark.sql(text, **{n: self[n] for n in set(re.findall(r"\{([a-z]\w*)\}", text))})


def with_fixtures(sql: str) -> str:
    """DuckDB SQL: the fixtures that ``{name}`` asks for become common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\{([a-z]\w*)\}", text):
            if name in FIXTURES and name not in order:
                need(FIXTURES[name])
                order.append(name)

    need(sql)
    plain = lambda text: re.sub(r"\{([a-z]\w*)\}", r"\1", text)
    heads = [f"{name} AS ({plain(FIXTURES[name])})" for name in order]
    sql = plain(sql).strip()
    if not heads:
        return sql
    recursive = "RECURSIVE " if sql.upper().startswith("WITH RECURSIVE") else ""
    if recursive:
        return f"WITH RECURSIVE {', '.join(heads)}, {sql[len('WITH RECURSIVE') :]}"
    return f"WITH {', '.join(heads)}, {sql[4:]}" if sql.upper().startswith("WITH") else f"WITH {', '.join(heads)} {sql}"


class Plans:
    """Queries and their SQL of one module."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, key: str, sql: str | None = None):
        def register(build: Callable[[Tables], DataFrame]):
            if key in self.queries:
                raise ValueError(f"{key} is registered twice")
            self.queries[key] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
            if sql is not None:
                self.oracles[key] = with_fixtures(sql)
            return build

        return register
