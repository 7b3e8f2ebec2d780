"""Queries of the quality checks and of redaction."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tablewarden.functions import redact
from tablewarden.operators import quality as q
from tablewarden.operators.assets import Assets
from tablewarden.plans.base import Plans, Tables

plan = Plans()
QUERIES, ORACLES = plan.queries, plan.oracles

BRIEF = ["check", "outcome", "failed_count", "total_count"]
CUST = "nullif(o_custkey % 10, 0)"


def brief(df):
    return df.select(*BRIEF)


def row(check: str, bad: str, table: str, total: str = "count(*)", where: str = "") -> str:
    return f"SELECT '{check}' AS \"check\", CASE WHEN {bad} = 0 THEN 'passed' ELSE 'failed' END AS outcome, CAST({bad} AS BIGINT) AS failed_count, CAST({total} AS BIGINT) AS total_count FROM {table} {where}"


def nulled(t: Tables):
    return t.sql(f"SELECT *, {CUST} AS cust, nullif(o_orderpriority, '5-LOW') AS prio FROM {{orders}}")


NULLED = f"(SELECT *, {CUST} AS cust, nullif(o_orderpriority, '5-LOW') AS prio FROM orders)"


@plan("dq_not_null", row("cells", "(count(*) FILTER (cust IS NULL) + count(*) FILTER (prio IS NULL))", NULLED))
def _(t):
    return brief(q.run_suite(nulled(t), [q.NotNull(name="cells", columns=("cust", "prio"))]))


DUP = "(count(*) - count(DISTINCT (l_orderkey, l_linenumber)))"


@plan("dq_unique", row("lines", DUP, "lineitem"))
def _(t):
    return brief(q.run_suite(t["lineitem"], [q.Unique(name="lines", columns=("l_orderkey", "l_linenumber"))]))


@plan(
    "dq_in_range",
    f"{row('skip', 'count(*) FILTER (cust < 3 OR cust > 7)', NULLED)} UNION ALL {row('fail', 'count(*) FILTER (cust IS NULL OR cust < 3)', NULLED)}",
)
def _(t):
    return brief(q.run_suite(nulled(t), [q.InRange(name="skip", column="cust", low=3, high=7), q.InRange(name="fail", column="cust", low=3, nulls="fail")]))


@plan(
    "dq_regex",
    f"{row('inside', "count(*) FILTER (NOT regexp_matches(prio, '[A-Z]{3}'))", NULLED)} UNION ALL {row('start', "count(*) FILTER (NOT regexp_matches(prio, '^(?:[1-3]-)'))", NULLED)}",
)
def _(t):
    return brief(q.run_suite(nulled(t), [q.Matches(name="inside", column="prio", pattern="[A-Z]{3}"), q.Matches(name="start", column="prio", pattern="[1-3]-", anchored=True)]))


@plan("dq_row_count", "SELECT 'rows' AS \"check\", CASE WHEN count(*) BETWEEN 10 AND 5000 THEN 'passed' ELSE 'failed' END AS outcome, 0::BIGINT AS failed_count, count(*) AS total_count FROM orders")
def _(t):
    return brief(q.run_suite(t["orders"], [q.RowCount(name="rows", low=10, high=5000)]))


@plan("dq_accepted_values", row("prio", "count(*) FILTER (prio NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))", NULLED))
def _(t):
    return brief(q.run_suite(nulled(t), [q.Accepted(name="prio", column="prio", values=("1-URGENT", "2-HIGH", "3-MEDIUM"))]))


@plan("dq_accepted_long", row("keys", "count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))", "lineitem"))
def _(t):
    """As many accepted values as there are orders, behind a filter of bits."""
    accepted = t["orders"].where("o_orderstatus <> 'P'").select("o_orderkey")
    return brief(q.run_suite(t["lineitem"], [q.AcceptedIn(name="keys", column="l_orderkey", reference=accepted, ref_column="o_orderkey")]))


@plan("dq_no_duplicate_rows", row("rows", "(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)))", "lineitem"))
def _(t):
    return brief(q.run_suite(t["lineitem"].select("l_orderkey", "l_linenumber", "l_returnflag"), [q.NoDuplicateRows(name="rows")]))


@plan(
    "dq_freshness",
    "SELECT 'day' AS \"check\", CASE WHEN max(ts) >= TIMESTAMP '2024-01-30 12:00:00' THEN 'passed' ELSE 'failed' END AS outcome FROM events "
    "UNION ALL SELECT 'signup', CASE WHEN max(ts) >= TIMESTAMP '2024-01-31 11:59:00' THEN 'passed' ELSE 'failed' END FROM events",
)
def _(t):
    checks = [q.Freshness(name="day", column="ts", max_age_s=86400, as_of="2024-01-31 12:00:00"), q.Freshness(name="signup", column="ts", max_age_s=60, as_of="2024-01-31 12:00:00")]
    return q.run_suite(t["events"], checks).select("check", "outcome")


ORPHAN = "SELECT l.* FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.doc_id % 5 <> 0)"


@plan("dq_referential", row("docs", f"(SELECT count(*) FROM ({ORPHAN}))", "labels"))
def _(t):
    return brief(q.run_suite(t["labels"], [q.References(name="docs", column="doc_id", reference=t["documents"].where("doc_id % 5 <> 0"), ref_column="doc_id")]))


@plan("join_orphans_anti", ORPHAN)
def _(t):
    return q.orphans(t["labels"], "doc_id", t["documents"].where("doc_id % 5 <> 0"), "doc_id")


@plan(
    "dq_custom",
    f"{row('priced', "count(*) FILTER (NOT (o_totalprice > 1000 OR o_orderstatus = 'P'))", 'orders')} UNION ALL SELECT 'known', 'passed', 0, 0 UNION ALL SELECT 'broken', 'error', 0, 0",
)
def _(t):
    def broken(df):
        raise ValueError("no luck")

    return brief(
        q.run_suite(
            t["orders"],
            [
                q.Custom(name="priced", predicate="o_totalprice > 1000 OR o_orderstatus = 'P'"),
                q.TableCheck(name="known", function=lambda df: df.where("o_orderstatus NOT IN ('O', 'F', 'P')").isEmpty()),
                q.TableCheck(name="broken", function=broken),
            ],
        )
    )


@plan("dq_schema_match", "SELECT 'both' AS \"check\", 'failed' AS outcome, 2::BIGINT AS failed_count, count(*) AS total_count FROM region UNION ALL SELECT 'names', 'passed', 0, count(*) FROM region")
def _(t):
    return brief(q.run_suite(t["region"], [q.SchemaMatch(name="both", columns=("r_regionkey", "r_title"), allow_extra=False), q.SchemaMatch(name="names", columns=("r_name",))]))


def suite() -> list[q.Check]:
    return [
        q.NotNull(name="key", columns=("o_orderkey",)),
        q.NotNull(name="cust", columns=("cust",), severity="warning"),
        q.Unique(name="unique_key", columns=("o_orderkey",)),
        q.InRange(name="price", column="o_totalprice", low=1000.0),
        q.Accepted(name="status", column="o_orderstatus", values=("O", "F"), blocking=False),
        q.Matches(name="prio", column="o_orderpriority", pattern="^[1-5]-"),
        q.RowCount(name="rows", low=1),
    ]


SUITE = " UNION ALL ".join(
    [
        row("key", "count(*) FILTER (o_orderkey IS NULL)", NULLED),
        row("cust", "count(*) FILTER (cust IS NULL)", NULLED),
        row("unique_key", "(count(*) - count(DISTINCT o_orderkey))", "orders"),
        row("price", "count(*) FILTER (o_totalprice < 1000)", "orders"),
        row("status", "count(*) FILTER (o_orderstatus NOT IN ('O', 'F'))", "orders"),
        row("prio", "count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-5]-'))", "orders"),
        row("rows", "CASE WHEN count(*) >= 1 THEN 0 ELSE 1 END", "orders"),
    ]
)


@plan("dq_suite", SUITE)
def _(t):
    return brief(q.run_suite(nulled(t), suite()))


@plan("dq_gate", 'SELECT sum(CASE WHEN outcome = \'failed\' AND "check" NOT IN (\'cust\', \'status\') THEN 1 ELSE 0 END) = 0 AS open, CAST(sum(CASE WHEN outcome = \'failed\' AND "check" NOT IN (\'cust\', \'status\') THEN 1 ELSE 0 END) AS BIGINT) AS blockers FROM (' + SUITE + ")")
def _(t):
    return q.gate(q.run_suite(nulled(t), suite()))


@plan("dq_suite_from_json", 'SELECT * FROM (' + SUITE + ") WHERE \"check\" IN ('price', 'status', 'unique_key')")
def _(t):
    text = json.dumps(
        [
            {"type": "in_range", "name": "price", "column": "o_totalprice", "low": 1000.0},
            {"type": "accepted_values", "name": "status", "column": "o_orderstatus", "values": ["O", "F"]},
            {"type": "unique", "name": "unique_key", "columns": ["o_orderkey"]},
        ]
    )
    return brief(q.run_suite(t["orders"], q.suite_from_json(text)))


@plan("dq_expect", 'SELECT * FROM (' + SUITE + ") WHERE \"check\" IN ('price', 'status', 'rows')")
def _(t):
    e = q.expect(t["orders"]).column("o_totalprice").in_range(1000.0, name="price").column("o_orderstatus").accepted("O", "F", name="status")
    return brief(e.table().row_count(low=1, name="rows").run())


BAD = "concat_ws(',', CASE WHEN cust IS NULL THEN 'cust' END, CASE WHEN o_totalprice < 1000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' END)"


@plan("dq_quarantine", f"SELECT o_orderkey, {BAD} AS violations FROM {NULLED} WHERE {BAD} <> ''")
def _(t):
    marked = q.quarantine(nulled(t), [q.NotNull(name="cust", columns=("cust",)), q.InRange(name="price", column="o_totalprice", low=1000.0), q.Accepted(name="status", column="o_orderstatus", values=("O", "F"))])
    return marked.where(F.size("violations") > 0).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


EXACT = "CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))"
SUMS = f"SELECT l_orderkey, CAST(sum({EXACT}) AS DOUBLE) AS s FROM lineitem GROUP BY l_orderkey"


@plan("dq_reconciles", f"SELECT o_orderkey, coalesce(s, 0) AS child_sum FROM orders LEFT JOIN ({SUMS}) ON o_orderkey = l_orderkey WHERE abs(o_totalprice - coalesce(s, 0)) > 200000")
def _(t):
    out = q.reconciles(t["orders"], t["lineitem"], "o_orderkey", "l_orderkey", "o_totalprice", F.expr(EXACT), 200_000)
    return out.select("o_orderkey", "child_sum")


@plan("topk_failed_samples", "SELECT o_orderkey, o_totalprice, 'o_totalprice' AS failed_column, 'below 5000.0' AS reason FROM orders WHERE o_totalprice < 5000 ORDER BY o_totalprice, o_orderkey LIMIT 10")
def _(t):
    found = q.failed_samples(t["orders"], q.InRange(name="price", column="o_totalprice", low=5000.0), ["o_totalprice", "o_orderkey"])
    return found.select("o_orderkey", "o_totalprice", "failed_column", "reason")


NOTE = "concat('mail user', CAST(doc_id AS STRING), '@example.org tel 212-555-', CAST(1000 + doc_id % 9000 AS STRING))"


@plan("topk_failed_samples_redacted", "SELECT doc_id, 'mail [EMAIL] tel [PHONE]' AS note, 'note' AS failed_column, 'mail [EMAIL] tel [PHONE]' AS failed_value, 'no match of ^no mail' AS reason FROM documents ORDER BY doc_id LIMIT 10")
def _(t):
    notes = t.sql(f"SELECT doc_id, {NOTE} AS note FROM {{documents}}")
    return q.failed_samples(notes, q.Matches(column="note", pattern="^no mail"), ["doc_id"])


@plan(
    "topk_orphan_message",
    f"""WITH v AS (SELECT DISTINCT doc_id FROM ({ORPHAN})), f AS (SELECT string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY doc_id) AS s FROM (SELECT * FROM v ORDER BY doc_id LIMIT 5))
    SELECT (SELECT count(*) FROM v) AS n, CASE WHEN (SELECT count(*) FROM v) > 5 THEN s || ' ... (' || ((SELECT count(*) FROM v) - 5) || ' more)' ELSE s END AS message FROM f""",
)
def _(t):
    return q.orphan_message(t["labels"], "doc_id", t["documents"].where("doc_id % 5 <> 0"), "doc_id")


@plan("win_duplicates", "SELECT l_orderkey, l_linenumber, count(*) - 1 AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(t):
    marked = q.duplicates(t["lineitem"], ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    return marked.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies"))


PROFILED = ["c_custkey", "c_nationkey", "c_mktsegment"]


@plan(
    "agg_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS data_type, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c} IS NULL) > 0 AS nullable, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM customer"
        for c, k in zip(PROFILED, ["bigint", "int", "string"], strict=True)
    ),
)
def _(t):
    return q.profile(t["customer"].select(*PROFILED))


def sql_redacted(col: str, max_len: int | None = 1000) -> str:
    for pattern, tag in redact.PII.values():
        col = f"regexp_replace({col}, '{pattern}', '{tag}', 'g')"
    return col if max_len is None else f"CASE WHEN length({col}) > {max_len} THEN substr({col}, 1, {max_len}) || '...[TRUNCATED]' ELSE {col} END"


FAKE = "concat('id ', CAST(200000000 + doc_id AS STRING), ' tel (212) 555-', CAST(1000 + doc_id % 9000 AS STRING), ' card 4111-1111-1111-', CAST(1000 + doc_id % 9000 AS STRING), ' ip 10.0.', CAST(doc_id % 256 AS STRING), '.7 ', text)"


@plan("fn_redact_pii", f"SELECT doc_id, md5({sql_redacted('t')}) AS digest FROM (SELECT doc_id, {FAKE} AS t FROM documents)")
def _(t):
    return t.sql(f"SELECT doc_id, {FAKE} AS t FROM {{documents}}").select("doc_id", F.md5(redact.redact_pii(F.col("t")).cast("binary")).alias("digest"))


@plan("fn_redact_nested", f"SELECT conv_id, turn, md5({sql_redacted('m')}) AS digest FROM (SELECT conv_id, turn, concat('Mail a@b.org ', text) AS m FROM conversations)")
def _(t):
    nested = t.sql("SELECT conv_id, turn, struct(role, array(concat('Mail a@b.org ', text)) AS parts) AS message FROM {conversations}")
    return redact.redact_nested(nested).select("conv_id", "turn", F.md5(F.col("message.parts")[0].cast("binary")).alias("digest"))


@plan(
    "fn_redact_secrets",
    "SELECT doc_id, '[REDACTED]' AS api_key, '[REDACTED]' AS note, concat('t', CAST(doc_id AS STRING)) AS tenant_id, lang AS plain, '[REDACTED]' AS user_password FROM documents",
)
def _(t):
    maps = t.sql(
        "SELECT doc_id, map('api_key', source, 'note', concat('sk-', CAST(doc_id AS STRING)), 'tenant_id', concat('t', CAST(doc_id AS STRING)), 'plain', lang, 'User_Password', lang) AS m FROM {documents}"
    ).withColumn("m", redact.redact_secrets(F.col("m")))
    return maps.selectExpr("doc_id", "m['api_key'] AS api_key", "m['note'] AS note", "m['tenant_id'] AS tenant_id", "m['plain'] AS plain", "m['User_Password'] AS user_password")


@plan("fn_mask_url", "SELECT page_id, 'postgres://app:****@' || split_part(url, '://', 2) AS masked FROM pages")
def _(t):
    urls = t["pages"].select("page_id", F.concat(F.lit("postgres://app:s3cret@"), F.split_part("url", F.lit("://"), F.lit(2))).alias("u"))
    return urls.select("page_id", redact.mask_url_password(F.col("u")).alias("masked"))


@plan("fn_pii_counts", "SELECT lang, " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS n_{k}" for k, (p, _) in redact.PII.items()) + " FROM documents GROUP BY lang")
def _(t):
    return redact.pii_counts(t["documents"], "text", ["lang"])


OUT = "outcome IN ('failed', 'error')"


@plan("flt_blocking_failures", f"SELECT result_id, check_id FROM {{results}} WHERE blocking AND {OUT} AND severity = 'error'")
def _(t):
    return q.blocking_failures(t["results"]).select("result_id", "check_id")


def order_assets() -> Assets:
    assets = Assets()

    @assets.asset(inputs={"raw": "orders"}, checks=(q.NotNull(columns=("o_orderkey",)),))
    def completed(raw):
        return raw.where("o_orderstatus = 'F'")

    @assets.asset()
    def spend(completed):
        return completed.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))

    @assets.asset()
    def segments(spend, customer):
        return spend.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))

    return assets


@plan("asset_compute", "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1")
def _(t):
    return order_assets().compute("segments", {"orders": t["orders"], "customer": t["customer"]})

