"""Redaction and partition keys: literal cases."""

import pytest
from pyspark.sql import functions as F

from tablewarden.functions import keys as k
from tablewarden.functions import redact
from tablewarden.operators import partitions as p


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Contact: john@example.com, SSN: 123-45-6789", "Contact: [EMAIL], SSN: [SSN]"),
        ("call (212) 555-1234 now", "call [PHONE] now"),
        ("card 4111-1111-1111-1111", "card [CARD]"),
        ("host 192.168.10.1 up", "host [IP] up"),
        ("x" * 1001, "x" * 1000 + "...[TRUNCATED]"),
        (None, None),
    ],
)
def test_pii(spark, text, want):
    assert one(spark, redact.redact_pii(F.lit(text).cast("string"))) == want


def test_secrets(spark):
    m = F.create_map(*[F.lit(x) for x in ("API_KEY", "v", "tenant_id", "t", "note", "Bearer abc", "plain", "w")])
    assert one(spark, redact.redact_secrets(m)) == {"API_KEY": "[REDACTED]", "tenant_id": "t", "note": "[REDACTED]", "plain": "w"}


@pytest.mark.parametrize(
    "day, key, monday",
    [("2021-01-01", "2020-W53", "2020-12-28"), ("2021-01-04", "2021-W01", "2021-01-04"), ("2024-01-15", "2024-W03", "2024-01-15"), ("2018-12-31", "2019-W01", "2018-12-31")],
)
def test_iso_weeks(spark, day, key, monday):
    assert one(spark, k.partition_key(F.lit(day).cast("timestamp_ntz"), "weekly")) == key
    assert str(one(spark, k.key_start(F.lit(key), "weekly").cast("date"))) == monday


def test_keys_that_are_none(spark):
    for text, grain in (("2024-13", "monthly"), ("2023-02-29", "daily"), ("2021-W53", "weekly"), ("x", "yearly"), ("2024-01-01 25:00:00", "hourly")):
        assert one(spark, k.key_start(F.lit(text), grain)) is None, text
    assert one(spark, k.valid_key(F.lit("2024-02-29T05"), "hourly"))


@pytest.mark.parametrize("month, days", [("2023-02", 28), ("2024-02", 29), ("1900-02", 28), ("2000-02", 29), ("2024-04", 30), ("2024-12", 31)])
def test_month_lengths(spark, month, days):
    assert p.map_aggregate(p.static_keys(spark, [month]), "monthly", "daily").count() == days


def test_spines(spark):
    assert p.spine(spark, "daily", "2024-02-28", "2024-03-01").count() == 3
    assert p.spine(spark, "daily", "2024-03-01", "2024-02-01").count() == 0
    assert [r.key for r in p.spine(spark, "weekly", "2024-01-03", "2024-01-17", align="start").collect()] == ["2024-01-03", "2024-01-10", "2024-01-17"]
    with pytest.raises(ValueError):
        p.spine(spark, "daily", "2024-01-01", "2026-01-01", limit=366)


def test_quick_patterns_have_the_same_matches(spark):
    import random

    from pyspark.sql import functions as F

    from tablewarden.functions import redact

    rng = random.Random(7)
    parts = ["123", "45", "6789", "1", "25", "255", "256", "0", "-", "-", ".", ".", " ", "(", ")", "a", "é", "_", "@b.org", "x@", "4111", "123456789", "10.0.", "199.25.", "249.7.", "1.2.3."]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))),) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "t string")
    for kind, (pattern, _) in redact.PII.items():
        slow, quick = F.regexp_replace("t", pattern, "#"), F.regexp_replace("t", redact.QUICK[kind], "#")
        assert df.where(slow != quick).limit(3).collect() == [], kind
        assert df.where(slow != F.col("t")).count() > 20
        assert df.where(F.col("t").rlike(pattern) != redact.has_pii(F.col("t"), kind)).count() == 0
