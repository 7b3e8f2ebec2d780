"""The target of the quality rules: trusted texts are found and counted where they stand, only doubtful ones are joined."""

from collections import Counter

import pytest

from tablewarden.llm import quality_rules


@pytest.mark.parametrize("kind", ["long", "string"])
def test_only_doubtful_rows_are_joined(spark, kind):
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 100 = 7 THEN NULL WHEN id % 50 = 1 THEN 9 ELSE id END AS id", "concat('text ', id) AS text")
    trusted = spark.range(0, 40_000, 3).selectExpr(f"CAST(id AS {kind}) AS id").union(spark.sql(f"SELECT CAST(NULL AS {kind})"))
    marked, doubtful = quality_rules.with_trusted(rows, trusted)
    want = Counter(r.text for r in rows.collect() if r.id is not None and r.id % 3 == 0)
    some = doubtful.count()
    assert 0 < some < 0.05 * sum(want.values())
    assert Counter(r.text for r in marked.where("trusted").union(doubtful.selectExpr("text", "true")).collect()) == want
    assert marked.count() == rows.count() and marked.where("trusted IS NULL").count() == 0


def test_counts_of_both_in_one_pass(spark):
    rows = spark.createDataFrame([("a b", True), (None, False), ("b c", False), ("", True), ("c a", True)], "text string, trusted boolean").repartition(3)
    raw, target = quality_rules._vector(quality_rules._gram_counts(rows, 12), 12)
    assert (raw == quality_rules._vector(quality_rules._gram_counts(rows.select("text"), 12), 12)).all()
    assert (target == quality_rules._vector(quality_rules._gram_counts(rows.where("trusted").select("text"), 12), 12)).all()
