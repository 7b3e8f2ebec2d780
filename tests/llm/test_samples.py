"""Samples by hash: those of one global sort, whatever the sizes, with bounded last tasks."""

import pytest
from pyspark.sql import functions as F

from tablewarden.llm import quality_classifier, text, toxicity


@pytest.mark.parametrize("n, limit", [(0, 5), (5, 5), (20_000, 7), (20_000, 3000)])
def test_smallest_is_the_head_of_the_sorted_keys(spark, n, limit):
    rows = spark.range(n).selectExpr("id * 7 - 5000 AS id").unionByName(spark.range(min(n, 900)).selectExpr("id * 7 - 5000 AS id"))
    rows = rows.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS id"))
    want = [r.id for r in rows.where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(limit).collect()]
    assert [r.id for r in text.smallest(rows, "id", limit).collect()] == want


@pytest.mark.parametrize("bits", [7, 12])
def test_bound_is_near_the_limit(spark, bits):
    rows = spark.range(5000)
    hashes = sorted(r.h for r in rows.select(F.xxhash64("id").alias("h")).collect())
    for limit in (1, 2500):
        bound = text.hash_bound(rows, F.xxhash64("id"), limit, bits)
        found = sum(h <= bound for h in hashes)
        assert limit <= found <= 2 * limit


def test_many_rows_of_one_id_are_one_example(spark, monkeypatch):
    """A third of all rows under one labelled id: what comes to the driver keeps to the sample's bound."""
    docs = spark.range(20_001).selectExpr("CASE WHEN id % 2 = 0 THEN 1 ELSE id END AS doc_id", "concat('some words number ', id % 50) AS text").repartition(7)
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (1, 1, 1), (3, 0, 0), (5, 0, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    tables = []
    whole = text.sampled_features

    def noted(*args):
        tables.append(whole(*args))
        return tables[-1]

    monkeypatch.setattr(toxicity, "sampled_features", noted)
    monkeypatch.setattr(quality_classifier, "sampled_features", noted)
    toxicity.train_toxicity(docs, labels, positives=20, unlabelled=50)
    first = quality_classifier.train_quality(docs, labels, rows_per_class=20)
    assert len(tables[0]) <= 70 and len(tables[1]) <= 5
    keys = list(zip(tables[1].column("id").to_pylist(), tables[1].column("y").to_pylist(), strict=True))
    assert len(keys) == len(set(keys))
    again = quality_classifier.train_quality(docs.repartition(3), labels, rows_per_class=20)
    assert (first.weights == again.weights).all() and first.bias == again.bias
