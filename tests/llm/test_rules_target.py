"""The trusted target is counted on all trusted rows, and its smoothing means the same at every size."""

import inspect

import numpy as np
from pyspark.sql import functions as F

from tablewarden.llm import quality_rules


def test_all_trusted_rows_count(spark):
    assert "target_rows" not in inspect.signature(quality_rules.fit_ratio).parameters
    docs = spark.range(24_000).selectExpr("id AS doc_id", "concat('w', id % 997, ' x', id % 13) AS text")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert np.abs(quality_rules.fit_ratio(docs, labels).ratio[quality_rules._vector(quality_rules._gram_counts(docs.select("text"), 16), 16) > 0]).max() < 1e-6


def test_size_does_not_change_the_model(spark):
    rows = [(i, "good clean words here" if i % 2 else "bad spam junk there", i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    more = docs.crossJoin(spark.range(50)).selectExpr("doc_id * 100 + id AS doc_id", "text", "quality")
    one, many = (quality_rules.fit_ratio(d.select("doc_id", "text"), d.select("doc_id", "quality")) for d in (docs, more))
    assert np.allclose(one.ratio, many.ratio)
    judged = {r.doc_id: r.log_ratio for r in quality_rules.judge(docs, one).collect()}
    assert judged[0] < -0.1 < judged[1]
