"""The pipeline on the small tables: each stage's decisions take effect, the last one places every kept token."""

from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from tablewarden.llm import queries

DATA = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 4
    assert docs.select("text").distinct().count() == sizes[-1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    library = Tokenizer.from_file(queries.tokenizer_path(queries.WORD_BPE))
    want = sum(len(e.ids) + 1 for e in library.encode_batch([r.text for r in docs.select("text").collect()], add_special_tokens=False))
    assert packed.selectExpr("sum(n_tokens) AS n").first().n == want


ODD = [(1, None), (2, ""), (None, "a text without an id"), (None, "a text without an id"), (3, "one text"), (3, "another text"), (4, "twice"), (4, "twice"), (5, "long " * 300_000), (6, " \n\t")]


def test_odd_rows(spark):
    """Every stage takes nulls, empty and very long texts, repeated rows and ids, and columns with its own names."""
    docs = spark.createDataFrame([(i, t, {"a": 1}, 1.5, 2) for i, t in ODD], "doc_id long, text string, grams map<string,int>, score double, n_tokens long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, DATA)
        assert found.columns == docs.columns, name
        rows = [(r.doc_id, r.text) for r in found.collect()]
        if name == "SimHash near-dedup":
            assert Counter(rows) == Counter([(1, None), (None, "a text without an id"), (3, "one text"), (3, "another text"), (4, "twice"), ODD[8]])
        else:
            assert not Counter(rows) - Counter(ODD)
            same = Counter(t for _, t in rows)
            assert all(same[t] == sum(x == t for _, x in ODD) for t in same), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(i for i, _ in ODD)
    assert sum(r.n_tokens for r in packed if r.doc_id == 5) == 300_001 and sum(r.n_tokens for r in packed if r.doc_id in (1, 2, 6)) == 3


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_names():
    found = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert found == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
