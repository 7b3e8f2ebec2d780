"""Ranked search against scoring every document of a small collection."""

import math
import random
import re
from collections import Counter

import numpy as np

from tablewarden.llm import lexical_search, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k=50):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = set()
    for item, wanted in asked.items():
        scored = []
        for doc, c, n in counted:
            m = 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out |= {(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)}
    return out


def rows(df):
    return [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]


def random_text(rng, n):
    words = ["The", "of", "and", "Über", "x1", "ÀB", "naïve", *map(str, range(40))]
    return rng.choice([" ", "-", "\n", "/"]).join(rng.choices(words, [30, 20, 10, 5, 4, 3, 2] + [1] * 40, k=n))


def test_random_collection_equals_plain_scores(spark):
    rng = random.Random(3)
    docs = [(i, random_text(rng, rng.randint(1, 60))) for i in range(900)] + [(7, "the the 5 of"), (7, "the the 5 of"), (None, "the 5 of"), (2000, None), (2001, ""), (2002, "--- !")]
    items = [(i, random_text(rng, rng.randint(1, 25))) for i in range(25)] + [(3, "Über"), (None, "of 5"), (50, None), (51, ";"), (52, "unknownterm")]
    items += [(60, " ".join(map(str, range(40))) + " " + " ".join(f"w{i}" for i in range(100)) + " the of and über")]
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, n int, terms string").repartition(5)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int")
    found = rows(lexical_search.rank_documents(d, q))
    assert len(found) == len(set(found))
    assert set(found) == plain(docs, items)
    assert set(rows(lexical_search.rank_documents(d, q, k=7, pass_terms=60))) == plain(docs, items, 7)


def test_ties_are_broken_by_id_across_tasks_and_blocks(spark, monkeypatch):
    docs = [(i, "same text here") for i in range(5000, 0, -1)] + [(9000 + i, f"other {i}") for i in range(100)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    q = spark.createDataFrame([(1, "here same")], "item_id long, text string")
    assert [(r[1], r[2]) for r in sorted(rows(lexical_search.rank_documents(d, q)))] == [(i, i) for i in range(1, 51)]


def test_masks_stop_early():
    rng = np.random.default_rng(1)
    n = 4000
    held = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(n)]
    ends = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    block = lexical_search.Block(np.concatenate(held), ends, np.repeat(rng.integers(5, 9, n), np.diff(ends)) * (np.concatenate(held) + 1))
    seen, scores = [], block.scores
    block.scores = lambda docs, wanted: seen.append(len(docs)) or scores(docs, wanted)
    docs, values = block.best(list(range(12)), np.ones(12, bool), 50, 1)
    every = np.array([block.impact[a:b].sum() for a, b in zip(ends[:-1], ends[1:], strict=True)])
    assert sum(seen) < n / 2
    assert sorted(values)[-50:] == sorted(every)[-50:]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "here same")], "item_id long, text string")
    assert rows(lexical_search.rank_documents(d, q)) == []
    assert rows(lexical_search.rank_documents(spark.createDataFrame([(1, "here")], "doc_id long, text string"), q.limit(0))) == []


def test_query_on_real_documents(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    docs = [(r.doc_id, r.text) for r in read("documents").collect()]
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    assert set(rows(queries.QUERIES["op13_lexical_search"](spark, "/root/testdata/sf0.001"))) == plain(docs, items)
