"""Held-out accuracy of the classifiers, the quality rules against brute force, and odd inputs."""

import re
import zlib
from collections import Counter

import numpy as np

from tablewarden.llm import quality_classifier, quality_rules, text, toxicity

DATA = "/root/testdata/sf0.1"


def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def held_out_errors(spark, scored, label):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", label)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    return Counter((r[label], r.predicted) for r in rows)


def test_toxicity_held_out(spark):
    docs, labels = tables(spark)
    scored = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels))
    n = held_out_errors(spark, scored, "toxic")
    assert n[1, 1] / (n[1, 0] + n[1, 1]) > 0.9 and n[0, 1] / (n[0, 0] + n[0, 1]) < 0.05
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored.limit(200).collect())


def test_quality_held_out(spark):
    docs, labels = tables(spark)
    n = held_out_errors(spark, quality_classifier.score_quality(docs, quality_classifier.train_quality(docs, labels)), "quality")
    assert n[1, 1] / (n[1, 0] + n[1, 1]) > 0.99 and n[0, 0] / (n[0, 0] + n[0, 1]) > 0.8


ODD = [(1, ""), (2, None), (None, "some words here"), (3, "x " * 50_000), (3, "x " * 50_000), (4, "\n\n\t"), (5, "é" * 2000)]


def odd(spark):
    return spark.createDataFrame([(i, t, 0.5, True) for i, t in ODD], "doc_id long, text string, score double, held_out boolean")


def test_odd_texts_and_labels(spark):
    docs = odd(spark)
    for labels in ([], [(1, 1, 1)], [(1, 1, 1), (3, 0, 0), (None, 1, 1), (4, None, None), (5, 9, 9), (3, 0, 0)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        for scored in (quality_classifier.score_quality(docs, quality_classifier.train_quality(docs, known)), toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, known))):
            rows = scored.collect()
            assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
            assert all(0 <= r.score <= 1 for r in rows)
        ratio = quality_rules.fit_ratio(docs, known)
        assert quality_rules.judge(docs, ratio).count() == len(ODD)
    none = docs.where("false")
    assert quality_rules.judge(none, quality_rules.fit_ratio(none, known)).count() == 0
    assert toxicity.score_toxicity(none, toxicity.train_toxicity(none, known)).count() == 0
    assert quality_classifier.score_quality(none, quality_classifier.train_quality(none, known)).count() == 0


def test_negative_risk_is_corrected():
    """Positives that are all memorised would make the corrected negative risk negative; weights stay finite."""
    rows = [np.array([i, 50]) for i in range(40)]
    w, b = toxicity.fit_nnpu(rows, rows, 6, 0.9, 200, 0.3, 0.0)
    assert np.isfinite(w).all() and np.isfinite(b) and w.max() < 50


def brute_rules(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            marked |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(marked)


def test_quality_rules_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_rules.fit_ratio(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    raw = np.zeros(1 << 16)
    grams = quality_rules.Grams(16)
    for t in texts.values():
        v = text.Vocabulary()
        ids, ends = text.numbered([t], v)
        raw += np.bincount(grams(v, ids, text.owners(ends))[0], minlength=1 << 16)
    again = {r.gram: r.n for r in quality_rules._gram_counts(docs.select("text"), 16).collect()}
    assert again == {i: int(n) for i, n in enumerate(raw) if n}
    for r in quality_rules.judge(docs, model).collect():
        want = brute_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed and r.log_ratio >= -0.1)


def test_odd_rules(spark):
    got = {r.doc_id: r for r in quality_rules.judge(odd(spark), quality_rules.RatioModel(np.zeros(1 << 16, np.float32), 16)).collect()}
    for i, t in ODD:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(t)
