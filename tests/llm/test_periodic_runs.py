"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import pytest

from tablewarden.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    found = []
    n = len(words)
    for q in range(1, n // 4 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - start
            if end > start and length >= max(6, 4 * q) and (start == 0 or words[start - 1] != words[start - 1 + q]):
                part = words[start : end + q]
                if not any(all(part[i] == part[i + d] for i in range(length - d)) for d in range(1, q)):
                    found.append((start, length, q))
            start = max(end, start + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *(best or (None,) * 3),
        1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def random_words(rng):
    kind = rng.randrange(4)
    words = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))]
    if kind == 1:  # a phrase again and again, cut at any place, between other words
        phrase = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
        words = words[:5] + (phrase * 8)[rng.randint(0, 5) : rng.randint(20, 60)] + words[5:]
    if kind == 2:  # Fibonacci words: many repetitions inside each other
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randint(3, 8)):
            a, b = b, b + a
        words = b + words
    if kind == 3:  # runs of runs
        inner = ["x"] * rng.randint(5, 8) + ["y"]
        words = inner * rng.randint(3, 6) + words
    return words


def test_runs_equal_a_plain_search():
    rng = random.Random(5)
    texts = [random_words(rng) for _ in range(800)] + [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"]]
    found = []
    for i in range(0, len(texts), 50):
        found += periodic_runs.runs_of([[w.encode() for w in words] for words in texts[i : i + 50]])
    for words, runs in zip(texts, found, strict=True):
        assert runs == plain_runs(words), words
    assert sum(map(len, found)) > 500


def test_one_word_a_hundred_thousand_times_is_one_run():
    assert periodic_runs.runs_of([[b"a"] * 100_000, [b"b"], [b"c", b"d"] * 40_000]) == [[(0, 100_000, 1)], [], [(0, 80_000, 2)]]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(random_words(rng))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (None, "a a a a a a a"), (1003, "é é\x0bé\x0cé é\né ü"), (1003, "é é\x0bé\x0cé é\né ü")]
    rows += [(1004, "           "), (1005, "long word " * 30_000)]
    return rows, spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, runs string, n_words int")


def test_query_rows_equal_the_plain_ones(spark, odd, tmp_path):
    rows, docs = odd
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = [tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()]
    wanted = [plain_row(*r) for r in rows if r[0] not in (None, 1005)]
    long = next(r for r in found if r[0] == 1005)
    assert long[1:5] == (1, 0, 60_000, 2) or zlib.crc32(b"1005") % 10 == 0
    alone = next(r for r in found if r[0] is None)
    assert alone[1:6] == (1, 0, 7, 1, 7000)
    assert sorted(r for r in found if r[0] not in (None, 1005)) == sorted(wanted)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)


def test_real_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect():
        if len(docs[r.doc_id] or "") < 3000:
            assert tuple(r) == plain_row(r.doc_id, docs[r.doc_id])


def test_spans_and_text(spark):
    docs = spark.createDataFrame([(1, "go " + "buy now " * 4 + "end")], "doc_id long, text string")
    row = periodic_runs.find_runs(docs).first()
    assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (10, [(1, 8, 2)], "go buy now end")
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
