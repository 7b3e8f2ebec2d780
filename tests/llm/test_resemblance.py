"""The pipeline's near-duplicate stage against brute force on pairs of similarity 0.80 to 0.95."""

import random

import corpus_pipeline
import numpy as np
from tablewarden.llm import resemblance


def jaccard(a, b):
    return len(a & b) / len(a | b)


def sets_of(text, words=5):
    found = text.lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def edited(rng, words, low, high):
    """A copy with replaced words whose similarity lies in the range."""
    while True:
        copy = list(words)
        for _ in range(rng.randint(1, max(1, len(words) // 20))):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        if low <= jaccard(sets_of(" ".join(words)), sets_of(" ".join(copy))) < high:
            return copy


def test_pairs_of_similarity_at_least_08(spark):
    rng = random.Random(11)
    rows, near = [], {}
    for low, high in ((0.65, 0.8), (0.8, 0.85), (0.85, 0.9), (0.9, 0.95)):
        for _ in range(120):
            words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(120, 400))]
            rows.append((2 * len(near), " ".join(words), 1))
            rows.append((2 * len(near) + 1, " ".join(edited(rng, words, low, high)), 1))
            near[2 * len(near)] = low
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    kept = {r.doc_id for r in kept.collect()}
    assert set(near) <= kept
    caught = {low: sum(i + 1 not in kept for i, x in near.items() if x == low) / 120 for low in set(near.values())}
    assert caught[0.65] == 0 and caught[0.8] >= 0.95 and caught[0.85] >= 0.98 and caught[0.9] == 1, caught


def test_dense_run_stays_connected(spark, monkeypatch):
    monkeypatch.setattr(resemblance, "SMALL", 16)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(edited(rng, base, 0.9, 1.0)), "x") for i in range(150)] + [(200 + i, t, "y") for i, t in enumerate([None, "", " \n"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, f0 string")
    assert sorted(r.doc_id for r in resemblance.keep_one_similar(docs).collect()) == [0, 200]
    assert resemblance.keep_one_similar(docs.where("false")).count() == 0


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(5, 6000))
        both, one, two = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, rng.integers(0, n), rng.integers(0, n)))
        x, y = np.unique(np.concatenate([both, one])), np.unique(np.concatenate([both, two]))
        a, b = (np.frombuffer(resemblance.parity_sketch(s), np.uint64) for s in (x, y))
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def test_dense_runs_lose_no_link_between_components():
    """A forest connects the candidates of a dense run, and every candidate that roots leave apart comes back."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(400) < 0.02 * (i % 5), rng.integers(0, 1 << 63, 400, dtype=np.uint64), base)) for i in range(60)]
    prints = np.stack([resemblance.fingerprint_family(s) for s in sets]).T.copy()
    sketch = np.stack([np.frombuffer(resemblance.parity_sketch(s), np.uint64) for s in sets])
    node, size = np.arange(1, 61, dtype=np.int64), np.array([len(s) for s in sets])
    members = resemblance.Members(node, size, prints, sketch, 1 / 9)
    linked = {(i, j) for i in range(1, 61) for j in range(i + 1, 61) if len(np.intersect1d(sets[i - 1], sets[j - 1])) >= 0.8 * len(np.union1d(sets[i - 1], sets[j - 1]))}
    a, b = members.forest()
    assert len(a) < 60
    root = np.array([n % 3 for n in node])
    apart = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in members.apart(root)), strict=True)}
    assert {(i, j) for i, j in linked if i % 3 != j % 3} <= apart and all(i % 3 != j % 3 for i, j in apart)
    reach = list(range(61))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        reach = [reach[y] if g == reach[x] else g for g in reach]
    assert all(reach[i] == reach[j] for i, j in linked)


def test_a_link_that_alone_joins_two_groups(spark, monkeypatch):
    """With every run dense, the second pass finds the links that a forest of candidates has missed."""
    monkeypatch.setattr(resemblance, "DENSE", 0)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    chain = [words]
    for _ in range(12):
        chain.append(edited(rng, chain[-1], 0.8, 0.9))
    rows = [(i, " ".join(w)) for i, w in enumerate(chain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [sets_of(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    group = list(range(len(rows)))
    for i, j in linked:
        group = [group[j] if g == group[i] else g for g in group]
    assert resemblance.keep_one_similar(docs).count() == len(set(group))


def copies_of_one(n, flips, seed=4):
    """(node, prints) of near copies whose fingerprints differ from one another in a few bits of each."""
    rng = np.random.default_rng(seed)
    base, flip = rng.integers(0, 1 << 63, (4, 1), dtype=np.uint64), rng.integers(0, 64, (flips, 4, n)).astype(np.uint64)
    return np.arange(1, n + 1, dtype=np.uint64), np.bitwise_xor.reduce(np.uint64(1) << flip, axis=0) ^ base


def test_no_run_gives_more_rows_than_members():
    """Short and long runs, all of near copies: pairs and members written together are no more than the run has rows."""
    for n in (2, 3, 4, 10, 12, resemblance.SMALL, 2 * resemblance.SMALL):
        node, prints = copies_of_one(n, 3)
        a, b, dense = resemblance.run_candidates(np.full(n, 7), node, prints)
        assert 0 < len(a) + len(dense) <= n, (n, len(a), len(dense))
        assert {*a.tolist(), *b.tolist(), *node[dense].tolist()} == set(node.tolist())


def test_rows_of_candidates_grow_with_the_group(spark):
    """A group of twice the near copies gives at most a row per member and key, twice the rows or less."""
    made = []
    for n in (40, 80):
        node, prints = copies_of_one(n, 1)
        rows = [(int(i), *map(int, p)) for i, p in zip(node, prints.view(np.int64).T, strict=True)]
        classes = spark.createDataFrame(rows, "fp long, f0 long, f1 long, f2 long, f3 long")
        found = resemblance.candidates(classes).collect()
        assert {r.u for r in found} | {r.v for r in found if r.v is not None} == set(range(1, n + 1))
        assert all((r.v is None) != (r.cell is None) for r in found)
        made.append(len(found))
        assert len(found) <= n * resemblance.FAMILIES * resemblance.KEYS
    assert made[1] <= 2.5 * made[0], made


def test_cells_of_the_same_members_are_one(spark):
    node, prints = copies_of_one(30, 0)
    classes = spark.createDataFrame([(int(i), *map(int, p)) for i, p in zip(node, prints.view(np.int64).T, strict=True)], "fp long, f0 long, f1 long, f2 long, f3 long")
    found = resemblance.candidates(classes).collect()
    assert len(found) == 30 and len({r.cell for r in found}) == 1 and {r.u for r in found} == set(range(1, 31))
