"""SimHash components, components of edges and neighbour search against brute force."""

import random

import numpy as np
import pytest

from tablewarden.llm import components, neighbours, queries, resemblance, simhash


def reach(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)] + [(i, i + 1) for i in range(200, 230)] + [(500, x) for x in range(501, 540)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = reach({x for e in edges for x in e}, edges)
    assert got == {n: want[n] for e in edges if e[0] != e[1] for n in e}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("cell", [4, 2048])
def test_links_lose_no_component(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(60)} | {0, 7}
    fps = sorted(prints)
    want = reach(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3])
    signed = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    found = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(signed, 3, 6).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    assert reach(fps, found) == want


def test_forest_of_a_long_run():
    rng = np.random.default_rng(0)
    fp = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    a, b = simhash.run_links(np.zeros(len(fp), np.int64), fp, 2)
    ints = [int(x) for x in fp]
    want = reach(ints, [(x, y) for x in ints for y in ints if (x ^ y).bit_count() <= 2])
    assert reach(ints, list(zip(map(int, a), map(int, b), strict=True))) == want and len(a) < len(fp)


def test_near_duplicates(spark):
    rng = random.Random(6)
    words = ["w%d" % i for i in range(400)]
    long = [rng.choice(words) for _ in range(400)]
    near = long[:200] + ["changed"] + long[201:]
    rows = [(9, " ".join(long)), (4, " ".join(near)), (5, "A  b\nC d"), (2, "a B c\td"), (2, "a B c\td"), (8, None), (7, ""), (6, " \n"), (None, "a b c d"), (11, "x"), (12, "é " * 100_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs).collect()
    fps = [(i, simhash.fingerprint(t or "")) for i, t in rows]
    want = reach(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a][1] ^ fps[b][1]).bit_count() <= 3])
    least = {}
    for k, r in want.items():
        if fps[k][0] is not None:
            least[r] = min(least.get(r, 99), fps[k][0])
    expect = sorted((i if i is not None else -1, f"{f:016x}", least[want[k]]) for k, (i, f) in enumerate(fps))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in got) == expect
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("keep", [simhash.keep_one, resemblance.keep_one_similar])
def test_documents_of_one_id_are_told_apart(spark, keep):
    alpha = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(3, alpha), (3, "one two three four five six seven eight nine ten"), (4, "red green blue black white grey pink"), (5, alpha)]
    rows += [(None, alpha), (None, "nothing like the other rows of this table"), (None, "nothing like the other rows of this table")]
    rows += [(9, "twice the same row in every column"), (9, "twice the same row in every column"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, {"a": 1}, 0, "x") for i, t in rows], "doc_id long, text string, `_row` map<string,int>, key int, fp string")
    kept = keep(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[2], rows[5], rows[7], rows[9]], key=str)


def test_fingerprint_uses_the_xxh64_of_spark(spark):
    from pyspark.sql import functions as F

    text = "one two three four"
    hashes = [r.h % (1 << 64) for r in spark.createDataFrame([("one two three",), ("two three four",)], "s string").select(F.xxhash64("s").alias("h")).collect()]
    assert simhash.fingerprint(text.upper()) == hashes[0] & hashes[1]


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = [(int(i), [float(x) for x in centres[i % 12] + 0.6 * rng.normal(size=16)]) for i in range(3000)]
    vectors += [(3000 + i, [1.0] * 16) for i in range(500)]  # one very common vector
    bad = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] + [1.0] * 15), (5004, [None] + [1.0] * 15), (5050, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors + bad], "vec_id long, embedding array<double>, part int")
    got = {}
    for r in neighbours.search(df, df.where("vec_id % 50 = 0"), probe_share=0.75, sample_rows=1024, depth=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, m = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = 0
    queries = np.flatnonzero(ids % 50 == 0)
    assert set(got) == {int(ids[i]) for i in queries}
    for i in queries:
        score = np.round(unit @ unit[i], 12)
        score[i] = -9
        order = np.lexsort((ids, -score))[:5]
        found = sorted(got[int(ids[i])])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert np.allclose([f[2] for f in found], [score[f[1]] for f in found])
        hits += len({f[1] for f in found} & set(ids[order].tolist()))
    assert hits >= 0.9 * 5 * len(queries)
    few = df.where("vec_id IN (0, 1, 2)")
    assert [(r["rank"], r.query_id) for r in neighbours.search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 0), (2, 0)]
    assert neighbours.search(few.where("false"), few).count() == 0


def test_partition_is_balanced():
    unit = np.random.default_rng(0).normal(size=(512, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    part = neighbours.balanced_partition(neighbours.neighbour_graph(unit, 5), unit, 4)
    assert np.bincount(part).tolist() == [32] * 16


def nearest(ids, vectors, queries, k=5):
    """Brute force in double precision: {query: [(score, id)]}."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for i in queries:
        score = (unit * unit[i]).sum(axis=1)
        score[i] = -9
        order = np.lexsort((ids, -score))[: min(k, len(ids) - 1)]
        out[int(ids[i])] = [(float(score[j]), int(ids[j])) for j in order]
    return out


def test_recall_on_the_embeddings_with_the_registered_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = nearest(ids, vectors, np.flatnonzero(ids % 50 == 0))
    got = {}
    for r in queries.QUERIES["op3_neighbours"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    assert all(abs(s - dict((i, s) for s, i in want[q]).get(i, s)) < 1e-12 for q in want for s, i in got[q])


def test_equal_vectors_tie_and_repeated_ids_count_once(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(size=37).tolist()) for i in range(1500)]
    vectors += [(2000 + i, vectors[7 + i % 3][1]) for i in range(300)]  # copies of three vectors, at all places of blocks
    vectors += [(50, [5.0] + [0.0] * 36), (50, [5.0] + [0.0] * 36), (1999, [4.0] + [0.0] * 36), (1999, [4.0] + [0.0] * 36), (1999, [9.0] * 37)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(7)
    got = {}
    for r in neighbours.search(df, df.where("vec_id IN (50, 7, 8, 9)"), probe_share=1.0, depth=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert all([i for i in got[7 + j]] == [2000 + j + 3 * n for n in range(5)] for j in range(3))
    assert len(set(got[50])) == 5  # of the two vectors of id 50 the lesser stands for it


def test_a_query_with_too_few_candidates_asks_all_parts(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=4).tolist()) for i in range(260)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = neighbours.search(df, df.where("vec_id % 50 = 0"), k=40, probe_share=1 / 64, depth=6).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {i: 40 for i in range(0, 260, 50)}


def test_vectors_of_another_length_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0]), (4, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(df, df).collect()
    assert {r.query_id for r in found} == {r.vec_id for r in found} == {0, 1, 3}
