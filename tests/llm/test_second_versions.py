"""Plain second versions of the fitted models, the hash tree and the quality rules' ratio, from raw inputs."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tablewarden.llm import quality_classifier, quality_rules, sharding, toxicity

MASK = (1 << 64) - 1


def soft(z):
    return max(z, 0) + math.log1p(math.exp(-abs(z)))


def sigmoid(z):
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def plain_nnpu(positive, unlabelled, bits, prior, epochs, rate, l1, batch):
    """The corrected risk and its steps with dictionaries, one text and one feature at a time."""
    p_share, u_share = Counter(f for t in positive for f in t), Counter(f for t in unlabelled for f in t)
    w, seen, bias, bias_seen = {}, defaultdict(lambda: 1e-2), -3.0, 1e-2
    for f in set(p_share) | set(u_share):
        p, u = p_share[f] / len(positive), u_share[f] / len(unlabelled)
        negative, small = max(u - prior * p, 0) / (1 - prior), 4.0 / len(positive)
        w[f] = max(math.log((p + small) / (negative + small)) - 1.0, 0)
    rng = np.random.default_rng(0)
    risks = []
    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for s in range(max(1, -(-len(unlabelled) // batch))):
            p = [positive[p_order[i % len(p_order)]] for i in range(s * batch, s * batch + batch)]
            u = [unlabelled[i] for i in u_order[s * batch : (s + 1) * batch]]

            def top(text):
                return sorted((f for f in text if w[f] > 0), key=lambda f: (-w[f], f))[: toxicity.STRONGEST]

            tops = [(top(t), kind) for kind, texts in ((1, p), (0, u)) for t in texts]
            zs = [bias + sum(w[f] for f in fs) for fs, _ in tops]
            zp, zu = zs[: len(p)], zs[len(p) :]
            negative_part = sum(map(soft, zu)) / len(u) - prior * sum(map(soft, zp)) / len(p)
            risks.append(prior * sum(soft(-z) for z in zp) / len(p) + max(0, negative_part))
            grad, bias_grad = defaultdict(float), 0.0
            for (fs, kind), z in zip(tops, zs, strict=True):
                if negative_part >= 0:  # slope of prior * loss(+) + loss(u, -) - prior * loss(+, -)
                    g = prior * (-sigmoid(-z) - sigmoid(z)) / len(p) if kind else sigmoid(z) / len(u)
                else:  # the step that raises the negative part again
                    g = prior * sigmoid(z) / len(p) if kind else -sigmoid(z) / len(u)
                bias_grad += g
                for f in fs:
                    grad[f] += g
            for f, g in grad.items():
                seen[f] += g * g
                step = rate / math.sqrt(seen[f])
                w[f] = max(w[f] - step * g - step * l1, 0)
            bias_seen += bias_grad**2
            bias -= rate / math.sqrt(bias_seen) * bias_grad
    return w, bias, risks


@pytest.mark.parametrize("prior", [0.1, 0.6])
def test_nnpu_equals_a_plain_version(prior):
    rng = np.random.default_rng(1)
    positive = [np.unique(np.append(rng.integers(0, 40, 6), rng.integers(50, 54))) for _ in range(25)]
    unlabelled = [np.unique(rng.integers(0, 54, 7)) for _ in range(60)]
    w, b = toxicity.fit_nnpu(positive, unlabelled, 6, prior, 8, 0.3, 1e-3, batch=16)
    plain, bias, risks = plain_nnpu([t.tolist() for t in positive], [t.tolist() for t in unlabelled], 6, prior, 8, 0.3, 1e-3, 16)
    assert np.allclose([plain.get(i, 0) for i in range(64)], w, atol=1e-5) and b == pytest.approx(bias, abs=1e-6)
    assert risks[-1] < risks[0]


def test_ftrl_equals_a_plain_version():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(60):
        columns = np.unique(rng.integers(0, 32, 8))
        rows.append((int(columns[0] < 3), columns, rng.random(len(columns))))
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.05
    w, b = quality_classifier.ftrl(rows, 5, 4, alpha, beta, l1, l2)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(4):
        for i in order.permutation(len(rows)):
            label, columns, values = rows[i]
            x = dict(zip(columns.tolist(), values.tolist(), strict=True)) | {"bias": 1.0}
            now = {c: weight(c) for c in x}
            error = sigmoid(sum(now[c] * v for c, v in x.items())) - label
            for c, v in x.items():
                g = error * v
                z[c] += g - (math.sqrt(n[c] + g * g) - math.sqrt(n[c])) / alpha * now[c]
                n[c] += g * g
    assert np.allclose([weight(i) for i in range(32)], w, atol=1e-6) and b == pytest.approx(weight("bias"))


def plain_mix(a, b):
    x = (a * 0x9E3779B97F4A7C15 + b) & MASK
    x ^= x >> 29
    x = (x * 0xBF58476D1CE4E5B9) & MASK
    return x ^ (x >> 32)


def test_quality_scores_are_sparse_dot_products(spark):
    texts = ["Some Words here", "spam spam spam 12", "", "été ÉTÉ a-b"]
    rng = np.random.default_rng(3)
    model = quality_classifier.QualityModel(rng.normal(size=1 << 10).astype(np.float32), 0.25, 10)
    want = []
    for t in texts:
        words = t.encode().split()
        columns = Counter(plain_mix(zlib.crc32(w.lower()), 1) & 1023 for w in words)
        columns.update(plain_mix(zlib.crc32(quality_classifier.shape(w)), 2) & 1023 for w in words)
        for a, b in zip(words, words[1:], strict=False):
            same = a.lower() == b.lower()
            columns[(plain_mix(0xFFFFFFFF, 3) if same else (plain_mix(zlib.crc32(a.lower()), zlib.crc32(b.lower())) + 3) & MASK) & 1023] += 1
        if not words:
            columns[plain_mix(0xFFFFFFFE, 4) & 1023] += 1
        value = {c: math.log1p(n) for c, n in columns.items()}
        norm = math.sqrt(sum(v * v for v in value.values()))
        want.append(sigmoid(0.25 + sum(float(model.weights[c]) * v / norm for c, v in value.items())))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality_classifier.score_quality(docs, model).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-6)


def test_hash_tree_equals_a_plain_descent(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    leaves = [sharding.Leaf(s, f"r{s // 5}", f"k{s // 2}", rng.choice([0.5, 1.0, 3.0])) for s in range(11)]
    keys = [rng.randrange(-(10**12), 10**12) for _ in range(800)]
    got = {r.id: r.s for r in spark.createDataFrame([(k,) for k in keys], "id long").select("id", sharding.shard_column([F.col("id")], leaves).alias("s")).collect()}

    def descend(key):
        members = leaves
        for name in (lambda x: x.region, lambda x: f"{x.region}/{x.rack}", lambda x: f"{x.region}/{x.rack}/{x.shard}"):
            weight = defaultdict(float)
            for leaf in members:
                weight[name(leaf)] += leaf.weight
            draws = []
            for child, w in weight.items():
                bits = xxhash.xxh64_intdigest(child.encode(), xxhash.xxh64_intdigest(struct.pack("<q", key), 42)) >> 11
                draws.append((-math.log((bits + 0.5) / 2**53) / w, child))
            members = [leaf for leaf in members if name(leaf) == min(draws)[1]]
        return members[0].shard

    assert got == {k: descend(k) for k in keys}
    assert len(set(got.values())) == 11


def test_log_ratio_from_raw_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}

    def grams(t):
        words = [zlib.crc32(w.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        pairs = [0 if a == b else plain_mix(a, b) for a, b in zip(words, words[1:], strict=False)]
        return [plain_mix(w, 1) & 65535 for w in words] + [plain_mix(p, 2) & 65535 for p in pairs]

    raw, target = Counter(), Counter()
    for i, t in texts.items():
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def ratio(g):
        return math.log(((target[g] / n_target) / (raw[g] / n_raw) + 0.5) / 1.5)

    model = quality_rules.fit_ratio(docs, labels)
    for r in quality_rules.judge(docs, model).collect():
        found = grams(texts[r.doc_id])
        assert r.log_ratio == pytest.approx(sum(map(ratio, found)) / max(1, len(found)), abs=1e-5)
