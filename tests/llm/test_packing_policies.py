"""Packing compares distinct packings on lengths above 2048 and takes the cheapest."""

import random

from tablewarden.llm import packing


def test_joint_policies_differ_and_the_cheapest_is_taken():
    rng = random.Random(1)
    lengths = sorted((min(16384, int(rng.lognormvariate(7, 0.8)) + 1) for _ in range(600)), reverse=True)
    assert max(lengths) > 2048
    sizes, cost = list(packing.CAPACITIES), packing.sequence_cost
    tried = [packing.place(lengths, sizes, p) for p in packing.joint_policies(lengths, sizes)]
    costs = [sum(map(cost, t[2])) for t in tried]
    assert len(tried) == len(packing.joint_policies(lengths, sizes)) and len({tuple(t[0]) for t in tried}) > 10
    joint = sum(map(cost, packing.pack_jointly(lengths, packing.CAPACITIES, cost)[2]))
    assert joint == min(costs) < sum(map(cost, packing.pack(lengths, packing.CAPACITIES, cost)[2]))


def test_documents_take_the_joint_packing(spark):
    rng = random.Random(2)
    lengths = [min(16384, int(rng.lognormvariate(7, 0.8)) + 1) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    got = packing.pack_documents(docs.selectExpr("doc_id", "n", "'' AS text"), docs["n"]).select("bin_id", "bin_length").distinct().collect()
    capped = packing.pack(sorted(lengths, reverse=True), packing.CAPACITIES, packing.sequence_cost)[2]
    assert sum(packing.sequence_cost(r.bin_length) for r in got) < sum(map(packing.sequence_cost, capped))
