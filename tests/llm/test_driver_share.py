"""What training holds on the driver: the sampled features once, and steps that touch their own features only."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tablewarden.llm import text, toxicity


def test_examples_are_sorted_views_of_the_table():
    ids, marks, lists = ["b", "a", "é", "Z", "a"], [1, 0, 0, 1, 1], [[1, 2], [], [3], [4, 5, 6], [7]]
    make = lambda at: pa.record_batch({"id": pa.array(ids[at]), "kind": pa.array(marks[at], pa.int32()), "columns": pa.array(lists[at], pa.list_(pa.int32()))})
    table = pa.Table.from_batches([make(slice(0, 2)), make(slice(2, 5)).slice(0, 3)])
    found = text.examples(table.slice(1))
    assert [(k, i, c.tolist()) for k, i, c in found] == [(0, "a", []), (0, "é", [3]), (1, "Z", [4, 5, 6]), (1, "a", [7])]
    chunk = table.column("columns").chunk(1).values.to_numpy()
    assert all(np.shares_memory(c, chunk) for _, i, c in found if len(c))
    assert text.examples(table.slice(0, 0)) == []


def test_toxicity_steps_need_no_copy_of_the_sample():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 1 << 16, 3000)).astype(np.int32) for _ in range(1500)]
    size = sum(map(len, rows)) * 8
    tracemalloc.start()
    toxicity.fit_nnpu(rows[:300], rows[300:], 16, 0.1, 2, 0.3, 5e-4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < size / 2, (most, size)


def test_counts_of_features_are_those_of_all_rows():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 500, 40)).astype(np.int32) for _ in range(70)]
    assert toxicity.texts_with(rows, 500).tolist() == np.bincount(np.concatenate(rows), minlength=500).tolist()
