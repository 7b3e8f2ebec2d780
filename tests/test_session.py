"""Scratch tables in the shared folder go when their scope ends."""

import os

from tablewarden.session import Scratch, cut, scratch_path, shared_dir


def test_scratch_is_deleted_but_for_what_is_kept(spark):
    root = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    with Scratch(spark) as outer:
        with Scratch(spark) as inner:
            dropped, kept = cut(spark.range(3)), inner.keep(cut(spark.range(5)))
            os.makedirs(scratch_path(spark, "empty").removeprefix("file:"))
            assert dropped.count() == 3
        assert len(set(os.listdir(root)) - before) == 1 and kept.count() == 5
        assert outer.paths == [kept._scratch]
    assert set(os.listdir(root)) == before
