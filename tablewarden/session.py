"""Session settings and small run-time helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf) -> SparkSession:
    """A session for tests and the bench; on a cluster, use the session that the job was given."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, from ``spark.checkpoint.dir``. Only where that is unset and everything
    runs in one process, as in tests, a new local folder is taken; on a cluster that would lose what executors write."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


_open: list[Scratch] = []


class Scratch:
    """``with Scratch(spark) as scratch:`` deletes at its end what was written to the shared folder inside, but for the
    tables given to ``keep``. Results that are still to be computed must be written or kept before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        """Leaves a table of ``cut`` to the scratch around this one, if there is one."""
        self.paths.remove(table._scratch)
        if len(_open) > 1:
            _open[-2].paths.append(table._scratch)
        return table

    def __exit__(self, *_) -> None:
        _open.remove(self)
        for path in self.paths:
            delete(self.spark, path)


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new place in the shared folder."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].paths.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again: a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def forget(table: DataFrame) -> None:
    """Deletes what ``cut`` wrote, once nothing that is still to run reads it."""
    path = getattr(table, "_scratch", None)
    if path is not None:
        delete(table.sparkSession, path)
