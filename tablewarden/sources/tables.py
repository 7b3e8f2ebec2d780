"""Readers and writers of partitioned tables and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_ragged_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Irregular JSON rows as a rectangular table: missing fields are null, rows that are no objects all null."""
    reader = spark.read.option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def parse_ragged_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The same for a column of JSON texts; the parsed fields take the column's place."""
    parsed = df.withColumn("_parsed", F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}))
    return parsed.select(*[c for c in df.columns if c != column], "_parsed.*")


def read_partition(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Only the named partitions: a filter on the partition column, which the scan prunes."""
    return df.where(F.col(column).isin(keys))


def partitioned(spark: SparkSession, path: str, schema: T.StructType, column: str) -> DataFrame:
    """A table written by ``materialize``, with the partition column typed as in ``schema``."""
    return spark.read.schema(T.StructType([*[f for f in schema.fields if f.name != column], schema[column]])).parquet(path)


def read_partitions(spark: SparkSession, path: str, schema: T.StructType, column: str, keys: list | DataFrame) -> DataFrame:
    """Only the named partitions of a table on disk, other files aren't opened. A list of keys prunes when the query is
    planned; a table of keys (a column of that name) while it runs, once its keys are known."""
    table = partitioned(spark, path, schema, column)
    if isinstance(keys, DataFrame):
        return table.join(keys.select(column), column, "left_semi")
    return table.where(F.col(column).isin(keys))


def materialize(df: DataFrame, path: str, column: str) -> DataFrame:
    """Writes the partitions that ``df`` has and leaves the others of the table alone; gives the written rows' count per
    partition. Rows of a partition are brought together first, so that it has few files.

    ``df`` is evaluated once: the number of rows and the keys of the partitions, a value for each, are observed while
    they are written. The counts come from the written partitions and must add up to what was observed."""
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(column).isNull()).alias("nulls"), F.collect_set(column).alias("keys"))
    observed.repartition(F.col(column)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    found = seen.get
    table = partitioned(df.sparkSession, path, df.schema, column)
    written = table.where(F.col(column).isin(list(found["keys"])) | (F.col(column).isNull() & F.lit(found["nulls"] > 0)))
    counts = written.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    if (counts.agg(F.sum("row_count")).first()[0] or 0) != found["rows"]:
        raise RuntimeError(f"{path} does not hold the {found['rows']} rows that were written")
    return counts


OUTCOMES, SEVERITIES = ("passed", "failed", "skipped", "error"), ("info", "warning", "error")


def valid_results(results: DataFrame) -> DataFrame:
    """Rows with a known outcome and severity and counts that are not negative."""
    ok = F.col("outcome").isin(*OUTCOMES) & F.col("severity").isin(*SEVERITIES)
    return results.where(ok & (F.col("failed_row_count") >= 0) & (F.col("total_row_count") >= 0))


def append_results(results: DataFrame, path: str) -> DataFrame:
    """Appends valid check results by date, and gives the table."""
    rows = valid_results(results).withColumn("executed_date", F.to_date("executed_at"))
    rows.repartition(F.col("executed_date")).write.mode("append").partitionBy("executed_date").parquet(path)
    return results.sparkSession.read.schema(rows.schema).parquet(path)


def append_once(new: DataFrame, existing: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows of ``new`` with ``created``: whether a row may be inserted. Of equal keys the first in ``order`` wins,
    keys that exist already are not created again, rows with a null in the last key column are always created."""
    optional = F.col(key[-1])
    first = Window.partitionBy(*key).orderBy(*order)
    keyed = new.where(optional.isNotNull()).withColumn("_n", F.row_number().over(first))
    known = existing.select(*key).where(optional.isNotNull()).distinct().withColumn("_known", F.lit(True))
    match = [keyed[k].eqNullSafe(known[k]) for k in key]
    joined = keyed.join(known, match, "left").select(*[keyed[c] for c in new.columns], "_n", "_known")
    created = joined.withColumn("created", (F.col("_n") == 1) & F.col("_known").isNull()).drop("_n", "_known")
    return created.unionByName(new.where(optional.isNull()).withColumn("created", F.lit(True)))


def catalog_edges(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of manifests (asset, owner, dependencies array): one node per asset, one edge per known name."""
    nodes = manifests.select("asset", "owner")
    wanted = manifests.select(F.explode("dependencies").alias("src"), F.col("asset").alias("dst")).distinct()
    return nodes, wanted.join(nodes.select(F.col("asset").alias("src")), "src", "left_semi").select("src", "dst")
