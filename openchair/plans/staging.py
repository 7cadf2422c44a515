"""Intermediate tables that several branches of a job read."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


OPEN_FILES = 64


def staging_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, or one in the warehouse where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/_staged"


def _own_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/openchair/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """A folder of this application that nothing else uses."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}"


@contextmanager
def open_files(spark: SparkSession) -> Iterator[None]:
    """While inside, a task writes to its partitions and buckets as rows come, without sorting whole rows first.

    With more than ``OPEN_FILES`` of them Spark sorts what is left of the task.
    """
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), OPEN_FILES)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _table_prefix(spark: SparkSession) -> str:
    return f"openchair_staged_{spark.sparkContext.applicationId}".replace("-", "_")


def staged(df: DataFrame, label: str, by: Sequence[str] = (), buckets: int = 0) -> DataFrame:
    """Write ``df`` as Parquet, partitioned by the columns ``by``, and read it back.

    The written table cuts the lineage, survives lost executors, is read by column, and has
    a known size, so the planner's broadcast check works from real file sizes. With ``buckets`` it
    is a table of the catalog whose rows lie by slot; rows that lie so already are not shuffled.
    """
    spark = df.sparkSession
    path = f"{new_folder(spark)}/{label}"
    with open_files(spark):
        if buckets:
            name = f"{_table_prefix(spark)}_{uuid.uuid4().hex}"
            writer = df.repartition(buckets, "slot_id").write.bucketBy(buckets, "slot_id").option("path", path)
            (writer.partitionBy(*by) if by else writer).saveAsTable(name)
            return spark.table(name).select(*df.columns)
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def drop_staged(spark: SparkSession) -> None:
    """Delete all tables staged by this application. DataFrames that read them end with it."""
    for table in spark.catalog.listTables(pattern=f"{_table_prefix(spark)}*"):
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
