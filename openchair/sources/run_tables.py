"""Stored tables laid out for joins: partitioned by run, bucketed by slot.

All tables of one catalog folder have the same number of buckets, so the rows of a slot lie in the bucket of the same number
in each of them. A reader that names its run gets that run's partitions only and joins slots, features, flags, scores and
actions bucket by bucket, without an exchange. Slot ids are unique within a run, so no bucket is hot. Choose the number of
buckets so that one bucket of a run's widest table is a few hundred megabytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from openchair.operators.evaluation import latest_runs
from openchair.params import RUN_KEY, RunSpec
from openchair.plans.staging import open_files


def write_runs(df: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Replace the runs that ``df`` holds and leave all others alone; the first write makes the table.

    Rows are dealt to tasks as they are to buckets, so a run gets one file for each bucket. ``path`` is the folder of a
    new table; without one it lies in the warehouse. A table that exists must have the same columns and buckets.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        _create(df, table, buckets, path)
    stored = spark.table(table).columns
    if set(stored) != set(df.columns):
        raise ValueError(f"{table} has columns {sorted(stored)}, the rows have {sorted(df.columns)}")
    if _buckets(spark, table) != buckets:
        raise ValueError(f"{table} has {_buckets(spark, table)} buckets, not {buckets}")
    with open_files(spark):
        df.select(*stored).repartition(buckets, "slot_id").write.insertInto(table, overwrite=True)


def clear_run(spark: SparkSession, table: str, run: RunSpec) -> None:
    """Take one run out of a table: a write of no rows would leave the old ones."""
    scope = ", ".join(f"{name} = '{getattr(run, name)}'" for name in RUN_KEY)
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({scope})")
    # The files of a table with a folder of its own outlive their partition, so they are overwritten by no rows.
    rows = spark.table(table)
    empty = spark.createDataFrame([], rows.drop(*RUN_KEY).schema)
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({scope}) SELECT * FROM {{empty}}", empty=empty)


def _create(df: DataFrame, table: str, buckets: int, path: str | None) -> None:
    columns = [c for c in df.columns if c not in RUN_KEY]
    empty = df.sparkSession.createDataFrame([], df.select(*columns, *RUN_KEY).schema)
    writer = empty.write.partitionBy(*RUN_KEY).bucketBy(buckets, "slot_id").option("partitionOverwriteMode", "dynamic")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def _buckets(spark: SparkSession, table: str) -> int:
    described = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
    return int(described["data_type"]) if described else 0


def read_run(spark: SparkSession, table: str, run: RunSpec, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of one run, without the run columns: within a run a slot is named by its id alone.

    A join on the id keeps the layout; one on the run columns as well would shuffle both sides.
    """
    rows = spark.table(table).where(
        (F.col("scenario_id") == run.scenario_id) & (F.col("run_id") == run.run_id)
    )
    if "feature_snapshot_version" in rows.columns:
        rows = rows.where(F.col("feature_snapshot_version") == run.feature_snapshot_version)
    rows = rows.drop(*RUN_KEY, "feature_snapshot_version")
    return rows.select(*columns) if columns else rows


def tag_run(rows: DataFrame, run: RunSpec) -> DataFrame:
    """The run columns back beside joined rows."""
    return rows.withColumns(
        {
            "scenario_id": F.lit(run.scenario_id),
            "run_id": F.lit(run.run_id),
            "feature_snapshot_version": F.lit(run.feature_snapshot_version),
        }
    )


def stored_runs(spark: SparkSession, table: str) -> DataFrame:
    """Every run that the table holds with its snapshot and number of rows, newest snapshot first.

    Keys come from the partitions; of the files only the snapshot time is read, one repeated value for each of them.
    """
    return latest_runs(spark.table(table))
