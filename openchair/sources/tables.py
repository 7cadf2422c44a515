"""Stored tables, partitioned by run."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from openchair.params import RUN_KEY, RunSpec
from openchair.operators.quality import require_clean


def scan_scoped(
    table: DataFrame, runs: Iterable[RunSpec], columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows of the given runs. Over a table partitioned by run this prunes partitions."""
    chosen = F.lit(False)
    for run in runs:
        chosen = chosen | (
            (F.col("scenario_id") == run.scenario_id) & (F.col("run_id") == run.run_id)
        )
    rows = table.where(chosen)
    return rows.select(*columns) if columns else rows


def read_scoped(
    spark: SparkSession,
    path: str,
    runs: Iterable[RunSpec],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    return scan_scoped(spark.read.parquet(path), runs, columns)


def write_scoped(df: DataFrame, path: str, by: Sequence[str] = RUN_KEY) -> None:
    """Replace the partitions present in ``df`` and leave all others alone."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def replace_scope(df: DataFrame, path: str, scope: Mapping[str, str]) -> None:
    """Replace exactly one partition, also when ``df`` has no rows for it.

    A dynamic overwrite would keep the old files of a partition that became empty.
    """
    condition = F.lit(True)
    for column, value in scope.items():
        condition = condition & (F.col(column) == value)
    folder = "/".join(f"{column}={value}" for column, value in scope.items())
    df.where(condition).drop(*scope).write.mode("overwrite").parquet(f"{path}/{folder}")


def write_checked(
    rules: DataFrame, tables: Mapping[str, DataFrame], by: Mapping[str, Sequence[str]]
) -> None:
    """Write a batch only if no rule fails; ``tables`` maps each path to its rows."""
    require_clean(rules)
    for path, df in tables.items():
        write_scoped(df, path, by[path])
