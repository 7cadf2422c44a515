"""Helpers shared by the operators: column picking, tables in the shared folder, a bounded cache for workers."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence
from itertools import chain, islice
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application, as a zip file in the shared folder."""
    context = spark.sparkContext
    if getattr(context, "_openchair_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/code-{uuid.uuid4().hex}/{package.name}.zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(path.toString())
    context._openchair_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name and position, so that extra columns of clashing names do no harm."""
    ship(df.sparkSession)
    columns = df.columns
    places = [columns.index(name) for name in names]
    plain = df.toDF(*(f"_extra_{i}" for i in range(len(columns))))
    chosen = [F.col(f"_extra_{i}").alias(name) for i, name in zip(places, names)]
    return plain.select(*chosen)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"


class Stage:
    """Tables of one job in the shared folder. Writing one cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0

    def write(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table that this stage wrote and nothing reads any more."""
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if self.root.split("://", 1)[-1].lstrip("/") in folder:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def blocks(batches: Iterable, most_rows: int = 512, most_chars: int = 2_000_000, text: int = 1) -> Iterator[tuple]:
    """(slice of a batch, its texts) of bounded size; nulls as empty texts."""
    for batch in batches:
        texts = ["" if value is None else value for value in batch.column(text).to_pylist()]
        begin = chars = 0
        for i, value in enumerate(texts):
            chars += len(value)
            if chars >= most_chars or i + 1 - begin >= most_rows or i + 1 == len(texts):
                yield batch.slice(begin, i + 1 - begin), texts[begin : i + 1]
                begin, chars = i + 1, 0


class WorkerCache:
    """Memo of a pure function in a Python worker. Two generations bound its size; dropping entries costs only time."""

    def __init__(self, compute: Callable[[Sequence[Hashable]], Sequence], limit: int = 300_000):
        self.compute, self.limit = compute, limit
        self.young: dict = {}
        self.old: dict = {}

    def many(self, keys: Sequence[Hashable]) -> list:
        self._fill(set(keys).difference(self.young))
        found = list(map(self.young.__getitem__, keys))
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return found

    def grouped(self, groups: Sequence[Sequence[Hashable]]) -> list[list]:
        """Values of many groups of keys, with one computation for all that are missing."""
        values = iter(self.many(list(chain.from_iterable(groups))))
        return [list(islice(values, len(group))) for group in groups]

    def _fill(self, missing: set) -> None:
        new = []
        for key in missing:
            value = self.old.get(key)
            if value is None:
                new.append(key)
            else:
                self.young[key] = value
        if new:
            self.young.update(zip(new, self.compute(new)))
