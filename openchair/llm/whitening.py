"""Whitening of embeddings: projection on the leading components, each scaled to variance one.

Entries are put on a grid of whole numbers, `floor(64 * c) + 1000000`, so that sums and products over any number of rows are
exact and do not depend on the order of tasks. Three passes over the vectors: sums, covariance (products of entries less the
rounded mean, then set right for the rest of the mean), and the covariance of the result as its check. Tasks hand over one
small matrix each; the driver holds one matrix of the dimension squared and finds its leading eigenpairs by `spectrum`.

Defined cases: a vector that is null or empty, or holds a null, a NaN or an infinite entry is dropped; so is one with an entry
beyond 2**34, for which the squared deviations fit no long. Where lengths differ, the most common one (of equals the
longest) is whitened and other vectors are dropped. Components whose variance rounding cannot tell from zero are left out, so
equal vectors, or a single one, give no rows. A deviation beyond a long is null, never wrapped. Rows of equal or null ids are
whitened one by one; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from openchair.llm.common import Stage, pick, table
from openchair.llm.spectrum import leading

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
_MOST = 2.0**40  # of a scaled entry
_EXACT = 2.0**53  # whole numbers up to here are exact as doubles
_ROWS = 4096
_LENGTHS = 64


def _scaled(vectors: pa.ListArray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of this length, and their entries as floor(64 * c)."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(lengths == length)
    begins = vectors.offsets.to_numpy()[places]
    entries = vectors.values.to_numpy(zero_copy_only=False)  # null entries become NaN
    grid = np.floor(entries[begins[:, None] + np.arange(length)].astype(np.float64) * SCALE)
    usable = (np.abs(grid) < _MOST).all(axis=1)
    return places[usable], grid[usable].astype(np.int64)


def _whole(values: Iterable[int]) -> pa.Array:
    return pa.array([int(v) for v in values], pa.decimal128(38, 0))


def _sums(vectors: DataFrame) -> DataFrame:
    """length, n and at (entry number, -1 for none) with total: sums of scaled entries for each length of vector."""

    def rows(totals: dict) -> Iterator[pa.RecordBatch]:
        for length, (n, sums) in totals.items():
            at = pa.array(np.arange(-1, length), pa.int32())
            lengths = pa.array(np.full(length + 1, length), pa.int32())
            yield pa.RecordBatch.from_arrays([lengths, at, _whole([n, *sums])], names=["length", "at", "total"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            for length in pc.unique(pc.list_value_length(batch.column(0)).drop_null()).to_pylist():
                places, grid = _scaled(batch.column(0), length)
                if length and len(places):
                    n, sums = totals.get(length, (0, np.zeros(length, dtype=object)))
                    totals[length] = n + len(places), sums + grid.sum(axis=0)
            if len(totals) > _LENGTHS:
                yield from rows(totals)
                totals = {}
        yield from rows(totals)

    partial = vectors.mapInArrow(run, "length int, at int, total decimal(38,0)")
    return partial.groupBy("length", "at").agg(F.sum("total").alias("total"))


def _products(vectors: DataFrame, length: int, centre: np.ndarray) -> DataFrame:
    """at (place in the upper triangle) and total: exact sums of products of entries less the rounded mean."""
    upper = np.triu_indices(length)

    def rows(total: np.ndarray) -> pa.RecordBatch:
        at = pa.array(np.arange(len(upper[0])), pa.int32())
        return pa.RecordBatch.from_arrays([at, _whole(total[upper].tolist())], names=["at", "total"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bound = np.zeros((length, length)), 0.0
        for batch in batches:
            _, grid = _scaled(batch.column(0), length)
            for begin in range(0, len(grid), _ROWS):
                block = grid[begin : begin + _ROWS] - centre
                most = float(np.abs(block).max()) ** 2 * len(block)
                if most >= _EXACT:
                    wide = block.astype(object)
                    yield rows(wide.T @ wide)
                    continue
                if bound + most >= _EXACT:
                    yield rows(total)
                    total, bound = np.zeros((length, length)), 0.0
                as_double = block.astype(np.float64)
                total, bound = total + as_double.T @ as_double, bound + most
        if bound:
            yield rows(total)

    partial = vectors.mapInArrow(run, "at int, total decimal(38,0)")
    return partial.groupBy("at").agg(F.sum("total").alias("total"))


@dataclass(frozen=True)
class Whitening:
    """What a fit over n vectors keeps: the mean as `centre + rest / n`, and the components as columns with variances."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def length(self) -> int:
        return len(self.centre)

    def project(self, grid: np.ndarray) -> np.ndarray:
        return ((grid - self.centre) - self.rest / self.n) @ (self.axes / np.sqrt(self.variances))

    def deviations(self, grid: np.ndarray) -> list[int | None]:
        """For each row the sum over entries of (n * x - sum of x) ** 2, exact."""
        far = int(np.abs(grid - self.centre).max(initial=0)) + 1
        if self.n**2 * far**2 * self.length < 2**63:
            return ((self.n * (grid - self.centre) - self.rest) ** 2).sum(axis=1).tolist()
        wide = (self.n * (grid - self.centre).astype(object) - self.rest.astype(object)) ** 2
        return [int(v) if v < 2**63 else None for v in wide.sum(axis=1)]


def fit(df: DataFrame, stage: Stage, vec_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors, or None if there are none or they do not vary."""
    vectors = pick(df, vec_col)
    sums = stage.write(_sums(vectors))
    common = sums.where("at = -1").orderBy(F.desc("total"), F.desc("length")).first()
    if common is None:
        return None
    n, length = int(common["total"]), common["length"]
    found = sums.where((F.col("length") == length) & (F.col("at") >= 0)).orderBy("at").collect()
    totals = [int(row["total"]) for row in found]
    centre = np.array([(2 * t + n) // (2 * n) for t in totals], dtype=np.int64)
    rest = [t - n * int(c) for t, c in zip(totals, centre)]
    products = {row["at"]: int(row["total"]) for row in _products(vectors, length, centre).collect()}
    covariance = np.zeros((length, length))
    for at, (i, j) in enumerate(zip(*np.triu_indices(length))):
        covariance[i, j] = covariance[j, i] = (n * products.get(at, 0) - rest[i] * rest[j]) / n**2
    variances, axes = leading(covariance, components)
    if not len(variances):
        return None
    return Whitening(n, centre, np.array(rest), axes, variances, float(np.trace(covariance)))


def identity_error(df: DataFrame, fitted: Whitening, vec_col: str = "embedding") -> float:
    """The largest entry by which the covariance of the whitened rows differs from the identity."""
    k = len(fitted.variances)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))  # the last row has plain sums
        for batch in batches:
            _, grid = _scaled(batch.column(0), fitted.length)
            for begin in range(0, len(grid), _ROWS):
                rows = fitted.project(grid[begin : begin + _ROWS])
                total += np.vstack([rows.T @ rows, rows.sum(axis=0)])
        at = pa.array(np.arange(total.size), pa.int32())
        yield pa.RecordBatch.from_arrays([at, pa.array(total.ravel())], names=["at", "total"])

    partial = pick(df, vec_col).mapInArrow(run, "at int, total double")
    found = dict(partial.groupBy("at").agg(F.sum("total").alias("total")).collect())
    total = np.array([found[i] for i in range((k + 1) * k)]).reshape(k + 1, k) / fitted.n
    covariance = total[:k] - np.outer(total[k], total[k])
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(df: DataFrame, fitted: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per usable vector and component: the id, component, deviation and whitened."""
    k = len(fitted.variances)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, grid = _scaled(batch.column(1), fitted.length)
            for begin in range(0, len(places), _ROWS):
                rows = grid[begin : begin + _ROWS]
                each = np.repeat(np.arange(len(rows)), k)
                columns = [
                    batch.column(0).take(pa.array(places[begin : begin + _ROWS][each])),
                    pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                    pa.array(fitted.deviations(rows), pa.int64()).take(pa.array(each)),
                    pa.array(fitted.project(rows).ravel()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "deviation", "whitened"])

    vectors = pick(df, id_col, vec_col)
    kind = vectors.schema[0].dataType.simpleString()
    found = vectors.mapInArrow(run, f"id {kind}, component int, deviation bigint, whitened double")
    return found.withColumnRenamed("id", id_col)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitened_report(vectors, Stage(spark, "whitening"))


def whitened_report(vectors: DataFrame, stage: Stage) -> DataFrame:
    """The whitened rows with the figures of their fit beside them."""
    fitted = fit(vectors, stage)
    if fitted is None:
        nothing = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        kind = pick(vectors, "vec_id").schema[0].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, {nothing}")
    explained = F.array(*[F.lit(float(v / fitted.trace)) for v in fitted.variances])
    return whiten(vectors, fitted).select(
        "vec_id",
        "component",
        F.lit(fitted.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("component")).alias("explained"),
        F.lit(identity_error(vectors, fitted)).alias("identity_error"),
    )
