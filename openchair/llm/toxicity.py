"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are positives; all other training rows, whatever their label, count as unlabelled. A linear model
over words and word beginnings is fitted with the risk `prior * R+(p) + max(0, R-(u) - prior * R-(p))`, so that positives
hidden among the unlabelled rows do not count as clean. Only the fit runs on the driver, over a sample of bounded size
chosen by a digest of the id; scoring reads every whole text.

Features of a text are its distinct words (runs of letters and digits, in lower case) and their first 3 to 8 characters,
valued by the logarithm of how many of the words give them. The ones kept are those whose share among positives exceeds that
among clean rows by the most, where the share among clean rows is that of unlabelled rows less the hidden positives.

Defined cases: a null or empty text has no features and gets the score of the bias; labels of null or of documents that are
not there are ignored, a document labelled twice is toxic if one label says so; without positives every score is 0; repeated rows
are scored one by one; empty tables give no rows; other columns are ignored by `score` and kept by `keep_clean`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from openchair.llm.common import Stage, pick, ship, table

MAX_POSITIVES = 4000
MAX_UNLABELLED = 8000
MAX_FEATURES = 4000
MIN_POSITIVE_ROWS = 3
MIN_POSITIVE_SHARE = 0.005
MIN_GAIN = 3.5  # standard errors
MIN_LIFT = 5.0
BEGINNINGS = range(3, 9)
THRESHOLD = 0.7
STEPS = 400
RATE = 0.1
PENALTY = 1e-4
_WORD = re.compile(r"[^\W_]+")


def features(text: str | None) -> Counter:
    """Words as they are, beginnings with a mark; how many distinct words give each."""
    words = set(_WORD.findall((text or "").lower()))
    found = Counter(words)
    for size in BEGINNINGS:
        found.update([f"{word[:size]}-" for word in words if len(word) > size])
    return found


@dataclass
class Model:
    bias: float = float("-inf")
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        if self.bias == float("-inf"):
            return 0.0
        words = set(_WORD.findall((text or "").lower()))
        known = self.weights
        found = Counter(word for word in words if word in known)
        for size in BEGINNINGS:
            found.update([mark for word in words if len(word) > size and (mark := f"{word[:size]}-") in known])
        total = self.bias + sum(known[name] * np.log2(1 + found[name]) for name in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


Entries = tuple[np.ndarray, np.ndarray, np.ndarray]  # row, column, value


def fit(positive: Entries, unlabelled: Entries, n_p: int, n_u: int, names: list[str], prior: float) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss. prior: the share of positives among unlabelled."""
    size = len(names)
    w, bias = np.zeros(size), -1.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)

    def logits(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return bias + np.bincount(row, weights=w[col] * value, minlength=n)

    def gradient(row: np.ndarray, col: np.ndarray, value: np.ndarray, per_row: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(col, weights=per_row[row] * value, minlength=size), per_row.sum())

    for step in range(1, STEPS + 1):
        z_p, z_u = logits(*positive, n_p), logits(*unlabelled, n_u)
        p_p, p_u = _sigmoid(z_p), _sigmoid(z_u)
        as_clean = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        negative = gradient(*unlabelled, p_u / n_u) - prior * gradient(*positive, p_p / n_p)
        if as_clean >= 0:
            g = prior * gradient(*positive, (p_p - 1) / n_p) + negative
        else:  # the corrected risk of clean rows fell below zero: step back from over-fitting it
            g = -negative
        g[:-1] += PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - change[:-1], bias - change[-1]
    return Model(float(bias), dict(zip(names, w.tolist())))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are not learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _feature_counts(rows: DataFrame) -> DataFrame:
    """feature, p and u: in how many positive and unlabelled rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(), Counter()
            for text, positive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[positive].update(features(text).keys())
            names = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(names, pa.string())]
            columns += [pa.array([counts[i][name] for name in names], pa.int64()) for i in (1, 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "p", "u"])

    found = rows.select("text", "positive").mapInArrow(run, "feature string, p bigint, u bigint")
    return found.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def choose_features(rows: DataFrame, n_p: int, n_u: int, prior: float) -> list[str]:
    p, u = F.col("p") / n_p, F.col("u") / n_u
    clean = F.greatest((u - prior * p) / (1 - prior), F.lit(0.0))
    spread = F.sqrt((p * (1 - p) + 0.5 / n_p) / n_p + (clean * (1 - clean) + 0.5 / n_u) / n_u)
    useful = (
        _feature_counts(rows)
        .where(F.col("p") >= max(MIN_POSITIVE_ROWS, MIN_POSITIVE_SHARE * n_p))
        .select("feature", ((p - clean) / spread).alias("gain"), (p / (clean + 1 / n_u)).alias("lift"))
        .where((F.col("gain") >= MIN_GAIN) & (F.col("lift") >= MIN_LIFT))
    )
    return [row[0] for row in useful.orderBy(F.desc("gain"), "feature").limit(MAX_FEATURES).collect()]


def _entries(rows: DataFrame, names: list[str]) -> Entries:
    """The chosen features of the rows as a sparse matrix, rows in the order of their ids."""
    place = {name: i for i, name in enumerate(names)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [sorted((place[f], n) for f, n in features(t).items() if f in place) for t in batch.column(1).to_pylist()]
            columns = [
                pa.array([[x[i] for x in row] for row in kept], pa.list_(pa.int32())) for i in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "at", "n"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, at array<int>, n array<int>").toArrow()
    found = found.sort_by("doc_id")
    sizes = [len(x) for x in found["at"].to_pylist()]
    flat = [np.array([x for row in found[name].to_pylist() for x in row], dtype=np.int64) for name in ("at", "n")]
    return np.repeat(np.arange(len(sizes)), sizes), flat[0], np.log2(1 + flat[1])


def train(docs: DataFrame, labels: DataFrame, stage: Stage) -> Model:
    """A model from bounded samples of both classes, out of rows that are not held out.

    Unlabelled rows are drawn from all rows, positives among them, so that the share of confirmed positives among labelled
    rows is the prior.
    """
    named = pick(docs, "doc_id", "text").where(~held_out(F.col("doc_id")))
    known = pick(labels, "doc_id", "toxic").where("toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    present = named.select("doc_id").where("doc_id IS NOT NULL").distinct()
    known = stage.write(
        known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(present, "doc_id", "left_semi")
    )
    n_known, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic:
        return Model()
    prior = min(0.9, max(0.001, n_toxic / n_known))

    def sample(ids: DataFrame, most: int, positive: int) -> DataFrame:
        """The rows of the ids that come first by digest; only ids are sorted."""
        chosen = ids.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        rows = named.join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        return rows.withColumn("positive", F.lit(positive))

    rows = stage.write(
        sample(known.where("toxic = 1"), MAX_POSITIVES, 1).unionAll(sample(present, MAX_UNLABELLED, 0))
    )
    counts = dict(rows.groupBy("positive").count().collect())
    n_p, n_u = counts[1], counts[0]
    names = choose_features(rows, n_p, n_u, prior)
    return fit(*(_entries(rows.where(F.col("positive") == i), names) for i in (1, 0)), n_p, n_u, names, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and score."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    named = pick(docs, id_col, text_col)
    return named.mapInArrow(run, f"doc_id {named.schema[0].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose texts score below the threshold."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [model.score(text) < threshold for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    plain = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels"), Stage(spark, "toxicity")))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
