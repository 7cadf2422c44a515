"""Near-duplicate vectors by a pivot-permutation index.

Each vector is described by its `NEAREST` nearest reference points in their order. Inverted lists hold the vectors of a label
that have a reference point near, or two points where the list of one has more than `BLOCK` vectors. Within a list, pairs that
share at least `LEAST_SHARED` points are candidates, and only candidates are verified by cosine in double precision. Around a tight group every other point is about as far, so its members may
share few: vectors within `APART` of their first point also stand in a list of that point alone, whose pairs are all verified.
A pair is missed only if it shares fewer points and is not tight around one.

Equal vectors of a label are one entry with a count. Lists of one vector end before vectors are sent. Long lists are cut into
blocks that meet pairwise, each pair of blocks in a task of its own; a task returns a count of links per vector and a spanning
set of its links, never all pairs.

Reference points are vectors of the table, drawn by a digest of their ids; one within `APART` of another is skipped, so a tight
group supplies few of them and its members share these. There are as many as the square root of the number of vectors, and from
`MANY` vectors on as its fourth root times that of `MANY`, so that lists of two points grow with the square root; every vector is
indexed.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows without a label, link with nothing;
rows with a null id too; repeated rows of one id count as one row, of its smallest usable label and vector;
vectors of different lengths never link; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from openchair.llm.common import Stage, pick, table
from openchair.llm.components import connected_components
from openchair.operators.joins import attach

LEAST_COSINE = 0.98
NEAREST = 6
LEAST_SHARED = 3
MIN_PIVOTS, MANY = 16, 1 << 20
APART = 0.9  # reference points have a cosine below it to each other
DRAWN = 8  # vectors looked at for each reference point wanted
BLOCK = 1024


def usable(embedding: str = "embedding", label: str = "label"):
    values = F.col(embedding)
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(
        F.col("vec_id").isNotNull() & F.col(label).isNotNull() & finite & F.exists(values, lambda x: x != 0), F.lit(False)
    )


def unit_rows(vectors: list | np.ndarray) -> np.ndarray:
    """Rows of one width, scaled to length 1 without overflow."""
    rows = np.array(vectors, dtype=np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def describe(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds near, the numbers of the nearest reference points of the vector's width, nearest first, and tight."""
    names = [field.name for field in vectors.schema]
    at = names.index("embedding")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(at).to_pylist()
            near: list = [[] for _ in values]
            tight = np.zeros(len(values), dtype=bool)
            by_width: dict[int, list[int]] = {}
            for i, value in enumerate(values):
                by_width.setdefault(len(value), []).append(i)
            for width, rows in by_width.items():
                close = unit_rows([values[i] for i in rows]) @ pivots[width].T
                order = np.argsort(-close, axis=1, kind="stable")[:, :NEAREST]
                tight[rows] = (close.max(axis=1) >= APART) | (close.shape[1] == 1)
                for i, found in zip(rows, order.tolist()):
                    near[i] = found
            columns = [*batch.columns, pa.array(near, pa.list_(pa.int32())), pa.array(tight)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "near", "tight"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{schema}, near array<int>, tight boolean")


def wanted_pivots(n: int) -> int:
    return max(MIN_PIVOTS, math.isqrt(n) if n <= MANY else math.isqrt(math.isqrt(n) * math.isqrt(MANY)))


def choose_pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Unit reference points by vector width, apart from each other, out of a bounded sample by digest."""
    sizes = vectors.groupBy(F.size("embedding").alias("width")).count().collect()
    out = {}
    for width, n in sizes:
        wanted = wanted_pivots(n)
        digest = F.xxhash64("vec_id")
        # Only about twice the drawn rows are sorted; they hold the smallest digests.
        most = int(min(1.0, 2 * DRAWN * wanted / n) * (2**64 - 1)) - 2**63
        low = vectors.where((F.size("embedding") == width) & (digest <= F.lit(min(most, 2**63 - 1))))
        rows = low.orderBy(digest, "vec_id").limit(DRAWN * wanted)
        drawn = rows.select("embedding").toArrow().column(0).combine_chunks().flatten().to_numpy().reshape(-1, width)
        out[width] = spread(unit_rows(drawn), wanted)
    return out


def spread(units: np.ndarray, wanted: int) -> np.ndarray:
    """The first rows, up to `wanted`, that have no earlier chosen one within `APART`."""
    chosen, n = np.empty((wanted, units.shape[1])), 0
    for unit in units:
        if n == wanted:
            break
        if not (chosen[:n] @ unit >= APART).any():
            chosen[n] = unit
            n += 1
    return chosen[:n]


def _spanning(pairs: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs join two parts not joined by earlier ones."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = np.zeros(len(pairs), dtype=bool)
    for i, (a, b) in enumerate(pairs.tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[b], keep[i] = a, True
    return keep


def _own(x: np.ndarray, y: np.ndarray, near: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows whose first shared point, by number, is p, and whose second is q unless that is -1."""
    keep = np.zeros(len(x), dtype=bool)
    for i in range(0, len(x), 65536):
        mine, theirs = near[x[i : i + 65536]], near[y[i : i + 65536]]
        both = (mine[:, :, None] == theirs[:, None, :]).any(axis=2)
        keep[i : i + 65536] = ~(both & (mine < max(p, q)) & (mine != p)).any(axis=1)
    return x[keep], y[keep]


def shared_points(near: np.ndarray):
    """A function of two lists of rows that counts the points each pair of them shares."""
    points, place, count = np.unique(near, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count > 1)
    column = np.full(len(points), len(often))
    column[often] = np.arange(len(often))
    holds = np.zeros((len(near), len(often) + 1), dtype=np.float32)
    holds[np.arange(len(near))[:, None], column[place.reshape(near.shape)]] = 1
    holds = holds[:, :-1]
    return lambda a, b: holds[a] @ holds[b].T


def compare_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the rows of block `one` and those of block `other` in one list.

    The list is that of point `p` (`q` is -1), of the points `p` and `q`, or of those tight around `p` (`q` is `p`).

    Returns rows (id, links, partner): a count of links per vector with a null partner, and spanning links with 0.
    """
    p, q = int(rows["p"].iloc[0]), int(rows["q"].iloc[0])
    ids, counts = rows["vec_id"].to_numpy(), rows["copies"].to_numpy()
    near = np.stack(rows["near"].to_list())
    around = np.where(rows["tight"], near[:, 0], -1)  # the point a vector is tight around
    shared = shared_points(near)
    units = unit_rows(rows["embedding"].to_list())
    one, other = np.flatnonzero(rows["one"]), np.flatnonzero(rows["other"])
    same = len(one) == len(other) and (one == other).all()
    links = np.zeros(len(rows), dtype=np.int64)
    pairs = [np.empty((0, 2), dtype=np.int64)]
    for at in range(0, len(one), 256):
        a = one[at : at + 256]
        open_ = a[:, None] < other[None, :] if same else a[:, None] != other[None, :]
        # The list around a point has all its pairs; the other lists have the others that share enough.
        if p != q:
            open_ &= shared(a, other) >= min(LEAST_SHARED, near.shape[1])
            open_ &= (around[a][:, None] != around[other][None, :]) | (around[a] < 0)[:, None]
        x, y = np.nonzero(open_)
        if not len(x):
            continue
        x, y = a[x], other[y]
        if p != q:  # a pair is handled in the list of the first point it shares, or of the first two
            x, y = _own(x, y, near, p, q)
        if len(x) > len(a) * len(other) / 8:
            close = (units[a] @ units[other].T)[np.searchsorted(a, x), np.searchsorted(other, y)]
        else:
            close = np.concatenate([(units[x[i : i + 65536]] * units[y[i : i + 65536]]).sum(axis=1) for i in range(0, len(x) or 1, 65536)])
        found = close >= LEAST_COSINE
        for i in np.flatnonzero(np.abs(close - LEAST_COSINE) < 1e-12):  # the sum must not depend on the block's shape
            found[i] = (units[x[i]] * units[y[i]]).sum() >= LEAST_COSINE
        x, y = x[found], y[found]
        links += np.bincount(x, weights=counts[y], minlength=len(rows)).astype(np.int64)
        links += np.bincount(y, weights=counts[x], minlength=len(rows)).astype(np.int64)
        # Rows linked to one y are joined through the first of them, which keeps the pairs few.
        ends, first, place = np.unique(y, return_index=True, return_inverse=True)
        hubs = np.divmod(np.unique(x * len(rows) + x[first][place]), len(rows))
        new = np.concatenate([np.stack([x[first], ends], axis=1), np.stack(hubs, axis=1)])
        pairs.append(new[_spanning(new, len(rows))])
    joined = np.concatenate(pairs)
    joined = joined[_spanning(joined, len(rows))]
    hit = np.flatnonzero(links)
    return pd.DataFrame(
        {
            "id": np.concatenate([ids[hit], ids[joined[:, 0]]]),
            "links": np.concatenate([links[hit], np.zeros(len(joined), dtype=np.int64)]),
            "partner": pd.array(np.concatenate([np.full(len(hit), -1), ids[joined[:, 1]]]), dtype="Int64"),
            "is_link": np.concatenate([np.zeros(len(hit), dtype=bool), np.ones(len(joined), dtype=bool)]),
        }
    )


def near_vectors(vectors: DataFrame, stage: Stage) -> DataFrame:
    """vectors: vec_id, embedding, label. Per vector: vec_id, n_links, component_id and kept."""
    named = pick(vectors, "vec_id", "embedding", "label").withColumn(
        "embedding", F.col("embedding").cast("array<double>")
    )
    chosen = named.where(usable()).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("one"))
    good = stage.write(chosen.select("vec_id", "one.label", "one.embedding"))
    classes = stage.write(
        good.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    )
    described = stage.write(describe(classes, choose_pivots(classes)))
    links = _links(described)
    links = stage.write(links)
    counted = links.where("NOT is_link").groupBy(F.col("id").alias("class_id")).agg(F.sum("links").alias("n"))
    edges = links.where("is_link").select(F.col("id").alias("a"), F.col("partner").alias("b"))
    component = connected_components(edges, stage).withColumnRenamed("id", "class_id")
    per_class = (
        classes.withColumnRenamed("vec_id", "class_id")
        .join(counted, "class_id", "left")
        .join(component, "class_id", "left")
        .select(
            "label",
            "embedding",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "class_id").alias("component_id"),
        )
    )
    linked = good.join(per_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = (
        named.join(good.select("vec_id"), "vec_id", "left_anti")
        .select("vec_id")
        .distinct()
        .select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    )
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(described: DataFrame) -> DataFrame:
    vectors = described.select("label", F.size("embedding").alias("width"), "vec_id", "near", "tight")
    first = vectors.withColumn("p", F.explode("near"))
    long = first.groupBy("label", "width", "p").agg((F.count("*") > BLOCK).alias("long"))
    first = attach(first, long, ["label", "width", "p"], ["vec_id"], how="inner")
    seconds = F.when(F.col("long"), F.filter("near", lambda i: i > F.col("p"))).otherwise(F.array(F.lit(-1)))
    around = F.when(F.col("tight") & (F.get("near", F.lit(0)) == F.col("p")), F.array("p")).otherwise(F.array().cast("array<int>"))
    key = ["label", "width", "p", "q"]
    listed = first.select("label", "width", "p", F.explode(F.concat(seconds, around)).alias("q"), "vec_id")
    sizes = listed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = attach(listed, sizes, key, ["vec_id"], how="inner")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")),
    )
    dealt = placed.join(described.drop("label"), "vec_id").withColumn("meet", F.explode(meets))
    dealt = dealt.select(
        *key,
        "meet",
        "vec_id",
        "copies",
        "embedding",
        "near",
        "tight",
        (F.col("block") == F.col("meet.i")).alias("one"),
        (F.col("block") == F.col("meet.j")).alias("other"),
    )
    return dealt.groupBy(*key, "meet").applyInPandas(
        compare_blocks, "id bigint, links bigint, partner bigint, is_link boolean"
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), Stage(spark, "pivots"))
