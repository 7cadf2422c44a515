"""Near-duplicates of word shingles by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct 5-word shingles (of fewer words, the whole sequence), held as 64-bit digests. Shingles
are placed by one permutation; coordinate k of the signature is the smallest value of a second permutation over all places
shifted by k around the circle. Four coordinates form a band; sets of one band bucket are candidates.

No pair within a group is listed. Equal sets are one class with one representative. Then each bucket's members are compared
with the bucket's leader only, verified on full sets, and joined into components; a few rounds use other leaders. Buckets
that still hold several components are compared across components in blocks: by their signatures, then, unless the estimate
is far below the threshold, on full sets. A task returns only links that join something new. So work on a group of copies is linear, and no link is left out
because a bucket is large.

Defined cases: null, empty or blank texts have an empty set and link with nothing, not even each other; a document id that
occurs on several rows counts once, with one of its texts chosen by digest; rows with a null id are returned as they are,
unlinked; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from openchair.llm.common import Stage, blocks, pick, table
from openchair.llm.components import connected_components

WIDTH = 5
PERCENT = 75
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
LEADER_ROUNDS = 3
#: A pair at the threshold estimates lower with a chance below 1 in 10 million.
LEAST_EQUAL = int(COORDINATES * (PERCENT / 100 - 0.2))
BLOCK = 512

_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = [np.uint64(x) for x in _SEED.integers(0, 2**63, WIDTH, dtype=np.uint64) * 2 + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all words of the texts in order, and where each text's words begin (one more entry than texts)."""
    encoded = [text.encode("utf-8", "surrogatepass") for text in texts]
    data = np.frombuffer(b"\n".join([*encoded, b""]), dtype=np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    powers = _powers(int((end - begin).max(initial=0)) + 1)
    word = np.repeat(np.arange(len(begin)), end - begin)
    at = np.flatnonzero(inside)
    place = at - begin[word]
    value = _BYTE[data[at]] * powers[place]
    digests = np.add.reduceat(value, np.concatenate([[0], np.cumsum(end - begin)[:-1]])) if len(begin) else value
    stops = np.cumsum([len(x) + 1 for x in encoded])
    counts = np.searchsorted(begin, stops)
    return mix64(digests + (end - begin).astype(np.uint64)), np.concatenate([[0], counts])


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The ascending distinct shingle digests of each text."""
    words, begin = word_digests(texts)
    n = max(0, len(words) - WIDTH + 1)
    joined = np.zeros(n, dtype=np.uint64)
    for j, step in enumerate(_STEPS):
        joined += words[j : j + n] * step
    joined = mix64(joined)
    sets = []
    for a, b in zip(begin.tolist(), begin[1:].tolist()):
        if b - a >= WIDTH:
            sets.append(np.unique(joined[a : b - WIDTH + 1]))
        elif b > a:
            whole = sum((words[a + j] * _STEPS[j] for j in range(b - a)), np.uint64(b - a))
            sets.append(mix64(np.array([whole], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minima per set, none of which may be empty."""
    sizes = np.array([len(x) for x in sets])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    codes = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    places = mix32(codes ^ np.uint32(0x5BD1E995))
    out = np.empty((len(sets), COORDINATES), dtype=np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(mix32(places + np.uint32(k)), begin)
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    keys = np.empty((len(found), BANDS), dtype=np.int64)
    for band in range(BANDS):
        key = np.full(len(found), band + 1, dtype=np.uint64)
        for row in range(ROWS):
            key = mix64(key * _BASE + found[:, band * ROWS + row])
        keys[:, band] = key.view(np.int64)
    return keys


def _set_digest(values: np.ndarray) -> tuple[int, int]:
    """Two independent sums over a set, as one 128-bit name of it."""
    with np.errstate(over="ignore"):
        return tuple(int(mix64(values ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64)) for salt in (1, 2**40))


def sketch(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): doc_id, text_key, n_shingles, d1, d2 (the set's name), bands, signature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            sets = shingle_sets(texts)
            full = [i for i, x in enumerate(sets) if len(x)]
            bands: list = [None] * len(sets)
            bits: list = [None] * len(sets)
            if full:
                found = signatures([sets[i] for i in full])
                for i, keys, row in zip(full, band_keys(found), found.astype("<u2")):
                    bands[i], bits[i] = keys, row.tobytes()
            names = [_set_digest(x) for x in sets]
            columns = [
                part.column(0),
                part.column(2),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([x[0] for x in names], pa.int64()),
                pa.array([x[1] for x in names], pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(bits, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "text_key", "n_shingles", "d1", "d2", "bands", "signature"]
            )

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(
        run,
        "doc_id bigint, text_key bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, signature binary",
    )


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < PERCENT * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures do not rule out a link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2") for i in (2, 3))
                equal = (x == y).reshape(-1, COORDINATES).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(equal >= LEAST_EQUAL))

    side = sketches.select("doc_id", "n_shingles", "signature")
    joined = (
        pairs.join(side.toDF("a", "n_a", "s_a"), "a")
        .join(side.toDF("b", "n_b", "s_b"), "b")
        .where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    )
    return joined.select("a", "b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                by_id = dict(zip(a, part.column(2).to_pylist())) | dict(zip(b, part.column(3).to_pylist()))
                sets = dict(zip(by_id, shingle_sets(list(by_id.values()))))
                linked = [similar(sets[x], sets[y]) for x, y in zip(a, b)]
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    joined = pairs.join(texts.toDF("a", "t_a"), "a").join(texts.toDF("b", "t_b"), "b")
    return joined.select("a", "b", "t_a", "t_b").mapInArrow(run, "a bigint, b bigint")


def _links_across(rows: pd.DataFrame) -> pd.DataFrame:
    """Verified links between different components in two blocks of one bucket; only links that join something new.

    A pair that shares several bands is met in the first of them alone.
    """
    band = int(rows["band"].iloc[0])
    n, component, ids = (rows[name].to_numpy() for name in ("n_shingles", "component", "doc_id"))
    bits = np.frombuffer(b"".join(rows["signature"]), "<u2").reshape(-1, COORDINATES)
    before = np.stack(rows["bands"].to_list())[:, :band]
    sets = shingle_sets(rows["text"].to_list())
    one, other = np.flatnonzero(rows["one"].to_numpy()), np.flatnonzero(rows["other"].to_numpy())
    found = []
    for i in one.tolist():
        near = other[component[other] != component[i]]
        near = near[100 * np.minimum(n[near], n[i]) >= PERCENT * np.maximum(n[near], n[i])]
        near = near[(bits[near] == bits[i]).sum(axis=1) >= LEAST_EQUAL]
        near = near[~(before[near] == before[i]).any(axis=1)]
        for j in near.tolist():
            if component[i] != component[j] and similar(sets[i], sets[j]):
                found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                component[component == component[j]] = component[i]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _across_blocks(rows: DataFrame, n_blocks: DataFrame) -> DataFrame:
    """Links between different components within a bucket.

    rows: key, band, doc_id, component, n_shingles, signature, bands, text. A bucket of many blocks meets block by block,
    each pair of blocks in a task of its own.
    """
    placed = rows.join(n_blocks, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks").cast("int") - 1),
        lambda j: F.struct(
            F.least(j, F.col("block").cast("int")).alias("i"),
            F.greatest(j, F.col("block").cast("int")).alias("j"),
        ),
    )
    dealt = placed.withColumn("meet", F.explode(meets)).select(
        *rows.columns,
        "meet",
        (F.col("block") == F.col("meet.i")).alias("one"),
        (F.col("block") == F.col("meet.j")).alias("other"),
    )
    return dealt.groupBy("key", "meet").applyInPandas(_links_across, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable by links) and kept (its own component)."""
    named = pick(docs, id_col, text_col).toDF("doc_id", "text")
    sketches = stage.write(sketch(named))
    one_each = stage.write(
        sketches.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min_by(F.struct("text_key", "n_shingles", "d1", "d2"), F.struct("text_key", "n_shingles")).alias("s"))
        .select("doc_id", "s.*")
    )
    classes = one_each.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("class_id"))
    members = stage.write(
        one_each.join(classes, ["n_shingles", "d1", "d2"], "left").select(
            "doc_id", "text_key", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id")
        )
    )
    chosen = members.where("doc_id = class_id AND n_shingles > 0").select("doc_id", "text_key")
    keys = (
        sketches.join(chosen, ["doc_id", "text_key"], "left_semi")
        .dropDuplicates(["doc_id"])
        .select("doc_id", "text_key", "n_shingles", "signature", "bands")
    )
    reps = stage.write(keys)
    rows = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = stage.write(rows.join(shared, "key"))
    texts = named.withColumn("text_key", F.xxhash64("text"))

    links: DataFrame | None = None
    component = None
    for turn in range(LEADER_ROUNDS + 1):
        placed = buckets.withColumn("component", F.col("doc_id"))
        if component is not None:
            placed = buckets.join(component.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
                "doc_id", "band", "key", F.coalesce("component", "doc_id").alias("component")
            )
            mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
            placed = stage.write(placed.join(mixed.where("x != y").select("key"), "key"))
            buckets = placed.select("doc_id", "band", "key")
            if placed.isEmpty():
                break
        if turn == LEADER_ROUNDS:
            wide = placed.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
            wanted = reps.join(placed.select("doc_id").distinct(), "doc_id", "left_semi")
            own = texts.join(wanted.select("doc_id", "text_key"), ["doc_id", "text_key"], "left_semi")
            described = wanted.drop("text_key").join(own.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id")
            new = stage.write(_across_blocks(placed.join(described, "doc_id"), wide))
            links = links.unionAll(new)
            component = stage.write(connected_components(links, stage))
            break
        first = F.struct(
            (F.xxhash64("doc_id", F.lit(turn)) if turn else F.col("doc_id")).alias("h"), "doc_id", "component"
        )
        leader = placed.groupBy("key").agg(F.min(first).alias("l"))
        star = (
            placed.join(leader.select("key", "l.doc_id", "l.component").toDF("key", "b", "c"), "key")
            .where("component != c")
            .select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b"))
            .distinct()
        )
        near = _estimated(star, reps)
        near = stage.write(near)
        ends = near.select(F.col("a").alias("doc_id")).unionAll(near.select(F.col("b").alias("doc_id"))).distinct()
        wanted = reps.select("doc_id", "text_key").join(ends, "doc_id", "left_semi")
        own = texts.join(wanted, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text")
        new = stage.write(_confirmed(near, own))
        links = new if links is None else links.unionAll(new)
        component = stage.write(connected_components(links, stage))
    found = members.join(component.toDF("class_id", "component"), "class_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id")
    )
    nameless = sketches.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("bigint").alias("component_id"))
    return found.unionAll(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Stage(spark, "minhash"))
