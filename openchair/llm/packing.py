"""Best-fit packing by a configuration linear program over the histogram of piece lengths.

Only the histogram, at most `capacity` counts, comes to the driver. There a fractional cover by configurations (which
lengths share a sequence) is found by multiplicative weights: lengths covered least get the highest prices, a knapsack
dynamic program prices configurations, and each step adds enough of one to raise the coverage of its lengths by a
fixed share. Whole multiples of the configurations are kept; what rounding leaves is placed best fit, longest first. Every
piece then finds its place from its rank among the pieces of its length, so no task sees more than a bucket of them.

Defined cases: a null or empty text is one piece of the end id alone; texts of more than the capacity are cut into full
pieces of which only the first may be shorter; repeated rows are packed one by one; an empty table gives no rows; columns other
than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from openchair.llm.common import Stage, WorkerCache, blocks, pick, table
from openchair.llm.pieces import FED_WORD, WORD, PartIds, cut_marks, lay_parts, looked_up, whole

CAPACITY = 2048
END_ID = 0
SHARE = 0.05  # how far one step raises the coverage of a length
ETA = 8.0  # how fast a price falls with coverage
PATTERNS_PER_ROUND = 192
MOST_ROUNDS = 400
BUCKET_ROWS = 50_000
CACHED = 400_000  # words whose ids a worker keeps
WORDS_AT_ONCE = 512
# Bounds of a block of texts: a word is looked up once in each.
BLOCK_ROWS, BLOCK_CHARS = 2048, 4_000_000
WRITTEN = {" ": "\u0120", "\n": "\u010a"}  # how the vocabulary file writes a space and a line feed
NOTHING = pa.scalar(b"", pa.large_binary())

Config = tuple[tuple[int, int], ...]  # (length, copies), longest first


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best price of every capacity, and the index of the length taken last there (-1: none)."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    lengths, prices = lengths[order], prices[order]
    usable = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        n = usable[room]
        if n:
            values = prices[:n] + best[room - lengths[:n]]
            top = int(values.argmax())
            if values[top] > best[room]:
                best[room], taken[room] = values[top], order[top]
        if best[room - 1] > best[room]:
            best[room], taken[room] = best[room - 1], -2
    return best, taken


def _fill(taken: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    chosen = []
    while room > 0 and taken[room] != -1:
        if taken[room] == -2:
            room -= 1
        else:
            chosen.append(int(taken[room]))
            room -= int(lengths[taken[room]])
    return chosen


def fractional_cover(histogram: dict[int, int], capacity: int) -> dict[Config, float]:
    """How often each configuration is used in a fractional cover of all lengths."""
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[int(x)] for x in lengths], dtype=float)
    covered = np.zeros(len(lengths))
    used: Counter = Counter()
    for _ in range(MOST_ROUNDS):
        if covered.min() >= 1:
            break
        # The weight of a token falls with the coverage of its length; what is covered is worth nothing.
        prices = np.where(covered < 1, lengths * np.exp(-ETA * (covered - covered.min())), 0.0)
        _, taken = knapsack(lengths, prices, capacity)
        behind = np.argsort(covered - 1e-6 * lengths, kind="stable")[:PATTERNS_PER_ROUND]
        for first in behind.tolist():
            if covered[first] >= 1:
                continue
            chosen = Counter([first, *_fill(taken, lengths, capacity - int(lengths[first]))])
            index = np.fromiter(chosen, dtype=np.int64)
            copies = np.fromiter(chosen.values(), dtype=float)
            step = SHARE * (demand[index] / copies).min()
            used[tuple(sorted(((int(lengths[i]), n) for i, n in chosen.items()), reverse=True))] += step
            covered[index] += step * copies / demand[index]
    return dict(used)


def rounded(cover: dict[Config, float], histogram: dict[int, int], capacity: int) -> tuple[Counter, Counter]:
    """Whole multiples of configurations within the demand, and the lengths left over."""
    left = Counter(histogram)
    plan: Counter = Counter()

    def fill(config: Config) -> int:
        return sum(length * n for length, n in config)

    for config in sorted(cover, key=lambda c: (fill(c), cover[c]), reverse=True):
        most = min(left[length] // n for length, n in config)
        wanted = int(cover[config]) if fill(config) < capacity else int(np.ceil(cover[config]))
        times = min(most, wanted)
        if times > 0:
            plan[config] += times
            for length, n in config:
                left[length] -= n * times
    return plan, +left


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Longest first into the fullest sequence with room; equal sequences are handled together."""
    rooms: dict[int, Counter] = {}
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                copies = min(n, capacity // length)
                times = n // copies
                rooms.setdefault(capacity - copies * length, Counter())[((length, copies),)] += times
                n -= times * copies
                continue
            config, count = next(iter(rooms[room].items()))
            times = min(n, count)
            grown = dict(config)
            grown[length] = grown.get(length, 0) + 1
            rooms[room][config] -= times
            if not rooms[room][config]:
                del rooms[room][config]
            if not rooms[room]:
                del rooms[room]
            rooms.setdefault(room - length, Counter())[tuple(sorted(grown.items(), reverse=True))] += times
            n -= times
    return sum(rooms.values(), Counter())


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Configurations and how many sequences use each; every piece is in exactly one."""
    if not histogram:
        return Counter()
    plan, left = rounded(fractional_cover(histogram, capacity), histogram, capacity)
    return plan + best_fit(left, capacity)


def place_table(plan: dict[Config, int]) -> dict[str, np.ndarray]:
    """Where ranks of each length go: from `first` on, `copies` of them to each sequence from `sequence` on, at `offset`."""
    rows, sequence = [], 0
    next_rank: Counter = Counter()
    for config, times in sorted(plan.items(), reverse=True):
        offset = 0
        for length, copies in config:
            rows.append((length, next_rank[length], copies, sequence, offset))
            next_rank[length] += copies * times
            offset += length * copies
        sequence += times
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "copies", "sequence", "offset"), columns))


def place(lengths: np.ndarray, ranks: np.ndarray, places: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by their lengths and their ranks among those of that length."""
    keys = places["length"] << 44 | places["first"]
    at = np.searchsorted(keys, lengths << 44 | ranks, side="right") - 1
    beyond = ranks - places["first"][at]
    copies = places["copies"][at]
    return places["sequence"][at] + beyond // copies, places["offset"][at] + beyond % copies * lengths


def joined(parts: pa.Array, between: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts), between)[0].as_py()


class Tokenizer:
    """Ids of a byte-level tokenizers file. Parts of texts repeat and are looked up, within a bound.

    Marks at the end of a word are encoded apart from it, as the pattern does, so a word is new only once. New words are
    encoded many at a time as one text. Where only the first character of each is a space, or a line feed, the tokens that
    start with one are where the words start.
    """

    def __init__(self, path: str):
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        self.special = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        vocabulary = self.whole.get_vocab()
        self.opens = {}
        for sign, written in WRITTEN.items():
            self.opens[sign] = opens = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
            opens[[i for token, i in vocabulary.items() if token.startswith(written)]] = True
        self.first = WorkerCache(lambda parts: [self._ids(part).tobytes() for part in parts], 50_000)
        self.words = PartIds(self._words, CACHED)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _later(self, parts: pa.Array) -> pa.Array:
        """Ids of each part as it stands after others."""
        bare, at, marks = cut_marks(parts)
        ids = self.words.many(bare)
        kinds = marks.dictionary_encode()
        ends = looked_up(self.first, kinds.dictionary).take(kinds.indices)
        ended = pc.binary_join_element_wise(ids.take(pa.array(at)), ends, NOTHING)
        places = np.arange(len(parts))
        places[at] = len(parts) + np.arange(len(at))
        return pa.concat_arrays([ids, ended]).take(pa.array(places))

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of new words as they stand after others."""
        order, ids = [], []  # places of words, and their ids
        for kind, sign, between in ((WORD, " ", " "), (FED_WORD, "\n", "")):
            own = np.flatnonzero(pc.match_substring_regex(words, kind).to_numpy(zero_copy_only=False))
            for begin in range(0, len(own), WORDS_AT_ONCE):
                at = own[begin : begin + WORDS_AT_ONCE]
                found = self._ids(between + joined(words.take(pa.array(at)), between))
                starts = np.flatnonzero(self.opens[sign][found])
                if len(starts) == len(at):
                    order.append(at)
                    ids.append((found, np.diff(starts, append=len(found))))
        odd = np.setdiff1d(np.arange(len(words)), np.concatenate([np.empty(0, dtype=np.int64), *order]))
        for at, part in zip(odd.tolist(), words.take(pa.array(odd)).to_pylist()):
            found = self._ids(whole(part))
            order.append(np.array([at]))
            ids.append((found, np.array([len(found)])))
        if not order:
            return pa.array([], pa.large_binary())
        flat, lengths = map(np.concatenate, zip(*ids))
        ends = np.concatenate([[0], 4 * np.cumsum(lengths)]).astype(np.int64)
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(flat)]
        laid = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), buffers)
        return laid.take(pa.array(np.argsort(np.concatenate(order))))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Texts with a special token's string are not cut."""
        odd = [any(token in text for token in self.special) for text in texts]
        plain = ["" if special else text for special, text in zip(odd, texts)]
        laid = lay_parts(plain, partial(looked_up, self.first), self._later)
        return [self._ids(text).tobytes() if special else ids for special, text, ids in zip(odd, texts, laid)]


@lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    """One per worker process."""
    return Tokenizer(path)


def token_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and ids (little-endian unsigned 32-bit)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        end = END_ID.to_bytes(4, "little")
        for part, texts in blocks(batches, BLOCK_ROWS, BLOCK_CHARS):
            rows = []
            for doc, ids in zip(part.column(0).to_pylist(), encode(texts)):
                ids += end
                n = len(ids) // 4
                stops = list(range(n % capacity or capacity, n + 1, capacity)) if n > capacity else [n]
                for piece, (start, stop) in enumerate(zip([0, *stops], stops)):
                    own = ids[4 * start : 4 * stop]
                    rows.append((doc, piece, start, stop - start, zlib.crc32(own), own))
            kinds = [part.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    named = pick(docs, id_col, text_col)
    kind = named.schema[0].dataType.simpleString()
    return named.mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
    )


def pack(pieces: DataFrame, stage: Stage, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = stage.write(pieces.select(columns))
    histogram = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    places = place_table(plan_sequences(histogram, capacity))
    n_buckets = sum(histogram.values()) // BUCKET_ROWS + 1

    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_buckets)))
    counts = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        bucketed.withColumn("within", F.row_number().over(within) - 1)
        .join(base, ["length", "bucket"])
        .select(*columns, (F.col("base") + F.col("within")).alias("rank"))
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            found = [pa.array(x) for x in place(lengths, ranks, places)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *found], names=[*columns, "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(
        run,
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )


def pack_documents(docs: DataFrame, path: str, stage: Stage) -> DataFrame:
    return pack(token_pieces(docs, path).drop("ids"), stage)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(table(spark, sf_dir, "documents"), path, Stage(spark, "packing"))
