"""Byte-level BPE encoding and decoding by dynamic programming over byte prefixes.

For every prefix of a pre-token exactly one token can end its encoding. It is the token whose pair with the last token of
the prefix before it stays apart under the merge order. Storing that token per prefix gives the encoding by
walking back, lets bytes be appended exactly, and after an edit needs new values only until they agree with the old ones.

Defined cases: a null text is empty and has no ids; repeated rows are encoded one by one; an empty table gives no rows;
columns other than the id and the text are ignored. Bytes of ids that are no valid UTF-8 decode to exactly these bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from openchair.llm.common import WorkerCache, blocks, pick, table
from openchair.llm.pieces import join_parts, whole


MAX_KNOWN_PAIRS = 1_000_000
BATCH_BYTES = 64  # longer pre-tokens are encoded one by one


class Merges:
    """Tables of a rank file: bytes to id, the two parts of each id, and the id of each pair."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        self.parts: list[tuple[int, int] | None] = [None] * len(self.bytes)
        self.pairs: dict[tuple[int, int], int] = {}
        self.longest = max(map(len, ranks), default=1)
        self.prefixes = {token[:i]: -1 for token in ranks for i in range(1, len(token))} | ranks
        self._known: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            self.bytes[rank] = token
            if len(token) > 1:
                self._learn(token, rank)

    def _learn(self, token: bytes, rank: int) -> None:
        for i in range(1, len(token)):
            left, right = self.ids.get(token[:i], rank), self.ids.get(token[i:], rank)
            if left < rank and right < rank and self.apart(left, right):
                self.parts[rank] = (left, right)
                self.pairs[left, right] = rank
                return

    def apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay two tokens; memoized within a bound."""
        key = left << 32 | right
        known = self._known.get(key)
        if known is None:
            if len(self._known) >= MAX_KNOWN_PAIRS:
                self._known.clear()
            known = self._known[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """No merge across the border of the two comes before those within.

        Goes back in time: the token formed last is taken apart again, and at each state the pair that touches the border
        must not merge earlier than either side grew. Of equal merges the left one comes first.
        """
        pairs, parts = self.pairs, self.parts
        left_grew = right_grew = len(self.bytes)
        while True:
            across = pairs.get((left, right))
            if across is not None and across < left_grew and across <= right_grew:
                return False
            undo_left = parts[left] is not None and (left > right or parts[right] is None)
            if undo_left:
                left_grew, left = left, parts[left][1]
            elif parts[right] is not None:
                right_grew, right = right, parts[right][0]
            else:
                return True


class PrefixEncoder:
    """The last token of every prefix of some bytes; bytes can be appended or replaced."""

    def __init__(self, merges: Merges, data: bytes = b""):
        self.merges, self.data, self.last = merges, b"", [-1]
        self.append(data)

    def _token_at(self, end: int) -> int:
        merges, data, last = self.merges, self.data, self.last
        for start in range(max(0, end - merges.longest), end):
            token = merges.ids.get(data[start:end])
            if token is not None and (start == 0 or merges.apart(last[start], token)):
                return token
        raise ValueError("the vocabulary lacks a byte of the text")

    def append(self, more: bytes) -> None:
        """New prefixes get their tokens from each start on, as far as any token has these first bytes."""
        merges, begin = self.merges, len(self.data)
        self.data = data = self.data + more
        size = len(data)
        self.last = last = self.last + [-1] * len(more)
        prefixes, apart = merges.prefixes, merges.apart
        for start in range(max(0, begin + 1 - merges.longest), size):
            before = last[start]
            for end in range(start + 1, min(size, start + merges.longest) + 1):
                token = prefixes.get(data[start:end])
                if token is None:
                    break
                if token >= 0 and last[end] < 0 and (start == 0 or apart(before, token)):
                    last[end] = token
        if size and last[size] < 0:
            raise ValueError("the vocabulary lacks a byte of the text")

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put new bytes in place of data[start:stop]; returns how many prefixes were computed again."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        same = 0
        for end in range(start + 1, len(self.data) + 1):
            token = self._token_at(end)
            self.last.append(token)
            past = end > start + len(new)
            same = same + 1 if past and token == old[end - shift] else 0
            if same >= self.merges.longest:
                self.last.extend(old[end - shift + 1 :])
                return end - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.merges.bytes[out[-1]])
        return out[::-1]


class Lookup:
    """Values of keys of 0 or more, -1 for others: open addressing in numpy arrays that are at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(65 - size.bit_length()), size - 1
        self.keys, self.values = np.full(size, -1), np.full(size, -1)
        slot, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[slot[open_]] < 0]
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            open_ = open_[self.keys[slot[open_]] != keys[open_]]
            slot[open_] = slot[open_] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        slot = self._slot(wanted)
        here = self.keys[slot]
        out = np.where(here == wanted, self.values[slot], -1)
        live = np.flatnonzero((here != wanted) & (here >= 0))
        while len(live):
            slot[live] = slot[live] + 1 & self.mask
            here = self.keys[slot[live]]
            hit = here == wanted[live]
            out[live[hit]] = self.values[slot[live[hit]]]
            live = live[~hit & (here >= 0)]
        return out


class BatchEncoder:
    """The same prefix tables for many short pre-tokens at once, as numpy arrays over their joined bytes."""

    def __init__(self, merges: Merges):
        self.merges = merges
        nodes = {prefix: i + 1 for i, prefix in enumerate(sorted(merges.prefixes))}
        steps = [(nodes.get(prefix[:-1], 0) << 8 | prefix[-1], node) for prefix, node in nodes.items()]
        self.step = Lookup(*np.array(steps, dtype=np.int64).reshape(-1, 2).T)
        self.node_token = np.array([-1] + [merges.prefixes[prefix] for prefix in nodes], dtype=np.int64)
        pairs = [(left << 32 | right, token) for (left, right), token in merges.pairs.items()]
        self.pair = Lookup(*np.array(pairs, dtype=np.int64).reshape(-1, 2).T)
        parts = [(-1, -1) if part is None else part for part in merges.parts]
        self.left, self.right = np.array(parts, dtype=np.int64).reshape(-1, 2).T.copy()
        self.size = np.array([len(token) for token in merges.bytes], dtype=np.int64)

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merges.apart for arrays of pairs."""
        answer = np.ones(len(left), dtype=bool)
        live = np.arange(len(left))
        left_grew = np.full(len(left), len(self.size))
        right_grew = left_grew.copy()
        while len(live):
            across = self.pair(left << 32 | right)
            merges = (across >= 0) & (across < left_grew) & (across <= right_grew)
            answer[live[merges]] = False
            whole_left, whole_right = self.left[left] < 0, self.left[right] < 0
            undo_left = ~whole_left & ((left > right) | whole_right)
            go = ~merges & ~(whole_left & whole_right)
            left_grew, right_grew = np.where(undo_left, left, left_grew), np.where(undo_left, right_grew, right)
            left, right = np.where(undo_left, self.right[left], left), np.where(undo_left, right, self.left[right])
            live, left, right, left_grew, right_grew = (x[go] for x in (live, left, right, left_grew, right_grew))
        return answer

    def _tokens_within(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens inside the words: their starts, ends and ids. stop: the end of each byte's word."""
        start, node, end = np.arange(len(data)), np.zeros(len(data), dtype=np.int64), np.arange(len(data))
        found = []
        while len(start):
            node = self.step(node << 8 | data[end])
            end = end + 1
            here = node >= 0
            token = self.node_token[np.where(here, node, 0)]
            hit = here & (token >= 0)
            found.append((start[hit], end[hit], token[hit]))
            go = here & (end < stop[start])
            start, node, end = start[go], node[go], end[go]
        return tuple(np.concatenate(x) for x in zip(*found))

    def encode(self, words: list[bytes]) -> list[bytes]:
        if not words:
            return []
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        begin = np.concatenate([[0], np.cumsum(lengths)])
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        starts, ends, tokens = self._tokens_within(data, begin[1:][word])
        place = starts - begin[:-1][word[starts]]
        order = np.lexsort((ends, place))
        starts, ends, tokens, place = starts[order], ends[order], tokens[order], place[order]
        # last[p]: the last token of the prefix whose final byte is p.
        last = np.full(len(data), -1, dtype=np.int64)
        bounds = np.searchsorted(place, np.arange(place[-1] + 2))
        for at, (a, b) in enumerate(zip(bounds, bounds[1:])):
            s, e, t = starts[a:b], ends[a:b] - 1, tokens[a:b]
            open_ = last[e] < 0
            s, e, t = s[open_], e[open_], t[open_]
            fits = self._apart(last[s - 1], t) if at else np.ones(len(t), dtype=bool)
            last[e[fits]] = t[fits]
        return self._walk_back(last, begin)

    def _walk_back(self, last: np.ndarray, begin: np.ndarray) -> list[bytes]:
        at = begin[1:].copy()
        live = np.flatnonzero(at > begin[:-1])
        owners, ids = [], []
        while len(live):
            token = last[at[live] - 1]
            if (token < 0).any():
                raise ValueError("the vocabulary lacks a byte of the text")
            owners.append(live)
            ids.append(token)
            at[live] -= self.size[token]
            live = live[at[live] > begin[live]]
        if not owners:
            return [b""] * (len(begin) - 1)
        owner, ids = np.concatenate(owners[::-1]), np.concatenate(ids[::-1])
        order = np.argsort(owner, kind="stable")
        flat = ids[order].astype("<i4").tobytes()
        cuts = 4 * np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(begin) - 1))])
        return [flat[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Whole texts to ids. Parts of texts and pre-tokens repeat, so both are memoized within a bound."""

    def __init__(self, path: str, pattern: str):
        self.merges = Merges(read_ranks(path))
        self.batch = BatchEncoder(self.merges)
        self.split = regex.compile(pattern).findall
        self.tokens = WorkerCache(self._tokens)
        self.first = WorkerCache(self._parts, 50_000)
        self.later = WorkerCache(lambda parts: self._parts(list(map(whole, parts))))

    def _tokens(self, found: list[str]) -> list[bytes]:
        data = [token.encode() for token in found]
        short = [i for i, x in enumerate(data) if len(x) <= BATCH_BYTES]
        out: list = [None] * len(data)
        for i, ids in zip(short, self.batch.encode([data[i] for i in short])):
            out[i] = ids
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = np.array(PrefixEncoder(self.merges, data[i]).tokens(), dtype="<i4").tobytes()
        return out

    def _parts(self, parts: list[str]) -> list[bytes]:
        encoded = self.tokens.grouped([self.split(part) for part in parts])
        return [b"".join(found) for found in encoded]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return join_parts(texts, self.first, self.later)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process."""
    return Encoder(path, pattern)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """The bytes of each id: all that decoding needs, one per worker process."""
    ranks = read_ranks(path)
    table = np.full(max(ranks.values(), default=-1) + 1, None, dtype=object)
    table[list(ranks.values())] = list(ranks)
    return table


def decode(lists: pa.ListArray, path: str) -> pa.Array:
    """The bytes of each list of ids; null lists have none."""
    lists = pc.fill_null(lists, pa.scalar([], lists.type))
    tokens = token_bytes(path)[lists.flatten().to_numpy(zero_copy_only=False)].tolist()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy()).tolist()
    return pa.array([b"".join(tokens[a:b]) for a, b in zip([0, *ends], ends)], pa.binary())


def _id_lists(encoded: list[bytes]) -> pa.Array:
    lengths = np.fromiter((len(x) // 4 for x in encoded), dtype=np.int64, count=len(encoded))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), dtype="<i4")))


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ids array<int>."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode
        for part, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), _id_lists(encode(texts))], names=[id_col, "ids"])

    named = pick(docs, id_col, text_col)
    return named.mapInArrow(run, f"`{id_col}` {named.schema[0].dataType.simpleString()}, ids array<int>")


def decode_ids(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id, ids and the decoded bytes; null ids decode to no bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                decoded = decode(part.column(1), path)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[id_col, "ids", "decoded"])

    named = pick(rows, id_col, ids_col).withColumnRenamed(ids_col, "ids")
    kind = named.schema[0].dataType.simpleString()
    return named.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`decode_ids` of `encode_texts` in one pass: per row id, ids and the bytes decoded from these ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode
        for part, texts in blocks(batches):
            ids = _id_lists(encode(texts))
            columns = [part.column(0), ids, decode(ids, path)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "decoded"])

    named = pick(docs, id_col, text_col)
    kind = named.schema[0].dataType.simpleString()
    return named.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return round_trip(table(spark, sf_dir, "documents"), *vocabulary).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
