"""Cutting texts where no pre-token of the byte-level pattern can cross, and putting ids of parts together.

Every match of the pattern has a space at most as its first character, unless it is a run of white space. So a space
between two characters that are not white space always starts a match, and the text up to it can be split alone. The same
holds for the first line feed after a character that is not white space. The parts are mostly single words, which repeat:
Arrow finds the distinct parts of a block of texts, only these are looked up or encoded, and numpy lays their ids out in
the order of the texts.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Sequence
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from openchair.llm.common import WorkerCache

_CUT = re.compile(r"(?<=\S)(?: (?=\S)|(?=\n))")
# For Arrow, whose \s knows only ASCII: white space, and texts with a space at an end or beside other white space.
_WHITE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
_ODD = rf"\A | \z| [{_WHITE}]|[{_WHITE}] "
_FEED = rf"([^{_WHITE}])\n"
# Parts that are one word after a space, or after a line feed.
WORD, FED_WORD = rf"\A[^{_WHITE}]+\z", rf"\A\n[^{_WHITE}]+\z"
_MARKS = string.punctuation
MOST_MARKS = 3
_PLAIN_END = r"[0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]\z"
_BEFORE_MARKS = r"(?s)\A.*[^!-/:-@\[-`{-~]"


def whole(part: str) -> str:
    """A part after the first one as it stands in the text: those that start with no line feed follow a space."""
    return part if part[:1] == "\n" else " " + part


def cut_all(texts: Sequence[str]) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts one after the other, and the number of parts of each text."""
    column = pa.array(texts, pa.string())
    if pc.any(pc.match_substring_regex(column, _ODD)).as_py():
        parts = [_CUT.split(text) for text in texts]
        counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        return pa.array(list(chain.from_iterable(parts)), pa.string()), counts
    found = pc.split_pattern(pc.replace_substring_regex(column, _FEED, "\\1 \n"), " ")
    return found.flatten(), pc.list_value_length(found).to_numpy().astype(np.int64)


def cut_marks(parts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Parts without the ASCII marks at their ends, the places of those that had some, and the marks of these.

    Marks after a letter or digit always start a match of the pattern, so both sides can be split alone. Only a plain letter
    or digit counts, and few marks, whose kinds are few; all other parts stay as they are.
    """
    bare = pc.ascii_rtrim(parts, characters=_MARKS)
    few = pc.less_equal(pc.subtract(pc.binary_length(parts), pc.binary_length(bare)), MOST_MARKS)
    ends = pc.and_(pc.and_(pc.not_equal(bare, parts), few), pc.match_substring_regex(bare, _PLAIN_END))
    at = np.flatnonzero(ends.to_numpy(zero_copy_only=False))
    return pc.if_else(ends, bare, parts), at, pc.replace_substring_regex(parts.filter(ends), _BEFORE_MARKS, "")


class PartIds:
    """Memo of the ids of parts, in Arrow arrays, those used last first: many parts are looked up in one call.

    Parts of more than `longest` bytes are not kept, so that `limit` bounds the bytes too.
    """

    def __init__(self, compute: Callable[[pa.Array], pa.Array], limit: int, longest: int = 64):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.parts, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def many(self, parts: pa.Array) -> pa.Array:
        coded = parts.dictionary_encode()
        own = coded.dictionary
        at = pc.fill_null(pc.index_in(own, self.parts), -1).to_numpy().astype(np.int64)
        unknown = at < 0
        rest = np.ones(len(self.parts), dtype=bool)
        rest[at[~unknown]] = False
        at[unknown] = len(self.parts) + np.arange(unknown.sum())
        ids = pa.concat_arrays([self.ids, self.compute(own.filter(pa.array(unknown)))]).take(pa.array(at))
        short, rest = pc.less_equal(pc.binary_length(own), self.longest), pa.array(rest)
        self.parts = pa.concat_arrays([own.filter(short), self.parts.filter(rest)])[: self.limit]
        self.ids = pa.concat_arrays([ids.filter(short), self.ids.filter(rest)])[: self.limit]
        return ids.take(coded.indices)


def lay_parts(
    texts: Sequence[str], first: Callable[[pa.Array], pa.Array], later: Callable[[pa.Array], pa.Array]
) -> list[bytes]:
    """Little-endian 32-bit ids of each text. The functions give the ids of parts that begin a text, and of later ones."""
    if not texts:
        return []
    parts, counts = cut_all(texts)
    coded = parts.dictionary_encode()
    codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    begins = np.cumsum(counts) - counts
    heads, codes[begins] = np.unique(codes[begins], return_inverse=True)
    codes[begins] += len(words)
    laid = pa.concat_arrays([later(words), first(words.take(pa.array(heads)))]).take(pa.array(codes))
    _, offsets, joined = laid.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[np.cumsum(counts)].tolist()
    joined = joined.to_pybytes() if joined else b""
    return [joined[a:b] for a, b in zip([0, *ends], ends)]


def looked_up(cache: WorkerCache, parts: pa.Array) -> pa.Array:
    return pa.array(cache.many(parts.to_pylist()), pa.large_binary())


def join_parts(texts: Sequence[str], first: WorkerCache, later: WorkerCache) -> list[bytes]:
    """`lay_parts` with the ids from two caches."""
    return lay_parts(texts, partial(looked_up, first), partial(looked_up, later))
