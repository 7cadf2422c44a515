"""Token counts under a unigram vocabulary, by dynamic programming over a trie of distinct pre-tokens.

Distinct words are put in a trie in sorted order. The forward score of a node is the best log-probability of any
segmentation of its prefix; it depends on the prefix alone, so words that share a prefix share its scores. Each terminal
node holds the count of its best segmentation. Of equal scores the one of fewer tokens wins.

A word is a run of characters other than space and U+0009 to U+000D, with the vocabulary's word mark in front. A
character that no piece covers costs one fallback token per byte of its UTF-8 form.

Defined cases: a null, empty or blank text has 0 tokens; repeated rows are counted one by one; an empty table gives no
rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from openchair.llm.common import WorkerCache, blocks, pick, table

MARK = "▁"
WORD = re.compile(r"[^ \t-\r]+")


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


class Unigram:
    """Segmentations by log-probabilities, none above 0."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.suffixes = {piece[i:]: None for piece in scores for i in range(1, len(piece))} | scores
        self.fallback = min(scores.values(), default=0.0) - 10.0

    def counts(self, words: Sequence[str]) -> list[int]:
        """Tokens of each word. The trie is walked depth first, so only the path to the present word is held."""
        found: dict[str, int] = {}
        best, tokens, before = [0.0], [0], ""
        for word in sorted(set(words)):
            marked = MARK + word
            shared = common_prefix(before, marked)
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(marked) + 1):
                score, count = self._node(marked, end, best, tokens)
                best.append(score)
                tokens.append(count)
            found[word] = tokens[-1]
            before = marked
        return [found[word] for word in words]

    def _node(self, word: str, end: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        n_bytes = len(word[end - 1].encode("utf-8", "surrogatepass"))
        top, count = best[end - 1] + n_bytes * self.fallback, tokens[end - 1] + n_bytes
        get = self.suffixes.get
        for start in range(end - 1, -1, -1):
            own = get(word[start:end], 1.0)
            if own is None:
                continue
            if own > 0:
                break
            score = best[start] + own
            if score > top or (score == top and tokens[start] + 1 < count):
                top, count = score, tokens[start] + 1
        return top, count


def zipf_scores(path: str) -> dict[str, float]:
    """Pieces of a SentencePiece file, most frequent first, with log-probabilities by Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        i
        for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    plain.sort(key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1 / (rank + 1) for rank in range(len(plain))))
    return {model.id_to_piece(i): -math.log(rank + 1) - total for rank, i in enumerate(plain)}


class Counter:
    def __init__(self, path: str):
        self.words = WorkerCache(Unigram(zipf_scores(path)).counts, 500_000)

    def count(self, texts: Sequence[str]) -> list[tuple[int, int]]:
        """(words, tokens) of each text; the trie holds all new words of the texts given at once."""
        return [(len(counts), sum(counts)) for counts in self.words.grouped([WORD.findall(text) for text in texts])]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per worker process."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_pretokens and n_tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for part, texts in blocks(batches):
            pairs = count(texts)
            columns = [pa.array((pair[i] for pair in pairs), pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[id_col, "n_pretokens", "n_tokens"])

    named = pick(docs, id_col, text_col)
    kind = named.schema[0].dataType.simpleString()
    return named.mapInArrow(run, f"`{id_col}` {kind}, n_pretokens bigint, n_tokens bigint")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
