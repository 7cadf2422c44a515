"""Collocations by Toivonen's sampling: exact counts of all frequent phrases from few passes over the texts.

A sample of the rows proposes words and phrases that may be frequent. A full pass then counts, exactly, every phrase whose
parts (itself less its first or its last word) were all proposed: these are the proposed phrases and their negative border.
A border phrase that turns out frequent was missed by the sample, so phrases that hold it may have gone uncounted; it is
proposed as well, and another pass counts what that adds; there, a phrase counted for the first time passes as proposed, so
that what extends it is counted along with it. A pass without such a failure closes the search, since a phrase can only be
frequent if its parts are.

Tasks ask whether a part was proposed in a bitmap of fixed size. A wrong yes only has one more phrase counted, so results do
not depend on the bitmap or on the sample; with more phrases than the bitmap can tell apart, less is left uncounted.
Counts are summed in blocks of text, then by phrase. Every table beyond that holds frequent phrases only.

Text: A to Z in lower case, cut into pieces at `[.,;:!?` and 0x0A to 0x0D`]`, pieces into words at spaces and tabs.

Defined cases: a null text is empty and an empty one has no words; a null language counts as `und`, together with that name;
repeated rows count each time; ids may be null or repeated, as they only choose the sample; ties are broken as the contract
says; empty tables give no rows; other columns are ignored. A text is tokenized whole, however long.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from openchair.llm.common import Stage, blocks, pick, table
from openchair.operators.joins import attach

LONGEST = 3
LEAST = 10
SAMPLE_SHARE = 8  # one row in so many proposes
SAMPLE_LEAST = 2
PARTS = 50  # percent of a phrase's occurrences inside a longer one that drop it
KEPT = 2000
FILTER_BITS = 1 << 27
UNKNOWN = "und"
_SHARES = 64
_BLOCK_CHARS = 6_000_000
_WORDS_HELD = 300_000
_MARK = b"\xff"  # not in UTF-8
_LOWER = bytearray(range(256))
_LOWER[65:91] = range(97, 123)
_LOWER[9] = 32
for _byte in b".,;:!?\n\v\f\r":
    _LOWER[_byte] = _MARK[0]
_LOWER = bytes(_LOWER)


def tokens(texts: Iterable[str]) -> list[bytes]:
    """The words of all texts in order, with marks where pieces end."""
    joined = "\n".join(texts).encode().translate(_LOWER)
    return joined.replace(_MARK, b" " + _MARK + b" ").split(b" ")


def _word_hashes(lang: str, words: Iterable[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.array([xxhash.xxh64_intdigest(word, seed) for word in words], dtype=np.uint64)


def _longer(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of all but its last word and the hash of that."""
    mixed = left * np.uint64(0x9E3779B97F4A7C15) + word
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last = np.uint64(FILTER_BITS - 1)
    return hashes & last, (hashes >> np.uint64(32)) & last


@dataclass(frozen=True)
class Proposed:
    """A bitmap of the proposed phrases, a constant number of bytes."""

    bits: np.ndarray

    @classmethod
    def of(cls, phrases: DataFrame) -> Proposed:
        """From the columns lang and phrase. Tasks reduce them to words of the bitmap."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hashes = []
                for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    parts = _word_hashes(lang, phrase.encode().split(b" "))
                    whole = parts[:1]
                    for part in parts[1:]:
                        whole = _longer(whole, part)
                    hashes.append(whole)
                at = np.concatenate(_places(np.concatenate(hashes))) if hashes else np.zeros(0, np.uint64)
                slots, place = np.unique(at >> np.uint64(6), return_inverse=True)
                words = np.zeros(len(slots), np.uint64)
                np.bitwise_or.at(words, place, np.uint64(1) << (at & np.uint64(63)))
                columns = [pa.array(slots.astype(np.int64)), pa.array(words.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["slot", "word"])

        words = phrases.select("lang", "phrase").mapInArrow(run, "slot bigint, word bigint")
        found = words.groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow()
        bits = np.zeros(FILTER_BITS >> 6, np.uint64)
        bits[found["slot"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
        return cls(bits)

    def __or__(self, other: Proposed) -> Proposed:
        return Proposed(self.bits | other.bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in _places(hashes):
            found &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return found


def _all(hashes: np.ndarray) -> np.ndarray:
    return np.ones(len(hashes), bool)


def count_block(texts: list[str], lang: str, longest: int, known, before) -> Iterator[tuple]:
    """(size, phrases, counts, proposed) of the texts, for phrases whose parts are known but were not all known before.

    `known` and `before` tell for hashes whether a phrase was proposed. Size 0 stands for the number of words. Words are
    given on the first pass only, which has nothing known before. On a later pass all phrases it counts pass as proposed.
    """
    first = before is None
    encoded = pa.array(tokens(texts), pa.binary()).dictionary_encode()
    listed = encoded.dictionary.to_pylist()
    n = len(listed)
    at = encoded.indices.to_numpy().astype(np.int64)
    if b"" in listed:
        at = at[at != listed.index(b"")]
    is_word = np.array([word not in (b"", _MARK) for word in listed], bool)
    words = pc.cast(pa.array([w if ok else b"" for w, ok in zip(listed, is_word)], pa.binary()), pa.string())
    word_hash = _word_hashes(lang, listed)
    # For words, then for each position: whether the phrase that starts there is proposed, and whether it was before.
    proposed = known(word_hash) & is_word
    earlier = before(word_hash) & is_word if before else np.zeros(n, bool)
    if first:
        chosen = np.flatnonzero(is_word)
        counts = np.bincount(at, minlength=n)[chosen]
        yield 0, pa.array([""]), np.array([counts.sum()]), np.array([True])
        yield 1, words.take(pa.array(chosen)), counts, proposed[chosen]
    hashes, passes, passed = word_hash[at], proposed[at], earlier[at]
    for size in range(2, longest + 1):
        if len(at) < size:
            return
        counted, done = passes[:-1] & passes[1:], passed[:-1] & passed[1:]
        new = np.flatnonzero(counted & ~done)
        parts, counts = _distinct(at, new, size, n)
        own = word_hash[parts[0]]
        for part in parts[1:]:
            own = _longer(own, word_hash[part])
        phrases = pc.binary_join_element_wise(*[words.take(pa.array(part)) for part in parts], " ")
        yield size, phrases, counts, known(own) if first else np.ones(len(own), bool)
        if size < longest:
            live = np.flatnonzero(counted)
            hashes = _longer(hashes[:-1], word_hash[at[size - 1 :]])
            passes, passed = np.zeros(len(counted), bool), np.zeros(len(counted), bool)
            passes[live] = known(hashes[live])
            if not first:
                passed[live] = before(hashes[live])
                passed &= done
                passes[new] = True


def _distinct(at: np.ndarray, starts: np.ndarray, size: int, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different runs of `size` numbers below n that start at the given places, column by column, and their counts."""
    if n**size < 1 << 63:
        keys = at[starts]
        for i in range(1, size):
            keys = keys * n + at[starts + i]
        keys, counts = np.unique(keys, return_counts=True)
        return [keys // n**i % n for i in reversed(range(size))], counts
    runs, counts = np.unique(np.column_stack([at[starts + i] for i in range(size)]), axis=0, return_counts=True)
    return list(runs.T), counts


def _counts(rows: DataFrame, longest: int, known: Proposed | None, before: Proposed | None) -> DataFrame:
    """lang, size, phrase, n and proposed over all rows; with nothing known, all phrases."""
    context = rows.sparkSession.sparkContext
    shared = [context.broadcast(p.bits) if p else None for p in (known, before)]

    def batch_of(lang: str, size: int, phrases: pa.Array, counts: Iterable[int], proposed: np.ndarray) -> pa.RecordBatch:
        columns = [phrases, pa.array(counts, pa.int64()), pa.array(proposed)]
        columns = [pa.repeat(lang, len(phrases)), pa.repeat(pa.scalar(size, pa.int8()), len(phrases)), *columns]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "size", "phrase", "n", "proposed"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has_known, has_before = [Proposed(bits.value).has if bits else None for bits in shared]
        single: dict[str, Counter] = {}  # words recur from block to block

        def of_words() -> Iterator[pa.RecordBatch]:
            for lang, counts in single.items():
                proposed = (has_known or _all)(_word_hashes(lang, [word.encode() for word in counts]))
                yield batch_of(lang, 1, pa.array(list(counts), pa.string()), list(counts.values()), proposed)
            single.clear()

        for batch, texts in blocks(batches, most_rows=100_000, most_chars=_BLOCK_CHARS):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                for size, phrases, counts, proposed in count_block(own, lang, longest, has_known or _all, has_before):
                    if size == 1:
                        held = single.setdefault(lang, Counter())
                        for word, count in zip(phrases.to_pylist(), counts.tolist()):
                            held[word] += count
                    else:
                        yield batch_of(lang, size, phrases, counts, proposed)
            if sum(map(len, single.values())) > _WORDS_HELD:
                yield from of_words()
        yield from of_words()

    found = rows.select("lang", "text").mapInArrow(
        run, "lang string, size tinyint, phrase string, n bigint, proposed boolean"
    )
    # Each block has summed its own occurrences, so no phrase has more rows than there are blocks.
    keys = ("lang", "size", "phrase")
    return found.repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("n"), F.max("proposed").alias("proposed"))


def frequent_phrases(docs: DataFrame, stage: Stage, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, size, phrase and n of all phrases that occur at least so often; size 0 has the number of words of a lang."""
    rows = pick(docs, "doc_id", "lang", "text").withColumn("lang", F.coalesce("lang", F.lit(UNKNOWN)))
    sample = rows.where(F.expr(f"pmod(xxhash64(doc_id, text), {SAMPLE_SHARE}) = 0"))
    proposals = stage.write(_counts(sample, longest - 1, None, None).where(f"size > 0 AND n >= {SAMPLE_LEAST}"))
    known, before = Proposed.of(proposals), None
    found = []
    while True:
        counts = _counts(rows, longest, known, before).where(f"size = 0 OR n >= {least}")
        found.append(stage.write(counts))
        missed = found[-1].where(f"size BETWEEN 1 AND {longest - 1} AND NOT proposed")
        if missed.isEmpty():
            break
        known, before = known | Proposed.of(missed), known
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("lang", "size", "phrase", "n")


def collocations(counts: DataFrame, kept: int = KEPT) -> DataFrame:
    """The best phrases of each language by the share of their weakest cut, from the counts of `frequent_phrases`."""
    known = counts.where("size > 0").select("lang", "phrase", "n")
    longer = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    words = longer.withColumn("_words", F.split("phrase", " "))

    part = "array_join(slice(_words, {}, {}), ' ')"
    cuts = words.selectExpr("lang", "phrase", "a", "size", "_words", "explode(sequence(1, size - 1)) AS k").selectExpr(
        "lang", "phrase", "a", "k", f"{part.format(1, 'k')} AS _first", f"{part.format('k + 1', 'size - k')} AS _rest"
    )
    for side, count in (("_first", "l"), ("_rest", "r")):
        cuts = attach(cuts, known.toDF("lang", side, count), ("lang", side), ("phrase", "k"))
    wide = "CAST({} AS DECIMAL(38, 0))".format
    scored = cuts.selectExpr(
        "*", f"({wide('a')} * {wide('a')} * {wide('1000000')}) div ({wide('l')} * {wide('r')}) AS score"
    )
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.expr("min(struct(score, k, l, r)) AS _cut"))

    inner = words.where("size > 2").selectExpr("lang", "a", "_words", "explode(sequence(2, size - 1)) AS _n", "size")
    inner = inner.selectExpr("lang", "a", "_words", "_n", "explode(sequence(1, size - _n + 1)) AS _from")
    inside = inner.selectExpr("lang", f"{part.format('_from', '_n')} AS phrase", "a")
    longest = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_within"))
    free = attach(weakest, longest, ("lang", "phrase"), ("phrase",), fanout=1).where(
        f"_within IS NULL OR 100 * _within < {PARTS} * a"
    )

    # The best of shares of each language first, so that no task sorts a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = free.selectExpr("lang", "phrase", "a", "_cut.*", f"pmod(xxhash64(phrase), {_SHARES}L) AS _share")
    for keys in (("lang", "_share"), ("lang",)):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        ranked = ranked.where(F.col("rank") <= kept)
    totals = counts.where("size = 0").select("lang", F.col("n").alias("n"))
    return attach(ranked, totals, ("lang",), ("phrase",)).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(frequent_phrases(table(spark, sf_dir, "documents"), Stage(spark, "phrases")))


SQL = rf"""
WITH pieces AS MATERIALIZED (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
), words AS (
  SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM starts
), f AS MATERIALIZED (
  SELECT lang, w1 AS phrase, count(*) AS f FROM words GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2, count(*) FROM words WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, count(*) FROM words WHERE w3 IS NOT NULL GROUP BY ALL
), candidates AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE f >= {LEAST} AND contains(phrase, ' ')
), cuts AS (
  SELECT lang, phrase, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM candidates
  UNION ALL SELECT lang, phrase, a, 2, array_to_string(w[1:2], ' '), w[3] FROM candidates WHERE len(w) = 3
), scored AS (
  SELECT c.lang, c.phrase, a, k, h.f AS l, t.f AS r, ((1000000::HUGEINT * a * a) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c
  JOIN f h ON h.lang = c.lang AND h.phrase = c.head
  JOIN f t ON t.lang = c.lang AND t.phrase = c.tail
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE len(w) = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE len(w) = 3)
  GROUP BY ALL
), free AS (
  SELECT s.* FROM weakest s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE i.a IS NULL OR 100 * i.a < {PARTS} * s.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free
)
SELECT r.lang, rank, phrase, a, l, r, n, score
FROM ranked r JOIN (SELECT lang, count(*) AS n FROM words GROUP BY lang) t ON t.lang = r.lang
WHERE rank <= {KEPT}
"""
