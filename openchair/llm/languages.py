"""Language identification by spans: scripts narrow the candidates, Viterbi over the words of a text labels its spans.

A language is described by the characters, pairs and triples of characters of its words, learnt from rows that are not held
out. A word is a run of letters (with the marks that follow them). Each word scores every candidate language by the logarithm
of the likelihood of its characters; languages that hardly use the word's script are no candidates. The best sequence of
languages pays a penalty wherever the language changes, so that single odd words do not start a span, but a passage in
another language does. The language of a text is the one with the most letters in its spans.

Fitting uses about `ROWS_A_LANGUAGE` rows of each language, chosen by a digest, all rows of a rarer one; whole texts are read and
counted by Spark, so only one table of counts by character triple reaches the driver. Labelling reads every whole text. All texts of a
block advance together, word by word, so a batch costs a few numpy steps for each word of its longest text.

Defined cases: a text that is null, empty or without letters has no spans and is `und` with score 0; without labelled rows so
is every text; a text whose letters belong to no learnt script may be any language; equal scores go to the name that sorts
first; rows of null id are not learnt from and not held out; repeated rows are labelled one by one; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from openchair.llm.common import Stage, WorkerCache, blocks, pick, table
from openchair.operators.joins import attach

ROWS_A_LANGUAGE = 2000
UNKNOWN = "und"
SWITCH = 14.0  # penalty of a change, in nats
MOST_EVIDENCE = 6.0  # of one word against a language, in nats
NO_CANDIDATE = -10_000.0
SCRIPT_SHARE = 0.01  # of the letters of a language, for it to be a candidate for words of a script
GRAM = 3
SMOOTHING = 0.5
# Marks that go on with a word, from the blocks of combining, Hebrew, Arabic, Indic and Thai signs.
_MARKS = r"\u0300-\u036f\u0483-\u0489\u0591-\u05c7\u064b-\u065f\u0900-\u0dff\u0e31-\u0e4e\u200c\u200d"
_WORD = re.compile(rf"[^\W\d_]+(?:[{_MARKS}]+[^\W\d_]*)*")

# First code points of the ranges of scripts, by the Unicode blocks.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
    (0x32000, "other"),
)
_STARTS = [start for start, _ in SCRIPT_STARTS]


def script(word: str) -> str:
    """The script of a word, by its first letter."""
    return SCRIPT_STARTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str) -> Iterator[str]:
    """Runs of one to three characters of a word between marks for its ends."""
    marked = f"<{word}>"
    for size in range(1, GRAM + 1):
        for i in range(len(marked) - size + 1):
            yield marked[i : i + size]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _keys(points: np.ndarray, size: int) -> np.ndarray:
    """One number for the characters at each place and the size - 1 after it, 21 bits each; runs over the end are odd."""
    keys = points.copy()
    for i in range(1, size):
        keys[:-i] = keys[:-i] << np.uint64(21) | points[i:]
    return keys


@dataclass(frozen=True)
class Model:
    """Languages by name; a row of logarithms for each run of characters; which languages use which script."""

    names: tuple[str, ...] = ()
    keys: np.ndarray | None = None  # of the runs, in order
    weights: np.ndarray | None = None  # the last two rows are for runs never seen, and for none
    scripts: dict[str, np.ndarray] | None = None

    def scores(self, words: list[str]) -> list[np.ndarray]:
        """For each word its evidence for every language, at most zero; none from words without a letter."""
        points = _points("".join(f"<{word}>" for word in words))
        sizes = np.array([len(word) + 2 for word in words])
        begins = np.cumsum(sizes) - sizes
        left = np.repeat(begins + sizes, sizes) - np.arange(len(points))  # characters of the word from here on
        total = np.zeros((len(words), len(self.names)))
        for size in range(1, GRAM + 1):
            keys = _keys(points, size)
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            at[self.keys[at] != keys] = len(self.weights) - 2
            at[left < size] = len(self.weights) - 1
            total += np.add.reduceat(self.weights[at], begins, axis=0)
        total = np.maximum(total - total.max(axis=1, keepdims=True), -MOST_EVIDENCE)
        for i, word in enumerate(words):
            if not any(map(str.isalpha, word)):
                total[i] = 0.0
            elif (able := self.scripts.get(script(word))) is not None:
                total[i][~able] = NO_CANDIDATE
        return list(total)



def fit(counts: Iterable[tuple[str, str, int]]) -> Model:
    """A model from counts of (language, run of characters); runs of one character also tell of scripts."""
    by_lang: dict[str, dict[str, int]] = {}
    for lang, gram, n in counts:
        by_lang.setdefault(lang, {})[gram] = n
    names = tuple(sorted(by_lang))
    if not names:
        return Model()
    found = {g: int(_keys(_points(g), len(g))[0]) for g in chain.from_iterable(by_lang.values()) if g}
    runs = sorted(found.items(), key=lambda item: item[1])
    places = {g: i for i, (g, _) in enumerate(runs)}
    sizes = np.array([len(g) for g in places] + [0])
    weights = np.zeros((len(places) + 2, len(names)))
    uses: dict[str, np.ndarray] = {}
    for j, name in enumerate(names):
        own = np.full(len(places) + 1, SMOOTHING)
        for gram, n in by_lang[name].items():
            if gram:
                own[places[gram]] += n
            if len(gram) == 1 and gram.isalpha():
                uses.setdefault(script(gram), np.zeros(len(names)))[j] += n
        totals = np.bincount(sizes, own, minlength=GRAM + 1)
        totals[0] = totals[1:].max()
        weights[:-1, j] = np.log(own / np.maximum(totals[sizes], SMOOTHING))
    letters = sum(uses.values())
    able = {name: n / np.maximum(letters, 1) >= SCRIPT_SHARE for name, n in uses.items()}
    keys = np.array([key for _, key in runs] or [0], np.uint64)
    return Model(names, keys, weights, {name: who for name, who in able.items() if who.any()})


def label_words(evidence: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best language number of every word of every text, given one (words, languages) array a text.

    Texts advance together, longest first, so that those still running are always the first ones.
    """
    lengths = np.array([len(e) for e in evidence])
    order = np.argsort(-lengths, kind="stable")
    labels = [np.zeros(n, np.int32) for n in lengths]
    running = int((lengths > 0).sum())
    if not running:
        return labels
    steps = int(lengths.max())
    active = np.searchsorted(-lengths[order], -np.arange(steps), side="left")  # texts longer than each step
    begins = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty((begins[-1], evidence[order[0]].shape[1]))
    for rank, text in enumerate(order[:running]):
        flat[begins[: lengths[text]] + rank] = evidence[text]
    from_best = np.zeros(flat.shape, bool)
    best = np.zeros(begins[-1], np.int32)
    value = flat[begins[0] : begins[1]].copy()
    best[begins[0] : begins[1]] = value.argmax(axis=1)
    for t in range(1, steps):
        value, now = value[: active[t]], slice(begins[t], begins[t + 1])
        lead = best[begins[t - 1] : begins[t - 1] + active[t]]
        changed = (value[np.arange(active[t]), lead] - switch)[:, None]
        np.greater(changed, value, out=from_best[now])
        value = np.maximum(value, changed) + flat[now]
        value.argmax(axis=1, out=(step := np.empty(active[t], np.intp)))
        best[now] = step
    chosen = np.empty(begins[-1], np.int32)
    state = np.zeros(0, np.int32)
    for t in range(steps - 1, -1, -1):
        now = slice(begins[t], begins[t + 1])
        ending = best[begins[t] + len(state) : begins[t + 1]]
        if t + 1 < steps:
            jump = from_best[begins[t + 1] + np.arange(len(state)), state]
            state = np.where(jump, best[begins[t] : begins[t] + len(state)], state)
        state = np.concatenate([state, ending])
        chosen[now] = state
    for rank, text in enumerate(order[:running]):
        labels[text] = chosen[begins[: lengths[text]] + rank]
    return labels


def held_out(doc_id: Column) -> Column:
    """Documents whose language is not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, stage: Stage) -> Model:
    known = pick(docs, "doc_id", "text", "lang").where("lang IS NOT NULL AND doc_id IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id")))
    sizes = stage.write(known.groupBy("lang").agg(F.count("*").alias("_n")))
    digest = F.expr("pmod(xxhash64(doc_id, text), 1000000007)")
    chosen = attach(known, sizes, ("lang",), ("doc_id",)).where(digest * F.col("_n") < F.lit(ROWS_A_LANGUAGE * 1000000007))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts):
                words.setdefault(lang, Counter()).update(words_of(text))
            for lang, own in words.items():
                found: Counter = Counter()
                for word, n in own.items():
                    for gram in grams(word):
                        found[gram] += n
                found[""] += 0  # a language is learnt even from texts without a word
                columns = [pa.repeat(lang, len(found)), pa.array(list(found)), pa.array(list(found.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

    counts = chosen.select("lang", "text").mapInArrow(run, "lang string, gram string, n bigint")
    counts = stage.write(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    return fit(map(tuple, counts.toArrow().to_pandas().itertuples(index=False)))


@dataclass
class Labelled:
    """Spans of a text as (start, end, language number), and the letters of each language."""

    spans: list[tuple[int, int, int]]
    letters: np.ndarray


class Labeller:
    def __init__(self, model: Model):
        self.model = model
        self.cache = WorkerCache(self._describe, 200_000)

    def _describe(self, words: list[str]) -> list[tuple[int, np.ndarray]]:
        letters = [sum(map(str.isalpha, word)) if not word.isalpha() else len(word) for word in words]
        return list(zip(letters, self.model.scores(words)))

    def label(self, texts: list[str], places: bool = True) -> list[Labelled]:
        nothing = np.zeros(len(self.model.names))
        if not self.model.names:
            return [Labelled([], nothing) for _ in texts]
        words = [words_of(text) for text in texts]
        numbers: defaultdict[str, int] = defaultdict(count().__next__)
        at = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64)
        described = self.cache.many(list(numbers))  # each word once a block
        scores = np.array([e for _, e in described]).reshape(-1, len(nothing))
        sizes = np.array([n for n, _ in described], np.int64)
        cuts = np.cumsum([len(row) for row in words])[:-1]
        own = np.split(at, cuts)
        labels = label_words([scores[row] for row in own])
        out = []
        for text, row, found in zip(texts, own, labels):
            counted = sizes[row]
            weight = np.bincount(found, counted, minlength=len(nothing)) if len(found) else nothing
            spans = self._spans(text, counted, found) if places and weight.any() else []
            out.append(Labelled(spans, weight))
        return out

    @staticmethod
    def _spans(text: str, letters: np.ndarray, labels: np.ndarray) -> list[tuple[int, int, int]]:
        """Runs of words of one language, from the first letter to the last, in code points of the text as given."""
        lower = text.lower()
        found = [m.span() for m in _WORD.finditer(text if len(lower) == len(text) else lower)]
        changes = np.flatnonzero(np.diff(labels)) + 1
        cuts = [0, *changes.tolist(), len(labels)]
        return [(found[a][0], found[b - 1][1], int(labels[a])) for a, b in zip(cuts, cuts[1:])]


def _labelled(rows: DataFrame, model: Model, kind: str, build, places: bool) -> DataFrame:
    """The first column of the rows and what `build` makes of the labels of their second one, a text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch, texts in blocks(batches):
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), **build(labeller.label(texts, places))})

    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, {kind}")


def label_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id and spans: an array of start, end (code points) and lang, in order."""
    names = model.names

    def build(found: list[Labelled]) -> dict:
        spans = [[{"start": a, "end": b, "lang": names[j]} for a, b, j in x.spans] for x in found]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        return {"spans": pa.array(spans, kind)}

    kind = "spans array<struct<start: bigint, end: bigint, lang: string>>"
    return _labelled(pick(docs, id_col, text_col), model, kind, build, True).withColumnRenamed("id", id_col)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id, lang_pred, and score: the share of the letters that lie in spans of that language."""
    names = model.names

    def build(found: list[Labelled]) -> dict:
        best = [int(x.letters.argmax()) if x.letters.any() else -1 for x in found]
        scores = [float(x.letters[j] / x.letters.sum()) if j >= 0 else 0.0 for x, j in zip(found, best)]
        return {
            "lang_pred": pa.array([names[j] if j >= 0 else UNKNOWN for j in best], pa.string()),
            "score": pa.array(scores, pa.float64()),
        }

    kind = "lang_pred string, score double"
    return _labelled(pick(docs, id_col, text_col), model, kind, build, False).withColumnRenamed("id", id_col)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs, Stage(spark, "languages")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
