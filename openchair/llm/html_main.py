"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into blocks of text; each is described by its ancestors (tags, and words of class, id and role) and by its text
(length, links, punctuation, place on the page). A chain of two labels, article or not, is trained on labelled pages: drawn
layouts, and a bounded sample of the table's own pages that mark their article by an element. Viterbi decodes each page.

Defined cases: a null or empty page, or one without text, has an empty main text; very long pages are decoded whole; repeated
rows are decoded one by one; an empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from openchair.llm.common import pick, table
from openchair.llm.html_blocks import Block, blocks_of
from openchair.llm.html_pages import labelled_pages

DRAWN_PAGES = 600
SAMPLED_PAGES = 200
STEPS = 250
RATE = 0.1
PENALTY = 2e-4
_NAME = re.compile(r"[a-z]+")
_NOT_MAIN = frozenset("nav header footer aside form button select".split())


def path_features(path: tuple[tuple[str, str], ...]) -> list[str]:
    inner = path[-1][0] if path else "none"
    found = {"bias", f"tag={inner}"} | {f"in={tag}" for tag, _ in path if tag not in ("html", "body")}
    for tag, names in path:
        found |= {f"name={word}" for word in _NAME.findall(names.lower())} if names else set()
    return sorted(found)


def text_features(block: Block, i: int, n: int) -> list[str]:
    text = block.text
    size, links = len(text), block.link_chars / len(text)
    ends = text[-1] in ".!?:;\"'…»”"
    return [
        f"size={min(7, size.bit_length() - 1)}",
        f"links={0 if not links else 1 if links < 0.5 else 2 if links < 0.9 else 3}",
        f"ends={ends}",
        f"sentences={min(3, sum(text.count(x) for x in '.!?'))}",
        f"copyright={'©' in text}",
        f"place={'first' if i == 0 else 'last' if i == n - 1 else 'early' if 4 * i < n else 'late' if 4 * i >= 3 * n else 'middle'}",
        f"long={size > 80}&links={links > 0.5}",
    ]


@dataclass
class Chain:
    """Weights of label 1 against label 0 by feature, and of transitions between labels."""

    weights: dict[str, float] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    _paths: dict = field(default_factory=dict)

    def emission(self, block: Block, i: int, n: int) -> float:
        get = self.weights.get
        own = self._paths.get(block.path)
        if own is None:
            if len(self._paths) > 20_000:
                self._paths.clear()
            own = self._paths[block.path] = sum(get(name, 0.0) for name in path_features(block.path))
        return own + sum(get(name, 0.0) for name in text_features(block, i, n))

    def decode(self, blocks: list[Block]) -> list[int]:
        """The best labels of a page's blocks (Viterbi)."""
        n = len(blocks)
        (stay0, to1), (to0, stay1) = self.moves.tolist()
        score0, score1, back = 0.0, 0.0, []
        for i, block in enumerate(blocks):
            e = self.emission(block, i, n)
            if i:
                from0 = score0 + stay0, score1 + to0
                from1 = score0 + to1, score1 + stay1
                back.append((int(from0[1] > from0[0]), int(from1[1] > from1[0])))
                score0, score1 = max(from0), max(from1)
            score1 += e
        labels = [int(score1 > score0)] if n else []
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = blocks_of(page or "")
        return "\n".join(block.text for block, label in zip(blocks, self.decode(blocks)) if label)


def fit(pages: list[tuple[list[Block], list[int]]]) -> Chain:
    """Maximum likelihood with a quadratic penalty, by full-batch Adam; forward and backward sums over all pages at once."""
    pages = [(blocks, labels) for blocks, labels in pages if blocks]
    if not pages:
        return Chain()
    rows = [
        [*path_features(b.path), *text_features(b, i, len(blocks))] for blocks, _ in pages for i, b in enumerate(blocks)
    ]
    names = sorted({name for row in rows for name in row})
    place = {name: i for i, name in enumerate(names)}
    row_of = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
    col_of = np.array([place[name] for row in rows for name in row])
    sizes = np.array([len(blocks) for blocks, _ in pages])
    longest, n = int(sizes.max()), len(pages)
    live = np.arange(longest)[None, :] < sizes[:, None]
    gold = np.zeros((n, longest), dtype=np.int64)
    gold[live] = np.concatenate([labels for _, labels in pages])
    pair_live = live[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[:, :-1][pair_live], gold[:, 1:][pair_live]), 1)
    target = np.bincount(col_of, weights=gold[live][row_of], minlength=len(names))

    w, moves = np.zeros(len(names)), np.zeros((2, 2))
    m = np.zeros(len(names) + 4)
    v = m.copy()
    for step in range(1, STEPS + 1):
        emit = np.zeros((n, longest, 2))
        emit[live, 1] = np.bincount(row_of, weights=w[col_of], minlength=len(rows))
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, longest):
            reached = np.logaddexp(ahead[:, t - 1, 0, None] + moves[0], ahead[:, t - 1, 1, None] + moves[1]) + emit[:, t]
            ahead[:, t] = np.where(live[:, t, None], reached, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            onward = emit[:, t + 1] + behind[:, t + 1]
            value = np.logaddexp(moves[:, 0] + onward[:, 0, None], moves[:, 1] + onward[:, 1, None])
            behind[:, t] = np.where(live[:, t + 1, None], value, 0.0)
        whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        single = np.exp(ahead[:, :, 1] + behind[:, :, 1] - whole[:, None])
        onward = emit[:, 1:] + behind[:, 1:]
        pair = np.exp(
            ahead[:, :-1, :, None] + moves[None, None] + onward[:, :, None, :] - whole[:, None, None, None]
        )
        g_w = np.bincount(col_of, weights=single[live][row_of], minlength=len(names)) - target
        g_m = (pair * pair_live[:, :, None, None]).sum(axis=(0, 1)) - seen
        g = np.concatenate([g_w, g_m.ravel()]) / n + PENALTY * np.concatenate([w, moves.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, moves = w - change[:-4], moves - change[-4:].reshape(2, 2)
    return Chain(dict(zip(names, w.tolist())), moves)


def marked_labels(blocks: list[Block]) -> list[int] | None:
    """Labels by the element that marks the article, if the page has just that."""
    inside = [
        int(any(tag in ("article", "main") for tag, _ in b.path) and not any(tag in _NOT_MAIN for tag, _ in b.path))
        for b in blocks
    ]
    return inside if any(inside) else None


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Chain:
    """A chain from drawn pages and a bounded sample, by digest of the id, of pages that mark their article."""
    examples = []
    for page, main in labelled_pages(DRAWN_PAGES):
        blocks = blocks_of(page)
        examples.append((blocks, [int(b.text in main) for b in blocks]))
    named = pick(pages, id_col, html_col).toDF("page_id", "html")
    ids = named.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLED_PAGES)
    sample = named.join(ids.distinct(), "page_id", "left_semi").dropDuplicates(["page_id"])
    for row in sorted(sample.collect(), key=lambda r: r["page_id"]):
        blocks = blocks_of(row["html"] or "")
        labels = marked_labels(blocks)
        if labels:
            examples.append((blocks, labels))
    return fit(examples)


def extract_main(
    pages: DataFrame, chain: Chain, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Per row: page_id, url and text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([chain.main_text(page) for page in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], texts], names=["page_id", "url", "text"])

    named = pick(pages, id_col, url_col, html_col)
    kinds = [f.dataType.simpleString() for f in named.schema[:2]]
    return named.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extract_main(pages, train(pages))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
