"""Phrase mining against its SQL, plain counting, and the defined cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from openchair.llm import phrases
from openchair.llm.common import Stage

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, LANG string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, "clash") for i, (t, lang) in enumerate(rows)], DOC)


def drawn(n=120, words=40, seed=3):
    """Texts of few words of unequal frequency, in two languages and none, with separators and odd spaces."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    rows = []
    for _ in range(n):
        chosen = rng.choices(vocabulary, weights, k=rng.randint(0, 80))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", " \x85 "]) for w in chosen)
        rows.append((text, rng.choice(["a", "a", "b", None, "und"])))
    return rows + [(None, "a"), ("", "c"), (" \n\t.", "d"), ("The the " * 3000, "e"), rows[0], rows[0]]


def plain_counts(rows, least, longest):
    """Phrase counts by lang, by splitting and counting."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found, totals = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    found[lang or "und", " ".join(words[i : i + size])] += 1
    return {key: n for key, n in found.items() if n >= least}, totals


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_counts_are_exact_whatever_the_sample_proposed(spark, monkeypatch, longest):
    monkeypatch.setattr(phrases, "SAMPLE_LEAST", 4)  # so that the sample misses many
    rows = drawn()
    counts = phrases.frequent_phrases(docs_of(spark, rows), Stage(spark, "test"), longest).toPandas()
    true, totals = plain_counts(rows, phrases.LEAST, longest)
    some = counts[counts["size"] > 0]
    assert len(some) == len(true)
    assert {(r.lang, r.phrase): r.n for r in some.itertuples()} == true
    whole = counts[counts["size"] == 0]
    assert {r.lang: r.n for r in whole.itertuples() if r.n} == {k: n for k, n in totals.items() if n}


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    everything = phrases.Proposed(np.full(phrases.FILTER_BITS >> 6, ~np.uint64(0)))
    monkeypatch.setattr(phrases.Proposed, "of", classmethod(lambda cls, df: everything))
    rows = drawn(40)
    counts = phrases.frequent_phrases(docs_of(spark, rows), Stage(spark, "test")).where("size > 0").collect()
    assert {(r.lang, r.phrase): r.n for r in counts} == plain_counts(rows, phrases.LEAST, 3)[0]


def test_collocations_equal_the_sql(spark):
    rows = drawn()
    documents = pd.DataFrame({"text": [t for t, _ in rows], "lang": [lang for _, lang in rows]})
    connection = duckdb.connect()
    connection.register("documents", documents)
    true = connection.execute(phrases.SQL).df().sort_values(["lang", "rank"]).reset_index(drop=True)
    counts = phrases.frequent_phrases(docs_of(spark, rows), Stage(spark, "test"))
    found = phrases.collocations(counts).toPandas().sort_values(["lang", "rank"]).reset_index(drop=True)
    assert len(found) > 40
    pd.testing.assert_frame_equal(found, true[found.columns], check_dtype=False)


def test_ties_wide_products_and_the_cut_of_the_list(spark):
    big = 4_000_000_000_000
    rows = [
        ("x", 0, "", 9 * big),
        *[("x", 1, w, big) for w in ("a", "b", "c", "ä")],
        ("x", 2, "a b", big - 1), ("x", 2, "b c", big - 1), ("x", 2, "ä a", big), ("x", 2, "c ä", big),
        ("x", 3, "a b c", big - 1),
    ]
    counts = spark.createDataFrame(rows, "lang string, size int, phrase string, n bigint")
    found = phrases.collocations(counts, kept=2).orderBy("rank").collect()
    # Inside the longer phrase: a b and b c. Equal scores and counts: by bytes, so c comes before ä.
    assert [(r["rank"], r.phrase, r.score) for r in found] == [(1, "c ä", 1_000_000), (2, "ä a", 1_000_000)]
    third = [r for r in phrases.collocations(counts).collect() if r["rank"] == 3][0]
    cut = 1_000_000 * (big - 1) ** 2 // (big * (big - 1))
    assert (third.phrase, third.l, third.r, third.score) == ("a b c", big, big - 1, cut)


def test_empty_tables(spark):
    for rows in ([], [(None, None)], [("", "a")]):
        counts = phrases.frequent_phrases(docs_of(spark, rows), Stage(spark, "test"))
        assert phrases.collocations(counts).count() == 0
