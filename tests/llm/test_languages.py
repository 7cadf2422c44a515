"""Language identification: Viterbi against brute force, spans, held-out accuracy and the defined cases."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from openchair.llm import languages
from openchair.llm.common import Stage, table

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT string"
EN = "the weather in the north was cold and the people of the town stayed inside their houses"
DE = "das wetter im norden war kalt und die leute der stadt blieben in ihren häusern"
RU = "погода на севере была холодной и люди города оставались в своих домах"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, "clash") for i, t, lang in rows], DOC)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * 20)]
    return languages.train(docs_of(spark, rows), Stage(spark, "test"))


def best_path(evidence, switch):
    n, k = evidence.shape

    def value(path):
        return sum(evidence[i, j] for i, j in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))

    return max(value(path) for path in itertools.product(range(k), repeat=n)), value


def test_viterbi_finds_the_best_sequence_of_every_text():
    rng = np.random.default_rng(4)
    for k in (1, 2, 3):
        texts = [-4 * rng.random((n, k)) for n in (0, 1, 7, 3, 6, 7, 0, 2)]
        for switch in (0.5, 2.0, 30.0):
            for evidence, labels in zip(texts, languages.label_words(texts, switch)):
                assert len(labels) == len(evidence)
                if len(evidence):
                    most, value = best_path(evidence, switch)
                    assert value(labels) == pytest.approx(most)
    assert languages.label_words([np.zeros((0, 2))])[0].size == 0


def test_spans_of_mixed_texts(spark, model):
    text = f"{EN.upper()}. {DE}! {EN}; {RU}"
    labelled = languages.label_spans(docs_of(spark, [(1, text, None), (2, EN, None)]), model)
    spans = dict(labelled.select("doc_id", "spans").collect())
    assert [(s.lang, text[s.start : s.end]) for s in spans[1]] == [
        ("en", EN.upper()), ("de", DE), ("en", EN), ("ru", RU),
    ]
    assert [tuple(s) for s in spans[2]] == [(0, len(EN), "en")]
    found = languages.predict(docs_of(spark, [(1, text, None)]), model).first()
    letters = [sum(map(str.isalpha, t)) for t in (EN, DE, RU)]
    assert found.lang_pred == "en"
    assert found.score == pytest.approx(2 * letters[0] / (2 * letters[0] + letters[1] + letters[2]))


def test_a_single_odd_word_starts_no_span_but_its_script_does(spark, model):
    words = EN.split()
    odd = " ".join(words[:6] + ["häusern"] + words[6:])
    greek = " ".join(words[:6] + ["города"] + words[6:])
    spans = dict(languages.label_spans(docs_of(spark, [(1, odd, None), (2, greek, None)]), model).collect())
    assert [s.lang for s in spans[1]] == ["en"]
    assert [s.lang for s in spans[2]] == ["en", "ru", "en"]


def test_scripts():
    cases = {"a": "latin", "É": "latin", "я": "cyrillic", "α": "greek", "漢": "han", "か": "kana", "한": "hangul", "क": "devanagari"}
    assert {c: languages.script(c) for c in cases} == cases
    assert languages.words_of("Don't été हिन्दी x2y ²") == ["don", "t", "été", "हिन्दी", "x", "y", "²"]


def test_defined_cases(spark, model):
    texts = [None, "", " \n", "123 $%", "½²", "日本", "x" * 200_000, f"{EN} " * 3000, EN, EN, "İİİ"]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    found = languages.predict(docs_of(spark, rows + [(None, DE, "de")]), model).toPandas()
    got = {int(i) if i == i else None: (lang, s) for i, lang, s in found.itertuples(index=False)}
    assert all(got[i] == ("und", 0.0) for i in range(5))
    assert all(got[i][0] in model.names for i in (5, 6, 10))
    assert got[7][0] == got[8][0] == got[9][0] == "en" and got[8] == got[9]
    assert got[None][0] == "de"
    assert languages.predict(docs_of(spark, []), model).count() == 0
    for rows in ([], [(None, EN, "en")], [(3, EN, None)]):
        unknown = languages.train(docs_of(spark, rows), Stage(spark, "test"))
        assert unknown.names == ()
        assert languages.predict(docs_of(spark, [(1, EN, None)]), unknown).collect() == [(1, "und", 0.0)]
    silent = languages.train(docs_of(spark, [(i, " ", "xx") for i in range(5)]), Stage(spark, "test"))
    assert languages.predict(docs_of(spark, [(1, EN, None)]), silent).first().lang_pred == "xx"


def test_held_out_labels_are_not_used_and_are_predicted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = languages.op12_language_id(spark, sf_dir).toPandas()
    true = docs.select("doc_id", "lang").toPandas().merge(found, on="doc_id")
    assert len(true) == docs.count()
    out = true[true.held_out & true.lang.notna()]
    assert len(out) > 40 and (out.lang == out.lang_pred).mean() > 0.97
    other = docs.selectExpr("doc_id", "text", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, 'zz', lang) AS lang")
    assert languages.train(other, Stage(spark, "test")).names == tuple(sorted(set(true.lang[~true.held_out].dropna())))
