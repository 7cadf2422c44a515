"""How many calls the packing operator's tokenizer takes for new words."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from openchair.llm import packing
from openchair.llm.pieces import PartIds


def test_new_words_are_encoded_hundreds_at_a_time():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = packing.Tokenizer(path), Tokenizer.from_file(path)
    calls, encode = [], own._ids
    own._ids = lambda text: calls.append(text) or encode(text)
    texts = ["head " + " ".join(f"w{i}x{i * i}" for i in range(at, at + 200)) for at in (0, 200)]
    found = [np.frombuffer(ids, dtype="<u4").tolist() for ids in own.encode(texts)]
    assert found == [plain.encode(text, add_special_tokens=False).ids for text in texts]
    # One call for the first word of both texts, one for the 400 others.
    assert len(calls) == 2


def test_words_with_other_marks_are_no_new_words():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = packing.Tokenizer(path), Tokenizer.from_file(path)
    calls, encode = [], own._ids
    own._ids = lambda text: calls.append(text) or encode(text)
    words = [f"wörd{i}é" for i in range(300)]
    texts = ["head " + " ".join(word + mark for word in words) for mark in ("", ",", ".", '"),', "'", "$$$")]
    found = [np.frombuffer(ids, dtype="<u4").tolist() for ids in own.encode(texts)]
    assert found == [plain.encode(text, add_special_tokens=False).ids for text in texts]
    assert sum(map(len, calls)) < 1.1 * len(" ".join(words))


def test_ids_of_words_beside_marks(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(packing, "CACHED", 40)
    monkeypatch.setattr(packing, "WORDS_AT_ONCE", 3)
    own, plain = packing.Tokenizer(path), Tokenizer.from_file(path)
    rng = random.Random(4)
    texts = [
        "ab$$$ ab$$$$ ab,,,,,,. it's. don't, x' 'll we'll! l'l... a's' 12% 1'2. "
        "\u00d7, \u2026. \u0130. \u00bd) \u00aa. \u02b0, \u0301. \u4e2d. \u2014,"
    ]
    for signs in ("ab1. ", "sdtl' .", "é×ª½…’.,' ", "中Ġ\u0301\u0130.) \n", "a.\n ", "a\x1c.\u00a0 \x85!"):
        texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        for text, ids in zip(some, own.encode(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert len(own.words.parts) == len(own.words.ids) == 40


def test_known_parts_are_those_used_last():
    asked = []

    def compute(parts):
        asked.append(parts.to_pylist())
        return pa.array([part.upper().encode() for part in parts.to_pylist()], pa.large_binary())

    known = PartIds(compute, limit=3, longest=4)
    for parts, new in (("abab", "ab"), ("cb", "c"), ("da", "d"), ("b", "b"), ("ad", ""), ("c", "c")):
        assert known.many(pa.array(list(parts))).to_pylist() == [part.upper().encode() for part in parts]
        assert "".join(sorted(asked[-1])) == new
    assert known.many(pa.array(["longer", "a", "longer"])).to_pylist() == [b"LONGER", b"A", b"LONGER"]
    assert asked[-1] == ["longer"] and "longer" not in known.parts.to_pylist()
    assert known.many(pa.array([], pa.string())).to_pylist() == []
