"""Operators against brute force, round trips and defined cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, namedtuple

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from openchair.llm import byte_bpe, chat, html_main, html_pages, minhash, packing, pivots, quality, secrets
from openchair.llm import token_counts, toxicity
from openchair.llm.common import Stage
from openchair.llm.html_blocks import blocks_of

Document = namedtuple("Document", "doc_id text")
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT string"
TEXTS = [None, "", " \n\t ", "one", "a b c d e f", "ärger  und\n\nnoch mehr \U0001f642 text", "x" * 5000, "<|endoftext|> hi"]


def docs_of(spark, texts, first=0):
    rows = [(first + i, t, None, None, None, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeioué") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    long = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) for _ in range(60)]
    near = [text + " tail" for text in long[:20]] + long[:10]
    return docs_of(spark, TEXTS + long + near)


def plain_rows(df):
    """doc_id and text by place; the name `text` is ambiguous here on purpose."""
    return [Document(row[0], row[1]) for row in df.collect()]


def collected(df):
    return df.toPandas()


def test_bpe_equals_the_reference_encoder(spark, docs):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = byte_bpe.read_ranks(path)
    plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode_texts(docs, path, pattern)
    found = collected(byte_bpe.decode_ids(encoded, path, pattern)).set_index("doc_id")
    for row in plain_rows(docs):
        assert list(found.ids[row.doc_id]) == plain.encode_ordinary(row.text or "")
        assert bytes(found.decoded[row.doc_id]) == (row.text or "").encode()


def test_bpe_of_odd_white_space_long_words_and_no_rows(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rng = random.Random(3)
    texts = ["", " ", "  ", None, " a", "a ", "a  b", "a \n b", "a\u3000 b c", "it's we'll 's", "plain words only here"]
    texts += ["".join(rng.choice("abc漢é") for _ in range(size)) for size in (62, 63, 64, 65, 66, 3000)]
    texts += ["".join(rng.choice("ab  \n\t'1.é") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(4, " a")], "doc_id long, text string")
    found = byte_bpe.round_trip(rows, path, pattern).collect()
    assert len(found) == len(texts) + 1
    for doc_id, ids, decoded in found:
        assert ids == plain.encode_ordinary(texts[doc_id] or "")
        assert bytes(decoded) == (texts[doc_id] or "").encode()
    assert byte_bpe.round_trip(rows.limit(0), path, pattern).count() == 0


def test_lookup_equals_a_dict():
    rng = np.random.default_rng(5)
    for size in (0, 1, 7, 5000):
        keys = rng.choice(1 << 40, size, replace=False) if size else np.zeros(0, dtype=np.int64)
        lookup, known = byte_bpe.Lookup(keys, np.arange(size)), dict(zip(keys.tolist(), range(size)))
        wanted = np.concatenate([keys, rng.integers(0, 1 << 40, 1000)])
        assert lookup(wanted).tolist() == [known.get(key, -1) for key in wanted.tolist()]


def test_bpe_appends_and_edits():
    merges = byte_bpe.Merges(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    rng = random.Random(1)
    for _ in range(150):
        data = "".join(rng.choice("theing ab漢é") for _ in range(rng.randint(1, 60))).encode()
        whole = byte_bpe.PrefixEncoder(merges, data)
        a, b = sorted(rng.randrange(len(data) + 1) for _ in range(2))
        grown = byte_bpe.PrefixEncoder(merges, data[:a])
        grown.append(data[a:])
        assert grown.last == whole.last
        whole.replace(a, b, b"the")
        assert whole.last == byte_bpe.PrefixEncoder(merges, data[:a] + b"the" + data[b:]).last


def test_token_counts_equal_plain_viterbi(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.zipf_scores(path)
    model = token_counts.Unigram(scores)

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(best[end - 1][0] + n * model.fallback, best[end - 1][1] - n)]
            for start in range(end):
                if word[start:end] in scores:
                    options.append((best[start][0] + scores[word[start:end]], best[start][1] - 1))
            best.append(max(options))
        return -best[-1][1]

    found = collected(token_counts.count_tokens(docs, path)).set_index("doc_id")
    for row in plain_rows(docs):
        words = re.findall(r"[^ \t-\r]+", row.text or "")
        if row.text and len(row.text) < 1000:
            assert found.n_tokens[row.doc_id] == sum(plain("▁" + word) for word in words)
        assert found.n_pretokens[row.doc_id] == len(words)


def test_loss_spans_count_characters_and_bytes_alike(spark):
    rows = [(c, t, r, "é漢😀<|"[: t % 6] * (t % 3)) for c in range(40) for t, r in enumerate("uaaauaua"[: c % 9])]
    rows = [(c, t, {"a": "assistant", "u": "usér"}[r], x) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    seen = 0
    for row in chat.format_conversations(df).collect():
        whole = row.formatted.encode()
        texts = [x for c, _, r, x in rows if c == row.conv_id and r == "assistant"]
        escaped = [x.replace("\\", "\\\\").replace("<|", "<\\|") for x in texts]
        assert [row.formatted[s.start : s.start + s.length] for s in row.loss_spans] == escaped
        assert [whole[s.first_byte : s.first_byte + s.n_bytes].decode() for s in row.loss_spans] == escaped
        seen += len(texts)
    assert seen > 50


@pytest.mark.parametrize("roles", [("user", "assistant"), ("assistant", "assistant")])
def test_long_conversations_cost_little_more_than_their_length(spark, roles):
    def seconds(n):
        rows = spark.range(n).selectExpr(
            "1L AS conv_id", "id AS turn", f"element_at(array('{roles[0]}', '{roles[1]}'), int(id % 2) + 1) AS role", "'é text' AS text"
        )
        begin = time.time()
        formatted = chat.format_conversations(rows.repartition(1))
        back = formatted.select(F.length(chat.read_loss_text(F.col("formatted"), F.col("loss_spans"))).alias("n")).first()
        assert back.n == 6 * sum(roles[i % 2] == "assistant" for i in range(n))
        return time.time() - begin

    seconds(100)
    # Quadratic work would take 64 times as long; the seconds added cover planning.
    assert seconds(40_000) < 16 * seconds(5_000) + 4


def test_chat_round_trip_with_control_strings(spark):
    odd = ["<|im_end|>", "a<|im_sep|>b", "\\", "<\\|", "<\\\\|im_end|>", "", None, "x\ny", "<|im_start|>assistant\nhi<|im_end|>\n"]
    rng = random.Random(2)
    rows = [
        (conv, turn, rng.choice(["user", "assistant", "sys<|\ntem", None]), rng.choice(odd), 1)
        for conv in (1, 2, 3, None)
        for turn in range(12)
    ]
    rows += [(9, None, "assistant", "last", 1), (9, None, "assistant", "last", 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, TURN int")
    formatted = chat.format_conversations(df)
    back = formatted.select(
        "conv_id",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    ).collect()
    assert len(back) == 5
    for row in back:
        own = sorted(
            ((t if t is not None else -1, r or "", x or "") for c, t, r, x, _ in rows if c == row.conv_id)
        )
        assert [(t.role, t.text) for t in row.turns] == [(r, x) for _, r, x in own]
        assert row.loss == "".join(x for _, r, x in own if r == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_quality_counts_equal_plain_python(spark, docs):
    rep = " ".join(f"w{i % 9}" for i in range(60))
    texts = TEXTS + [rep, "a\na\n \nb\na", "the " * 30, "# * $ word!!", " nbsp x " * 12]
    df = docs_of(spark, texts)
    found = {r.doc_id: r for r in quality.measure(df).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^ \t-\r]+", text or "")
        grams = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {p for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
        row = found[i]
        assert (row.n_words, row.word_chars, row.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert row.n_dup_lines == len(lines) - len(set(lines))
        assert row.n_symbols == sum(c in "#*$%&|<>" for c in text or "")
        assert row.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert {r[0] for r in kept.collect()} == {i for i, r in found.items() if r.kept}


SYNTAXES = {
    "element": "<db><password> @ </password></db>",
    "tag": '<add key="DbPassword" value="@"/>',
    "tag of two lines": "<property name='db.token'\n  value='@'>",
    "block": "user: u\npassword: |\n  @\nnext: 1",
    "folded block in a list": "a:\n  - secret_key: >-\n\n      @\n  - b: c",
    "ENV": "FROM x\nENV DB_PASSWORD @",
    "ENV quoted": 'ENV DB_PASSWORD "@"\nRUN x',
    "setenv": "setenv API_TOKEN @\n",
    "define": '#define API_SECRET "@"',
    "define passed on": '# define K "@"\nsession_token = K',
    "setter": 'db.setPassword("@")',
    "snake setter": "p.set_password( '@' );",
    "named setter": 'props.setProperty("db.password", "@");',
    "put": 'editor.putString("auth_token","@")',
    "long annotation": f'password: Annotated[str, Field({"x" * 500})] = "@"',
    "second annotation": f'n: dict[str, list[int]] = {{}}; password: Map<String, {"y" * 90}> = "@"',
}


@pytest.mark.parametrize("name", SYNTAXES)
def test_secrets_without_a_sign_of_assignment(name):
    secret = "hN7xQ2vLw9Zt"
    text = "é\n" + SYNTAXES[name].replace("@", secret)
    found = [text[a:b] for kind, a, b in secrets.spans_of(text) if kind == "literal"]
    assert found == [secret]
    assert secret not in secrets.redacted(text)


@pytest.mark.parametrize(
    "text",
    [
        '<a href="x">password</a>',
        "<color>hN7xQ2vLw9Zt</color>",
        'setColor("hN7xQ2vLw9Zt")',
        'put("colour", "hN7xQ2vLw9Zt")',
        "ENV COLOR hN7xQ2vLw9Zt",
        "note: |\n  hN7xQ2vLw9Zt",
        "password: |\nhN7xQ2vLw9Zt",
        "password(get())",
        "set the password (later) and put it away",
    ],
)
def test_literals_of_plain_names_are_no_secrets(text):
    assert secrets.spans_of(text) == []


HOSTILE = {
    "tags": "<a>x",
    "attributes": 'b="c" ',
    "open tags": '<a b="c" ',
    "setters": 'set("',
    "blocks": "a: |\n  b: |\n",
    "annotations": "a: b[",
    "closed annotations": 'a: b[c]= "x" ',
    "definitions": "#define a ",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_long_texts_of_one_syntax_cost_linear_time(name):
    def seconds(n):
        text, begin = HOSTILE[name] * n, time.process_time()
        secrets.spans_of(text)
        return time.process_time() - begin

    # Quadratic work would take 64 times as long; the half second covers the clock.
    assert seconds(40_000) < 20 * seconds(5_000) + 0.5


def test_secrets(spark):
    key = "AKIA" + "Z" * 16
    text = f'Ünì db_password: "h4xK9.qq" then {key} and {"0a" * 12} K = "s3cretValue99"\nsession_token = K\nname = "plain words"'
    found = secrets.spans_of(text)
    by_kind = {}
    for kind, start, end in found:
        by_kind.setdefault(kind, []).append(text[start:end])
    assert by_kind["access"] == [key]
    assert by_kind["hex"] == ["0a" * 12]
    assert by_kind["assign"] == ['password: "h4xK9.qq', "token = K"][:1]
    assert "s3cretValue99" in by_kind["literal"]  # passed on to a sensitive name
    assert secrets.spans_of("paſſword=abcdefgh token=abc Key: x") == []
    df = docs_of(spark, TEXTS + [text])
    rows = {r.doc_id: r.spans for r in secrets.find_secrets(df).collect()}
    assert [(s.kind, s.start, s.end) for s in rows[len(TEXTS)]] == found
    assert rows[0] == [] and secrets.find_secrets(df.limit(0)).count() == 0
    clean = secrets.redact(df)
    assert clean.columns == df.columns
    texts = [r[1] for r in sorted(clean.collect())]
    assert texts[: len(TEXTS)] == TEXTS and "s3cret" not in texts[-1] and key not in texts[-1]


@pytest.mark.parametrize(
    "text",
    [
        'cfg["password"] = "@"',
        "os.environ['DB_PASSWORD'] = '@'",
        'app.config["db"].password = "@"',
        'password: str = "@"',
        'password: Optional[str] = "@"',
        'const apiKey: string = "@";',
        'let password: &str = "@";',
        'var password string = "@"',
        'char password[] = "@";',
        'password = b"@"',
        "password = rb'@'",
        'password = """@"""',
        "password = \'\'\'\\\n@\n\'\'\'",
        'password = "ab\\"@"',
        'password = ("@")',
        'password = ["@", "zz9Qw1Lk8Vb2"]',
        'password = "hN7x" + "Q2vLw9Zt"',
        'password = ("hN7x"\n    "Q2vLw9Zt")',
        'password = prefix + "@"',
        'K = "hN7x"\npassword = K + "Q2vLw9Zt"',
        'self.K = "@"\npassword = self.K',
        'class C:\n    K = "@"\npassword = C.K',
        'cfg["k"] = "@"\npassword = cfg["k"]',
        'password = k = "@"',
        'note: set token = "@"',
        'cmd = "run --password=@ now"',
        '{\\"password\\": \\"@\\"}',
    ],
)
def test_assignment_forms(text):
    text = text.replace("@", "hN7xQ2vLw9Zt")
    literals = "".join(text[a:b] for kind, a, b in secrets.spans_of(text) if kind == "literal")
    assert "hN7xQ2vLw9Zt" in literals
    clean = secrets.redacted(text)
    assert "hN7x" not in clean and "Q2vLw9Zt" not in clean


def runs_of(text, at, signs):
    end = at
    while end < len(text) and text[end] in signs:
        end += 1
    return end


def plain_base_spans(text):
    """The three base kinds by walking over the characters."""
    digits, upper = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value = digits + upper + upper.lower() + "+/_.=-"
    low = "".join(c.lower() if c in upper else c for c in text)
    found, at = [], 0
    while at < len(text):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(w, at)), None)
        end = at + 1
        if word:
            here = at + len(word)
            here = runs_of(text, here + (text[here : here + 1] in ('"', "'")), " ")
            if text[here : here + 1] in (":", "="):
                here = runs_of(text, here + 1, " ")
                here += text[here : here + 1] in ('"', "'")
                stop = runs_of(text, here, value)
                if stop > here:
                    end = stop
                    if stop - here >= 6:
                        found.append(("assign", at, stop))
        at = end
    for kind, signs, head, least in (("access", digits + upper, "AKIA", 20), ("hex", digits + "abcdef", "", 24)):
        at = 0
        while at < len(text):
            stop = runs_of(text, at + len(head), signs) if text.startswith(head, at) else at
            if stop - at >= least:
                found.append((kind, at, stop))
            at = max(at + 1, stop if stop > at + len(head) else at)
    return sorted(found, key=lambda span: (span[1], ("assign", "access", "hex").index(span[0])))


def test_base_spans_equal_a_plain_scan(spark):
    from openchair.llm.secrets import op5_secret_scan

    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = op5_secret_scan(spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    seen = 0
    for row in found:
        want = plain_base_spans(texts[row.doc_id] or "")
        joined = ",".join(f"{kind}:{start}:{end}" for kind, start, end in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(w[0] == k for w in want) for k in ("assign", "access", "hex")]
        seen += len(want)
    assert seen > 0
    rng = random.Random(2)
    pieces = ["password", "PassWD", "api_key", "apikey", "token", "AKIA", "ABCD0123", "abcdef01", "=", ":", " ", '"', "'", "x", "-é", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) * rng.randint(1, 3) for _ in range(rng.randint(1, 14)))
        own = sorted(secrets.base_spans(text), key=lambda span: (span[1], ("assign", "access", "hex").index(span[0])))
        assert own == plain_base_spans(text), text


def test_long_runs_of_name_characters_are_read_once():
    for text in ("x = 1 " + "a1" * 500_000, "x = 1 " + "a.-1" * 250_000, "a[0]." * 200_000):
        begin = time.perf_counter()
        secrets.spans_of(text)
        assert time.perf_counter() - begin < 5


def test_names_after_digits_dots_and_hyphens():
    for text in ('--password="hN7xQ2vLw9Zt"', '.db_password = "hN7xQ2vLw9Zt"', '1: db_password = "hN7xQ2vLw9Zt"', '9password = "hN7xQ2vLw9Zt"'):
        at = text.index("hN7")
        assert ("literal", at, at + 12) in secrets.spans_of(text)


def test_long_constants_pass_on_their_names():
    text = 'k = "hN7xQ2vLw9Zt"\n' + 'k = k + "y"\n' * 5000 + "password = k\n"
    assert "hN7xQ2vLw9Zt" in [text[a:b] for kind, a, b in secrets.spans_of(text)]


def brute_components(texts):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for text in texts:
        words = re.findall(r"[^ \t-\r]+", (text or "").translate(low))
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
        sets.append(grams)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = list(TEXTS) + ["A b C", "a B c"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 150))]
        for _ in range(rng.randint(1, 12)):
            changed = list(base)
            for _ in range(rng.randint(0, 5)):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            texts.append(" ".join(changed))
            base = changed if rng.random() < 0.4 else base
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(25)) for _ in range(15)]
    df = docs_of(spark, texts)
    nameless = spark.createDataFrame([(None, "a b c d e f", None, None, None, "x")], DOC)
    found = minhash.near_duplicates(df.unionAll(df.limit(5)).unionAll(nameless), Stage(spark, "test"))
    rows = {r.doc_id: r for r in found.collect()}
    sizes, components = brute_components(texts)
    assert [rows[i].n_shingles for i in range(len(texts))] == sizes
    assert [rows[i].component_id for i in range(len(texts))] == components
    assert all(rows[i].kept == (components[i] == i) for i in range(len(texts)))
    assert rows[None].component_id is None and rows[None].kept
    assert len(set(components)) < len(texts) - 20
    assert minhash.near_duplicates(df.limit(0), Stage(spark, "test")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = np.unique(pool[:300]), np.unique(pool[60:])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = minhash.signatures([a, b])
        errors.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_linked_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, label = [], 0
    for group in range(30):
        center = rng.normal(size=32)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (center + rng.normal(size=32) * 0.08).tolist(), int(group % 3)))
    rows += [(len(rows) + i, rows[i][1], rows[i][2]) for i in range(5)]
    n = len(rows)
    odd = [None, [0.0] * 32, [float("nan")] * 32, [None] * 32, [float("inf")] * 32, []]
    rows += [(n + i, v, 1) for i, v in enumerate(odd)] + [(n + len(odd), rows[0][1], None)]
    df = spark.createDataFrame(rows + rows[:3], "vec_id bigint, embedding array<float>, label int")
    found = {r.vec_id: r for r in pivots.near_vectors(df, Stage(spark, "test")).collect()}
    assert len(found) == len(rows)
    units = np.array([r[1] for r in rows[:n]], dtype=np.float32).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    linked = (units @ units.T >= 0.98) & np.equal.outer([r[2] for r in rows[:n]], [r[2] for r in rows[:n]])
    np.fill_diagonal(linked, False)
    got = np.array([found[i].n_links for i in range(n)])
    assert (got <= linked.sum(1)).all() and got.sum() >= 0.97 * linked.sum() > 40
    assert all(found[n + i].n_links == 0 and found[n + i].kept for i in range(len(odd) + 1))
    assert pivots.near_vectors(df.limit(0), Stage(spark, "test")).count() == 0


def test_links_in_a_large_near_group_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    n, width = 4500, 64
    vectors = rng.normal(size=(n, width))
    vectors[: n // 3] = rng.normal(size=width) + 0.09 * vectors[: n // 3]
    vectors[n - 300 :] = vectors[n - 600 : n - 300] + 0.15 * rng.normal(size=(300, width))
    vectors = rng.permutation(vectors).astype(np.float32)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors.tolist())], "vec_id bigint, embedding array<float>, label int")
    found = collected(pivots.near_vectors(df, Stage(spark, "test"))).set_index("vec_id").sort_index()
    units = pivots.unit_rows(vectors)
    linked = units @ units.T >= 0.98
    np.fill_diagonal(linked, False)
    assert linked.sum() > 0.9 * (n // 3) ** 2
    assert (found.n_links <= linked.sum(1)).all() and found.n_links.sum() >= 0.999 * linked.sum()
    component = np.arange(n)
    while (lower := np.where(linked, component, n).min(1).clip(max=component)).tolist() != component.tolist():
        component = lower
    assert (found.component_id == component).mean() >= 0.999


def test_lists_of_two_points_find_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(12)
    centers = rng.normal(size=(60, 24))
    vectors = np.repeat(centers, 8, axis=0) + 0.06 * rng.normal(size=(480, 24))
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors.tolist())], "vec_id bigint, embedding array<double>, label int")
    whole = collected(pivots.near_vectors(df, Stage(spark, "test"))).sort_values("vec_id")
    monkeypatch.setattr(pivots, "BLOCK", 16)
    cut = collected(pivots.near_vectors(df, Stage(spark, "test"))).sort_values("vec_id")
    assert whole.n_links.sum() > 400
    assert whole.to_numpy().tolist() == cut.to_numpy().tolist()


def test_repeated_ids_count_by_their_smallest_vector(spark):
    rows = [(1, [1.0, 0.0, 0.1], 1, "a"), (1, [0.0, 1.0, 0.1], 1, "b"), (2, [1.0, 0.0, 0.11], 1, "c"), (3, [0.0, 1.0, 0.11], 1, "d")]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "vec_id bigint, embedding array<double>, label int, VEC_ID string")
        found = {r.vec_id: r for r in pivots.near_vectors(df, Stage(spark, "test")).collect()}
        assert {i: (r.n_links, r.component_id) for i, r in found.items()} == {1: (1, 1), 2: (0, 2), 3: (1, 1)}


def test_widths_and_few_vectors(spark):
    rows = [(i, [1.0] * (2 + i % 2), 1) for i in range(4)] + [(9, [1.0, 0.0], 1)]
    found = {r.vec_id: r for r in pivots.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), Stage(spark, "test")).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in found.items()} == {0: (1, 0), 1: (1, 1), 2: (1, 0), 3: (1, 1), 9: (0, 9)}


def test_packing_plan_is_whole_and_tight():
    rng = random.Random(6)
    for histogram in ({700: 100, 683: 100, 665: 100}, {2048: 4}, {1: 5000}, dict(Counter(rng.randint(1, 2048) for _ in range(3000)))):
        plan = packing.plan_sequences(histogram)
        held = Counter()
        for config, times in plan.items():
            assert sum(length * n for length, n in config) <= packing.CAPACITY
            for length, n in config:
                held[length] += n * times
        assert held == Counter(histogram)
        least = math.ceil(sum(length * n for length, n in histogram.items()) / packing.CAPACITY)
        assert sum(plan.values()) <= 1.03 * least + 1
    assert packing.plan_sequences({}) == Counter()


def test_packed_pieces(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = docs.unionAll(docs_of(spark, ["long words " * 3000, "long words " * 3000], 1000))
    found = collected(packing.pack_documents(df, path, Stage(spark, "test"))).sort_values(["sequence_id", "offset"])
    starts = found.groupby("sequence_id").length.cumsum() - found.length
    assert (starts == found.offset).all() and found.groupby("sequence_id").length.sum().max() <= 2048
    plain = Tokenizer.from_file(path)
    for row in plain_rows(df):
        ids = np.array(plain.encode(row.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        own = found[found.doc_id == row.doc_id].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length[1:] == 2048).all()
        for piece in own.itertuples():
            assert piece.ids_crc32 == zlib.crc32(ids[piece.start : piece.start + piece.length].tobytes())
    assert packing.pack_documents(df.limit(0), path, Stage(spark, "test")).count() == 0


def test_tokenizer_of_odd_white_space():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), packing.Tokenizer(path)
    rng = random.Random(9)
    texts = ["", "\n", "a\n", "\na", "a\nb", "a\n\nb", "a\n\n", "a \nb", "a\n b", "a\u00a0\nb", "a\x1f\nb", "a\n<|endoftext|>\nb"]
    for signs in ("ab \n", "ab\n.", "ab \n\t\r\u00a0\u2003\x1c.'s1é", "ab \x85\x0b\n"):
        texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    for some in (texts, [t for t in texts if "  " not in t], *([t] for t in texts[:400])):
        for text, ids in zip(some, own.encode(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(10, 60))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["vileword", "zzgrr" + rng.choice(words)]))
        rows.append((i, " ".join(text), None, None, None, "x"))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    df = spark.createDataFrame(rows + [(5000, None, None, None, None, None), (5001, "", None, None, None, None)], DOC)
    known = spark.createDataFrame(labels + [(0, 1, None), (99999, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(df, known, Stage(spark, "test"))
    found = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([found[i] >= 0.7 for i in held if i % 8 == 0]) > 0.9
    assert np.mean([found[i] >= 0.7 for i in held if i % 8]) < 0.03
    assert found[5000] == found[5001] and 0 <= found[5000] < 0.7
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and kept.count() == sum(s < 0.7 for s in found.values())
    empty = toxicity.train(df.limit(0), known, Stage(spark, "test"))
    assert {r.score for r in toxicity.score(df, empty).collect()} == {0.0}


def test_main_text(spark):
    pages = [(i, "u", page, None) for i, (page, _) in enumerate(html_pages.labelled_pages(40, seed=5))]
    odd = [None, "", "<p>", "no tags here. Just a sentence.", "<script>var t='</p>';</script>"]
    schema = "page_id bigint, url string, html string, HTML string"
    df = spark.createDataFrame(pages + [(100 + i, None, x, None) for i, x in enumerate(odd)], schema)
    chain = html_main.train(df)
    found = {r.page_id: r.text for r in html_main.extract_main(df, chain).collect()}
    wrong = total = 0
    for (page, main), (i, *_) in zip(html_pages.labelled_pages(40, seed=5), pages):
        lines = {b.text for b in blocks_of(page)}
        got = set(found[i].split("\n"))
        wrong += len((got ^ main) & lines)
        total += len(lines)
    assert wrong < 0.02 * total
    assert found[100] == found[101] == found[102] == found[104] == ""
    plain = "<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; x</h1><p><b>One   two.<br><p>Three.</article><footer>&copy; f.</footer>"
    assert chain.main_text(plain) == "T & x\nOne two.\nThree."


def test_blocks_after_and_inside_embedded_elements():
    def texts(page):
        return " ".join(block.text for block in blocks_of(page))

    for opening in ('<svg class="i"/>', "<svg>", "<math/>", "<object/>", "<template>", "<noscript>", "<object>"):
        assert "whole article" in texts(f"{opening}<article><p>whole article</p></article>")
    assert texts("<p>so <math><mi>x</mi></math> holds</p>").split()[:2] == ["so", "x"]
    assert "kept" in texts("<article><object data='a'><p>kept</p></object></article>")
    assert texts("<p>a</p><svg><title>drawn</title></svg><script>code</script><p>b</p>") == "a b"


def test_viterbi_is_the_best_labelling():
    chain = html_main.Chain({"in=p": 0.4, "bias": -0.2, "ends=True": 0.5}, np.array([[0.3, -0.8], [-0.5, 0.6]]))
    blocks = blocks_of("<p>One two.</p><div>menu</div><p>Three</p><div>x</div><p>Four five.</p>")

    def total(labels):
        score = sum(chain.emission(b, i, len(blocks)) * y for i, (b, y) in enumerate(zip(blocks, labels)))
        return score + sum(chain.moves[a, b] for a, b in zip(labels, labels[1:]))

    options = [[(k >> i) & 1 for i in range(len(blocks))] for k in range(2 ** len(blocks))]
    assert total(chain.decode(blocks)) == pytest.approx(max(map(total, options)))
