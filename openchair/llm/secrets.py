"""Secrets in texts: fixed patterns, and literals assigned to names that sound sensitive.

Spans have a kind, a start and an exclusive end in code points. Kinds `assign`, `access` and `hex` come from patterns. Kind
`literal` comes from lexing: name-literal pairs of source and configuration syntax (`name = "x"`, `name: x`, `"name": "x"`,
`name := x`, `name => x`, `a.b["name"] = x`, `name: type = x`, `name type = x`, `name = other = x`) are read in order, also those
inside strings. A value is a bare word or strings with prefixes, escapes, triple quotes, brackets and concatenation. Pairs
written without a sign of assignment are read first: `<name>x</name>`, `<add key="name" value="x"/>`, block scalars
(`name: |` and the deeper lines), `ENV NAME x`, `#define NAME "x"`, `setName("x")`, `put("name", "x")`, and names with
annotations of any length. Names
that are assigned other names, found by their last part, take over their literals, and a literal is scored by the words
of all names it reaches and by its own shape or that of the strings joined to it.

Defined cases: a null or empty text has no spans; repeated rows are scanned one by one; an empty table gives no rows;
`find_secrets` ignores columns other than the id and the text, `redact` keeps them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from openchair.llm.common import pick, ship, table

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

_NAME = r"[A-Za-z_][A-Za-z0-9_.-]*+(?:\[[^\[\]\n]{0,80}\](?:\.[A-Za-z_][A-Za-z0-9_.-]*+)?)*+"
_QUOTED = r"""(?:[rRbBuUfF]{1,2}|u8|[rR]\#{1,3}|L|@|\$@?)?["']"""
# A name, an annotation and the sign of assignment. A run of name characters has one start, so long ones are read once.
HEAD = re.compile(
    rf"""(?<![A-Za-z0-9_.-])[0-9.-]*+(?P<name>{_NAME})(?:\\?["'])?
    (?:[\x20\t]+(?:\[\]byte|\*?string|str|bytes|text|char|any)(?=[\x20\t]*=)
      |[\x20\t]*[?!]?:[\x20\t]*[A-Za-z_&*'\[][\w.&*'?|:\x20]{{0,60}}(?:[\[<][^\n=]{{0,60}}[\]>])?[\w?|\x20]{{0,30}}
       (?=[\x20\t]*=[\x20\t]*(?:{_QUOTED}|[(\[])|[\x20\t]+=[\x20\t]))?
    [\x20\t]*(?::=|=>|[?+|&]{{0,2}}=(?!=)|:(?![:/]))""",
    re.VERBOSE | re.ASCII,
)
_BODY = r"[^{q}\\\n]*+(?:\\(?s:.)[^{q}\\\n]*+)*+"
STRING = re.compile(
    r"""(?:[rRbBuUfF]{1,2}|u8|[rR]\#{1,3}|L|@|\$@?)?(?:"{3}(?P<triple>(?s:[^\\]|\\.)*?)"{3}|'{3}(?P<triple1>(?s:[^\\]|\\.)*?)'{3}"""
    rf"""|"(?P<double>{_BODY.format(q='"')})"|'(?P<single>{_BODY.format(q="'")})'"""
    r"""|"(?P<double1>[^"\n]*)"|'(?P<single1>[^'\n]*)')|\\"(?P<escaped>[^"\\\n]*)\\"|\\'(?P<escaped1>[^'\\\n]*)\\'"""
)
BARE = re.compile(r"""[^\s"',;(){}\[\]]+""")
REFERENCE = re.compile(rf"\$?{_NAME}")
UNKNOWN = re.compile(r"[\w.$]+")
JOIN = re.compile(r"""\s*\+(?!=)\s*|[\x20\t]*\.{1,2}[\x20\t]*(?=["'])""")
CHAIN = re.compile(r"[\x20\t]*=(?![=>])")
BLANK, SPACE = re.compile(r"[\x20\t]*"), re.compile(r"\s*")
LAST_PART = re.compile(r"[A-Za-z0-9_-]+")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

# Pairs without a sign of assignment. Each pattern reads a stretch of text once, whatever its length.
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>(?P<value>[^<>]++)</(?P=name)\s*+>", re.ASCII)
TAG = re.compile(r"""<[A-Za-z][\w.:-]*+(?P<inner>(?:\s++[\w.:-]++\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'))++)\s*+/?>""", re.ASCII)
ATTRIBUTE = re.compile(r"""(?P<name>[\w.:-]++)\s*+=\s*+(?:"(?P<double>[^"<]*+)"|'(?P<single>[^'<]*+)')""", re.ASCII)
# Attributes that name the value of the same tag.
NAMING = ("key", "name", "id")
BLOCK = re.compile(
    rf"""^(?P<indent>[\x20\t]*+(?:-\x20++)?)["']?(?P<name>{_NAME})["']?[\x20\t]*+:[\x20\t]*+[|>][-+0-9]*+[\x20\t]*+\r?$""",
    re.ASCII | re.MULTILINE,
)
LINE = re.compile(r"\n(?P<indent>[\x20\t]*+)(?P<value>[^\n]*+)")
ENVIRONMENT = re.compile(rf"^[\x20\t]*+(?:ENV|setenv)[\x20\t]++(?P<name>{_NAME})[\x20\t]++(?=[^\s=])", re.ASCII | re.MULTILINE)
DEFINITION = re.compile(rf"^[\x20\t]*+\#[\x20\t]*+define[\x20\t]++(?P<name>{_NAME})[\x20\t]++", re.ASCII | re.MULTILINE)
SETTER = re.compile(r"(?<![A-Za-z0-9])(?:set|put|add|with)_?(?P<name>\w*+)\(\s*+", re.ASCII | re.IGNORECASE)
ARGUMENT = re.compile(r"\s*+,\s*+")
# The end of a bracketed annotation, its sign, and the place where the annotation begins.
ANNOTATED = re.compile(rf"[\]>][\w?|\x20\t]*+=(?=[\x20\t]*+(?:{_QUOTED}|[(\[]))", re.ASCII)
BRACKET = re.compile(r"[\[\]<>]")
ANNOTATION = re.compile(rf"(?<![A-Za-z0-9_.-])(?P<name>{_NAME})[?!]?[\x20\t]*+:[\x20\t]*+(?P<type>[A-Za-z_][\w.]*+)[\[<]", re.ASCII)

# How much a word in a target's name speaks for a secret.
NAME_WEIGHTS = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "credential": 3, "credentials": 3,
    "token": 2, "apikey": 3, "pass": 2, "auth": 2, "bearer": 2, "private": 2, "pin": 1, "key": 1, "api": 1,
    "access": 1, "signing": 1, "session": 1, "salt": 1, "cookie": 1,
}
# Literals that stand for a secret without being one.
PLACEHOLDERS = ("changeme", "example", "placeholder", "redacted", "none", "null", "true", "false", "your", "xxx", "todo")
MIN_CHARS = 6
MIN_SCORE = 4.0


def entropy(text: str) -> float:
    """Bits per character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def name_score(name: str) -> float:
    return float(sum(NAME_WEIGHTS.get(part.lower(), 0) for part in NAME_PART.findall(name)))


def literal_score(literal: str) -> float:
    low = literal.lower()
    if len(literal) < MIN_CHARS or any(word in low for word in PLACEHOLDERS) or low[:1] in "$<{%" or " " in literal:
        return -10.0
    mixed = sum(any(test(c) for c in literal) for test in (str.isdigit, str.islower, str.isupper))
    return entropy(literal) / 2 + mixed / 2 + min(len(literal), 32) / 32


Spans = tuple[tuple[int, int], ...]
MANY_PARTS = 64  # a constant of more parts is linked to what it is joined to, not copied into it


def last_part(name: str) -> str:
    """`password` of `self.password` and of `cfg["password"]`."""
    return (LAST_PART.findall(name) or [""])[-1]


def value_at(text: str, at: int, holds: dict[str, Spans], links: list[tuple[Spans, Spans]]) -> list[Spans]:
    """The values that stand at a place, each as the spans of its parts: one, or the entries of a list.

    Adds to links the last value and each constant it takes in.
    """
    found: list[Spans] = []
    taken: list[Spans] = []
    parts: Spans = ()
    depth, begins = 0, True
    while True:
        at = (SPACE if depth else BLANK).match(text, at).end()
        if text[at : at + 1] in ("(", "["):
            depth, at = depth + 1, at + 1
            continue
        if string := STRING.match(text, at):
            start, end = string.span(string.lastgroup)
            if string.lastgroup.startswith("triple"):
                body = string[string.lastgroup]
                start += len(body) - len(body.removeprefix("\\").lstrip())
                end = max(start, end - (len(body) - len(body.rstrip())))
            parts, at = (*parts, (start, end)), string.end()
        else:
            name = REFERENCE.match(text, at)
            known = holds.get(last_part(name[0])) if name else None
            if known and not BARE.match(text[name.end() : name.end() + 1].replace("+", " ")):
                at = name.end()
                taken.append(known)
                if len(known) <= MANY_PARTS:
                    parts = (*parts, *known)
            elif other := (not begins or depth or _joined(text, at)) and UNKNOWN.match(text, at):
                at = other.end()
            elif begins and not depth and (bare := BARE.match(text, at)):
                word = bare[0].rstrip(".")
                return [((at, at + len(word)),)]
            else:
                break
        begins = False
        at = (SPACE if depth else BLANK).match(text, at).end()
        while depth and text[at : at + 1] in (")", "]"):
            depth -= 1
            at = (SPACE if depth else BLANK).match(text, at + 1).end()
        if join := JOIN.match(text, at):
            at = join.end()
        elif depth and text[at : at + 1] == ",":
            found.append(parts)
            parts, at = (), at + 1
        elif not STRING.match(text, at):
            break
    if taken and not parts:
        parts = taken.pop()
    links += [(parts, known) for known in taken]
    return [spans for spans in (*found, parts) if spans]


def _joined(text: str, at: int) -> bool:
    """Whether a name stands here that a string is added to."""
    name = UNKNOWN.match(text, at)
    join = name and JOIN.match(text, name.end())
    return bool(join and STRING.match(text, join.end()))


def _string_at(text: str, at: int) -> tuple[Spans, int] | None:
    """The body of the string that starts at a place, and its end."""
    string = STRING.match(text, at)
    return string and ((string.span(string.lastgroup),), string.end())


def _trimmed(text: str, start: int, end: int) -> Spans:
    body = text[start:end]
    start += len(body) - len(body.lstrip())
    return ((start, max(start, end - (len(body) - len(body.rstrip())))),)


def _tag_pairs(text: str) -> Iterator[tuple[str, Spans]]:
    for element in ELEMENT.finditer(text):
        yield element["name"], _trimmed(text, *element.span("value"))
    for tag in TAG.finditer(text):
        names, value = [], None
        for attribute in ATTRIBUTE.finditer(text, *tag.span("inner")):
            body = attribute.span(attribute.lastgroup)
            if attribute["name"].lower() in NAMING:
                names.append(text[slice(*body)])
            elif attribute["name"].lower() == "value":
                value = (body,)
        if value:
            yield from ((name, value) for name in names)


def _block_pairs(text: str) -> Iterator[tuple[str, Spans]]:
    at = 0
    while block := BLOCK.search(text, at):
        at, lines = block.end(), []
        while line := LINE.match(text, at):
            if line["value"].strip() and len(line["indent"]) <= len(block["indent"]):
                break
            lines += _trimmed(text, *line.span("value")) if line["value"].strip() else ()
            at = line.end()
        if lines:
            yield block["name"], tuple(lines)


def _line_pairs(text: str) -> Iterator[tuple[str, Spans]]:
    for variable in ENVIRONMENT.finditer(text):
        if string := _string_at(text, variable.end()):
            yield variable["name"], string[0]
        else:
            stop = text.find("\n", variable.end())
            yield variable["name"], _trimmed(text, variable.end(), len(text) if stop < 0 else stop)
    for definition in DEFINITION.finditer(text):
        if string := _string_at(text, definition.end()):
            yield definition["name"], string[0]


def _call_pairs(text: str) -> Iterator[tuple[str, Spans]]:
    for call in SETTER.finditer(text):
        if not (first := _string_at(text, call.end())):
            continue
        body, at = first
        comma = ARGUMENT.match(text, at)
        second = comma and _string_at(text, comma.end())
        if second:
            yield text[slice(*body[0])], second[0]
        elif SPACE.match(text, at).end() < len(text) and text[SPACE.match(text, at).end()] == ")":
            yield call["name"], body


def other_pairs(text: str) -> Iterator[tuple[str, Spans]]:
    """Name-literal pairs that are written without a sign of assignment."""
    if "</" in text or "/>" in text or "value=" in text:
        yield from _tag_pairs(text)
    if "|" in text or ">" in text:
        yield from _block_pairs(text)
    if "ENV" in text or "setenv" in text or "define" in text:
        yield from _line_pairs(text)
    if "(" in text:
        yield from _call_pairs(text)


def _opening(text: str, begin: int, closing: int) -> int | None:
    """Where the bracket opens that closes at a place."""
    opened: list[int] = []
    at = None
    for bracket in BRACKET.finditer(text, begin, closing + 1):
        if bracket[0] in "[<":
            opened.append(bracket.start())
            continue
        wanted = "[" if bracket[0] == "]" else "<"
        # A sign of comparison opens nothing that a square bracket could close.
        while wanted == "[" and opened and text[opened[-1]] != wanted:
            opened.pop()
        at = opened.pop() if opened and text[opened[-1]] == wanted else None
    return at


def annotated_pairs(text: str) -> Iterator[tuple[str, int, int]]:
    """Names with a bracketed annotation of any length: the name, where the type starts and where the value does."""
    done = 0
    for closed in ANNOTATED.finditer(text):
        begin = max(done, text.rfind("\n", done, closed.start()) + 1)
        done = closed.end()
        heads = {head.end() - 1: head for head in ANNOTATION.finditer(text, begin, closed.start())}
        if heads:
            head = heads.get(_opening(text, begin, closed.start()), heads[max(heads)])
            yield head["name"], head.start("type"), closed.end()


def assigned_literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose names, their own or those they are passed on to, make them secrets."""
    holds: dict[str, Spans] = {}
    names: dict[Spans, float] = {}
    links: list[tuple[Spans, Spans]] = []
    for name, spans in other_pairs(text):
        names[spans] = max(names.get(spans, 0.0), name_score(name))
        if part := last_part(name):
            holds[part] = spans
    types = set()
    for name, kind, start in annotated_pairs(text) if ("]" in text or ">" in text) else ():
        types.add(kind)
        for spans in (values := value_at(text, BLANK.match(text, start).end(), holds, links)):
            names[spans] = max(names.get(spans, 0.0), name_score(name))
        if values:
            holds[last_part(name)] = tuple(span for spans in values for span in spans)
    chain: list[str] = []
    chain_at = at = 0
    while head := HEAD.search(text, at):
        at = head.end("name")
        own = [*chain, head["name"]] if head.start() == chain_at else [head["name"]]
        chain, chain_at = [], 0
        begin = BLANK.match(text, head.end()).end()
        name = REFERENCE.match(text, begin)
        if name and CHAIN.match(text, name.end()):
            chain, chain_at = own, begin
        if begin in types:
            continue
        for spans in (values := value_at(text, begin, holds, links)):
            names[spans] = max([names.get(spans, 0.0), *map(name_score, own)])
        if values:
            for one in own:
                holds[last_part(one)] = tuple(span for spans in values for span in spans)
    for spans, known in reversed(links):
        names[known] = max(names.get(known, 0.0), names.get(spans, 0.0))
    found: dict[tuple[int, int], None] = {}
    for spans, score in names.items():
        if score >= 2:
            whole = literal_score("".join(text[slice(*span)] for span in spans))
            for span in spans:
                shape = max(whole, literal_score(text[slice(*span)]))
                if span[0] < span[1] and score + shape >= MIN_SCORE:
                    found[span] = None
    return list(found)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if ("=" in text or ":" in text) and KEYWORD.search(text):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind."""
    found = base_spans(text)
    if any(sign in text for sign in "=:<(") or "ENV" in text or "setenv" in text or "define" in text:
        found += [("literal", *span) for span in assigned_literals(text)]
    return sorted(found, key=lambda span: (span[1], KINDS.index(span[0]), span[2]))


def redacted(text: str) -> str:
    """The text with each stretch covered by spans replaced by `<kind>` of its first span."""
    out, at = [], 0
    for kind, start, end in spans_of(text):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and spans, array<struct<kind, start, end>> by start, then kind."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [{"kind": k, "start": s, "end": e} for k, s, e in spans_of(text or "")]
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPAN_TYPE)], names=[id_col, "spans"])

    named = pick(docs, id_col, text_col)
    return named.mapInArrow(run, f"`{id_col}` {named.schema[0].dataType.simpleString()}, spans {SPANS}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with secrets taken out of their texts; a null text stays null."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if text is None else redacted(text) for text in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    plain = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "literal")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
