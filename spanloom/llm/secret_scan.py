"""Secret scans by assignment-aware lexing.

Base spans come from three fixed patterns. Beyond them a lexer reads source and
configuration syntax into pairs of a name and an expression: `name = ...`, `name: ...`,
`"name": ...`, `name: type = ...`, `env["NAME"] = ...`, `:=`, `=>`, `--name ...` and
`<name>...</name>`. An expression is a chain of literals and names (joined by +, .., ||
or by standing next to each other, over lines within parentheses; simple decoding
calls are looked through); literals may be triple-quoted and span lines.

Pairs form a graph: a name in an expression stands for its last definition before, else
its first one after. Character counts flow along it (never the joined strings, which can
double with every definition), so each pair has a length and an entropy. A pair
whose name is sensitive and whose value is random enough marks every literal that reaches
it; these are the spans of kind "lexed". The last word of a name decides what it holds: a
key_name or a token_count is no secret.

Runs as one Arrow map over the scan: no shuffle, memory bounded by a batch, time in
proportion to a text's length.

Defined results: a null or empty text has no spans; repeated rows are scanned
row by row; cycles of definitions add nothing; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

KINDS = ("assign", "access", "hex", "lexed")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

_STRING = re.compile(r"""(?:[rRbBfFuU]{1,2})?(?:\"{3}(?P<a>(?:[^\\]|\\.)*?)\"{3}|'{3}(?P<b>(?:[^\\]|\\.)*?)'{3}|"(?P<c>(?:[^"\\\n]|\\.)*+)"|'(?P<d>(?:[^'\\\n]|\\.)*+)'|`(?P<e>[^`\n]*+)`)""", re.S)
_HEAD = re.compile(
    r"""<(?P<tag>[A-Za-z_][\w.:\-]*+)(?:\s[^<>\n]*+)?>(?P<text>[^<>]++)</(?P=tag)>
    |(?<![\w.\-$])(?:(?:[A-Za-z_$][\w.$]*+)?\[[\x20\t]*(?P<q>["'])(?P<key>[^"'\n\]]{1,200})(?P=q)[\x20\t]*\]|(?P<p>["'])(?P<quoted>[A-Za-z_][\w\x20.\-]{0,100})(?P=p)|(?P<name>[A-Za-z_$][\w$]*+(?:(?:\.|->|::|-)[A-Za-z_$][\w$]*+)*+))
     (?:[\x20\t]*:[\x20\t]*[A-Za-z_][\w.\[\],\x20|]{0,60}?(?=[\x20\t]*=[^=]))?[\x20\t]*(?::=|=>|=(?![=~>])|:(?![:/]))
    |(?<!\S)--?(?P<flag>[A-Za-z][\w\-]*+)(?=[\x20\t]+["'A-Za-z0-9])""",
    re.X | re.A,
)
_BARE = re.compile(r"[A-Za-z0-9+/_.=\-$]+")
_BLANK, _GAP = re.compile(r"(?:[\x20\t]|\\\n)*"), re.compile(r"(?:[\x20\t\n\r]|\\\n)*")
_JOIN = re.compile(r"\+(?!\+)|\|\||\.\.(?!\.)|&(?!&)")
_NUMBER = re.compile(r"[0-9.,:/+\-]*")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: How much a word in a name tells; fixed values.
WEIGHTS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.8, "credentials": 0.8, "auth": 0.6, "private": 0.6, "access": 0.4, "client": 0.2, "api": 0.4, "key": 0.4, "bearer": 0.8, "signature": 0.4, "salt": 0.5}
#: Last words of names that hold something about a secret, not the secret; fixed values.
ABOUT = {"name", "rate", "count", "len", "length", "size", "type", "file", "filename", "path", "dir", "url", "uri", "endpoint", "field", "label", "hint", "min", "max", "num", "index", "format", "policy", "pattern", "prompt", "ttl", "expiry", "expires", "timeout", "enabled", "required", "error", "message", "status", "age", "version", "limit", "column", "id", "list", "class", "date", "time", "at", "by"}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "dummy", "none", "null", "true", "false")
#: Calls whose argument is the value; fixed values.
THROUGH = {"decode", "b64decode", "atob", "fromhex", "unhexlify", "bytes", "str", "string", "encode", "trim", "strip", "secretstr"}
_HINT = re.compile("|".join(WEIGHTS), re.I | re.A)
#: A word before an assignment, in a flag or in a tag.
_TARGET = re.compile(r"""(?<![\w.\-$])[\w.\-$]++(?=["'\]]*+[\x20\t]*+[:=])|(?<!\S)--?[A-Za-z][\w\-]*+|</[\w.:\-]++""", re.A)
THRESHOLD = 0.5
MIN_LITERAL = 8
#: Characters from which a part of a joined value is a span of its own.
MIN_PART = 4


def name_weight(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[-1] in ABOUT:
        return 0.0
    return min(1.0, sum(WEIGHTS.get(w, 0.0) for w in words))


def literal_weight(counts: Counter) -> float:
    """Of a value's character counts: its entropy in thirds of a byte; white space halves it, a decimal number has none."""
    n = sum(counts.values())
    if n < MIN_LITERAL or counts["."] and all(c in "0123456789.,:/+-" for c in counts):
        return 0.0
    entropy = min(1.0, -sum(c / n * math.log2(c / n) for c in counts.values()) / 3.0)
    return entropy * (0.6 if counts[" "] or counts["\n"] else 1.0)


def _string_at(text: str, at: int) -> tuple[int, int, int] | None:
    """Start and end of what a literal at that place holds, and the place after it."""
    m = _STRING.match(text, at)
    if not m:
        return None
    return (*m.span(m.lastgroup), m.end())


def _terms(text: str, at: int) -> list[tuple[int, int, bool]]:
    """Literals and words (start, end, whether quoted) of the expression at that place."""
    out: list[tuple[int, int, bool]] = []
    depth, before = 0, ""  # what came before: a string, another term or a joining sign
    while True:
        at = (_GAP if depth or before == "+" else _BLANK).match(text, at).end()
        c = text[at : at + 1]
        if found := _string_at(text, at):
            if before == "term":
                return out
            out.append((found[0], found[1], True))
            at, before = found[2], "string"
        elif c == "(" and before in ("", "+"):
            at, depth = at + 1, depth + 1
        elif c == ")" and depth:
            at, depth, before = at + 1, depth - 1, "term"
        elif before not in ("", "+"):
            if not (m := _JOIN.match(text, at)):
                return out
            at, before = m.end(), "+"
        elif m := _BARE.match(text, at):
            if text[m.end() : m.end() + 1] == "(":
                if re.split(r"[.\-]", m[0].lower())[-1] not in THROUGH:
                    return out
                at = m.end()
            else:
                out.append((m.start(), m.end(), False))
                at, before = m.end(), "term"
        else:
            return out


def _pairs(text: str) -> list[tuple[int, str, list[tuple[int, int, bool]]]]:
    """Place, name and terms of every assignment."""
    out = []
    for m in _HEAD.finditer(text):
        if m["tag"]:
            s, e = m.span("text")
            value = m["text"].strip()
            s += len(m["text"]) - len(m["text"].lstrip())
            terms = [(s, s + len(value), True)] if value else []
            name = m["tag"]
        else:
            name = m["key"] or m["quoted"] or m["name"] or m["flag"]
            terms = _terms(text, m.end())
        if terms:
            out.append((m.start(), name, terms))
    return out


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name."""
    low = text.lower()
    if not any(w in low for w in WEIGHTS) or not any(_HINT.search(m[0]) for m in _TARGET.finditer(text)):
        return []
    pairs = _pairs(text)
    defined: dict[str, list[int]] = {}
    for k, (_, name, _) in enumerate(pairs):
        for own in {name, re.split(r"\.|->|::", name)[-1]}:
            defined.setdefault(own, []).append(k)

    def meant(k: int, word: str) -> int | None:
        own = defined.get(word) or defined.get(re.split(r"\.|->|::", word)[-1])
        if not own:
            return None
        i = bisect_left(own, k)
        return own[i - 1] if i else own[-1] if own[0] == k else own[0]

    literals: list[list[tuple[int, int]]] = []
    links: list[list[int]] = []
    for k, (_, _, terms) in enumerate(pairs):
        literals.append([])
        links.append([])
        for s, e, quoted in terms:
            to = None if quoted else meant(k, text[s:e].rstrip("."))
            if to is not None and to != k:
                links[k].append(to)
            elif quoted or any(c.isdigit() for c in text[s:e]) and not _NUMBER.fullmatch(text, s, e):
                low = text[s:e].lower()
                if not any(p in low for p in PLACEHOLDERS):
                    literals[k].append((s, e))
    counts: list[Counter | None] = [None] * len(pairs)
    for root in range(len(pairs)):
        todo = [(root, False)]
        while todo:
            k, ready = todo.pop()
            if ready:
                for to in links[k]:
                    counts[k].update(counts[to] or {})
            elif counts[k] is None:
                counts[k] = Counter("".join(text[s:e] for s, e in literals[k]))
                if links[k]:
                    todo.append((k, True))
                    todo += [(to, False) for to in links[k] if counts[to] is None]
    marked, todo = set(), [k for k, (_, name, _) in enumerate(pairs) if (w := name_weight(name)) and w * literal_weight(counts[k]) >= THRESHOLD]
    while todo:
        k = todo.pop()
        if k not in marked:
            marked.add(k)
            todo += links[k]
    return sorted({x for k in marked for x in literals[k] if x[1] - x[0] >= MIN_PART})


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place in KINDS, end), sorted."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found += [(s, 3, e) for s, e in lexed_spans(text)]
    return sorted(found)


def _scan(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(t)] if t else [] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "lexed")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
