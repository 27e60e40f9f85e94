"""Secret scans by assignment-aware lexing.

The base finds three plain patterns. The method then lexes source and
configuration syntax around each assignment sign into name-literal pairs
(``name = "x"``, ``"name": "x"``, ``name := x``, ``NAME=x``, joined literals
``"a" + "b"``), also through a type note (``name: str = "x"``, where the more
sensitive of the names on both sides of the colon counts), a line break or an
opening bracket before the literal, the items of a list, the arguments of a call
(of one that reads the environment or a mapping all but the first, which names
the entry), a scheme before a token (``Bearer x``), and elements
(``<name>x</name>``). It keeps the constants a text defines, resolves a name on
the right-hand side through them, and scores each literal by how sensitive its
target name is and how much it looks like a generated or chosen secret.
Literals that reach THRESHOLD are added, as kind ``literal`` where they stand
beside the sensitive name and as kind ``flow`` where a constant carried them
there. Spans of the base always stay; a literal inside one is not told twice,
and one that goes beyond it (a base pattern ends at the first character
outside its set) stands beside it. Masking merges spans that overlap.

Offsets are code points, the end is exclusive. Each text is scanned whole, in
the task that reads it: nothing is shuffled.

Edge cases: null and empty texts have no spans; a very long text is one scan, in
time that grows as its length; repeated rows have a row each; an empty table
gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.common import batch, small_batches

#: The base patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal", "flow")
THRESHOLD = 1.0

#: Weights of words in a target name, and words that make it harmless.
NAME_WEIGHTS = {
    "password": 0.8, "passwd": 0.8, "pwd": 0.8, "passphrase": 0.8, "passcode": 0.7, "secret": 0.8, "token": 0.6, "apikey": 0.8, "credential": 0.7, "credentials": 0.7,
    "bearer": 0.6, "auth": 0.4, "authorization": 0.5, "private": 0.4, "signing": 0.4, "encryption": 0.4, "access": 0.3, "api": 0.3, "key": 0.4, "pass": 0.5, "pin": 0.4, "salt": 0.4, "jwt": 0.6, "dsn": 0.4,
}
HARMLESS = frozenset("count counts length len name names field fields type types url uri path file dir id ids size max min limit ttl expiry expires label hint prompt policy regex pattern header index class style format".split())
PLACEHOLDER = re.compile(r"(?i)(change_?me|example|placeholder|redacted|your[_-]|dummy|none|null|true|false|undefined|todo|\*+|x+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%\w+%)")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
SIGN = re.compile(r":=|=>|[:=]")
RIGHT = re.compile(r"""[ \t]*(?:(?P<q>["'`])(?P<lit>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)|(?P<bare>[^\s"'`,;#(){}\[\]<>]+))""")
#: A line break or an opening bracket that a literal may stand behind, and what parts the literals of a list or call.
OPENED, PARTED = re.compile(r"[ \t]*(?:\\?\r?\n[ \t]*)?(?:[(\[]\s*)?(?=[\"'`])"), re.compile(r"\s*,?\s*(?:[^\"'`()\[\]\n,]*,\s*)*(?=[\"'`])")
#: From a colon to the sign that follows a type note.
TYPED = re.compile(r"[ \t]*([A-Za-z_][\w.]*)(?:\[[^\[\]\n=]*\]|<[^<>\n=]*>)?\??(?:[ \t]*\|[ \t]*[A-Za-z_][\w.]*)*[ \t]*=(?![=>])")
CALLED, READS = re.compile(r"[ \t]*[A-Za-z_][\w.:!]*\([ \t]*"), re.compile(r"(?i)(env|get|fetch|lookup|config)\w*!?\([ \t]*\Z")
#: An argument of a call that is no literal, up to the next one.
SKIPPED = re.compile(r"[^\"'`()\n,]*,\s*")
SCHEME = re.compile(r"(?i)(?:bearer|basic|token|digest)[ \t]+(?=\S)")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>([^<>\s][^<>]*)</\1>")
JOINED = re.compile(r"""[ \t]*\+[ \t]*(?P<q>["'`])(?P<lit>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)""")
REFERENCE = re.compile(r"(?:\$\{?)?([A-Za-z_][A-Za-z0-9_.]*)\}?\Z")
NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), by start, then kind as listed."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return sorted(out)


def target(text: str, at: int) -> str:
    """The name that ends before place ``at``, through closing quotes, brackets and a type note; empty if there is none."""
    i = at
    while i and text[i - 1] in " \t":
        i -= 1
    while i and text[i - 1] in "\"'`]":
        i -= 1
    j = i
    while j and text[j - 1] in NAME_CHARS:
        j -= 1
    return text[j:i].strip("-.")


def sensitivity(name: str) -> float:
    words = [p.lower() for p in PARTS.findall(name)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    return min(1.0, sum(NAME_WEIGHTS.get(w, 0.0) for w in dict.fromkeys(words)))


def secrecy(literal: str) -> float:
    """0 to 1: length, variety of characters and entropy of a literal; 0 for placeholders, references and prose."""
    if len(literal) < 6 or PLACEHOLDER.fullmatch(literal) or any(c.isspace() for c in literal):
        return 0.0
    n = len(literal)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    kinds = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, 0.1 + 0.1 * entropy + 0.1 * kinds + 0.1 * (n >= 16))


def telling(weight: float, value: str) -> bool:
    """Whether a value of a name of this weight is a secret; a name alone makes none of a placeholder or a short word."""
    return bool(weight and (how := secrecy(value)) and weight + how >= THRESHOLD)


def literal(text: str, at: int) -> tuple[str, int, int, int] | None:
    """(value, start, end, after) of the literal at a quote, with those joined to it; the span is that of the content."""
    right = RIGHT.match(text, at)
    if not right or right["q"] is None:
        return None
    parts, (start, end), after = [right["lit"]], right.span("lit"), right.end()
    while more := JOINED.match(text, after):
        parts.append(more["lit"])
        end, after = more.end("lit"), more.end()
    return "".join(parts), start, end, after


def values(text: str, at: int) -> Iterator[tuple[str, int, int, bool, int]]:
    """(value, start, end, quoted, after) of what stands on the right of a sign that ends at ``at``: a literal, those of a list or of a call, or a bare value."""
    call = CALLED.match(text, at)
    opened = None if call else OPENED.match(text, at)
    if call or opened:
        at, skip = (call or opened).end(), bool(call and READS.search(call[0]))
        many = text[at - 1 : at] in ("(", "[") or bool(call) or bool(opened and opened[0].rstrip()[-1:] in ("(", "["))
        while call and (over := SKIPPED.match(text, at)):
            at, skip = over.end(), False
        found = literal(text, at)
        while found:
            if not skip:
                yield *found[:3], True, found[3]
            skip = False
            found = literal(text, next_.end()) if many and (next_ := PARTED.match(text, found[3])) else None
        if opened:
            return
    right = None if call else RIGHT.match(text, at)
    if right and right["bare"] is not None:
        start, end = right.span("bare")
        scheme = SCHEME.match(text, start)
        if scheme and (token := RIGHT.match(text, scheme.end())) and token["bare"] is not None:
            start, end = token.span("bare")
        yield text[start:end], start, end, False, end


def pairs(text: str) -> Iterator[tuple[str, str, int, int, bool]]:
    """(name, value, start, end, quoted) for each assignment, in order; the span is the value's."""
    after = 0
    for m in SIGN.finditer(text):
        if m.start() < after or text[m.end() : m.end() + 1] == "=" or text[m.start() - 1 : m.start()] in ("=", "!", "<", ">"):
            continue
        name, at = target(text, m.start()), m.end()
        if m[0] == ":" and (typed := TYPED.match(text, at)):
            name, at = max((name, typed[1]), key=sensitivity), typed.end()
        if not name:
            continue
        for value, start, end, quoted, after in values(text, at):  # noqa: B020  the scan goes on behind the last one
            if quoted and (scheme := SCHEME.match(value)):
                value, start = value[scheme.end() :], start + scheme.end()
            yield name, value, start, end, quoted


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    found, constants = set(), {}
    if "</" in text:
        for m in ELEMENT.finditer(text):
            if telling(sensitivity(m[1]), m[2].rstrip()):
                found.add((m.start(2), 3, m.start(2) + len(m[2].rstrip())))
    if ":" not in text and "=" not in text:
        return sorted(found)
    for name, value, start, end, quoted in pairs(text):
        weight = sensitivity(name)
        known = None if quoted and not value.startswith("${") else (r := REFERENCE.match(value)) and constants.get(r[1])
        if known:
            if telling(weight, known[0]):
                found.add((known[1], 4, known[2]))
            constants[name] = known
        else:
            if telling(weight, value):
                found.add((start, 3, end))
            constants[name] = (value, start, end)
    return sorted(found)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans of the base, and all spans: one pass over both lists, which are in order."""
    base, more, told, i, reach = base_spans(text), [], set(), 0, -1
    for s, k, e in lexed_spans(text):
        while i < len(base) and base[i][0] <= s:
            reach, i = max(reach, base[i][2]), i + 1
        if e > reach and (s, e) not in told:
            told.add((s, e))
            more.append((s, k, e))
    return base, sorted(base + more)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """text with each run of overlapping spans replaced by mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, sha, spans = ([], [], []), [], []
        for text in b.column(1).to_pylist():
            base, every = scan(text or "")
            for k, to in enumerate(counts):
                to.append(sum(x[1] == k for x in base))
            sha.append(hashlib.sha256(shown(base).encode()).hexdigest())
            spans.append(shown(every))
        yield batch(_DIGEST, b.column(0), *counts, sha, spans)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by a mark; n_chars follows the text, all other columns stay."""
    small_batches(docs.sparkSession)

    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redacted(t, scan(t)[1]))

    out = docs.withColumn("text", F.pandas_udf(clean, "string")("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
