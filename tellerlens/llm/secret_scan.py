r"""Secrets by assignment-aware lexing.

Base patterns (assignments to a few names, access keys, long hexadecimal runs) give base spans. Beside them a lexer reads
the text as source or configuration: it finds assignment signs (``=``, ``:``, ``:=``, ``=>``), the name to their left
(``user.api-key``, ``"clientSecret"``, ``$TOKEN``, ``config['pwd']``) and the value to their right: quoted literals, bare
values to the end of the word, references to other names (``name``, ``${name}``, ``$name``), and any of these joined by
``+``; also tags ``<name>literal</name>`` and options ``--name literal``.

Constants are propagated: names and literals form a graph in which a name points to what was last assigned to it before
the reference (or first after it). How sensitive a name is goes along the arrows, so ``k = "…"`` followed by
``api_key = k`` makes the literal of ``k`` as sensitive as ``api_key``. Each literal then gets a score: the sensitivity
of the most sensitive name that it reaches, times how much it looks like a random value (its length, kinds of
characters and entropy), zero for placeholders. Literals with a score of ``THRESHOLD`` or more become spans of the kind
``literal``, unless a base span holds them already.

Work and memory grow with the text alone: every sign is lexed once, every arrow followed once per sensitivity level.
Positions are code points, ends exclusive. Spans are never merged or dropped.

Rows: a null or empty text has no spans; null ids stay; equal rows get equal results; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters; a shorter match holds no longer one
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
#: Texts without any of these have no base assignment, and no name that the table below knows.
HINTS = r"(?i)passw|pwd|secret|token|api_?key|passphrase|passcode|credential|apikey|private|access|signing|encryption|auth|bearer|license|master|session|jwt|salt"

#: How sensitive a name is by its parts: one part, or two in a row joined (fixed values).
PARTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "passcode": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.8,
    "credentials": 0.8, "jwt": 0.8, "bearer": 0.8, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9,
    "masterkey": 0.9, "authkey": 0.9, "licensekey": 0.7, "sessionkey": 0.8, "salt": 0.5,
}
#: Last parts that make a name speak about a secret rather than hold one (fixed values).
ABOUT = frozenset("name id type count length len size limit limits url uri path file field label hint policy expiry expires ttl age max min ids names types".split())
#: Values that stand for a secret without being one (fixed values).
PLACEHOLDERS = frozenset("password passwd secret token changeme change_me example sample test dummy placeholder none null nil true false undefined required optional todo xxx redacted hidden unknown string default your_password yourpassword".split())
THRESHOLD = 0.45

_SIGN = re.compile(r":=|=>|<(?=[A-Za-z])|--(?=[A-Za-z])|[=:]")
_NAME_END = re.compile(r"""[A-Za-z0-9_]""")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_TAG = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*)>([^<>\n]+)</\1>")
_OPTION = re.compile(r"--([A-Za-z][A-Za-z0-9_-]*)[ \t]+([^\s\"'=-][^\s\"']*)")
_QUOTED = re.compile(r"""[A-Za-z]{0,2}(?:"((?:[^"\\\n]|\\[^\n])*)"|'((?:[^'\\\n]|\\[^\n])*)'|`([^`\n]*)`)""")
_REFERENCE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_.]*)\}|\$([A-Za-z_][A-Za-z0-9_]*)|([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)(?![A-Za-z0-9_.+/=!@#$%^&*(\[-])")
_BARE = re.compile(r"""[^\s"'`,;<>()\[\]{}]+""")
_BLANKS = re.compile(r"[ \t]*")
_PLUS = re.compile(r"[ \t]*\+[ \t]*(?:\n[ \t]*)?")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-$")


@lru_cache(maxsize=20_000)
def sensitivity(name: str) -> float:
    """0 to 1: how surely a value of that name is secret, by the last dotted piece of the name."""
    parts = [p.lower() for p in _PART.findall(name.rsplit(".", 1)[-1])]
    if not parts or parts[-1] in ABOUT or (len(parts) > 1 and parts[0] == "public"):
        return 0.0
    pairs = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((PARTS.get(p, 0.0) for p in parts + pairs), default=0.0)


def strength(value: str) -> float:
    """0 to 1: how much a literal looks like a secret rather than a word, a placeholder or a template."""
    low = value.lower()
    if len(value) < LEAST_VALUE or low in PLACEHOLDERS or len(set(low)) < 4 or "${" in value or "{{" in value or value[0] == "<" or " " in value.strip():
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if kinds == 1 and value.isalpha():
        return 0.3 if n < 20 else min(1.0, entropy / 4.5)
    return min(1.0, 0.2 * kinds + entropy / 8 + min(n, 32) / 80)


@dataclass
class Value:
    """What one assignment gives its name: literals (start, end) and references (name), as lexed."""

    at: int
    name: str
    literals: list[tuple[int, int]] = field(default_factory=list)
    references: list[str] = field(default_factory=list)


def _name_before(text: str, at: int) -> str | None:
    """The name that ends right before ``at``, blanks, quotes and brackets aside."""
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    while end and text[end - 1] in "\"'])":
        end -= 1
    start = end
    while start and text[start - 1] in _NAME_CHARS:
        start -= 1
    name = text[start:end].strip(".-$")
    return name if name and not name[0].isdigit() else None


def _value(text: str, at: int, found: Value) -> None:
    """Read the value from ``at`` on: literals and references joined by plus signs."""
    at = _BLANKS.match(text, at).end()
    while at < len(text):
        if quoted := _QUOTED.match(text, at):
            span = quoted.span(quoted.lastindex) if quoted.lastindex else (at, at)
            if reference := _REFERENCE.fullmatch(text, *span):
                if reference[1] or reference[2]:
                    found.references.append(reference[1] or reference[2])
                else:
                    found.literals.append(span)
            elif span[1] > span[0]:
                found.literals.append(span)
            end = quoted.end()
        elif reference := _REFERENCE.match(text, at):
            name = reference[1] or reference[2] or reference[3]
            found.references.append(name)
            if reference[3]:  # a bare word may be a value as well as a name: the graph decides
                found.literals.append(reference.span(3))
            end = reference.end()
        elif bare := _BARE.match(text, at):
            end = at + len(bare[0].rstrip(".,;:!?"))  # the end of a sentence is no part of a value
            if end == at:
                return
            found.literals.append((at, end))
        else:
            return
        plus = _PLUS.match(text, end)
        if not plus:
            return
        at = plus.end()


def assignments(text: str) -> list[Value]:
    """Every assignment, tag and option of a text, in order."""
    out = []
    for sign in _SIGN.finditer(text):
        at, end = sign.span()
        if sign[0] == "<":
            if tag := _TAG.match(text, at):
                out.append(Value(at, tag[1], [tag.span(2)]))
        elif sign[0] == "--":
            if option := _OPTION.match(text, at):
                out.append(Value(at, option[1], [option.span(2)]))
        elif end < len(text) and text[end] == "=":  # a comparison
            continue
        elif at and text[at - 1] in "=!<>":
            continue
        elif name := _name_before(text, at):
            found = Value(at, name)
            _value(text, end, found)
            if found.literals or found.references:
                out.append(found)
    return out


def scored_literals(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of every literal that some sensitive name gets, directly or by way of other names."""
    values = assignments(text)
    level = [sensitivity(v.name) for v in values]
    if not any(level):
        return []
    by_name: dict[str, list[int]] = {}
    for i, v in enumerate(values):
        by_name.setdefault(v.name, []).append(i)

    def assigned(name: str, i: int) -> int | None:
        """The assignment a reference in the i-th one means: the last before it, else the first after it."""
        at = by_name.get(name)
        if at is None or at == [i]:
            return None
        lo, hi = 0, len(at)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if at[mid] < i else (lo, mid)
        return at[lo - 1] if lo else next((k for k in at[:2] if k != i), None)

    best: dict[tuple[int, int], float] = {}
    reached = [0.0] * len(values)
    for value in sorted({x for x in level if x}, reverse=True):  # most sensitive first: each is passed once
        todo = [i for i, x in enumerate(level) if x == value and reached[i] < value]
        while todo:
            i = todo.pop()
            if reached[i] >= value:
                continue
            reached[i] = value
            known = [(name, to) for name in values[i].references if (to := assigned(name, i)) is not None]
            names = {name for name, _ in known}
            for span in values[i].literals:
                if text[span[0] : span[1]] not in names:  # a bare word that is a known name is no literal
                    best[span] = max(best.get(span, 0.0), value)
            todo.extend(to for _, to in known)
    return [(a, b, s * strength(text[a:b])) for (a, b), s in sorted(best.items())]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and the literals that no base span holds, by start and kind."""
    more, ends, at, far = [], base, 0, -1
    for a, b, score in scored_literals(text):
        while at < len(ends) and ends[at][0] <= a:
            far = max(far, ends[at][2])
            at += 1
        if score >= THRESHOLD and b > far:
            more.append((a, 3, b))
    return sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans of every row."""
    ship(docs.sparkSession)
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = batch.column("body"), batch.num_rows
            counts, digests, spans = [[0] * n for _ in KINDS], [empty] * n, [""] * n
            hinted = pc.match_substring_regex(texts, HINTS).to_pylist()
            hit = pc.or_(pc.match_substring_regex(texts, "AKIA[A-Z0-9]{16}|[0-9a-f]{24}"), pa.array(hinted))
            for i in pc.indices_nonzero(hit).to_pylist():
                text = texts[i].as_py()
                base = base_spans(text)
                found = all_spans(text, base) if hinted[i] else base
                for _, kind, _ in found:
                    counts[kind][i] += 1
                digests[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).mapInArrow(
        run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_literal bigint, base_sha256 string, spans string")
