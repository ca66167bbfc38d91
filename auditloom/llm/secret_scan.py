"""Secret scans by assignment-aware lexing.

Source and configuration syntax is lexed into tokens and read as name-literal pairs: ``name =
"literal"`` and its kin (``:``, ``:=``, ``=>``), quoted keys, indexed targets, tags, options
and bare values. A target that is given another name takes the literals that name held, joined
strings take all their parts, and ``${name}`` inside a string is looked up too. A literal is
scored by how sensitive its target's name is and by how much it looks like a generated value.

Besides, three base kinds are always reported as they stand: ``assign``, ``access``, ``hex``.

Spans are code points of the given text, the end exclusive. Edge cases: a null or empty text
has no spans; two targets of one literal report it once, with the higher score; repeated rows
are reported as they stand; a null id is kept; texts of any length are taken whole, in time
linear in their length; other columns are ignored; no rows give none.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_SCORE = 0.5

#: The base patterns, with the shortest match or value that counts.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of fewer is dropped anyway
KINDS = ["assign", "access", "hex", "named"]

#: How sensitive a word, or two neighbouring words, of a target's name are.
NAMES = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "api key": 1.0, "access key": 1.0, "secret key": 1.0, "private key": 1.0,
    "signing key": 1.0, "encryption key": 1.0, "account key": 0.9, "auth key": 0.9,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "authorization": 0.8, "auth": 0.7,
    "connection string": 0.8, "dsn": 0.6, "webhook": 0.6, "salt": 0.6, "key": 0.5,
}

#: Words that make a name harmless.
HARMLESS = {
    "public", "count", "length", "size", "limit", "max", "min", "name", "type", "url", "path",
    "file", "field", "label", "expiry", "expires", "ttl", "version", "hint", "format", "policy",
}

PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|0+|changeme.*|your[-_ ].*|<.*>|\$\{?.*|%.*%|example.*|dummy.*|none|null|true|false|undefined)$")

_TOKEN = re.compile(
    r"""(?P<quote>\\["'`])|(?P<long>\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3})"""
    r"""|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"""
    r"""|(?P<set>:=|=>|(?<![=!<>:])=(?![=>~])|:(?![:/]))"""
    r"""|(?P<name>[A-Za-z_][\w.]*(?:-[\w.]+)*)"""
    r"""|(?P<join>\+|\\\n)|(?P<line>\n)|(?P<tag></?[A-Za-z][\w.-]*>)|(?P<mark>[\[\](){},;])|(?P<number>[0-9][\w.+/-]*)|(?P<other>\S)"""
)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_LOOKED_UP = re.compile(r"\$\{?([A-Za-z_]\w*)\}?")

_BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[ \t]*\n")

Literal = tuple[int, int]


class _Constant:
    """What was given to a name: literals and earlier constants, and the highest sensitivity
    of a name that all of them are known to have reached."""

    __slots__ = ("items", "best")

    def __init__(self, items: list):
        self.items, self.best = items, -1.0

    def reached(self, score: float):
        """The literals that no name of this sensitivity has reached through here yet.

        Each constant is gone through once per rise of its score, of which there are few, so
        texts that build on their own constants cost no more than others.
        """
        todo: list = [self]
        while todo:
            item = todo.pop()
            if isinstance(item, tuple):
                yield item
            elif item.best < score:
                item.best = score
                todo += reversed(item.items)


def sensitivity(name: str) -> float:
    """0 to 1, by the words of a name in snake, kebab, dotted or camel case."""
    words = [w.lower() for w in _WORD.findall(name)]
    score = max((NAMES.get(" ".join(words[i : i + n]), 0.0) for i in range(len(words)) for n in (1, 2)), default=0.0)
    return score * 0.3 if words and (words[-1] in HARMLESS or "public" in words) else score


def randomness(literal: str) -> float:
    """0 to 1: short, worded or repetitive literals score low, generated ones high."""
    n = len(literal)
    if n < 6 or PLACEHOLDER.match(literal) or any(c.isspace() for c in literal):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(any(test(c) for c in literal) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, entropy / 3.2) * min(1.0, 0.45 + 0.2 * classes + 0.02 * max(0, n - 12))


def pairs(text: str) -> list[tuple[str, int, int]]:
    """Target name, start and end of every literal given to it, in the order of the text.

    A literal that reaches names through constants is given for the first of them, and again
    for each more sensitive one.
    """
    out: list[tuple[str, int, int]] = []
    constants: dict[str, _Constant] = {}
    tokens = [m for m in _TOKEN.finditer(text)]
    i, opened = 0, None
    while i < len(tokens):
        m = tokens[i]
        kind = m.lastgroup
        if kind == "tag":
            if opened and m[0] == f"</{opened[0]}>" and m.start() > opened[1]:
                value = text[opened[1] : m.start()]
                if "\n" not in value and value.strip():
                    start = opened[1] + len(value) - len(value.lstrip())
                    out.append((opened[0], start, start + len(value.strip())))
            opened = (m[0][1:-1], m.end()) if m[0][1] != "/" else None
        if kind != "set" or not i:
            i += 1
            continue
        target = _target(tokens, i)
        values, i = _value(text, tokens, i, constants)
        if target and values:
            constants[target] = _Constant(values)
            out += [(target, s, e) for s, e in constants[target].reached(sensitivity(target))]
    return out


def _target(tokens: list, i: int) -> str | None:
    """The name before a sign of assignment: a name (with a type or not), a quoted key, or an index."""
    before = tokens[i - 1]
    if before.lastgroup == "quote" and i > 1:
        before = tokens[i - 2]
    if i > 2 and before.lastgroup == "name" and tokens[i - 2][0] == ":" and tokens[i - 3].lastgroup == "name":
        before = tokens[i - 3]
    if before.lastgroup == "mark" and before[0] == "]" and i > 2 and tokens[i - 2].lastgroup == "string":
        before = tokens[i - 2]
    if before.lastgroup == "string":
        return before[0][1:-1]
    return before[0] if before.lastgroup == "name" else None


def _value(text: str, tokens: list, i: int, constants: dict[str, _Constant]) -> tuple[list, int]:
    """The literals and constants after the sign at ``i``, and the token to go on with."""
    values: list = []
    k, expects = i + 1, True
    while k < len(tokens):
        m = tokens[k]
        if m.lastgroup == "string" and m.end() - m.start() > 2:
            values.append((m.start() + 1, m.end() - 1))
            values += [constants[name] for name in _LOOKED_UP.findall(m[0]) if name in constants]
        elif m.lastgroup == "long" and m.end() - m.start() > 6:
            values.append(_stripped(text, m.start() + 3, m.end() - 3))
        elif m.lastgroup == "quote" and expects and not values:
            end = next((n for n in range(k + 1, len(tokens)) if tokens[n].lastgroup in ("quote", "line")), len(tokens))
            if end < len(tokens) and tokens[end][0] == m[0] and tokens[end].start() > m.end():
                values.append((m.end(), tokens[end].start()))
                k = end
            else:
                return values, end
        elif m[0] in "|>" and expects and not values and (head := _BLOCK.match(text, m.start())):
            values, end = _block(text, tokens[i].start(), head.end())
            while k < len(tokens) and tokens[k].start() < end:
                k += 1
            return values, max(k, i + 1)
        elif m.lastgroup == "name" and expects:
            if k + 1 < len(tokens) and tokens[k + 1].lastgroup == "set" and tokens[k + 1].start() == m.end():
                break  # the next pair begins
            if m[0] in constants:
                values.append(constants[m[0]])
            elif not values and (bare := _BARE.match(text, m.start())):
                if not re.match(r"[(\[.]", text[bare.end() : bare.end() + 1]):
                    values.append(bare.span())
                while k + 1 < len(tokens) and tokens[k + 1].start() < bare.end():
                    k += 1
        elif m.lastgroup in ("number", "other") and expects and not values and (bare := _BARE.match(text, m.start())):
            if m[0] == "$" and (name := _LOOKED_UP.match(text, m.start())) and name[1] in constants:
                values.append(constants[name[1]])
            else:
                values.append(bare.span())
            while k + 1 < len(tokens) and tokens[k + 1].start() < bare.end():
                k += 1
        elif m.lastgroup == "join":
            expects, k = True, k + 1
            continue
        else:
            break
        expects, k = False, k + 1
        if not (k < len(tokens) and (tokens[k].lastgroup == "join" or tokens[k].lastgroup in ("string", "long") and values)):
            break
    return values, max(k, i + 1)


def _stripped(text: str, start: int, end: int) -> Literal:
    """The span without blanks around it."""
    value = text[start:end]
    start += len(value) - len(value.lstrip())
    return start, start + len(value.strip())


def _block(text: str, sign: int, at: int) -> tuple[list[Literal], int]:
    """The lines of a block value from ``at`` on, those indented more than the line of its sign, and their end."""
    first = text.rfind("\n", 0, sign) + 1
    key = text[first:sign]
    least = len(key) - len(key.lstrip(" \t-"))
    lines: list[Literal] = []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if line.strip():
            if len(line) - len(line.lstrip(" \t")) <= least:
                break
            lines.append(_stripped(text, at, end))
        at = end + 1
    return lines, min(at, len(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def scan(text: str, least: float = LEAST_SCORE) -> list[tuple[str, int, int, str | None, float]]:
    """Kind, start, end, target name and score of all spans, by start and then by kind."""
    found = [(*s, None, 1.0) for s in base_spans(text)]
    named: dict[Literal, tuple[str, float]] = {}
    if ":" in text or "=" in text or "</" in text:
        for name, s, e in pairs(text):
            score = sensitivity(name) * randomness(text[s:e])
            if score >= least and score > named.get((s, e), ("", 0.0))[1]:
                named[s, e] = name, score
    found += [("named", s, e, name, score) for (s, e), (name, score) in named.items()]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def secrets(docs: DataFrame, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: its id and ``found``: kind, start, end, name and score of each span."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            found: list[list[dict]] = [[] for _ in range(len(texts))]
            # without any of these no span begins
            some = pc.match_substring_regex(texts, "[=:]|</|AKIA|[0-9a-f]{16}")
            for i in np.flatnonzero(np.asarray(pc.fill_null(some, False))).tolist():
                found[i] = [dict(zip(("kind", "start", "end", "name", "score"), f, strict=True)) for f in scan(texts[i].as_py(), least)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], ["id", "found"])

    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, found array<struct<kind: string, start: long, end: long, name: string, score: double>>"
    return given.mapInArrow(run, schema).withColumnRenamed("id", id_col)
