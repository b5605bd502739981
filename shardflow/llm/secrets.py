"""Secret scans with a trigram inverted index.

Each rule's regular expression is parsed, and a Boolean query of trigrams follows from
it: strings that a match must hold, as ands and ors of their three-byte parts (in lower
case).  The texts of a batch are indexed: for every trigram that some query names, the
list of texts that hold it.  Queries intersect and unite these lists, and only the texts
left are searched.  A rule without mandatory trigrams (runs of hexadecimal digits)
searches every text.

Base rules are ``assign``, ``access`` and ``hex``; the others add spans.  A private key
goes from its header to its end line, or without one over the lines of base64 that follow.

Defined cases: a null or empty text has no spans; spans are in code points, end
exclusive; spans of different kinds may overlap; repeated rows get equal results; a text of any length is scanned whole; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shardflow.llm.common import rows, slices, texts


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


@dataclass(frozen=True)
class Rule:
    """``least`` characters are needed in ``group``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in re.finditer(self.pattern, text) if m.end(self.group) - m.start(self.group) >= self.least]


#: The base kinds in their order, then the added ones.
BASE = (
    Rule("assign", rf"""({_either_case('password')}|{_either_case('passwd')}|{_either_case('secret')}|{_either_case('token')}|{_either_case('api')}_?{_either_case('key')})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # as runs of any length of which those under 24 are dropped
)
#: A line's end, also as written in source code.
_BREAK = r"(?:[\x20\t]*(?:\r?\n|\\r\\n|\\n))"
_KEY = r"(?:[A-Z0-9]+\x20){0,4}PRIVATE KEY(?: BLOCK)?-----"
#: What follows a header without an end: header lines, then lines of base64, of which the last may be short.
_OPEN_BODY = rf"(?:{_BREAK}+(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset):[^\r\n\\]*|=?[A-Za-z0-9+/]{{16,}}={{0,2}}(?=[\x20\t]*(?:[\r\n\"'\\]|\Z))))*(?:{_BREAK}=?[A-Za-z0-9+/]{{1,15}}={{0,2}}(?=[\x20\t]*(?:[\r\n\"'\\]|\Z)))?"
ADDED = (
    Rule("private_key", rf"-----BEGIN {_KEY}(?:(?:(?!-----BEGIN )[\s\S])*?-----END {_KEY}|{_OPEN_BODY})"),
    Rule("github", r"(?:gh[oprsu]_|github_pat_)[A-Za-z0-9_]{22,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED

#: A query is None (any text), a trigram, or ("and" | "or", queries).
Query = None | bytes | tuple
_MOST = 64


def _all(queries: list[Query], how: str) -> Query:
    """The and or the or of queries."""
    if how == "or" and any(q is None for q in queries):
        return None
    kept = sorted({q for q in queries if q is not None}, key=repr)
    return None if not kept else kept[0] if len(kept) == 1 else (how, tuple(kept))


def _of_strings(strings: frozenset[bytes]) -> Query:
    """What texts that hold one of the strings must hold."""
    if not strings or any(len(s) < 3 for s in strings):
        return None
    return _all([_all([s[i : i + 3] for i in range(len(s) - 2)], "and") for s in strings], "or")


def _of_nodes(nodes) -> tuple[frozenset[bytes] | None, Query]:
    """All strings that the nodes match, if they are few, and else the query."""
    now: frozenset[bytes] = frozenset({b""})
    queries: list[Query] = []
    exact = True
    for op, value in nodes:
        strings, query = _of_node(str(op), value)
        joined = None if strings is None else frozenset(a + b for a, b in product(now, strings)) if len(now) * len(strings) <= _MOST else None
        if joined is not None:
            now = joined
            continue
        # The strings so far end here.
        queries += [_of_strings(now), query, None if strings is None else _of_strings(strings)]
        exact, now = False, frozenset({b""}) if strings is None or len(strings) > _MOST else strings
    if exact:
        return now, _of_strings(now)
    return None, _all([*queries, _of_strings(now)], "and")


def _of_node(op: str, value) -> tuple[frozenset[bytes] | None, Query]:
    if op == "LITERAL":
        return frozenset({chr(value).encode().lower()}), None
    if op == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in value):
        chars = {c for o, v in value for c in ([v] if str(o) == "LITERAL" else range(v[0], min(v[1], v[0] + 999) + 1))}
        lower = frozenset(chr(c).encode().lower() for c in chars)
        return (lower if len(lower) <= 8 else None), None
    if op == "SUBPATTERN":
        return _of_nodes(value[-1])
    if op == "BRANCH":
        parts = [_of_nodes(x) for x in value[1]]
        if all(s is not None for s, _ in parts):
            whole = frozenset().union(*(s for s, _ in parts))
            if len(whole) <= _MOST:
                return whole, None
        return None, _all([q for _, q in parts], "or")
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = value
        strings, query = _of_nodes(inner)
        if strings is not None and high <= 3:
            many = [frozenset(b"".join(p) for p in product(strings, repeat=n)) for n in range(low, high + 1) if len(strings) ** n <= _MOST]
            if len(many) == high - low + 1:
                return frozenset().union(*many), None
        return None, (query if low else None)
    if op == "AT":
        return frozenset({b""}), None
    return None, None


def trigram_query(pattern: str) -> Query:
    """What every text with a match holds, in lower-case UTF-8."""
    return _of_nodes(_parser.parse(pattern))[1]


def _trigrams(query: Query) -> set[bytes]:
    return set() if query is None else {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


@dataclass
class Scanner:
    """The rules with their queries, and a table from trigrams to their numbers."""

    rules: tuple[Rule, ...]
    queries: list[Query] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.queries = [trigram_query(r.pattern) for r in self.rules]
        named = sorted(set().union(*map(_trigrams, self.queries)))
        self.number = {x: i + 1 for i, x in enumerate(named)}
        self.table = np.zeros(1 << 24, np.uint16)
        for x, i in self.number.items():
            self.table[int.from_bytes(x, "big")] = i

    def postings(self, found: list[str]) -> dict[int, np.ndarray]:
        """For each named trigram the numbers, in order, of the texts that hold it."""
        encoded = [x.encode().lower() for x in found]
        data = np.frombuffer(b"\0\0".join(encoded) + b"\0\0", np.uint8).astype(np.uint32)
        hits = self.table[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
        at = np.flatnonzero(hits)
        starts = np.cumsum([0, *(len(x) + 2 for x in encoded)])
        pairs = np.unique(hits[at].astype(np.int64) << 32 | np.searchsorted(starts, at, "right") - 1)
        numbers, docs = pairs >> 32, pairs & 0xFFFFFFFF
        cuts = np.flatnonzero(np.diff(numbers)) + 1
        return {int(n[0]): d for n, d in zip(np.split(numbers, cuts), np.split(docs, cuts), strict=True) if len(n)}

    def candidates(self, query: Query, lists: dict[int, np.ndarray], n: int) -> np.ndarray:
        if query is None:
            return np.arange(n)
        if isinstance(query, bytes):
            return lists.get(self.number[query], np.zeros(0, np.int64))
        parts = [self.candidates(q, lists, n) for q in query[1]]
        out = parts[0]
        for x in parts[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out

    def scan(self, found: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, number of the rule, end) in order, for each text."""
        lists = self.postings(found)
        out: list[list[tuple[int, int, int]]] = [[] for _ in found]
        for k, (rule, query) in enumerate(zip(self.rules, self.queries, strict=True)):
            for i in self.candidates(query, lists, len(found)):
                out[i] += [(start, k, end) for start, end in rule.spans(found[i])]
        for x in out:
            x.sort()
        return out


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    out, done = [], 0
    for start, _, end in spans:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the number of spans of each base kind, base_sha256 and spans of every row."""
    kinds = [r.kind for r in BASE]
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in kinds), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(rules)
        for batch in slices(batches):
            every = own.scan(texts(batch))
            said = lambda spans: ",".join(f"{rules[k].kind}:{start}:{end}" for start, k, end in spans)
            base = [[x for x in spans if rules[x[1]].kind in kinds] for spans in every]
            counts = [[sum(rules[x[1]].kind == k for x in spans) for spans in base] for k in kinds]
            yield rows(schema, batch.column(0), *counts, [hashlib.sha256(said(x).encode()).hexdigest() for x in base], [said(x) for x in every])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in kinds)}, base_sha256 string, spans string")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found secret replaced; ``n_chars``, if there, follows."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(rules)
        for batch in slices(batches):
            found = batch.column(names.index("text")).to_pylist()
            clean = [x and redacted(x, spans, mark) for x, spans in zip(found, own.scan([x or "" for x in found]), strict=True)]
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            if "n_chars" in columns:
                old = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([o if a == b else len(b) for o, a, b in zip(old, found, clean, strict=True)], batch.column(names.index("n_chars")).type)
            columns["text"] = pa.array(clean, batch.column(names.index("text")).type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(run, docs.schema)
