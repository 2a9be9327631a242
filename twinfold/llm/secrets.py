"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams
that any match must contain. Each shard of documents gets an index from the
trigrams asked for to the documents that hold them; intersecting and uniting
the postings leaves few candidates, which the expression itself verifies. A
rule without a mandatory trigram scans every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from twinfold.llm.frames import add_columns, same_columns

#: Sets of strings larger than this are given up for their trigrams.
_MOST_EXACT, _MOST_CLASS = 128, 16


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an ASCII expression and a least length of one group."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False


#: The three base kinds, in this order, then well-known public token formats.
BASE_RULES = (
    Rule(
        "assign",
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2,
        least=8,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
)
ADDED_RULES = (
    # to the END line; without one, to the end of the base64 body
    Rule(
        "private_key",
        r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
        r"(?:(?:[^-]|-(?!----))*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
        r"|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)*+(?:(?:\r?\n|\\n)[A-Za-z0-9+/]{1,63}={0,2}(?=\s|\\|$))?)",
    ),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"sk_live_[0-9a-zA-Z]{24,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + ADDED_RULES

# --- trigram queries -------------------------------------------------------
#
# A query is True (all documents), a trigram, or ("and"/"or", parts). A node of
# an expression is described by (exact, prefixes, suffixes, query): the strings
# it can match if they are few, else how its matches begin and end, and what
# they must contain. Everything is in lower case, as the index is.


def _both(*parts):
    flat: set = set()
    for p in parts:
        if p is not True:
            flat |= set(p[1]) if isinstance(p, tuple) and p[0] == "and" else {p}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _either(parts):
    parts = set(parts)
    if True in parts or not parts:
        return True
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _contains(strings) -> object:
    return _either([_both(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


_ANY = (None, frozenset({""}), frozenset({""}), True)
_EMPTY = (frozenset({""}), frozenset({""}), frozenset({""}), True)


def _of_exact(strings):
    strings = frozenset(strings)
    return strings, strings, strings, True


def _concat(x, y):
    ex, px, sx, qx = x
    ey, py, sy, qy = y
    if ex is not None and ey is not None and len(ex) * len(ey) <= _MOST_EXACT:
        return _of_exact(a + b for a in ex for b in ey)
    seam = True
    if len(sx) * len(py) <= _MOST_EXACT:
        seam = _contains({a[-2:] + b[:2] for a in sx for b in py})
    own = [_contains(e) if e is not None else True for e in (ex, ey)]
    begin = {a + b for a in ex for b in py} if ex is not None and len(ex) * len(py) <= _MOST_EXACT else px
    end = {a + b for a in sx for b in ey} if ey is not None and len(ey) * len(sx) <= _MOST_EXACT else sy
    query = _both(qx, qy, seam, *own, _contains(begin), _contains(end))
    return None, frozenset(b[:3] for b in begin), frozenset(e[-3:] for e in end), query


def _union(parts):
    exact = frozenset().union(*[p[0] for p in parts]) if all(p[0] is not None for p in parts) else None
    if exact is not None and len(exact) <= _MOST_EXACT:
        return _of_exact(exact)
    return (
        None,
        frozenset().union(*[p[1] for p in parts]),
        frozenset().union(*[p[2] for p in parts]),
        _either([_both(p[3], _contains(p[0]) if p[0] is not None else True) for p in parts]),
    )


class _Reader:
    """Reads an expression into ``("or", sequences)``, a sequence being a list of
    nodes ``("chars", characters or None)``, ``("repeat", least, most, node)``
    and ``("or", ...)``. Assertions match nothing of their own. What it does not
    know raises ValueError."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def peek(self, n: int = 1) -> str:
        return self.pattern[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        got = self.peek(n)
        if len(got) < n:
            raise ValueError("the expression ends too early")
        self.at += n
        return got

    def alternatives(self):
        sequences = [[]]
        while self.peek() and self.peek() != ")":
            if self.peek() == "|":
                self.at += 1
                sequences.append([])
                continue
            node = self.repeated(self.atom())
            if node is not None:
                sequences[-1].append(node)
        return "or", sequences

    def atom(self):
        c = self.take()
        if c == "(":
            assertion = False
            if self.peek() == "?":
                self.at += 1
                kind = self.take()
                if kind == "<" and self.peek() in ("=", "!"):
                    kind = self.take()
                assertion = kind in "=!"
                if not assertion and kind not in ":>":
                    raise ValueError(f"group of kind {kind!r}")
            inner = self.alternatives()
            if self.take() != ")":
                raise ValueError("a group is not closed")
            return None if assertion else inner
        if c in "^$":
            return None
        if c == ".":
            return "chars", None
        if c == "[":
            return "chars", self.char_class()
        if c == "\\":
            chars = self.escape()
            return None if chars == "" else ("chars", chars)
        if c in "*+?{":
            raise ValueError("nothing to repeat")
        return "chars", frozenset(c)

    def escape(self):
        """The characters of an escape, None for many, "" for an assertion."""
        c = self.take()
        if c == "x":
            return frozenset(chr(int(self.take(2), 16)))
        if c in "bBAZ":
            return ""
        if c in "dDwWsS":
            return None
        if c in "nrtfv":
            return frozenset({"n": "\n", "r": "\r", "t": "\t", "f": "\f", "v": "\v"}[c])
        if c.isalnum():
            raise ValueError(f"escape of {c!r}")
        return frozenset(c)

    def char_class(self):
        chars, known, first = set(), self.peek() != "^", True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            one = self.escape() if c == "\\" else frozenset(c)
            if c == "^" and not known and not chars:
                continue
            if not one:
                known = False
            elif self.peek() == "-" and self.peek(2)[1:] not in ("]", ""):
                self.at += 1
                c = self.take()
                last = self.escape() if c == "\\" else frozenset(c)
                if not last:
                    raise ValueError("a range without an end")
                chars |= {chr(i) for i in range(ord(min(one)), ord(min(last)) + 1)}
            else:
                chars |= one
        self.at += 1
        return frozenset(chars) if known else None

    def repeated(self, node):
        braces = re.compile(r"\{(\d*)(,?)(\d*)\}").match(self.pattern, self.at)
        c = self.peek()
        if c and c in "*+?":
            self.at += 1
            least, most = (1 if c == "+" else 0), (1 if c == "?" else None)
        elif braces and (braces[1] or braces[3]):
            self.at = braces.end()
            least = int(braces[1] or 0)
            most = (int(braces[3]) if braces[3] else None) if braces[2] else least
        else:
            return node
        if self.peek() and self.peek() in "?+":  # lazy or possessive: the same strings
            self.at += 1
        return None if node is None else ("repeat", least, most, node)


def _describe(node):
    kind = node[0]
    if kind == "chars":
        chars = {c.lower() for c in node[1] or ()}
        return _of_exact(chars) if 0 < len(chars) <= _MOST_CLASS else _ANY
    if kind == "or":
        parts = []
        for sequence in node[1]:
            out = _EMPTY
            for n in sequence:
                out = _concat(out, _describe(n))
            parts.append(out)
        return _union(parts)
    _, least, most, inner = node
    one, out = _describe(inner), _EMPTY
    for _ in range(min(least, 3)):
        out = _concat(out, one)
    if (least, most) == (0, 1):
        return _union([_EMPTY, one])
    return out if most == least and least <= 3 else _concat(out, _ANY)


def trigram_query(pattern: str):
    """A Boolean query over lower-case trigrams that every match satisfies.

    True means no trigram is mandatory, or that the expression has something
    this reader does not know (back references, inline flags).
    """
    reader = _Reader(pattern)
    try:
        tree = reader.alternatives()
    except ValueError:
        return True
    if reader.at < len(pattern):
        return True
    exact, _, _, query = _describe(tree)
    return _both(query, _contains(exact) if exact is not None else True)


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*[trigrams_of(p) for p in query[1]])


class TrigramIndex:
    """Postings of the asked-for trigrams over one shard of documents."""

    def __init__(self, texts: list[bytes], asked: list[str], codes: np.ndarray):
        self.n = len(texts)
        joined = np.frombuffer(b"\n\n".join(texts).lower(), np.uint8)
        ends = np.cumsum([len(t) + 2 for t in texts])
        places, kinds = [], []
        for at in range(0, max(0, len(joined) - 2), 1 << 20):
            part = joined[at : at + (1 << 20) + 2].astype(np.int32)
            key = codes[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            hit = np.flatnonzero(key)
            places.append(hit + at)
            kinds.append(key[hit])
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        kind = np.concatenate(kinds) if kinds else np.zeros(0, codes.dtype)
        doc = np.searchsorted(ends, place, side="right")
        self.postings = {t: np.unique(doc[kind == i + 1]) for i, t in enumerate(asked)}

    def candidates(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings[query]
        parts = sorted((self.candidates(p) for p in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, True) if query[0] == "and" else np.union1d(out, p)
        return out


@lru_cache(4)
def _compiled(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    asked = sorted(set().union(*[trigrams_of(q) for q in queries]))
    codes = np.zeros(1 << 24, np.uint8 if len(asked) < 256 else np.uint16)
    for i, t in enumerate(asked):
        a, b, c = t.encode("latin-1")
        codes[a << 16 | b << 8 | c] = i + 1
    finders = []
    for rule in rules:
        # a run shorter than the least fails as a whole, so it need not match
        lone = re.fullmatch(r"\[[^]]+\]\+", rule.pattern) and rule.group == 0 and rule.least
        pattern = f"{rule.pattern[:-1]}{{{rule.least},}}" if lone else rule.pattern
        finders.append(re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0)).finditer)
    return queries, asked, codes, finders


def find_spans(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its spans ``(start, rule number, end)``, sorted."""
    queries, asked, codes, finders = _compiled(rules)
    index = TrigramIndex([t.encode("utf-8", "surrogatepass") for t in texts], asked, codes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query, find) in enumerate(zip(rules, queries, finders, strict=True)):
        for i in index.candidates(query).tolist():
            for m in find(texts[i]):
                a, b = m.span(rule.group)
                if b - a >= rule.least:
                    out[i].append((m.start(), k, m.end()))
    for spans in out:
        spans.sort()
    return out


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``secret_spans``: an array of ``(kind, start, end)`` for every row.

    Offsets are code points of ``text``, ends exclusive, sorted by start and
    then by the order of the rules. A null or empty text has no spans.
    Repeated rows are scanned as they come, an empty table stays empty, and
    an input column called ``secret_spans`` is replaced; others pass through.
    """
    span = StructType(
        [StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]
    )

    def spans_of(texts):
        found = find_spans([t or "" for t in texts.to_pylist()], rules)
        return [[[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in spans] for spans in found]]

    added = [StructField("secret_spans", ArrayType(span))]
    return add_columns(docs, added, lambda: spans_of, most_rows=4096)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """The same rows and columns, secrets in ``text`` replaced by ``mask``.

    Overlapping spans are replaced together by one mask. A text without
    secrets, null or empty, is unchanged. Repeated rows stay repeated, very
    long texts are scanned whole, and an empty table stays empty.
    """

    def masked(text, spans):
        if not spans:
            return text
        out, done = [], 0
        for a, _, b in spans:
            if a >= done:
                out += [text[done:a], mask]
            done = max(done, b)
        return "".join(out) + text[done:]

    def change(part, at):
        given = part.column(at).to_pylist()
        found = find_spans([t or "" for t in given], rules)
        texts = pa.array([masked(t, x) for t, x in zip(given, found, strict=True)], part.column(at).type)
        return part.set_column(at, part.schema.field(at), texts)

    return same_columns(docs, lambda: change, most_rows=4096)


def span_digests(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds and digests of ``secret_spans``."""
    base = [r.kind for r in BASE_RULES]

    def count(kind):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return scanned.withColumns(
        {f"n_{kind}": count(kind) for kind in base}
        | {
            "base_sha256": F.sha2(joined(F.filter("secret_spans", lambda s: s["kind"].isin(base))), 256),
            "spans": joined(F.col("secret_spans")),
        }
    )
