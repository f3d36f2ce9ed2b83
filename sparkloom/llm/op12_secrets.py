"""Secret scans over a trigram inverted index.

From every rule's regular expression a Boolean query of trigrams is derived: what
any match must hold. Documents are indexed where they lie: a shard (some MB of
whole documents) has a posting list of document numbers for each trigram that the
rules ask for, a rule's query intersects and unites the lists, and the rule's
expression runs on the whole texts of the documents that remain. A rule without
a mandatory trigram runs on every text. An index by document shards moves no text
and no posting: there is no shuffle, memory is bounded by a shard and the longest
text, and a lost task indexes its own shard again.

The index folds A-Z to lower case, which only adds candidates. Rules' expressions
match ASCII letters in either case under IGNORECASE. Of a rule the matches are the
leftmost ones that don't overlap; a match of fewer characters than the rule asks
for is dropped, and the search goes on behind it.

Places are code points. A null or empty text has no spans. Repeated rows are
scanned one by one. An empty table gives an empty result. Columns of docs are
passed on; a column `spans` is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from re import _parser as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_slices, sealed

SHARD_BYTES = 8 << 20
#: Bytes of a shard whose trigrams are looked up at once.
STEP = 2 << 20
#: Strings that the analysis of an expression keeps apart; with more it asks for less, so only candidates are added.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, and the fewest characters of one of its groups."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    either_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.either_case else 0))


#: The three kinds of the contract. A hex run of 24 characters or more is what is left of `[0-9a-f]+`.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", least=6, group=2, either_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: Token shapes that their issuers publish.
MORE = [
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----"),
    Rule("bearer", r"bearer\x20{1,4}[A-Za-z0-9._~+/-]{16,}=*", either_case=True),
    Rule("url_login", r"://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{1,64}@"),
]
RULES = [*BASE, *MORE]

# A query is True (any text), a trigram in bytes, or ("and" | "or", frozenset of queries).


def both(*queries):
    flat = {q for x in queries if x is not True for q in (x[1] if isinstance(x, tuple) and x[0] == "and" else (x,))}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def either(queries):
    found = set(queries)
    if True in found or not found:
        return True
    return next(iter(found)) if len(found) == 1 else ("or", frozenset(found))


def holds(strings):
    """One of the strings occurs: each of them through all of its trigrams."""
    return either(both(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings)


@dataclass(frozen=True)
class Needs:
    """What matches of an expression have in common.

    Where `whole` is set, matches are just those strings. Else each match starts with one
    of `start`, ends with one of `end` (both may be the empty string) and fits `query`.
    """

    whole: frozenset | None
    start: frozenset = frozenset([b""])
    end: frozenset = frozenset([b""])
    query: object = True

    def opened(self) -> Needs:
        """The same without the list of whole strings, which becomes part of the query."""
        if self.whole is None:
            return self
        return Needs(None, short({s[:2] for s in self.whole}), short({s[-2:] for s in self.whole}), holds(self.whole))


ANY, EMPTY = Needs(None), Needs(frozenset([b""]))


def short(strings) -> frozenset:
    return frozenset(strings) if len(strings) <= MOST_STRINGS else frozenset([b""])


def follow(a: Needs, b: Needs) -> Needs:
    """Matches of a, each with one of b behind it."""
    if a.whole is not None and b.whole is not None and len(a.whole) * len(b.whole) <= MOST_STRINGS:
        return Needs(frozenset(x + y for x, y in product(a.whole, b.whole)))
    left, right = a.whole if a.whole is not None else a.end, b.whole if b.whole is not None else b.start
    across = True
    if len(left) * len(right) <= MOST_STRINGS:
        across = holds({x + y for x, y in product(left, right)})
    x, y = a.opened(), b.opened()
    start = {s + t for s, t in product(a.whole, y.start)} if a.whole is not None and len(a.whole) * len(y.start) <= MOST_STRINGS else x.start
    end = {s + t for s, t in product(x.end, b.whole)} if b.whole is not None and len(x.end) * len(b.whole) <= MOST_STRINGS else y.end
    # The start may be kept whole, so that what stands before joins it; only two letters of the far side are of use.
    return Needs(None, short({s[:2] for s in start}) if a.whole is None else short(start), short(end), both(x.query, y.query, across))


def one_of(options: list[Needs]) -> Needs:
    if all(o.whole is not None for o in options) and len(whole := frozenset().union(*(o.whole for o in options))) <= MOST_STRINGS:
        return Needs(whole)
    opened = [o.opened() for o in options]
    return Needs(None, short(frozenset().union(*(o.start for o in opened))), short(frozenset().union(*(o.end for o in opened))), either(o.query for o in opened))


def letter(code: int) -> bytes:
    return chr(code).encode("utf-8", "surrogatepass").lower()


def needs(parsed) -> Needs:
    """What the matches of a parsed expression have in common; of a part that it doesn't know, nothing."""
    found = EMPTY
    for op, value in parsed:
        if op is sre.LITERAL:
            part = Needs(frozenset([letter(value)]))
        elif op is sre.IN:
            part = letters(value)
        elif op is sre.SUBPATTERN:
            part = needs(value[3])
        elif op is sre.ATOMIC_GROUP:
            part = needs(value)
        elif op is sre.BRANCH:
            part = one_of([needs(x) for x in value[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            part = repeat(*value)
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            part = EMPTY
        else:
            part = ANY
        found = follow(found, part)
    return found


def letters(members) -> Needs:
    """A class of characters: its members if they are few."""
    found: set[bytes] = set()
    for op, value in members:
        if op is sre.LITERAL:
            found.add(letter(value))
        elif op is sre.RANGE and value[1] - value[0] < MOST_STRINGS:
            found |= {letter(c) for c in range(value[0], value[1] + 1)}
        else:
            return ANY
    return Needs(frozenset(found)) if len(found) <= MOST_STRINGS // 4 else ANY


def repeat(least: int, most: int, inner) -> Needs:
    one = needs(inner)
    if (least, most) == (0, 1):
        return one_of([EMPTY, one])
    if least == 0:
        return ANY
    found = EMPTY
    for _ in range(min(least, 3)):  # three in a row hold every trigram that more would
        found = follow(found, one)
    if (least, most) == (min(least, 3),) * 2:
        return found
    found = found.opened()
    return Needs(None, found.start, one.opened().end, found.query)


def query_of(rule: Rule):
    """The Boolean query of a rule: documents without an answer to it hold no match."""
    return needs(sre.parse(rule.pattern, re.ASCII)).opened().query


def trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams(q) for q in query[1]))


class Index:
    """Posting lists of a shard: for each wanted trigram the numbers of the texts that hold it, in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: list[int]):
        """data: the bytes of all texts; offsets: where each begins, and the end; wanted: trigrams as numbers, sorted."""
        ask, pairs = np.array(wanted, np.int32), np.zeros(1 << 16, bool)
        pairs[ask >> 8] = True
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        size, found = len(offsets) - 1, []
        begin, end = int(offsets[0]), int(offsets[-1])
        for at in range(begin, end, STEP):
            piece = fold[data[at : min(at + STEP + 2, end)]].astype(np.int32)
            if len(piece) < 3:
                continue
            two = (piece[:-2] << 8) | piece[1:-1]
            place = np.flatnonzero(pairs[two])
            code = (two[place] << 8) | piece[place + 2]
            number = np.minimum(np.searchsorted(ask, code), len(ask) - 1)
            hit = ask[number] == code
            place, number = place[hit] + at, number[hit]
            text = np.searchsorted(offsets, place, side="right") - 1
            inside = place + 3 <= offsets[text + 1]
            found.append(np.unique(number[inside].astype(np.int64) * size + text[inside]))
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        ends = np.searchsorted(keys, np.arange(len(ask) + 1) * size)
        self.size = size
        self.lists = {int(t): keys[ends[i] : ends[i + 1]] % max(size, 1) for i, t in enumerate(ask)}

    def candidates(self, query) -> np.ndarray:
        """Numbers of the texts that answer a query, by intersecting and uniting posting lists."""
        if query is True:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.lists[int.from_bytes(query)]
        lists = sorted((self.candidates(q) for q in query[1]), key=len, reverse=query[0] == "or")
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


def matches(rule: Rule, expression: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    for m in expression.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.span()


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """All columns of docs with `spans`: kind, start and end of every secret, by start, then by the order of the rules."""
    rules = RULES if rules is None else rules
    rows, names = sealed(docs)
    body, queries = names[text], [query_of(r) for r in rules]
    wanted = sorted({int.from_bytes(t) for q in queries for t in trigrams(q)})
    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "_spans array<struct<kind:string,start:bigint,end:bigint>>"])

    def spans(texts: pa.Array) -> list[list[dict]]:
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        index = Index(data, offsets, wanted)
        found: list[list[tuple]] = [[] for _ in range(len(texts))]
        for order, (rule, query) in enumerate(zip(rules, queries, strict=True)):
            expression = rule.compiled()
            for i in index.candidates(query).tolist():
                found[i] += [(a, order, b) for a, b in matches(rule, expression, texts[i].as_py())]
        return [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(x)] for x in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_slices(batch, body, SHARD_BYTES):
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(spans(piece.column(body)), pa.list_(_SPAN))], names=[*piece.schema.names, "_spans"])

    found = rows.mapInArrow(run, fields)
    return found.select(*[F.col(n).alias(c) for c, n in names.items() if c != "spans"], F.col("_spans").alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return found.select("doc_id", *[F.size(of(r.kind)).cast("bigint").alias(f"n_{r.kind}") for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def brute(rows: list[tuple]) -> list[tuple]:
    """The digest by running every expression, as the contract words it, over every text, for tests."""
    base = {"assign": (r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}
    out = []
    for doc_id, text in rows:
        found = [(m.start(), order, kind, m.end()) for order, (kind, (pattern, group, least)) in enumerate(base.items()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
        n = [sum(f[2] == kind for f in found) for kind in base]
        join = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        more = [(m.start(), 3 + order, r.kind, m.end()) for order, r in enumerate(MORE) for m in r.compiled().finditer(text or "")]
        out.append((doc_id, *n, hashlib.sha256(join(found).encode()).hexdigest(), join(found + more)))
    return out
