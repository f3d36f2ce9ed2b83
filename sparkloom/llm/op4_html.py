"""Main text of web pages by differencing each page with its nearest neighbour.

Pages of one host are put in the order of their URL paths; a page's partner is
the nearest page before it in that order that holds another article (the first ones
take the nearest after them); copies of the page and pages without text are passed
over. The blocks
of text of both are aligned by longest common subsequence, and what both share
is page furniture and goes, inside article and main too; what isn't shared stays,
outside them too. A partner with the same article or main (the same blocks, where
there is none) is another address of the page and deletes nothing. Elements that
hold no main text wherever they stand (menus, headers, footers, sidebars, forms,
scripts, styles, adverts, notices, reader comments) are left out before.

A page without partner keeps all that is left. Pages are cut into ranges of (host,
path, id), so that a large host spreads over many tasks; each range also gets the
page before and the page after it that its own pages need, as a partner only (pages
are known by digests of their article, so copies may fill whole ranges). The
pages of a range stream in order and only one partner is held. Null html gives an
empty text; a null URL has no host and no partner.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts, row_slices

#: Elements without main text, elements that start a new block, elements without content.
NOISE = frozenset("head title script style noscript template nav footer aside form button select textarea iframe svg canvas object dialog menu".split())
BLOCK = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg textarea title".split())
#: Parts of class, id and role that mark an element as no main text.
_MARK = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo|cookies?|consent|gdpr|notice|menu|nav\w*|breadcrumbs?|sidebar|footer|masthead|header|comments?|disqus|respond|replies|share|social|related|newsletter|subscribe|signup|login|search|popup|modal|widget|complementary|contentinfo)(?:$|[\s_-])", re.I)
_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|!\[CDATA\[|[!?])")
_EDGE = re.compile(r"[>\"']")
#: Elements that a start tag of the key's kind closes, if they are the innermost one that is open.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th")}
_ATTR = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPACE = re.compile(r"\s+")
#: Ranges for each shuffle partition, and keys sampled for each range to set the bounds.
RANGES, PER_RANGE = 4, 8
_KEY = ["_host", "_path", "page_id", "_hash"]


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of every tag, comment or declaration (name empty), in time linear in the page."""
    at, open_quotes = 0, {'"', "'"}  # quotes of which another one follows
    while tag := _OPEN.search(page, at):
        start, at = tag.span()
        if not tag[2]:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(tag[0], ">")
            end = page.find(close, at)
            at = len(page) if end < 0 else end + len(close)
            yield start, at, "", "", ""
            continue
        began = at
        while edge := _EDGE.search(page, at):
            at = edge.end()
            if edge[0] == ">":
                break
            if edge[0] in open_quotes:
                end = page.find(edge[0], at)
                if end < 0:  # an unclosed quote is a character like any other
                    open_quotes.discard(edge[0])
                else:
                    at = end + 1
        else:
            return
        yield start, at, tag[1], tag[2].lower(), page[began : at - 1]


def blocks(page: str | None) -> list[tuple[str, bool]]:
    """Blocks of text outside noise elements, in page order, each with whether it stands in article or main.

    A paragraph ends where a block starts, a list item, cell or term where the next one does.
    """
    page = page or ""
    out: list[tuple[str, bool]] = []
    piece: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements that matter: name, is noise
    noise = held = at = 0

    def end() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(piece))).strip()
        piece.clear()
        if text:
            out.append((text, held > 0))

    for start, stop, slash, name, attributes in tags(page):
        if start < at:  # inside a raw element
            continue
        if not noise and start > at:
            piece.append(page[at:start])
        at = stop
        if not name:
            continue
        if name in BLOCK:
            end()
        if slash:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    for n, bad in stack[i:]:
                        noise -= bad
                        held -= n in ("article", "main")
                    del stack[i:]
                    break
        elif name not in VOID and not attributes.endswith("/"):
            while stack and (stack[-1][0] == "p" and name in BLOCK or stack[-1][0] in _CLOSES.get(name, ())):
                noise -= stack.pop()[1]
            marked = any(_MARK.search(x.strip("\"'")) for x in _ATTR.findall(attributes)) if name in BLOCK and name not in ("html", "body", "article", "main") else False
            bad = name in NOISE or marked or (name == "header" and not held)
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = close.end() if close else len(page)
            elif bad or name in ("article", "main") or name in BLOCK and name not in ("p", "li"):
                stack.append((name, bad))
                noise += bad
                held += name in ("article", "main")
    if not noise and at < len(page):
        piece.append(page[at:])
    end()
    return out


def _lengths(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Length of a longest common subsequence of p with each prefix of q; one row is held."""
    best = np.zeros(len(q) + 1, np.int32)
    for x in p:
        take = np.where(q == x, best[:-1] + 1, 0)
        best[1:] = np.maximum.accumulate(np.maximum(take, best[1:]))
    return best


def common_places(p: np.ndarray, q: np.ndarray) -> list[int]:
    """Places in p of a longest common subsequence with q, in memory linear in both: p is halved and q cut where the halves' lengths add up to most."""
    if not len(p) or not len(q):
        return []
    if len(p) == 1:
        return [0] if (q == p[0]).any() else []
    half = len(p) // 2
    cut_ = int(np.argmax(_lengths(p[:half], q) + _lengths(p[half:][::-1], q[::-1])[::-1]))
    return common_places(p[:half], q[:cut_]) + [half + i for i in common_places(p[half:], q[cut_:])]


def shared(mine: list[str], other: list[str]) -> list[bool]:
    """Which of my lines lie on a longest common subsequence with the other's."""
    out = [False] * len(mine)
    a, b = 0, 0
    while a < min(len(mine), len(other)) and mine[a] == other[a]:  # equal ends always lie on one
        out[a] = True
        a += 1
    while b < min(len(mine), len(other)) - a and mine[-1 - b] == other[-1 - b]:
        out[-1 - b] = True
        b += 1
    x, y = mine[a : len(mine) - b], other[a : len(other) - b]
    both = set(x) & set(y)
    xi = [i for i, t in enumerate(x) if t in both]
    y = [t for t in y if t in both]
    if not xi:
        return out
    ids = {t: i for i, t in enumerate(both)}
    p, q = np.array([ids[x[i]] for i in xi]), np.array([ids[t] for t in y])
    for i in common_places(p, q):
        out[a + xi[i]] = True
    return out


def core(page: list[tuple[str, bool]]) -> list[str]:
    """What tells two articles apart: the blocks in article or main, where there are none all blocks."""
    return [t for t, h in page if h] or [t for t, _ in page]


def main_text(mine: list[tuple[str, bool]], partner: list[tuple[str, bool]] | None) -> str:
    """The lines that the partner doesn't share; all of them without a partner, or where it is a copy."""
    lines = [t for t, _ in mine]
    gone = shared(lines, [t for t, _ in partner]) if partner and core(partner) != core(mine) else [False] * len(lines)
    return "\n\n".join(t for t, g in zip(lines, gone, strict=True) if not g)


def _ranges(keys: DataFrame, n: int) -> list[tuple]:
    """Bounds that cut the order of keys into about n ranges of like size, from a sample by hash."""
    every = max(1, keys.count() // (n * PER_RANGE))
    found = sorted(_sortable(tuple(r)) for r in keys.select(*_KEY).where(F.pmod(F.xxhash64(F.lit(4), *_KEY), F.lit(every)) == 0).collect())
    return sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []


def _sortable(key: tuple) -> tuple:
    return tuple((x is not None, x) if x is not None else (False,) for x in key)


def _digests(rows: DataFrame) -> DataFrame:
    """The key of each page with a digest of its article; null where the page holds no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            cores = (core(blocks(h.as_py())) for h in t.column("html"))
            found = pa.array([blake2b("\0".join(c).encode("utf-8", "surrogatepass"), digest_size=16).digest() if c else None for c in cores], pa.binary())
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in _KEY), found], names=[*_KEY, "_core"])

    return rows.select(*_KEY, "html").mapInArrow(run, f"_host string, _path string, page_id {rows.schema['page_id'].dataType.simpleString()}, _hash bigint, _core binary")


def _edges(keys: DataFrame) -> list[tuple[int, tuple]]:
    """(range, key) of the pages that a range needs from outside: for its first article the nearest other one before it, for its last the nearest after it, of one host."""
    page = F.struct(*_KEY, "_core")
    held = keys.where("_host <> '' and _core is not null")
    ends = cut(held.groupBy("_part").agg(F.min(page).alias("a"), F.max(page).alias("z")))
    other = lambda end: F.when((F.col("_host") == F.col(f"{end}._host")) & (F.col("_core") != F.col(f"{end}._core")), page)
    found = held.join(F.broadcast(ends), "_part").groupBy("_part", "a", "z").agg(F.min(other("a")).alias("a2"), F.max(other("z")).alias("z2")).collect()
    found = sorted(((r["_part"], *(r[c] and tuple(r[c]) for c in ("a", "a2", "z", "z2"))) for r in found), key=lambda r: r[0])
    return [*_nearest((p, a, z, z2) for p, a, _, z, z2 in found), *_nearest((p, z, a, a2) for p, a, a2, z, _ in reversed(found))]


def _nearest(ranges: Iterator[tuple]) -> Iterator[tuple[int, tuple]]:
    """For each range's head the nearest page of its host and another article in the ranges before."""
    last = last2 = None  # the page nearest to the next range, and the nearest one with another article
    for part, head, tail, tail2 in ranges:
        if last and last[0] == head[0] and (partner := last if last[-1] != head[-1] else last2):
            yield part, partner[:-1]
        if last and last[0] == tail[0] and not tail2:
            tail2 = last if last[-1] != tail[-1] else last2
        last, last2 = tail, tail2


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    host, path = F.lower(F.regexp_extract(rest, r"^[^/]*", 0)), F.regexp_extract(rest, r"^[^/]*(.*)$", 1)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("_host"), path.alias("_path"), F.xxhash64(url, html).alias("_hash"))
    keys = cut(_digests(rows))
    bounds = spark.sparkContext.broadcast(_ranges(keys, RANGES * parts(spark)))

    @F.arrow_udf("int")
    def part(*key: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds.value, _sortable(k)) for k in zip(*(c.to_pylist() for c in key), strict=True)], pa.int32())

    edges = _edges(keys.withColumn("_part", part(*_KEY)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # copies of the first article of a host in a range wait for the next
        key = now = before = None
        for batch in batches:
            for piece in row_slices(batch, "html", 4 << 20):
                out: list[tuple] = []
                for page, link, page_html, host, part, own in zip(*(piece.column(c).to_pylist() for c in ("page_id", "url", "html", "_host", "_part", "_own")), strict=True):
                    if key != (part, host):
                        out += ((*w[:2], main_text(w[2], None)) for w in waiting)
                        waiting, key, now, before = [], (part, host), None, None
                    mine = blocks(page_html)
                    if not host or not mine:
                        if own:
                            out.append((page, link, main_text(mine, None)))
                        continue
                    if now and core(now) != core(mine):
                        before = now
                        out += ((*w[:2], main_text(w[2], mine)) for w in waiting)
                        waiting = []
                    now = now if now == mine else mine  # equal copies are held once
                    if own and before:
                        out.append((page, link, main_text(mine, before)))
                    elif own:
                        waiting.append((page, link, now))
                yield _out(out, piece.schema)
        if waiting:
            yield _out([(*w[:2], main_text(w[2], None)) for w in waiting], batch.schema)

    def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, schema.field("page_id").type), pa.array(b, pa.string()), pa.array(c, pa.string()), pa.array(map(len, c), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    guests = spark.createDataFrame([(p, *k) for p, k in edges], f"_part int, _h string, _p string, _i {kind}, _x bigint")
    same = F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")) & F.col("page_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_x"))
    lent = rows.join(F.broadcast(guests), same).select(*rows.columns, "_part", F.lit(False).alias("_own"))  # at most two a range
    dealt = rows.withColumn("_part", part(*_KEY)).withColumn("_own", F.lit(True)).unionByName(lent)
    ordered = dealt.repartition("_part").sortWithinPartitions("_part", *_KEY)
    return ordered.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
