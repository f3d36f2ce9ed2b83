"""What a page's elements say: item detection, one element for each field, classes of blocks, sample blocks.

`located` parses a page once into its elements in page order, each with the number of its
last descendant, its ancestors, its children and its stretch of the page's text, so that
containment is a comparison, a child path a walk of lookups and any element's text a
slice. All the rest are Column expressions over that array: no shuffle, a page a row.

Visual signals (font size, place on the screen) have no counterpart in static HTML and give
no points. A null or empty page has no elements, so no items, fields, blocks or samples.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.pages import VOID, Node, _Tree, select

# Elements without content, those that end a line of a field's text, and marks of list items.
SILENT = frozenset("style script noscript link template svg iframe head meta title base".split())
CUT = frozenset("style script noscript link template svg iframe".split())
BLOCKS = frozenset("p div li tr h1 h2 h3 h4 h5 h6 section article header footer blockquote".split())
MARKS = "•●▪‣◦·∙※✔✓☑✅❖➤➔→▶✦★"
# Elements that are judged as blocks.
JUDGED = "h1 h2 h3 h4 h5 h6 p span a li td th dd dt label div strong em b i".split()
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
ICONS = ["svg", "i", "img"]

_SHAPE = "at:int,last:int,up:array<int>,nth:int,kids:array<int>,tag:string,id:string,classes:array<string>,from:int,to:int,link:string,values:map<string,string>,marks:array<string>,text:string,size:int,repeats:boolean,hints:string,label:string,before:string,begin:int,end:int"


class _Placed(_Tree):
    """The tree, and where in the source each element begins and ends."""

    def __init__(self, page: str) -> None:
        super().__init__()
        self.page, self.lines, self.span = page, [0, *(m.end() for m in re.finditer("\n", page))], {}
        self.token, self.ends = (0, 0), False
        self.feed(page)
        self.close()
        self.token = (len(page),) * 2
        while self.at.parent:
            self.leave(self.at)

    def begins(self, length: int) -> None:
        line, column = self.getpos()
        self.token = (self.lines[line - 1] + column, self.lines[line - 1] + column + length)

    def handle_starttag(self, tag, attrs):
        self.begins(len(self.get_starttag_text() or ""))
        super().handle_starttag(tag, attrs)
        self.span[id(self.at.kids[-1] if tag in VOID else self.at)] = self.token

    def handle_startendtag(self, tag, attrs):
        self.begins(len(self.get_starttag_text() or ""))
        super().handle_startendtag(tag, attrs)
        self.span[id(self.at.kids[-1])] = self.token

    def handle_endtag(self, tag):
        self.begins(0)
        self.token, self.ends = (self.token[0], self.page.find(">", self.token[0]) + 1 or len(self.page)), True
        super().handle_endtag(tag)
        self.ends = False

    def leave(self, node):
        """What is open below ends where this tag begins; the node itself behind the tag, if the tag is its own."""
        start, stop = self.token
        while True:
            own = self.ends and self.at is node
            self.span[id(self.at)] = (self.span[id(self.at)][0], stop if own else start)
            if self.at is node:
                break
            self.at = self.at.parent
        super().leave(node)


def _address(n: Node) -> str:
    """An address that a mail guard has hidden: its first byte is combined with each of the others."""
    coded = n.attrs.get("data-cfemail") or (n.attrs.get("href", "").partition("#")[2] if "__cf_email__" in n.attrs.get("class", "").split() else "")
    try:
        raw = bytes.fromhex(coded)
    except ValueError:
        return ""
    return "".join(chr(b ^ raw[0]) for b in raw[1:])


def _data(n: Node) -> list[str]:
    return [x.lower() for k, v in n.attrs.items() if k.startswith("data-") and v for x in (k, v)]


def _named(n: Node, *names: str) -> list[str]:
    return [n.attrs[k].lower() for k in names if n.attrs.get(k)]


def _resolved(url: str | None, href: str | None) -> str | None:
    if not href or re.match("#|javascript:", href):
        return None
    try:
        return urljoin(url or "", href)
    except ValueError:
        return href


class _Text:
    """The text of a page's elements, each a stretch of its runs: trimmed, without joining more than is asked for."""

    def __init__(self) -> None:
        self.runs: list[str] = []
        self.full, self.ends = [0], [0]  # runs that aren't blank, and characters, before each run

    def add(self, run: str) -> None:
        self.runs.append(run)
        self.full.append(self.full[-1] + bool(run.strip()))
        self.ends.append(self.ends[-1] + len(run))

    def bounds(self, a: int, b: int) -> tuple[int, int]:
        """The first run that isn't blank, and one behind the last."""
        return bisect_right(self.full, self.full[a]) - 1, bisect_left(self.full, self.full[b])

    def size(self, a: int, b: int) -> int:
        if self.full[a] == self.full[b]:
            return 0
        x, y = self.bounds(a, b)
        first, last = self.runs[x], self.runs[y - 1]
        return self.ends[y] - self.ends[x] - (len(first) - len(first.lstrip())) - (len(last) - len(last.rstrip()))

    def head(self, a: int, b: int, most: int) -> str:
        if self.full[a] == self.full[b]:
            return ""
        x, y = self.bounds(a, b)
        stop = min(y, bisect_right(self.ends, self.ends[x] + len(self.runs[x]) + most))
        return "".join(self.runs[x:stop]).lstrip()[: min(most, self.size(a, b))]


def located(page: str | None, url: str | None = None, selectors: dict[str, str] | None = None, names: tuple[str, ...] = (), every: str | None = None) -> dict:
    """A page's pieces of text and its elements; `selectors` marks the first match of each field, `names` are attributes to keep, all matches of `every` are marked "".

    Pieces are runs of text, with line ends and list marks as pieces of their own. Of an
    element's text the first 500 characters are held (`size` counts all).
    """
    tree = _Placed(page or "")
    nodes = list(tree.root.walk())
    at = {id(n): i for i, n in enumerate(nodes)}
    by_id, labels = ({key: n for n in reversed(nodes) if (key := n.attrs.get(a)) and (a == "id" or n.tag == "label")} for a in ("id", "for"))
    marks: dict[int, list[str]] = {}
    for field, selector in (selectors or {}).items():
        if hits := select(tree.root, selector):
            marks.setdefault(min(at[id(h)] for h in hits), []).append(field)
    for hit in select(tree.root, every) if every else ():
        marks.setdefault(at[id(hit)], []).append("")
    text, pieces, stretch, rows = _Text(), [], [], []
    anchors: list[Node | None] = []
    todo: list[tuple[Node | str, bool, bool]] = [(k, True, True) for k in reversed(tree.root.kids)]
    while todo:
        k, enters, shown = todo.pop()
        if isinstance(k, str):
            text.add(k)
            pieces += [k] if shown else []
        elif enters:
            pieces += ["\n"] if k.tag == "br" and shown else ["\x01"] if k.tag == "li" and shown else []
            up, mail = at.get(id(k.parent), -1), _address(k)
            pieces += [mail] if mail and shown else []
            anchors.append(k if k.tag == "a" else anchors[up] if up >= 0 else None)
            stretch.append([len(text.runs), 0])
            rows.append({"at": len(rows), "last": len(rows), "up": [*rows[up]["up"], up] if up >= 0 else [], "nth": 0, "kids": [at[id(x)] for x in k.kids if isinstance(x, Node)], "tag": k.tag, "id": k.attrs.get("id", ""), "classes": k.attrs.get("class", "").split(), "from": len(pieces) - bool(mail and shown),
                         "to": 0, "values": {x: k.attrs[x].strip() for x in names if x in k.attrs}, "marks": marks.get(len(rows), []), "begin": tree.span[id(k)][0], "end": tree.span[id(k)][1]})
            todo.append((k, False, shown))
            todo += [(x, True, shown and not mail and k.tag not in CUT) for x in reversed(k.kids)]
        else:
            i = at[id(k)]
            stretch[i][1], rows[i]["to"] = len(text.runs), len(pieces)
            up = at.get(id(k.parent), -1)
            if up >= 0:
                rows[up]["last"] = max(rows[up]["last"], rows[i]["last"])
            if k.tag == "li" and shown:  # the mark before it, unless it is empty or brings its own
                first = text.head(*stretch[i], 1)
                pieces[rows[i]["from"] - 1] = "• " if first and first not in MARKS + "*-" else ""
            pieces += ["\n"] if k.tag in BLOCKS and shown else []
    below: list[Node | None] = [None] * len(rows)
    for i in range(len(rows) - 1, -1, -1):
        below[i] = nodes[i] if nodes[i].tag == "a" else next((below[k] for k in rows[i]["kids"] if below[k] is not None), None)
    words = lambda i: text.head(*stretch[i], sum(map(len, text.runs[slice(*stretch[i])])))
    for up in [tree.root, *nodes]:
        own = [at[id(k)] for k in up.kids if isinstance(k, Node)]
        for place, i in enumerate(own):
            n, row, size = nodes[i], rows[i], text.size(*stretch[i])
            row |= {"nth": place, "text": text.head(*stretch[i], 500), "size": size, "before": nodes[own[place - 1]].tag if place else None}
            full = text.full[stretch[i][1]] - text.full[stretch[i][0]]
            row["repeats"] = any(text.full[stretch[k][1]] - text.full[stretch[k][0]] == full for k in row["kids"])
            anchor = anchors[i] if anchors[i] is not None else below[i]
            row["link"] = _resolved(url, anchor.attrs.get("href")) if anchor is not None else None
            row["hints"] = " ".join([*_named(n, "class", "id", "aria-label", "role"), *_data(n)])
            near = [x for x in (by_id.get(n.attrs.get("aria-labelledby") or ""), labels.get(n.attrs.get("id") or "")) if x is not None]
            old = [words(own[place - 1]).lower()] if place and 0 < text.size(*stretch[own[place - 1]]) < 50 else []
            around = [*_named(up, "class", "id"), *_data(up)] if up is not tree.root else []
            row["label"] = " ".join([*_named(n, "aria-label"), *(words(at[id(x)]).lower() for x in near), *old, *around, *_named(n, "class", "id")])
    return {"pieces": pieces, "elements": rows}


#: Letters of pages that are parsed before their elements go back: these take some sixty times as much memory.
CHUNK = 1 << 18


def framed(parts: Iterator[tuple[pd.Series, pd.Series]], made: Callable[[str | None, str | None], dict]) -> Iterator[pd.DataFrame]:
    """What is made of each page and its address, in frames that end with the page that fills the chunk or ends the batch."""
    for pages, urls in parts:
        found, letters = [], 0
        for i, (p, u) in enumerate(zip(pages, urls, strict=True), 1):
            found.append(made(p, None if pd.isna(u) else u))
            letters += len(p or "")
            if letters >= CHUNK or i == len(pages):
                yield pd.DataFrame({c: pd.Series([x[c] for x in found], dtype=object) for c in ("pieces", "elements")})
                found, letters = [], 0


def located_udf(page: Column | str, url: Column | str | None = None, selectors: dict[str, str] | None = None, names: tuple[str, ...] = (), every: str | None = None, only: tuple[str, ...] = ()) -> Column:
    """`located` in tasks, a few pages at a time, however many an Arrow batch brings; `only` names the parts of elements that are needed, without them all are given."""
    shape = {k: kind for k, kind in re.findall(r"(\w+):(\w+(?:<.*?>)?)", _SHAPE) if not only or k in only}

    def made(p: str | None, u: str | None) -> dict:
        found = located(p, u, selectors, names, every)
        return found if not only else {"pieces": [], "elements": [{k: x[k] for k in shape} for x in found["elements"]]}

    def batches(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return framed(parts, made)

    kinds = ",".join(f"{k}:{kind}" for k, kind in shape.items())
    return F.pandas_udf(batches, f"pieces:array<string>,elements:array<struct<{kinds}>>")(page, F.lit(None).cast("string") if url is None else url)


def _sum(points: list[tuple[Column, int]]) -> Column:
    """Points in hundredths for what holds; nulls add nothing."""
    return reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for c, p in points])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What body makes of a value that is computed once a row, however often body uses it; null for a null."""
    return F.get(F.transform(F.filter(F.array(value), lambda x: x.isNotNull()), body), 0)


def _has(where: Column, pattern: str) -> Column:
    return where.rlike(pattern)


def _inside(x: Column, top: Column) -> Column:
    return (x["at"] > top["at"]) & (x["at"] <= top["last"])


def field_text(pieces: Column, x: Column) -> Column:
    """An element's text as a record's field holds it: a line a block, list items behind a mark, at most one empty line; nothing of silent elements."""
    marks = f"[{MARKS}]"
    s = F.array_join(F.slice(pieces, x["from"] + 1, F.greatest(x["to"] - x["from"], F.lit(0))), "")
    for pattern, into in ((r"[^\S\n]+", " "), (r"\n{3,}", "\n\n"), (r" \n", "\n"), (r"\n ", "\n"), (rf"({marks})\n+(?=[^\s{MARKS}])", "$1 "), (r"^\s+|\s+$", "")):
        s = F.regexp_replace(s, pattern, into)
    return F.when(x["tag"].isin(*SILENT), "").otherwise(s)


def detected_items(pages: DataFrame, key: str, html: str, fields: dict[str, str], url: str | None = None) -> DataFrame:
    """Items of a page without a selector for them: key, item (from 0) and a map of fields.

    fields: a selector for each field, `selector@attr` for an attribute; only its first match counts, and
    `title` is needed. Going up from the title, the first element that has a sibling of its tag which holds
    the title's tag too is an item; all its siblings with its tag and classes are items. The fields inside
    the item, or in one of the three siblings behind it, are read at the same path of children from each
    item; fields elsewhere are the same for all. `<field>_href` is the nearest usable link of a field. The
    items' parent is found again by its id, or its tag and first three classes, as the first such element of
    the page. Items without any value drop out, their numbers stay.
    """
    parts = {f: how.partition("@") for f, how in fields.items()}
    names = tuple(sorted({attr for _, _, attr in parts.values() if attr}))
    rows = pages.select(F.col(key), located_udf(html, url, {f: sel for f, (sel, _, _) in parts.items()}, names).alias("_p"))
    e, pieces = F.col("_p.elements"), F.col("_p.pieces")
    node = lambda k: F.get(e, k)
    marked = lambda f: F.get(F.filter(e, lambda x: F.array_contains(x["marks"], f)), 0)
    kind = "array<struct<item:int,fields:map<string,string>>>"

    def level_of(title: Column) -> Column:
        """How many ancestors the item has: the title's deepest ancestor below the body with a sibling like it."""
        heads = F.filter(e, lambda x: x["tag"] == title["tag"])

        def alike(k: Column) -> Column:
            peers = F.filter(heads, lambda h: (F.size(h["up"]) > k) & F.get(h["up"], k - 1).eqNullSafe(F.get(title["up"], k - 1)))
            return F.size(F.array_distinct(F.filter(F.transform(peers, lambda h: F.get(h["up"], k)), lambda n: node(n)["tag"] == node(F.get(title["up"], k))["tag"])))

        levels = F.filter(F.sequence(F.lit(0), F.size(title["up"]) - 1), lambda k: ~node(F.get(title["up"], k))["tag"].isin("html", "body") & (alike(k) >= 2))
        return F.array_max(F.when(F.size(title["up"]) > 0, levels))

    def items_at(item: Column, parent: Column) -> Column:
        """The items and, for each field, where it is found: offset among the siblings behind (0: inside, null: elsewhere) and path of children (null: nowhere)."""
        like = F.when(parent["id"] != "", F.filter(e, lambda x: x["id"] == parent["id"])).otherwise(F.filter(e, lambda x: (x["tag"] == parent["tag"]) & (F.size(F.array_except(F.slice(parent["classes"], 1, 3), x["classes"])) == 0)))
        return let(F.get(like, 0), lambda again: let(F.struct(*[place(marked(f), item, parent).alias(f"f{i}") for i, f in enumerate(fields)]), lambda places: read(again, item, places)))

    def place(found: Column, item: Column, parent: Column) -> Column:
        def placed(x: Column) -> Column:
            peer = lambda o: node(F.get(parent["kids"], item["nth"] + o))
            offset = F.get(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda o: (peer(o)["at"] == x["at"]) | _inside(x, peer(o))), 0)
            near = let(offset, lambda o: F.struct(x.alias("first"), o.alias("offset"), F.when(peer(o)["at"] != x["at"], below(x, peer(o))).alias("path")))
            return F.coalesce(near, F.struct(x.alias("first"), F.lit(None).cast("int").alias("offset"), F.lit(None).cast("array<int>").alias("path")))

        return let(found, placed)

    def below(x: Column, top: Column) -> Column:
        """The places of children that lead from one element down to another."""
        chain = F.concat(F.slice(x["up"], F.size(top["up"]) + 2, F.size(x["up"])), F.array(x["at"]))
        return F.transform(chain, lambda k: node(k)["nth"])

    def read(again: Column, item: Column, places: Column) -> Column:
        fits = lambda x: (x["tag"] == item["tag"]) & (F.size(F.array_except(item["classes"], x["classes"])) == 0)
        own = F.filter(again["kids"], lambda k: fits(node(k)))
        made = F.transform(own, lambda k, i: F.struct(i.alias("item"), record(again, node(k), places).alias("fields")).cast(kind[6:-1]))
        return F.filter(made, lambda r: F.exists(F.map_values(r["fields"]), lambda v: F.length(v) > 0))

    def record(again: Column, mine: Column, places: Column) -> Column:
        entries = []
        for i, f in enumerate(fields):
            at, attr = places[f"f{i}"], parts[f][2]
            value = lambda y: F.coalesce(F.try_element_at(y["values"], F.lit(attr)), F.lit("")) if attr else field_text(pieces, y)  # noqa: B023, E731
            start = F.get(again["kids"], mine["nth"] + at["offset"])
            end = F.aggregate(at["path"], start, lambda a, k: F.get(node(a)["kids"], k))
            local = F.transform(F.array(node(end)), lambda y: F.array(F.coalesce(value(y), F.lit("")), y["link"]))  # noqa: B023
            both = F.when(at["path"].isNotNull(), F.get(local, 0)).when(at["first"].isNotNull() & at["offset"].isNull(), F.array(value(at["first"]), F.lit(None).cast("string")))
            entries.append(F.transform(F.array(both), lambda b: F.array(F.struct(F.lit(f).alias("k"), F.get(b, 0).alias("v")), F.struct(F.lit(f"{f}_href").alias("k"), F.get(b, 1).alias("v")))))  # noqa: B023
        return F.map_from_entries(F.filter(F.flatten(F.concat(*entries)), lambda x: x["v"].isNotNull()))

    def found(title: Column) -> Column:
        item = lambda k: let(node(F.get(title["up"], k)), lambda x: let(node(F.get(title["up"], k - 1)), lambda up: items_at(x, up)))
        return let(level_of(title), item)

    rows = rows.select(key, F.explode_outer(let(marked("title"), found)).alias("_r"))  # the outer form: no filter that finds the items once more
    return rows.where(F.col("_r").isNotNull()).select(key, "_r.item", "_r.fields")


def _word(options: str) -> str:
    """A pattern for whole words in either case; letters beyond ASCII end a word."""
    return rf"(?i)(?<![A-Za-z0-9_])({options})(?![A-Za-z0-9_])"


# Names and words that give a field away, as patterns; places, pay and their words in running text.
HINTS = {
    "title": r"(?i)title|job[-_]?name|position[-_]?name|job[-_]?title",
    "company": r"(?i)company|employer|org|firm|business|corp",
    "location": r"(?i)location|city|area|address|region|place",
    "salary": r"(?i)salary|pay|wage|compensation|price|cost",
    "description": r"(?i)description|summary|details|about|excerpt|overview",
}
LOCAL_HINTS = {"company": "חברה|מעסיק", "location": "מיקום|אזור|עיר", "salary": "שכר|משכורת|שכירה", "description": "תיאור|פירוט"}
LABELS = {
    "salary": r"(?i)salary|pay|compensation|wage|שכר|משכורת",
    "location": r"(?i)location|city|area|address|region|place|מיקום|אזור|עיר",
    "job_title": r"(?i)title|position[-_]?name|job[-_]?name|job[-_]?title|role|תפקיד|משרה",
    "company_name": r"(?i)company|employer|organization|org[-_]?name|firm|business|corp|חברה|מעסיק|ארגון",
    "description": r"(?i)description|summary|details|about|excerpt|overview|תיאור|פירוט",
}
TOWNS = ["תל אביב", "ירושלים", "חיפה", "באר שבע", "רמת גן", "פתח תקווה", "נתניה", "הרצליה", "ראשון לציון", "אשדוד", "רחובות"]
MORE_TOWNS = ["כפר סבא", "רעננה", "הוד השרון", "מודיעין"]
COINS = "[₪$€£]"
COIN_WORDS = _word(r"nis|ils|shekel")
PAY_WORDS = 'ש"ח|שקל|משכורת|שכר'
SUMS, THOUSANDS = r"\d{1,3}([,.]\d{3})+\s*[-–]\s*\d{1,3}([,.]\d{3})+", r"\d+[kK]\s*[-–]\s*\d+[kK]"
SPOTS = _word(r"tel\s*aviv|jerusalem|haifa|israel|remote|hybrid")
MORE_SPOTS = _word(r"tel\s*aviv|jerusalem|haifa|israel|remote|hybrid|new york|london|san francisco|berlin")
AWAY_SPOTS = _word(r"tel\s*aviv|jerusalem|haifa|remote|hybrid")
#: Elements of an item that are looked at, and blocks of a page that are kept.
MOST_ELEMENTS, MOST_BLOCKS = 51, 100
SHOWN, SHORT = 200, 100


def _pay(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [_has(text, p) for p in (COINS, COIN_WORDS, PAY_WORDS, SUMS, THOUSANDS)])


def _place(text: Column) -> Column:
    return _has(text, SPOTS) | _has(text, "|".join([*TOWNS, "מיקום", "אזור"]))


def field_points(field: str, x: Column) -> Column:
    """Hundredths that speak for an element as a field: names it bears, its kind, its text's length and words; null names count as none."""
    text, size, head, link = F.substring(x["text"], 1, SHOWN), x["size"], x["tag"].isin(HEADINGS), x["tag"] == "a"
    named = [(_has(x["hints"], HINTS[field]), {"title": 35}.get(field, 40)), *([(_has(x["hints"], LOCAL_HINTS[field]), {"description": 30}.get(field, 35))] if field in LOCAL_HINTS else [])]
    said = {
        "title": lambda: [(head, 35), (link & (size > 5), 25), (size.between(11, 99), 5), (size > 200, -20), (size < 5, -30)],
        "company": lambda: [(~head & ~link & (size < 60), 5), (size > 150, -20), (_pay(text), -40), (_place(text), -30)],
        "location": lambda: [(_place(text), 30), (x["before"].isin(ICONS), 10), (size.between(3, 59), 5), (size > 150, -20), (_pay(text), -40)],
        "salary": lambda: [(_pay(text), 40), (size.between(4, 39), 5), (size > 100, -15)],
        "description": lambda: [(size > 80, 25), (x["tag"] == "p", 15), (size.between(41, 499), 10), (size < 20, -30)],
    }[field]()
    return _sum([*named, *said])


#: Points that a field's element needs more of than this.
LEAST = {"title": 10, "company": 10, "location": 10, "salary": 15, "description": 10}


_FOUND = "struct<field:string,at:int,sample:string,confidence:double>"


def field_elements(e: Column, item: Column) -> Column:
    """An element of an item for each field, in the order of LEAST: field, at, sample, confidence (0 to 1).

    It is the element with the most points, of equal ones the first; what a field has taken
    is out for the next. Looked at are the first 51 elements that hold text beyond what
    one of their children says alone. All points are counted in one pass; a fold over
    the fields carries them along with what is taken.
    """
    fit = lambda x: _inside(x, item) & (x["size"] > 0) & ~x["repeats"] & ~x["tag"].isin(*SILENT, "svg", "iframe")
    looked = F.slice(F.filter(e, fit), 1, MOST_ELEMENTS)
    pointed = F.transform(looked, lambda x: F.struct(F.array(*[field_points(f, x) for f in LEAST]).alias("points"), x["at"].alias("at"), x["text"].alias("text")))
    fields = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("field"), F.lit(n).alias("least"), F.lit(150 if f == "description" else SHORT).alias("most")) for i, (f, n) in enumerate(LEAST.items())])
    start = F.struct(pointed.alias("left"), F.array().cast(f"array<{_FOUND}>").alias("found"))

    def step(state: Column, f: Column) -> Column:
        fits = F.filter(state["left"], lambda s: (F.get(s["points"], f["i"]) > f["least"]) & ~F.exists(state["found"], lambda g: g["at"] == s["at"]))
        best = F.array_max(F.transform(fits, lambda s: F.struct(F.get(s["points"], f["i"]).alias("points"), (-s["at"]).alias("place"), s["text"].alias("text"))))
        made = F.transform(F.array_compact(F.array(best)), lambda b: F.struct(f["field"].alias("field"), (-b["place"]).alias("at"), F.substring(b["text"], F.lit(1), f["most"]).alias("sample"), (F.least(b["points"], F.lit(100)) / 100).alias("confidence")).cast(_FOUND))
        return F.struct(state["left"].alias("left"), F.concat(state["found"], made).alias("found"))

    return F.aggregate(fields, start, step, lambda state: state["found"])


def page_fields(pages: DataFrame, key: str, html: str, item: str) -> DataFrame:
    """For each page the fields' elements within the first match of a selector; pages without it drop out."""
    rows = pages.select(key, located_udf(html, None, {"item": item})["elements"].alias("_e"))
    first = F.get(F.filter("_e", lambda x: F.array_contains(x["marks"], "item")), 0)
    rows = rows.select(key, F.explode_outer(let(first, lambda x: field_elements(F.col("_e"), x))).alias("_f"))
    return rows.where(F.col("_f").isNotNull()).select(key, "_f.*")


def block_points(x: Column) -> Column:
    """Hundredths that speak for an element as pay, place, title, company and description."""
    text, size, label, head = x["text"], x["size"], x["label"], x["tag"].isin(HEADINGS)
    coins = _has(text, COINS)
    return F.struct(
        _sum([(_has(label, LABELS["salary"]), 50), (coins, 40), (_has(text, COIN_WORDS), 35), (_has(text, PAY_WORDS), 35), (_has(text, SUMS), 25), (_has(text, THOUSANDS), 25)]).alias("pay"),
        _sum([(_has(label, LABELS["location"]), 45), (_has(text, MORE_SPOTS), 40), (_has(text, "|".join([*TOWNS, *MORE_TOWNS])), 40), (_has(text, "היברידי|מרחוק"), 30), (x["before"].isin(ICONS), 10)]).alias("place"),
        _sum([(_has(label, LABELS["job_title"]), 40), (head, 30), ((x["tag"] == "a") & size.between(6, 79), 25), (size.between(5, 80) & ~coins, 10), (size > 200, -20), (size < 5, -30)]).alias("title"),
        _sum([(_has(label, LABELS["company_name"]), 45), (size.between(3, 60), 10), (~head, 5), (size > 150, -20), (coins, -30), (_has(text, AWAY_SPOTS), -20)]).alias("company"),
        _sum([(_has(label, LABELS["description"]), 40), (size > 80, 25), (x["tag"] == "p", 15), (size.between(41, 500), 10), (size < 20, -30)]).alias("about"),
    )


def block_class(points: Column, size: Column) -> Column:
    """Class and hundredths of the first of pay, place, title, company and description with points enough and a text of its length; null for none."""
    made = lambda name, n: F.struct(F.lit(name).alias("class"), F.least(n, F.lit(100)).alias("points"))
    pay, place, title, company, about = (points[c] for c in ("pay", "place", "title", "company", "about"))
    return (
        F.when(pay >= 35, made("salary", pay))
        .when((place >= 35) & (size < 80), made("location", place))
        .when((title >= 30) & size.between(5, 150), made("job_title", title))
        .when((company >= 25) & size.between(2, 100), made("company_name", company))
        .when((about >= 25) & (size >= 30), made("description", about))
    )


def block_classes(e: Column) -> Column:
    """The first 100 blocks of a page that have a class: at, c (class and points), text (200 characters). Blocks hold 1 to 500 characters beyond what one child says alone."""
    fit = F.filter(e, lambda x: x["tag"].isin(JUDGED) & x["size"].between(1, 500) & ~x["repeats"])
    judged = F.transform(fit, lambda x: F.struct(x["at"].alias("at"), block_points(x).alias("p"), x["size"].alias("size"), F.substring(x["text"], 1, SHOWN).alias("text")))
    classed = F.transform(judged, lambda b: F.struct(b["at"].alias("at"), block_class(b["p"], b["size"]).alias("c"), b["text"].alias("text")))
    return F.slice(F.filter(classed, lambda b: b["c"].isNotNull()), 1, MOST_BLOCKS)


def page_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A page's classified blocks; `chosen` marks the best of each class, the first of equal ones: each block has one class, each class one block."""
    rows = pages.select(key, block_classes(located_udf(html, only=("at", "tag", "text", "size", "repeats", "label", "before"))["elements"]).alias("_b"))
    kind = "struct<class:string,points:int,at:int>"
    start = F.array().cast(f"array<{kind}>")

    def better(best: Column, b: Column) -> Column:
        mine = F.struct(b["c"]["class"].alias("class"), b["c"]["points"].alias("points"), b["at"].alias("at")).cast(kind)
        beaten = F.exists(best, lambda x: (x["class"] == mine["class"]) & (x["points"] >= mine["points"]))
        return F.when(beaten, best).otherwise(F.concat(F.filter(best, lambda x: x["class"] != mine["class"]), F.array(mine)))

    best = F.aggregate("_b", start, better, lambda s: F.transform(s, lambda x: x["at"]))
    shown = rows.select(key, best.alias("_best"), F.inline("_b"))
    return shown.select(key, "at", F.col("c.class").alias("class"), (F.col("c.points") / 100).alias("confidence"), F.substring("text", 1, SHORT).alias("sample"), F.array_contains("_best", F.col("at")).alias("chosen"))


def sample_blocks(pages: DataFrame, key: str, html: str, selector: str | None = None, most: int = 6, letters: int = 5000) -> DataFrame:
    """Source of up to `most` items, cut to `letters` characters each: of what the selector matches, or where that is nothing, of
    the first element inside the body with 3 to 50 children like its first one (tag and first three classes). `matched` counts what
    the selector fits (in the other case, the samples). Pages without either drop out.
    """
    e = F.col("_p.elements")
    rows = pages.select(key, F.col(html).alias("_h"), located_udf(html, every=selector).alias("_p"))
    hits = F.transform(F.filter(e, lambda x: F.array_contains(x["marks"], "")), lambda x: x["at"])
    sign = lambda x: F.concat_ws("|", x["tag"], F.array_join(F.array_sort(F.slice(x["classes"], 1, 3)), "."))
    alike = lambda kids: let(sign(F.get(e, F.get(kids, 0))), lambda first: F.filter(kids, lambda k: sign(F.get(e, k)) == first))
    inside = lambda x: F.exists(x["up"], lambda k: F.get(e, k)["tag"] == "body")
    groups = F.transform(F.filter(e, lambda x: (F.size(x["kids"]) >= 3) & inside(x)), lambda x: alike(x["kids"]))
    group = F.slice(F.get(F.filter(groups, lambda g: F.size(g).between(3, 50)), 0), 1, most)
    chosen = let(hits, lambda h: F.when(F.size(h) > 0, F.struct(F.size(h).alias("matched"), F.slice(h, 1, most).alias("at"))).otherwise(let(group, lambda g: F.struct(F.size(g).alias("matched"), g.alias("at")))))
    piece = lambda x: F.col("_h").substr(x["begin"] + 1, F.least(x["end"] - x["begin"], F.lit(letters)))
    samples = let(chosen, lambda c: F.transform(c["at"], lambda k, i: F.struct(c["matched"].alias("matched"), i.alias("item"), piece(F.get(e, k)).alias("sample"))))
    rows = rows.select(key, F.explode_outer(samples).alias("_s"))
    return rows.where(F.col("_s").isNotNull()).select(key, "_s.*")
