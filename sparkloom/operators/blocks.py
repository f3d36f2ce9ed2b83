"""What a page is built of: element rows, repeated siblings and their scores, page and link scores, selectors.

`elements` makes a row of each element of a page; counting and scoring are DataFrame work.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.pages import Node, _each, parse

# Words of record pages, in titles, in groups of siblings and in running text; paths of records; places of furniture.
TITLE_WORDS = ["jobs", "careers", "positions", "vacancies", "openings", "hiring", "משרות", "דרושים", "קריירה"]
GROUP_WORDS = ["job", "position", "career", "vacancy", "opening", "role", "hiring", "משרה", "עבודה", "תפקיד", "חברה"]
TEXT_WORDS = ["job", "position", "career", "vacancy", "opening", "role", "hiring", "apply", "משרה", "תפקיד", "דרושים", "מועמדות"]
DETAIL_PATH = "(?i)/(jobs?|positions?|careers?|vacancies?|openings?|משרה|משרות)/"
FURNITURE = ["nav", "footer", "header", "menu", "breadcrumb"]
CONTAINERS = ["div", "ul", "ol", "section", "main", "tbody", "article"]
# Class names and ids that a build or a record makes, so they don't last.
MADE_CLASS = r"^[a-z]{1,3}-[a-zA-Z0-9]{5,}$|^css-[a-zA-Z0-9]+$|^[A-Z][a-zA-Z]+__[a-zA-Z]+-[a-zA-Z0-9]+$"
MADE_ID = r"(?i:^:r|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})|(^|[-_:.])\d+([-_:.]|$)|\d([^-_:.\d]*\d){3}|^.{41}"

_ELEMENT = "at:int,parent:int,tag:string,classes:array<string>,within:string,kids:int,links:int,heads:int,size:int,said:boolean,href:string,text:string,near:int,beside:int"


HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
ITEMS = ("li", "tr", "article")


def _nearest(nodes: list[Node], tags: tuple[str, ...]) -> dict[int, Node | None]:
    """For each node, known by its id(), itself or the nearest node above of these tags; nodes come in page order."""
    found: dict[int, Node | None] = {}
    for n in nodes:
        found[id(n)] = n if n.tag in tags else found.get(id(n.parent))
    return found


def elements(page: str | None) -> list[dict]:
    """An element a row, in page order: its parent's number (-1: none), classes, tag and classes of the parent, and of all below it the
    links, headings, letters (white space as one space) and whether a group word is said; links and headings have a text
    (what is nearest to them), links what surrounds them: links below the grandparent, children of the nearest item.
    """
    nodes = list(parse(page).walk())
    at = {id(n): i for i, n in enumerate(nodes)}
    rows, texts = [], {}
    link, named, item = _nearest(nodes, ("a",)), _nearest(nodes, (*HEADS, "title")), _nearest(nodes, (*ITEMS, "div"))
    for n in nodes:
        own = [" ".join(k.split()) for k in n.kids if isinstance(k, str) and k.strip()]
        hidden, low = n.tag in ("script", "style"), " ".join(own).lower()
        for top in () if hidden else (link[id(n)], named[id(n)]):
            if top:
                texts.setdefault(id(top), []).extend(own)
        rows.append({
            "at": len(rows), "parent": at.get(id(n.parent), -1), "tag": n.tag, "classes": n.attrs.get("class", "").split(),
            "within": f"{n.parent.tag} {n.parent.attrs.get('class', '')}".lower() if n.parent else "", "kids": sum(isinstance(k, Node) for k in n.kids),
            "links": 0, "heads": 0, "size": 0 if hidden else sum(map(len, own)), "said": not hidden and any(w in low for w in GROUP_WORDS),
            "href": n.attrs.get("href") if n.tag == "a" else None,
        })
    for n, r in zip(reversed(nodes), reversed(rows)):
        r["text"] = " ".join(texts.get(id(n), [])) if n.tag in ("a", "title", *HEADS) else None
        if r["parent"] >= 0:
            up = rows[r["parent"]]
            up["links"] += r["links"] + (r["href"] is not None)
            up["heads"] += r["heads"] + (n.tag in HEADS)
            up["size"] += r["size"]
            up["said"] |= r["said"]
    for n, r in zip(nodes, rows):
        if r["href"] is not None:
            grand = rows[r["parent"]]["parent"] if r["parent"] >= 0 else -1
            around = item[id(n)]
            r["near"], r["beside"] = rows[grand]["links"] if grand >= 0 else 0, rows[at[id(around)]]["kids"] if around else 0
    return rows


def elements_udf(page: Column | str) -> Column:
    return _each(elements, f"array<struct<{_ELEMENT}>>", page)


def element_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    return pages.select(key, F.explode(elements_udf(html)).alias("_e")).select(key, "_e.*")


def signature(tag: Column, classes: Column) -> Column:
    """Tag and sorted classes, but for made ones."""
    return F.array_join(F.concat(F.array(tag), F.array_sort(F.filter(classes, lambda c: ~c.rlike(MADE_CLASS)))), ".")


def repeated_siblings(rows: DataFrame, page: str, least: int = 3, seen: int = 5) -> DataFrame:
    """Siblings of one signature inside a container, `least` at least: their number, the first one, and a score from the first `seen`.

    2 for three children each on average, 2 for a link, 1 for a heading, 1 for five siblings, 3 for a group word, 2 less in
    furniture, 1 less for under 20 letters each. One shuffle, by page, parent and signature.
    """
    key = [page, "parent", "signature"]
    r = rows.withColumn("signature", signature(F.col("tag"), F.col("classes"))).where(F.split("within", " ")[0].isin(CONTAINERS))
    r = r.withColumn("_early", F.row_number().over(Window.partitionBy(*key).orderBy("at")) <= seen)
    early = lambda c: F.when(F.col("_early"), c)
    furniture = reduce(lambda a, b: a | b, [F.substring_index("_in", " ", 1) == "nav", *[F.contains(F.expr("substring(_in, locate(' ', _in) + 1)"), F.lit(w)) for w in FURNITURE]])
    got = r.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("at").alias("first"), F.min("within").alias("_in"), F.avg(early(F.col("kids"))).alias("_kids"),
        F.bool_or(early((F.col("links") > 0))).alias("_links"), F.bool_or(early(F.col("heads") > 0)).alias("_heads"), F.bool_or(early(F.col("said"))).alias("_said"), F.avg(early(F.col("size"))).alias("_size"),
    )
    points = [(F.col("_kids") >= 3, 2), (F.col("_links"), 2), (F.col("_heads"), 1), (F.col("n") >= 5, 1), (F.col("_said"), 3), (furniture, -2), (F.col("_size") < 20, -1)]
    score = reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for c, p in points])
    return got.where(F.col("n") >= least).select(*key, "n", "first", score.alias("score"))


def page_likelihood(title: Column, headings: Column, repeated: Column, hrefs: Column, text: Column) -> Column:
    """From 0 to 1: a title word 0.2, each heading with one 0.15, repeated siblings 0.25, links to records 0.25 (three) or 0.1, text words 0.15 (ten) or 0.08 (five). Nulls add nothing."""
    said = lambda c: F.lower(c).rlike("|".join(TITLE_WORDS))
    links = F.size(F.filter(F.coalesce(hrefs, F.array()), lambda h: h.rlike(DETAIL_PATH)))
    words = F.regexp_count(F.lower(text), F.lit("|".join(TEXT_WORDS)))
    points = [
        F.when(said(title), 20), F.size(F.filter(F.coalesce(headings, F.array()), said)) * 15, F.when(repeated, 25),
        F.when(links >= 3, 25).when(links >= 1, 10), F.when(words >= 10, 15).when(words >= 5, 8),
    ]
    return F.least(F.lit(100), reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in points])) / 100


def detail_link_score(url: Column, words: Column, near: Column, beside: Column) -> Column:
    """3 for a record's path, 2 for a text of 5 to 80 letters, 2 for three links nearby, 1 for three elements beside it."""
    points = [(url.rlike(DETAIL_PATH), 3), (F.length(F.trim(words)).between(5, 80), 2), (near >= 3, 2), (beside >= 3, 1)]
    return reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for c, p in points])


def page_scores(pages: DataFrame, key: str, html: str, text: str) -> DataFrame:
    """Per page its likelihood and its best link to a record, ties to the first. All inside the page's row; no shuffle."""
    e = F.col("_e")
    named = lambda tags: F.transform(F.filter(e, lambda x: x.tag.isin(tags)), lambda x: x.text)
    inside = F.filter(e, lambda x: F.substring_index(x.within, " ", 1).isin(CONTAINERS[:-1]))
    signs = F.transform(inside, lambda x: F.concat_ws("|", x.parent.cast("string"), x.tag, F.array_join(F.array_sort(x.classes), ".")))
    ordered = F.array_sort(signs)
    repeated = F.exists(F.sequence(F.lit(0), F.greatest(F.size(ordered) - 3, F.lit(0))), lambda i: F.get(ordered, i) == F.get(ordered, i + 2))
    links = F.filter(e, lambda x: (x.href != "") & ~x.href.rlike("^(#|javascript:)"))
    scored = F.transform(links, lambda x: F.struct(detail_link_score(x.href, x.text, x.near, x.beside).alias("score"), (-x["at"]).alias("_at"), x.href.alias("url")))
    best = F.array_max(scored)
    rows = pages.select(key, F.col(text).alias("_t"), elements_udf(html).alias("_e"))
    likelihood = page_likelihood(F.array_join(named(["title"]), " "), named(["h1", "h2", "h3"]), F.coalesce(repeated, F.lit(False)), F.transform(links, lambda x: x.href), F.col("_t"))
    return rows.select(key, likelihood.alias("likelihood"), best["url"].alias("link"), best["score"].alias("link_score"))


def _fits(n: Node | None, parts: list[tuple]) -> bool:
    for tag, made, classes, nth in reversed(parts):
        if n is None or (tag and n.tag != tag) or (made and n.attrs.get("id") != made) or not set(classes) <= set(n.attrs.get("class", "").split()) or (nth and _nth(n)[0] != nth):
            return False
        n = n.parent
    return True


def _nth(n: Node) -> tuple[int, int]:
    """Number among siblings of its tag, and how many they are."""
    like = [k for k in n.parent.kids if isinstance(k, Node) and k.tag == n.tag]
    return next(i for i, k in enumerate(like, 1) if k is n), len(like)


def _shown(parts: list[tuple]) -> str:
    safe = lambda s: re.sub(r"([^\w-])", r"\\\1", s)
    return " > ".join((f"#{safe(made)}" if made else tag + "".join(f".{safe(c)}" for c in classes)) + (f":nth-of-type({nth})" if nth else "") for tag, made, classes, nth in parts)


def selector(n: Node, scope: Node, ids: bool = True) -> str:
    """A selector that fits this node alone among all below the scope: a lasting id, a data attribute, its classes, a path of up to five
    elements with two classes each, a path from the nearest ancestor with an id or classes, or places along the path.
    Without `ids` (records differ in them) only tags, classes and places count.
    """
    nodes = list(scope.walk())
    alone = lambda parts: sum(_fits(x, parts) for x in nodes) == 1
    own = lambda x, most=None: x.attrs.get("class", "").split()[:most]
    lasting = lambda x: ids and bool(x.attrs.get("id")) and not re.search(MADE_ID, x.attrs["id"]) and alone([("", x.attrs["id"], [], 0)])
    if lasting(n):
        return _shown([("", n.attrs["id"], [], 0)])
    for name, value in n.attrs.items() if ids else ():
        if name.startswith("data-") and sum(x.attrs.get(name) == value for x in nodes) == 1:
            escaped = value.replace("\\", "\\\\").replace('"', '\\"')
            return f'[{name}="{escaped}"]'
    if own(n) and alone([(n.tag, "", own(n), 0)]):
        return _shown([(n.tag, "", own(n), 0)])
    path, up = [], n
    while up is not scope and len(path) < 5:
        path.insert(0, (up.tag, "", own(up, 2), 0))
        if alone(path):
            return _shown(path)
        up = up.parent
    path, up = [], n
    while up is not scope:
        place, among = _nth(up)
        path.insert(0, (up.tag, "", own(up, 2), place if among > 1 else 0))
        up = up.parent
        if up is not scope and (own(up) or lasting(up)):
            whole = [("", up.attrs["id"], [], 0) if lasting(up) else (up.tag, "", own(up, 3), 0), *path]
            if alone(whole):
                return _shown(whole)
    return _shown(path)


def item_selector(n: Node, scope: Node) -> str | None:
    """Tag with as many of its classes, dropped from the end, as fit more than one node; null where none does."""
    nodes, classes = list(scope.walk()), n.attrs.get("class", "").split()
    for most in range(len(classes), 0, -1):
        parts = [(n.tag, "", classes[:most], 0)]
        if sum(_fits(x, parts) for x in nodes) > 1:
            return _shown(parts)
    return None


def picked(page: str | None, at: int | None) -> dict | None:
    """Selectors of the element with this number: alone on the page, alone within its nearest item (a list item, row or article), and of all like it; null without such an element."""
    root = parse(page)
    nodes = list(root.walk())
    if at is None or not 0 <= at < len(nodes):
        return None
    n = nodes[at]
    item = _nearest(nodes, ITEMS).get(id(n.parent)) or root
    return {"alone": selector(n, root), "in_item": selector(n, item, ids=False), "like": item_selector(n, root)}


def picked_udf(page: Column | str, at: Column | str) -> Column:
    def batch(pages: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        found = [picked(p, None if pd.isna(a) else int(a)) or {} for p, a in zip(pages, numbers)]
        return pd.DataFrame([[x.get(c) for c in ("alone", "in_item", "like")] for x in found], columns=["alone", "in_item", "like"], dtype=object)

    return F.pandas_udf(batch, "alone:string,in_item:string,like:string")(page, at)


def form_capture(form: Column, action: Column, method: Column, fields: Column) -> Column:
    """What a saved form gives: null without a selector and fields; the blob is null without fields."""
    blob = F.when(F.size(fields) > 0, F.to_json(F.struct(F.coalesce(action, F.lit("")).alias("actionUrl"), F.coalesce(F.nullif(method, F.lit("")), F.lit("GET")).alias("method"), fields.alias("fields"))))
    return F.when((F.length(form) > 0) | blob.isNotNull(), F.struct(F.coalesce(form, F.lit("")).alias("selector"), blob.alias("blob")))


def field_hits(items: Column, fields: list[str]) -> Column:
    """How many of a page's extracted items (maps) hold each field."""
    def hits(f):
        return F.size(F.filter(items, lambda x: F.length(F.trim(F.try_element_at(x, F.lit(f)))) > 0)).alias(f)

    return F.struct(*map(hits, fields))
