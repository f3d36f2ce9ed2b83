"""Page and payload operators: DOM text, forms, items by selector, JSON discovery, detectors.

Tree walks have no Column form; they run in Arrow batches on the standard parser.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that start a line, elements without an end tag.
LINES = frozenset("p div li ul ol br tr table section article h1 h2 h3 h4 h5 h6 header footer blockquote dt dd hr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Fixed values of the HTML standard: a start tag, what it ends where that is still open, and what it doesn't look beyond.
_CELLS, _ROWS = ("td", "th"), ("tr", "td", "th")
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "td": (_CELLS, ("tr", "table")), "th": (_CELLS, ("tr", "table")), "tr": (_ROWS, ("table",)), **dict.fromkeys(("thead", "tbody", "tfoot"), ((*_ROWS, "thead", "tbody", "tfoot"), ("table",))),
    **dict.fromkeys("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), (("p",), ("button", "table", "td", "th", "caption", "object", "template"))),
}
# What gives away the system behind a page, first match first.
VENDORS = [
    (r"myworkdayjobs\.com|workday\.com/staffing", "Workday"),
    (r"boards\.greenhouse\.io|embed\.greenhouse\.io|js\.greenhouse\.io|greenhouse-iframe", "Greenhouse"),
    (r"jobs\.lever\.co|lever-jobs-embed|jobs-app\.lever\.co", "Lever"),
    (r"jobs\.smartrecruiters\.com|api\.smartrecruiters\.com", "SmartRecruiters"),
    (r"apply\.workable\.com|workable-iframe|workable\.com/embed", "Workable"),
    (r"\.bamboohr\.com/(jobs|careers)", "BambooHR"),
    (r"jobs\.jobvite\.com|recruit\.jobvite\.com", "Jobvite"),
    (r"career\.successfactors\.com|successfactors\.eu|sapsf\.com", "SuccessFactors"),
    (r"taleo\.net", "Oracle Taleo"),
    (r"\.icims\.com", "iCIMS"),
    (r"workforcenow\.adp\.com", "ADP Recruiting"),
    (r"comeet\.co|comeet-job-iframe|comeet\.com/embed", "Comeet"),
    (r"breezy\.hr", "Breezy HR"),
    (r"personio\.com|personio\.de/embed", "Personio"),
    (r"teamtailor\.com", "Teamtailor"),
    (r"recruitee\.com", "Recruitee"),
    (r"ashbyhq\.com", "Ashby"),
    (r"wp-content/(plugins|themes|uploads)|wp-includes/", "WordPress"),
    (r"wix\.com/_partials|static\.wixstatic\.com|x-wix-", "Wix"),
    (r"squarespace\.com|sqsp\.net|squarespace-cdn\.com", "Squarespace"),
    (r"cdn\.shopify\.com|shopify\.theme", "Shopify"),
]
UNKNOWN_VENDOR = "Custom / unknown"


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs, [], parent

    def walk(self):
        """All elements below, in page order; no recursion, so depth is free."""
        todo = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [k for k in reversed(node.kids) if isinstance(k, Node)]

    def text(self) -> str:
        return " ".join("".join(_pieces(self)).split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        ends, within = IMPLIED.get(tag, ((), ()))
        up, top = self.at, None
        while ends and up.parent and up.tag not in within:
            top, up = (up if up.tag in ends else top), up.parent
        if top:
            self.leave(top)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.leave(node)

    def leave(self, node):
        """A node ends, and with it all that is open below."""
        self.at = node.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(page: str | None) -> Node:
    tree = _Tree()
    tree.feed(page or "")
    tree.close()
    return tree.root


def _pieces(node: Node):
    todo = list(reversed(node.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            yield k
        elif k.tag not in ("script", "style"):
            todo += reversed(k.kids)


def dom_text(page: str | None) -> str:
    """Visible text, a line for each block, list items after a bullet that isn't doubled."""
    out: list[str] = []
    todo: list[Node | str | None] = [*reversed(parse(page).kids)]  # None ends a block
    while todo:
        k = todo.pop()
        if k is None:
            out.append("\n")
        elif isinstance(k, str):
            out.append(re.sub(r"\s+", " ", k))
        elif k.tag not in ("script", "style", "noscript", "template"):
            if k.tag in LINES:
                out.append("\n")
                todo.append(None)
            if k.tag == "li":
                out.append("\x01")
            todo += reversed(k.kids)
    text = re.sub(r"\x01\s*[•●▪‣◦·]?\s*", "• ", "".join(out))
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in text.split("\n")]
    return "\n".join(x for x in lines if x and x != "•")


def forms(page: str | None) -> list[dict]:
    """Fields of all forms: form number, name, label, kind, required. A label is by `for`, around, placeholder, aria, name, the label before, kind; 100 characters at most."""
    root, out = parse(page), []
    by_for = {n.attrs["for"]: n.text() for n in root.walk() if n.tag == "label" and n.attrs.get("for")}
    before = {}
    for n in [root, *root.walk()]:
        own = [k for k in n.kids if isinstance(k, Node)]
        before.update((id(b), a.text()) for a, b in zip(own, own[1:]) if a.tag == "label")
    for i, form in enumerate(n for n in root.walk() if n.tag == "form"):
        for f in form.walk():
            kind = f.attrs.get("type", "").lower() or f.tag
            if f.tag not in ("input", "select", "textarea") or kind in ("hidden", "submit", "button"):
                continue
            around, up = "", f.parent
            while up and up is not form:
                around, up = (up.text() if up.tag == "label" else around), up.parent
            spoken = re.sub(r"[_-]", " ", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", f.attrs.get("name", "")))
            label = next(x for x in (by_for.get(f.attrs.get("id", "")), around, f.attrs.get("placeholder"), f.attrs.get("aria-label"), spoken, before.get(id(f)), f"{kind} {f.tag}" if "type" in f.attrs else f.tag) if x and x.strip())
            out.append({"form": i, "name": f.attrs.get("name", ""), "label": label.strip()[:100], "kind": kind, "required": "required" in f.attrs})
    return out


def _matches(n: Node, part: str) -> bool:
    tag = re.match(r"[A-Za-z][\w-]*", part)
    own = n.attrs.get("class", "").split()
    return (not tag or n.tag == tag[0].lower()) and all(c in own for c in re.findall(r"\.([\w-]+)", part)) and all(n.attrs.get("id") == i for i in re.findall(r"#([\w-]+)", part)) and all((k in n.attrs and (not eq or n.attrs[k] == v.strip("\"'"))) for k, eq, v in re.findall(r"\[([\w-]+)(=?)([^\]]*)\]", part))


def select(root: Node, selector: str) -> list[Node]:
    """Nodes by tag, class, id and attribute selectors, joined by descent; commas give alternatives."""
    out: list[Node] = []
    for one in selector.split(","):
        found = [root]
        for part in one.split():
            found = list(dict.fromkeys(k for n in found for k in n.walk() if _matches(k, part)))
        out += found
    return list(dict.fromkeys(out))


def items(page: str | None, container: str, fields: dict[str, str]) -> list[dict[str, str]]:
    """A map of fields for each item: `selector` gives text, `selector@attr` an attribute."""
    out = []
    for n in select(parse(page), container):
        row = {}
        for name, how in fields.items():
            selector, _, attr = how.partition("@")
            hit = next(iter(select(n, selector)), None)
            row[name] = "" if hit is None else (hit.attrs.get(attr, "").strip() if attr else hit.text())
        out.append(row)
    return out


def arrays(payload: str | None, depth: int = 5) -> list[dict]:
    """Arrays of objects in a JSON payload, down to a depth: path, size and keys of the first object."""
    out: list[dict] = []

    def visit(x, path: str, left: int) -> None:
        if isinstance(x, list) and x and all(isinstance(i, dict) for i in x):
            out.append({"path": path, "n": len(x), "keys": sorted(x[0])})
        if left:
            inner, at = (x[0], f"{path}[*]") if isinstance(x, list) and x else (x, path)  # an array is known by its first object
            for k, v in inner.items() if isinstance(inner, dict) else []:
                visit(v, f"{at}.{k}", left - 1)

    try:
        visit(json.loads(payload or ""), "$", depth)
    except ValueError:
        pass
    return out


def closed_references(page: Column) -> Column:
    """The page with `&` escaped where no semicolon ends a reference, so that only closed references are decoded: a page cut off within one keeps it as written."""
    return F.regexp_replace(page, r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;")


def _each(function, kind: str, column: Column | str) -> Column:
    """A function of one value over a column, in Arrow batches."""

    def batch(values: pd.Series) -> pd.Series:
        return values.map(function)

    return F.pandas_udf(batch, kind)(column)


def dom_text_udf(page: Column | str) -> Column:
    return _each(dom_text, "string", page)


def forms_udf(page: Column | str) -> Column:
    return _each(forms, "array<struct<form:int,name:string,label:string,kind:string,required:boolean>>", page)


def arrays_udf(payload: Column | str) -> Column:
    return _each(arrays, "array<struct<path:string,n:int,keys:array<string>>>", payload)


def items_udf(container: str, fields: dict[str, str]):
    return lambda page: _each(lambda p: items(p, container, fields), "array<map<string,string>>", page)


def vendor(url: Column, page: Column) -> Column:
    low = F.lower(F.concat_ws("\n", url, page))
    return F.coalesce(*[F.when(low.rlike(p), n) for p, n in VENDORS], F.lit(UNKNOWN_VENDOR))


def structured_data(page: Column) -> Column:
    """Whether a block of linked data declares a job posting."""
    blocks = F.regexp_extract_all(page, F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    return F.when(F.exists(blocks, lambda x: x.rlike(r"(?i)@type[\"']?\s*:\s*[\"']?JobPosting")), "JobPosting JSON-LD").otherwise("none")


def pagination(page: Column) -> Column:
    return (
        F.when(page.rlike(r"(?i)\b(load[\s-]?more|show[\s-]?more|view[\s-]?more)\b|(טען|הצג|טעינת)[\s-]?עוד"), "load-more-button")
        .when(page.rlike(r"(?i)class=[\"'][^\"']*\b(pagination|page-numbers|paginator|pager)\b|<nav[^>]+(aria-label|class)=[\"'][^\"']*pag"), "numbered")
        .when(page.rlike(r"(?i)IntersectionObserver|infinite[\s-]?scroll|data-infinite"), "infinite-scroll")
        .otherwise("unknown")
    )


def page_language(page: Column) -> Column:
    lang, direction = (F.lower(F.regexp_extract(page, rf"(?i)<html[^>]+{a}=[\"']([^\"']+)[\"']", 1)) for a in ("lang", "dir"))
    return F.when(lang.startswith("he") | (direction == "rtl"), "he-IL").when(lang.startswith("en"), "en").when(lang == "", "unknown").otherwise(lang)


def needs_login(url: Column, page: Column) -> Column:
    """A login wall: by address, a password field, or a phrase."""
    return F.when(url.rlike(r"(?i)/(login|signin|sign-in)(/|\?|$)"), "url").when(page.rlike(r"(?i)<input[^>]+type=[\"']?password"), "password").when(page.rlike(r"(?i)(log|sign) ?in to (continue|apply|view)|יש להתחבר"), "phrase")
