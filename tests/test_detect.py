"""Item detection, fields, blocks and samples against plain walks of the tree, on made and on given pages."""

import os
import random
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import detect
from sparkloom.operators.pages import Node, parse, select

SF = "/root/testdata/sf0.001"
WORDS = ["Nurse", "Driver in Haifa", "$100 a day", "10k - 20k", "Acme Corp", "remote", "Pay", "שכר", "תל אביב", "x", "", "a long text about the work that goes on and on until it is longer than eighty letters, at last", "é" * 260]


def made(rng, depth=0):
    """Markup with unclosed items, attributes that name fields, empty and repeated elements."""
    tag = rng.choice(["div", "div", "span", "p", "h3", "ul", "li", "a", "i", "b", "td", "svg", "script"])
    attrs = rng.choice(["", "", ' class="card"', ' class="card hot"', ' class="company-name"', ' id="salary"', ' data-field="location"', ' aria-label="Title"', ' class="description x"', ' href="/job/1"', ' href="#top"'])
    inside = "".join(made(rng, depth + 1) if depth < 4 and rng.random() < 0.6 else rng.choice(WORDS) + rng.choice(["", " ", "\n", "<br>"]) for _ in range(rng.randrange(4)))
    return f"<{tag}{attrs}>{inside}" + (f"</{tag}>" if rng.random() < 0.9 else "")


def listing(rng):
    card = rng.choice(["<div class='card {k}'><h3>{t}</h3><span class='company'>{c}</span></div>", "<li><a href='/job/{k}'><h3>{t}</h3></a><p class='pay'>{c}</p>", "<article class='card'><div><h3>{t}</h3></div></article><section class='panel'><p>{c}</p><a href='x'>go</a></section>"])
    cards = "".join(card.format(k=rng.choice("ab"), t=rng.choice(WORDS), c=rng.choice(WORDS)) for _ in range(rng.randrange(5)))
    return f"<html><body>{rng.choice(['', '<div><h3>one</h3></div>'])}<{'ul' if '<li' in cards else 'div'} {rng.choice(['', 'id=list', 'class=\"list a b c\"'])}>{cards}</div><footer class='lead'>end</footer></body></html>"


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(4)
    out = [(i, f"<body>{''.join(made(rng) for _ in range(rng.randrange(1, 5)))}</body>") for i in range(150)] + [(200 + i, listing(rng)) for i in range(120)]
    out += [(400, None), (401, ""), (402, "no tags"), (403, "<h3>alone</h3>"), (404, "<ul>" + "<li><h3>deep</h3>" * 2000 + "</ul>"), (405, "<div>" * 300 + "x"), (405, "<p>again</p>")]
    if os.path.isdir(SF):
        import pyarrow.parquet as pq

        out += [(1000 + r["page_id"], r["html"]) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()[:60]]
    return out


@pytest.fixture(scope="module")
def table(spark, pages):
    return spark.createDataFrame([(*p, "http://h.x/a/b") for p in pages], "page_id int, html string, url string").withColumn("elements", F.lit(1)).repartition(4).cache()


def text(n: Node) -> str:
    return "".join(k if isinstance(k, str) else text(k) for k in n.kids)


def trimmed(n: Node) -> str:
    return text(n).strip()


def own(n: Node) -> list[Node]:
    return [k for k in n.kids if isinstance(k, Node)]


def shown(n: Node) -> str:
    def inner(x):
        out = ""
        for k in x.kids:
            if isinstance(k, str):
                out += k
            elif k.tag == "br":
                out += "\n"
            elif k.tag not in detect.CUT:
                s = inner(k)
                if k.tag == "li" and (first := trimmed(k)[:1]) and first not in detect.MARKS + "*-":
                    s = "• " + s
                out += s + ("\n" if k.tag in detect.BLOCKS else "")
        return out

    if n.tag in detect.SILENT:
        return ""
    s = re.sub(r"[^\S\n]+", " ", inner(n))
    s = re.sub(r"\n ", "\n", re.sub(r" \n", "\n", re.sub(r"\n{3,}", "\n\n", s)))
    return re.sub(rf"([{detect.MARKS}])\n+(?=[^\s{detect.MARKS}])", r"\1 ", s).strip()


def above(n):
    while n.parent and n.parent.tag:
        n = n.parent
        yield n


def link(n):
    a = n if n.tag == "a" else next((x for x in above(n) if x.tag == "a"), None) or next((x for x in n.walk() if x.tag == "a"), None)
    href = a.attrs.get("href", "") if a else ""
    return urljoin("http://h.x/a/b", href) if href and not href.startswith(("#", "javascript:")) else None


def items(page, fields):
    root = parse(page)
    first = {f: min(hits, key=list(root.walk()).index) for f, s in fields.items() if (hits := select(root, s.partition("@")[0]))}
    if "title" not in first:
        return []
    title = first["title"]
    item = None
    for a in above(title):
        if a.tag == "body" or not a.parent.tag:
            break
        if sum(k.tag == a.tag and any(x.tag == title.tag for x in k.walk()) for k in own(a.parent)) >= 2:
            item = a
            break
    if item is None or item.tag == "html":
        return []
    up = item.parent
    for n in root.walk():
        same = n.attrs.get("id") == up.attrs["id"] if up.attrs.get("id") else n.tag == up.tag and set(up.attrs.get("class", "").split()[:3]) <= set(n.attrs.get("class", "").split())
        if same:
            again = n
            break
    fits = [k for k in own(again) if k.tag == item.tag and set(item.attrs.get("class", "").split()) <= set(k.attrs.get("class", "").split())]

    def path(top, n):
        out = []
        while n is not top:
            out.insert(0, own(n.parent).index(n))
            n = n.parent
        return out

    value = lambda n, f: n.attrs.get(fields[f].partition("@")[2], "").strip() if "@" in fields[f] else shown(n)
    inside = lambda n, top: n is top or top in above(n)
    out = []
    for number, it in enumerate(fits):
        row = {}
        for f, n in first.items():
            peers = own(item.parent)
            place = next((o for o in range(4) if peers.index(item) + o < len(peers) and inside(n, peers[peers.index(item) + o])), None)
            if place is None:
                row[f] = value(n, f)
                continue
            top = peers[peers.index(item) + place]
            if top is n:
                continue
            mine = own(again)
            at = mine.index(it) + place
            node = mine[at] if at < len(mine) else None
            for k in path(top, n):
                node = own(node)[k] if node is not None and k < len(own(node)) else None
            row[f] = "" if node is None else value(node, f)
            if node is not None and link(node) is not None:
                row[f"{f}_href"] = link(node)
        if any(row.values()):
            out.append((number, row))
    return out


@pytest.mark.parametrize("fields", [{"title": "h3", "company": ".company", "pay": ".panel p", "lead": ".lead", "id": "h3@id"}, {"pay": "p", "title": "li a", "cls": "div@class"}])
def test_detected_items(table, pages, fields):
    got = sorted(((r["page_id"], r["item"], sorted(r["fields"].items())) for r in detect.detected_items(table, "page_id", "html", fields, "url").collect()))
    want = sorted((i, n, sorted(row.items())) for i, p in pages if i != 404 for n, row in items(p, fields))
    assert [g for g in got if g[0] != 404] == want and len(want) > 40
    assert detect.detected_items(table.limit(0), "page_id", "html", fields).count() == 0


def judged(n):
    t = trimmed(n)
    return t and not any(trimmed(k) == t for k in own(n))


def near(nodes, n):
    a, up = n.attrs, n.parent
    named = lambda x, *names: [x.attrs[k].lower() for k in names if x.attrs.get(k)]
    data = lambda x: [s.lower() for k, v in x.attrs.items() if k.startswith("data-") and v for s in (k, v)]
    out = named(n, "aria-label")
    out += [text(x).lower() for x in nodes if a.get("aria-labelledby") and x.attrs.get("id") == a["aria-labelledby"]][:1]
    out += [text(x).lower() for x in nodes if a.get("id") and x.tag == "label" and x.attrs.get("for") == a["id"]][:1]
    place = own(up).index(n)
    if place and 0 < len(t := trimmed(own(up)[place - 1])) < 50:
        out.append(t.lower())
    out += [*named(up, "class", "id"), *data(up)] if up.tag else []
    hints = " ".join([*named(n, "class", "id", "aria-label", "role"), *data(n)])
    return " ".join([*out, *named(n, "class", "id")]), hints, own(up)[place - 1].tag if place else None


HEAD = re.compile("h[1-6]")
has = lambda s, p: re.search(p, s, re.ASCII) is not None
coins = lambda s: has(s, detect.COINS)


def paid(s):
    return coins(s) or has(s, detect.COIN_WORDS) or has(s, detect.PAY_WORDS) or has(s, detect.SUMS) or has(s, detect.THOUSANDS)


def located(s):
    return has(s, detect.SPOTS) or any(w in s for w in [*detect.TOWNS, "מיקום", "אזור"])


def fields_of(page):
    root = parse(page)
    nodes = list(root.walk())
    item = next((n for n in nodes if n.tag in ("article", "ul")), None)
    if item is None:
        return []
    looked = [n for n in item.walk() if judged(n) and n.tag not in detect.SILENT | {"svg", "iframe"}][:51]
    out, used = [], set()
    for field, least in (("title", 10), ("company", 10), ("location", 10), ("salary", 15), ("description", 10)):
        best, most = None, least
        for n in looked:
            if n in used:
                continue
            _, hints, old = near(nodes, n)
            t, size, head, a = trimmed(n)[:200], len(trimmed(n)), bool(HEAD.fullmatch(n.tag)), n.tag == "a"
            p = (35 if field == "title" else 40) * has(hints, detect.HINTS[field])
            p += (30 if field == "description" else 35) * (field != "title" and has(hints, detect.LOCAL_HINTS[field]))
            if field == "title":
                p += 35 * head + 25 * (a and size > 5) + 5 * (10 < size < 100) - 20 * (size > 200) - 30 * (size < 5)
            if field == "company":
                p += 5 * (not head and not a and size < 60) - 20 * (size > 150) - 40 * paid(t) - 30 * located(t)
            if field == "location":
                p += 30 * located(t) + 10 * (old in ("svg", "i", "img")) + 5 * (2 < size < 60) - 20 * (size > 150) - 40 * paid(t)
            if field == "salary":
                p += 40 * paid(t) + 5 * (3 < size < 40) - 15 * (size > 100)
            if field == "description":
                p += 25 * (size > 80) + 15 * (n.tag == "p") + 10 * (40 < size < 500) - 30 * (size < 20)
            if p > most:
                best, most = n, p
        if best is not None:
            used.add(best)
            out.append((field, nodes.index(best), trimmed(best)[: 150 if field == "description" else 100], min(most, 100) / 100))
    return out


def test_field_elements(table, pages):
    got = sorted((r["page_id"], r["field"], r["at"], r["sample"], r["confidence"]) for r in detect.page_fields(table, "page_id", "html", "article, ul").collect() if r["page_id"] != 404)
    want = sorted((i, *f) for i, p in pages if i != 404 for f in fields_of(p))
    assert got == want and {w[1] for w in want} == set(detect.LEAST)


def class_of(nodes, n):
    label, _, old = near(nodes, n)
    t, head = trimmed(n), bool(HEAD.fullmatch(n.tag))
    size = len(t)
    pay = 50 * has(label, detect.LABELS["salary"]) + 40 * coins(t) + 35 * has(t, detect.COIN_WORDS) + 35 * has(t, detect.PAY_WORDS) + 25 * has(t, detect.SUMS) + 25 * has(t, detect.THOUSANDS)
    if pay >= 35:
        return "salary", pay
    place = 45 * has(label, detect.LABELS["location"]) + 40 * has(t, detect.MORE_SPOTS) + 40 * any(w in t for w in [*detect.TOWNS, *detect.MORE_TOWNS]) + 30 * has(t, "היברידי|מרחוק") + 10 * (old in ("svg", "i", "img"))
    if place >= 35 and size < 80:
        return "location", place
    title = 40 * has(label, detect.LABELS["job_title"]) + 30 * head + 25 * (n.tag == "a" and 5 < size < 80) + 10 * (5 <= size <= 80 and not coins(t)) - 20 * (size > 200) - 30 * (size < 5)
    if title >= 30 and 5 <= size <= 150:
        return "job_title", title
    firm = 45 * has(label, detect.LABELS["company_name"]) + 10 * (3 <= size <= 60) + 5 * (not head) - 20 * (size > 150) - 30 * coins(t) - 20 * has(t, detect.AWAY_SPOTS)
    if firm >= 25 and 2 <= size <= 100:
        return "company_name", firm
    about = 40 * has(label, detect.LABELS["description"]) + 25 * (size > 80) + 15 * (n.tag == "p") + 10 * (40 < size <= 500) - 30 * (size < 20)
    return ("description", about) if about >= 25 and size >= 30 else None


def blocks_of(page):
    nodes = list(parse(page).walk())
    found = [(i, *c, trimmed(n)) for i, n in enumerate(nodes) if n.tag in detect.JUDGED and judged(n) and len(trimmed(n)) <= 500 and (c := class_of(nodes, n))][:100]
    best = {}
    for i, c, p, _ in found:
        if c not in best or min(p, 100) > best[c][0]:
            best[c] = (min(p, 100), i)
    return [(i, c, min(p, 100) / 100, t[:100], best[c][1] == i) for i, c, p, t in found]


def test_block_classes(table, pages):
    got = sorted((r["page_id"], r["at"], r["class"], r["confidence"], r["sample"], r["chosen"]) for r in detect.page_blocks(table, "page_id", "html").collect() if r["page_id"] != 404)
    want = sorted((i, *b) for i, p in pages if i != 404 for b in blocks_of(p))
    assert got == want and {w[2] for w in want} == set(detect.LABELS)


def test_sample_blocks(spark):
    page = "<body><nav><a>1</a></nav>\n<ul><li class='a b'>one<li class='b a'>two <b>x</b></li>\n<li class='b a c'>three</li><li class='a b'>four</ul><p>end</p></body>"
    df = spark.createDataFrame([(1, page), (2, "<ul><li>1<li>2<li>3</ul>"), (3, None), (4, "<body><div>" + "<i></i>" * 51 + "</div></body>"), (5, "<body>" + "<p>é</p>" * 9 + "</body>")], "k int, h string")
    got = [tuple(r) for r in detect.sample_blocks(df, "k", "h").orderBy("k", "item").collect()]
    assert got[:3] == [(1, 3, i, s) for i, s in enumerate(["<li class='a b'>one", "<li class='b a'>two <b>x</b></li>", "<li class='a b'>four"])] and len(got) == 3
    got = [tuple(r) for r in detect.sample_blocks(df, "k", "h", "p, li b", most=2, letters=6).orderBy("k", "item").collect()]
    assert got == [(1, 2, 0, "<b>x</"), (1, 2, 1, "<p>end"), (5, 9, 0, "<p>é</"), (5, 9, 1, "<p>é</")]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<ul>\n  <li>\n    <p>one</p>\n  </li>\n  <li>\n    <p>two</p>\n  </li>\n</ul>", "• one\n\n• two"),
        ("<ul><li>need- must</li><li>basic</li></ul>", "• need- must\n• basic"), ("<ul><li>• marked</li></ul>", "• marked"), ("<ul><li>\n  <div><p>deep</p></div>\n</li></ul>", "• deep"),
        ("<div>one<br>two</div>", "one\ntwo"), ("<div><p>a</p><p>b</p></div>", "a\nb"), ("<div>plain text</div>", "plain text"),
        ("<p>mail <a class='__cf_email__' data-cfemail='422102236c20'>[email]</a>!</p>", "mail c@a.b!"), ("<p>a<script>b</script><svg><text>c</text></svg>d</p>", "ad"),
    ],
)
def test_field_text(spark, html, want):
    df = spark.createDataFrame([(f"<div>{html}</div>",)], "h string").select(detect.located_udf("h").alias("p"))
    got = df.select(detect.field_text(F.col("p.pieces"), F.get("p.elements", F.lit(0)))).first()[0]
    assert re.sub(r"\n+", "\n", got) == re.sub(r"\n+", "\n", want)


def test_detected_items_query_of_cut_pages(spark, tmp_path):
    """A headline cut off within a reference keeps it as written, as in the query's SQL."""
    from sparkloom.plans import detect_catalog

    page = '<html><body><ul><li><a href="/a?x=1&copy=2">One&ltx</a></li><li><a href="/b">Two &amp; more</a></li></ul><h1>In &&&amp</h1></body></html>'
    spark.createDataFrame([(1, "https://a.com/", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = detect_catalog.detected_items(lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")).orderBy("item").collect()
    assert [tuple(r) for r in got] == [(1, 0, "One&ltx", "https://a.com/a?x=1&copy=2", "In &&&amp"), (1, 1, "Two & more", "https://a.com/b", "In &&&amp")]


def test_pages_go_back_in_chunks():
    """However many pages a batch brings, no more than a chunk and a page are held; null and empty pages keep their rows."""
    import pandas as pd

    rows = [None, "", *["<p>" + "x" * 999] * 2000, "<p>" + "y" * (2 * detect.CHUNK), None]
    sizes, held = [], []
    for frame in detect.framed(iter([(pd.Series(rows), pd.Series([None] * len(rows))), (pd.Series(["<b>z"]), pd.Series(["u"]))]), lambda p, u: held.append(p) or {"pieces": [], "elements": [p]}):
        sizes.append(len(frame))
        assert sum(len(x or "") for x in held[:-1]) < 2 * detect.CHUNK and [x[0] for x in frame["elements"]] == held
        held.clear()
    assert sum(sizes) == len(rows) + 1 and len(sizes) > 6


def test_blocks_take_only_the_parts_they_need(spark):
    df = spark.createDataFrame([(1, "<div><h1>Nurse wanted</h1><p>Location: Haifa</p></div>"), (2, None), (3, "")], "k int, h string")
    kind = df.select(detect.located_udf("h", only=("at", "tag", "values"))["elements"].alias("e")).schema["e"].dataType.simpleString()
    assert kind == "array<struct<at:int,tag:string,values:map<string,string>>>"
    blocks = detect.page_blocks(df, "k", "h")
    assert sorted((r.k, r.at, r["class"]) for r in blocks.collect() if r.at) == [(1, 1, "job_title"), (1, 2, "location")]
    assert "struct<at:int,last:int" not in blocks._jdf.queryExecution().analyzed().toString() and "begin" not in blocks._jdf.queryExecution().analyzed().toString()
