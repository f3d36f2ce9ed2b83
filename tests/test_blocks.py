"""Element rows, sibling groups, page and link scores, selectors, seeds: golden values and plain counting."""

from pyspark.sql import functions as F

from sparkloom.operators import blocks, pages
from sparkloom.sources import tables

CARD = '<li class="card css-a1b2"><h3><a href="/jobs/{0}">Driver {0} north</a></h3><span>Haifa</span><span class="pay">9000</span></li>'
PAGE = '<html><head><title>Open jobs</title></head><body><nav class="top"><a href="/">Home</a><a href="/x">X</a></nav><ul id="list" class="jobs">' + "".join(CARD.format(i) for i in range(6)) + '</ul><div id="job-77123"><p>a<p>b</div></body></html>'


def test_elements_of_odd_pages():
    assert blocks.elements(None) == [] and blocks.elements("") == [] and blocks.elements("plain") == []
    deep = blocks.elements("<div>" * 1500 + "<a href=/jobs/1>x</a>")
    assert len(deep) == 1501 and deep[0]["links"] == 1 and deep[-1]["text"] == "x" and deep[-1]["near"] == 1
    rows = blocks.elements(PAGE)
    link = next(r for r in rows if r["href"] == "/jobs/3")
    assert (link["text"], link["beside"], link["near"]) == ("Driver 3 north", 3, 1)


def test_groups_and_scores(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, PAGE)], "id int, html string")
    got = {(r.id, r.signature): r for r in blocks.repeated_siblings(blocks.element_rows(df, "id", "html"), "id").collect()}
    assert set(got) == {(1, "li.card"), (4, "li.card")}
    card = got[1, "li.card"]
    assert (card.n, card.score) == (6, 2 + 2 + 1 + 1)  # three children, links, headings, five; no group word in the text
    scores = {r.id: r for r in blocks.page_scores(df.withColumn("t", F.lit("job " * 5)), "id", "html", "t").collect()}
    assert scores[1].likelihood == 0.78 and (scores[1].link, scores[1].link_score) == ("/jobs/0", 6)
    assert scores[2].likelihood == 0.08 and scores[2].link is None and scores[3] == (3, *scores[2][1:])


def test_likelihood_of_nulls(spark):
    null = F.lit(None)
    assert spark.range(1).select(blocks.page_likelihood(null.cast("string"), null.cast("array<string>"), null.cast("boolean"), null.cast("array<string>"), null.cast("string"))).first()[0] == 0


def fits(root, selector):
    """Nodes that a path of `tag.class:nth-of-type(n)`, `#id` or [attr="value"] parts fits, by search from the top."""
    found = [root]
    for i, part in enumerate(selector.split(" > ")):
        plain, _, nth = part.partition(":nth-of-type(")
        below = [k for n in found for k in (n.walk() if i == 0 else n.kids) if isinstance(k, pages.Node) and pages._matches(k, plain)]
        found = [k for k in below if not nth or [x for x in k.parent.kids if isinstance(x, pages.Node) and x.tag == k.tag].index(k) + 1 == int(nth[:-1])]
    return found


def test_selectors_fit_their_node_alone():
    root = pages.parse(PAGE + '<p data-k="v">q</p><b id="lasting-name"></b>')
    for n in root.walk():
        assert fits(root, blocks.selector(n, root)) == [n]
        item = blocks._nearest(list(root.walk()), blocks.ITEMS)[id(n)]
        if item and item is not n:
            assert fits(item, blocks.selector(n, item, ids=False)) == [n]
    by = {n.attrs.get("id"): n for n in root.walk()}
    assert blocks.selector(by["lasting-name"], root) == "#lasting-name" and "77123" not in blocks.selector(by["job-77123"], root)
    assert blocks.selector(next(n for n in root.walk() if "data-k" in n.attrs), root) == '[data-k="v"]'
    card = next(n for n in root.walk() if n.tag == "li")
    assert blocks.item_selector(card, root) == "li.card.css-a1b2" and blocks.item_selector(by["list"], root) is None


def test_item_selector_drops_classes_from_the_end():
    root = pages.parse('<div class="job open"></div><div class="job shut"></div><div class="other"></div>')
    first = next(root.walk())
    assert blocks.item_selector(first, root) == "div.job"


def test_picked_of_odd_rows(spark):
    df = spark.createDataFrame([(1, PAGE, None), (2, None, 0), (3, "<p>x", 5), (4, "<p>x", 0)], "id int, html string, at int")
    got = [tuple(r) for r in df.select("id", blocks.picked_udf("html", "at").alias("s")).select("id", "s.*").orderBy("id").collect()]
    assert got == [(1, None, None, None), (2, None, None, None), (3, None, None, None), (4, "p", "p", None)]


def test_form_labels():
    page = '<form><label>Phone</label><input type="tel"><input name="firstName_he"><input type="file"><textarea></textarea><label>In <input></label></form>'
    assert [f["label"] for f in pages.forms(page)] == ["Phone", "first Name he", "file input", "textarea", "In"]


def test_seeds_and_mirror(spark, tmp_path):
    new = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    assert sorted(r.k for r in tables.seeds(new, spark.createDataFrame([("a",)], "k string"), "k").collect()) == ["b"]
    path = str(tmp_path / "mirror")
    tables.mirror_json(spark.createDataFrame([("Big Site!", 1), ("other", 2)], "name string, n int"), path, "name")
    assert sorted((r.slug, r.name, r.n) for r in spark.read.json(path).collect()) == [("big-site", "Big Site!", 1), ("other", "other", 2)]
