"""Record pipeline, pages, policies, queue, sources."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import groups, pages, places, policy, records, scoring
from sparkloom.plans.listings import Listing
from sparkloom.sources import tables
from sparkloom.streaming import queue


def test_records(spark):
    raw = [(1, {"title": "Senior Data Scientist - (JB-2683)", "detailUrl_href": "https://x/1", "extra": " a  b "}), (2, {"title": "Senior Data Scientist - (JB-2683)", "detailUrl_href": "https://x/2"}), (3, {"title": "Home", "title_href": "https://x/3"}), (4, {"title": "", "location": "y"}), (5, {"title": "Other", "detailUrl": "https://x/5"})]
    out = {r["i"]: r for r in records.pipeline(spark.createDataFrame(raw, "i int, raw map<string,string>"), [F.col("i")]).collect()}
    assert sorted(out) == [1, 5]
    assert out[1]["jobId"] == "JB-2683" and out[1]["additional"] == {"extra": "a b", "_enrichedFromTitle_externalJobId": "JB-2683"}
    assert out[5]["jobId"].startswith("h-") and out[5]["synthesised"] and not out[5]["collision"]


@pytest.mark.parametrize("title", ["Home", "About Us", "Contact", "Privacy Policy", "Terms of Use", "  Home  ", "אודות", "Press ESC to close"])
def test_furniture(spark, title):
    assert spark.range(1).select(records.furniture(F.lit(title))).first()[0]


@pytest.mark.parametrize("title", ["אחראי/ת משמרת FOX HOME בית שמש", "About You - מנהל/ת חנות", "נציג/ת שירות Contact Center", "Home Center גלילות"])
def test_no_furniture(spark, title):
    assert not spark.range(1).select(records.furniture(F.lit(title))).first()[0]


def test_first_occurrence_keeps_exempt_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "|"), (4, "|")], "i int, k string")
    got = groups.first_occurrence(df, F.col("k"), [F.col("i")], F.col("_key") == "|")
    assert sorted(r["i"] for r in got.collect()) == [1, 3, 4]


def test_dom_text():
    assert pages.dom_text("<ul><li>\n<p>A</p>\n</li><li>\n<p>B</p>\n</li></ul>") == "• A\n• B"
    assert pages.dom_text("<ul><li>• x</li></ul>").count("•") == 1
    assert pages.dom_text("<div>a<br>b</div>") == "a\nb" and pages.dom_text(None) == ""


def test_forms_and_items():
    page = '<form><label for="m">Mail</label><input id="m" name="e" required><label>CV <input type="file"></label><textarea placeholder="Why"></textarea><input type="hidden"></form>'
    assert [f["label"] for f in pages.forms(page)] == ["Mail", "CV", "Why"]
    assert pages.items('<div class="j x"><a href=" /1 ">A</a></div><div class="j"><a>B</a></div>', "div.j", {"t": "a", "u": "a@href"}) == [{"t": "A", "u": "/1"}, {"t": "B", "u": ""}]
    assert pages.arrays('{"a": {"b": [{"y": 1, "x": 2}, {"x": 1}]}}') == [{"path": "$.a.b", "n": 2, "keys": ["x", "y"]}]
    assert pages.arrays("no json") == []


def test_deep_pages_and_payloads():
    deep = "<div>" * 5000 + "x<ul><li>y</ul>" + "</div>" * 5000
    assert pages.dom_text(deep) == "x\n• y" and pages.parse(deep).text() == "xy" and sum(1 for _ in pages.parse(deep).walk()) == 5002
    assert [a["path"] for a in pages.arrays('{"groups": [{"jobs": [{"t": 1}]}]}')] == ["$.groups", "$.groups[*].jobs"]


def test_places_of_a_text():
    g = places.Gazetteer(["חיפה", "קרית גת", "קרית גת דרום", "לוד"], {}, {})
    assert g.scan("בא מחיפה") == [] and g.scan("חיפה וקרית גת, קרית גת דרום") == ["חיפה", "קרית גת", "קרית גת דרום"] and g.scan("לודים") == []


def test_recovery_from_prose(spark):
    rows = [(1, "נהג", "דרושים בנתניה עובדים", "", "", {"a": "b"}), (2, "b", "בחיפה", "", "own", {})]
    df = spark.createDataFrame(rows, "i int, title string, description string, requirements string, location string, additional map<string,string>")
    out = {r["i"]: r for r in records.recover_places(df).collect()}
    assert out[1]["location"] == "נתניה" and out[1]["additional"] == {"a": "b", "_enrichedFromDescription_location": "נתניה"} and out[2]["location"] == "own" and out[2]["additional"] == {}


def test_verdicts(spark):
    rows = spark.createDataFrame([("s", "NO_EXPLICIT_RESTRICTION", 80, ["b"]), ("s", "RESTRICTED", 61, ["a", "b"])], "k string, s string, c int, t array<string>")
    r = policy.merge_verdicts(rows, "k", "s", "c", "t").first()
    assert (r["status"], r["confidence"], r["terms"]) == ("RESTRICTED", 71, ["a", "b"])


def test_categories(spark):
    rows = spark.createDataFrame([("Timeout 30000", True, True, 0), ("x", True, False, 0), ("x", True, True, 0), ("x", False, False, 0)], "e string, l boolean, m boolean, n int")
    got = [r[0] for r in rows.select(scoring.failure_category(F.col("e"), F.col("l"), F.col("m"), F.col("n"))).collect()]
    assert got == ["timeout", "structure_changed", "empty_results", "other"]


def test_listing(spark):
    df = spark.createDataFrame([(1, "Ab", "fresh"), (2, "aB_", "d90"), (3, "c", None)], "i int, n string, ageBucket string")
    assert [r["i"] for r in Listing(contains=(("n", "AB"),), order=(("i", True),)).page(df).collect()] == [2, 1]
    assert [r["i"] for r in Listing(age="none").rows(df).collect()] == [3]
    assert {r[0]: r[1] for r in Listing(age="over90").facets(df).collect()} == {"fresh": 1, "d90": 1, "none": 1}


def test_snapshot_is_never_replaced_by_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    assert tables.replace_snapshot(spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string"), path, "s")
    assert tables.replace_snapshot(spark.createDataFrame([(3, "a")], "i int, s string"), path, "s")
    assert not tables.replace_snapshot(spark.createDataFrame([], "i int, s string"), path, "s")
    assert sorted(r["i"] for r in spark.read.parquet(path).collect()) == [2, 3]


def test_csv_round_trip(spark, tmp_path):
    rows = [("a,b", 'say "x"'), ("two\nlines", "")]
    tables.write_csv(spark.createDataFrame(rows, "p string, q string").coalesce(1), str(tmp_path / "c"))
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "c")).collect()] == rows
    tables.write_csv_crlf(spark.createDataFrame(rows + [("c", "d")], "p string, q string").coalesce(1), str(tmp_path / "d"))
    (part,) = (tmp_path / "d").glob("part-*")
    assert part.read_bytes() == b'p,q\r\n"a,b","say ""x"""\r\n"two\nlines",\r\nc,d\r\n'


def test_stream(spark, tmp_path):
    tables.append_json(spark.createDataFrame([("scrape:completed", 1), ("policy:checked", 2)], "type string, id int"), str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        queue.run_available(spark, str(tmp_path / "in"), "type string, id int", str(tmp_path / "out"), str(tmp_path / "ck"))
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_queue(spark):
    log = spark.createDataFrame([(1, "s", "PENDING", 1, 0), (1, "s", "IN_PROGRESS", 2, 1), (2, "t", "PENDING", 1, 2)], "job_id int, site string, status string, ts int, seq int")
    state = queue.queue_state(log)
    assert {(r["job_id"], r["status"], r["attempts"]) for r in state.collect()} == {(1, "IN_PROGRESS", 1), (2, "PENDING", 0)}
    assert queue.next_jobs(state).first()["job_id"] == 2
    assert queue.admit(spark.createDataFrame([("s",), ("u",), ("u",)], "site string"), state, ["site"]).collect() == [("u",)]
    assert [r["job_id"] for r in queue.recover(state).collect()] == [1]


def test_scores_round_as_sql_does(spark):
    """0.235 + 0.1 prints as 0.33499999999999996, its hundredfold is 33.5; 0.285 is 28.499999999999996 hundredths."""
    rows = spark.createDataFrame([(0.235, 2, 0.34), (0.285, 1, 0.28), (0.145, 1, 0.14), (0.185, 3, 0.34), (0.95, 3, 1.0), (None, 2, None)], "base double, methods int, want double")
    assert all(r.got == r.want for r in rows.select(scoring.agreement(F.col("base"), F.col("methods")).alias("got"), "want").collect() if r.want is not None)
    assert spark.range(1).select(scoring.rounded(F.lit(-0.285), 2), scoring.rounded(F.lit(-0.5), 0), scoring.rounded(F.lit(None).cast("double"), 2)).first()[:] == (-0.28, -1.0, None)


#: Cents whose mean is 53.5 dollars; the doubles, added in this order, fall short of it.
HALF = [597, 9921, 355, 3189, 3031, 11766, 2030, 7852, 3451, 11914, 13120, 1001, 11131, 374, 518]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_means_of_a_half_go_up_in_any_order(spark, parts):
    rows = [("a", c / 100) for c in HALF] + [("b", -c / 100) for c in reversed(HALF)] + [("c", None), ("d", 3.0), ("d", None), ("e", 2.5), ("f", 1e9)]
    df = spark.createDataFrame(rows, "k string, c double").coalesce(1)
    df = df if parts == 1 else df.repartition(parts)
    got = policy.merge_verdicts(df.withColumns({"s": F.lit("RESTRICTED"), "t": F.array(F.lit("x"))}), "k", "s", "c", "t").collect()
    assert {r.k: r.confidence for r in got} == {"a": 54, "b": -54, "c": None, "d": 3, "e": 3, "f": 10**9}


def test_only_closed_references_are_decoded(spark):
    """Pages cut off within a reference; the operators themselves decode it, as a browser does."""
    pieces = ["<h1>a &amp;&amp", "x &lt y &#65 &#x42;</h1>", "&copy; &AMP & &", None, ""]
    rows = spark.createDataFrame(list(enumerate(pieces)), "i int, h string")
    got = [r[0] for r in rows.orderBy("i").select(pages.dom_text_udf(pages.closed_references(F.col("h")))).collect()]
    assert got == ["a &&amp", "x &lt y &#65 B", "© &AMP & &", "", ""] and pages.dom_text(pieces[0]) == "a &&"


def test_dom_text_query_of_cut_pages(spark, tmp_path):
    from sparkloom.plans import catalog

    spark.createDataFrame([(1, "u", "<h1>This &amp;&amp</h1><li>a&ampb&lt;</li>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert catalog.QUERIES["dom_text"](spark, str(tmp_path)).first().text == "This &&amp\n• a&ampb<"


def test_records_are_made_once(spark):
    """The test of the status isn't pushed below the fields, where it would make them all once more: each pattern stands once in the plan."""
    raw = spark.createDataFrame([(i, {"title": f"T{i // 2}", "description": "Department: R&D | Location: Haifa", "detailUrl": f"u{i // 2}"}) for i in range(6)] + [(9, {"title": "Home"}), (10, {})], "i int, raw map<string,string>")
    out = records.pipeline(raw, [F.col("i")]).select("i", "title", "status", "location", "jobId", "collision")
    assert sorted((r.i, r.location) for r in out.collect()) == [(0, "Haifa"), (2, "Haifa"), (4, "Haifa")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("keyframes") == 1 and len(plan) < 100_000
