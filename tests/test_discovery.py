"""JSON listings, links and embedded boards: golden values and odd rows."""

from pyspark.sql import functions as F

from sparkloom.operators import discovery


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_key_scores(spark):
    score = lambda f, k, v: one(spark, discovery.key_score(f, F.lit(k), F.lit(v).cast("string")))
    assert score("title", "JOBTITLE", "Driver") == 0.95 and score("title", "subtitle", "x") == 0.35 and score("title", "id", "Driver") == 0
    assert score("location", "עיר", "חיפה") == 0.9 and score("company", "employer", None) == 0.45
    assert score("salary", "pay", "₪ 900 nis") == 1.0 and score("description", "body", "x" * 60) == 0.95


def test_listing_of_odd_arrays(spark):
    rows = spark.createDataFrame([(None,), ([],), ([{}],), ([{"a": "1"}, {"title": "Nurse wanted"}],), ([{"name": None, "title": "Nurse"}],)], "i array<map<string,string>>")
    got = [r[0] for r in rows.select(discovery.listing(F.col("i"))).collect()]
    assert not any(got[:3]) and [(x.field, x.key, x.confidence) for x in got[3]] == [("title", "title", 0.45)] and got[4][0].key == "title"
    scores = [r[0] for r in rows.select(discovery.listing_score(discovery.listing(F.col("i")), F.col("i"))).collect()]
    assert scores[:3] == [0, 0, 0] and abs(scores[3] - 0.18) < 1e-9


def test_ties_of_endpoints(spark):
    items = [{"title": "Nurse", "city": "Haifa"}] * 3
    rows = spark.createDataFrame([("s", "b", 2, items), ("s", "a", 1, items), ("t", "x", 1, items[:2])], "g string, p string, at int, i array<map<string,string>>")
    assert [(r.g, r.p, r.n) for r in discovery.endpoints(rows, "g", "p", "i", "at").collect()] == [("s", "a", 3)]


def test_detail_pattern_of_few_links(spark):
    rows = spark.createDataFrame([("a", 1, "https://a.com/j/1/x"), ("a", 2, "https://a.com/about"), ("a", 3, "https://a.com/j/2/x"), ("b", 1, "https://b.com/j/1"), ("c", 1, "https://c.com/"), ("c", 2, "https://c.com/x")], "s string, n int, u string")
    assert {r.s: r.pattern for r in discovery.detail_pattern(rows, "s", "u", "n").collect()} == {"a": "/j/:id/x", "b": None, "c": None}


def test_hidden_mail(spark):
    hidden = "2a" + "".join(f"{b ^ 0x2A:02x}" for b in b"a@b.co")
    assert one(spark, discovery.hidden_mail(F.lit(hidden))) == "a@b.co"
    assert [one(spark, discovery.hidden_mail(F.lit(x).cast("string"))) for x in ("", "2a", "zz11", None)] == [None] * 4


def test_boards_need_their_own_host(spark):
    board = lambda h: one(spark, discovery.embedded_board(F.lit(h), F.lit("jobs.lever.co")))
    assert board('<iframe src="https://jobs.lever.co/x">') is None and board('<iframe src="https://lever.co.evil.com/">') is None
    assert board('<iframe src="https://jobs.lever.co/x"><iframe src="//a.icims.com/y">') == ("icims", "https://a.icims.com/y")


def test_scope_takes_signs_as_they_are(spark):
    scope = lambda u, p: one(spark, discovery.field_scope(F.lit(u), F.lit(2), F.lit(p)))
    assert scope("https://a.com/x?q=1", "https://a.com/x?q=*") == "listing" and scope("https://aXcom/", "https://a.com/") == "detail" and scope("https://a.com/(1)", "https://a.com/(*)") == "listing"


def test_arrays_are_scored_once(spark, tmp_path):
    """One pass over the lines, and each test of a key stands once in the plan, however many uses its score has."""
    from sparkloom.plans import discovery_catalog

    rows = [(o, p, 1, n, 1.0) for o, k in ((1, 6), (2, 3), (3, 2), (None, 4)) for n, p in enumerate(range(7, 7 + k))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    best = discovery_catalog.listing_endpoints(lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet"))
    assert sorted((r.l_orderkey or 0, r.n, r.path, r.score) for r in best.collect()) == [(0, 4, "$", 0.76), (1, 6, "$", 0.95), (2, 3, "$", 0.57)]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("(?i)^(title|jobTitle") == 1
