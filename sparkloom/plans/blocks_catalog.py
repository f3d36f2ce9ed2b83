"""Named queries on page structure, scores, selectors and seeds, beside SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import blocks
from sparkloom.plans.catalog import query
from sparkloom.plans.fleet_catalog import pick, pick_sql
from sparkloom.sources import tables

CLASSES = ["card", "card css-9zz", "job card", "", "ab-cdefgh"]
WITHIN = ["ul ", "div main-nav", "nav ", "span x", "section list", "article", "tbody footer"]


@query(rf"""WITH e AS (SELECT l_suppkey AS page, l_linenumber AS parent, l_orderkey * 100000000 + l_partkey * 1000 + CAST(l_quantity AS INT) * 10 + l_linenumber AS pos, CASE WHEN l_returnflag = 'N' THEN 'li' ELSE 'div' END AS tag, list_sort(list_filter(string_split({pick_sql('l_partkey', CLASSES)}, ' '), lambda c: c <> '' AND c NOT IN ('css-9zz', 'ab-cdefgh'))) AS c,
{pick_sql('l_linenumber', WITHIN)} AS w, CAST(l_quantity AS INT) % 6 AS kids, l_partkey % 7 = 0 AS link, l_partkey % 11 = 0 AS head, l_partkey % 5 = 0 AS said, CAST(l_quantity AS INT) AS size FROM lineitem),
r AS (SELECT *, tag || CASE WHEN len(c) > 0 THEN '.' ELSE '' END || array_to_string(c, '.') AS signature FROM e WHERE string_split(w, ' ')[1] IN ('div', 'ul', 'ol', 'section', 'main', 'tbody', 'article')),
k AS (SELECT *, row_number() OVER (PARTITION BY page, parent, signature ORDER BY pos) <= 5 AS early FROM r)
SELECT page, parent, signature, count(*) AS n, min(pos) AS first, CAST(CASE WHEN avg(kids) FILTER (early) >= 3 THEN 2 ELSE 0 END + CASE WHEN bool_or(link AND early) THEN 2 ELSE 0 END + CASE WHEN bool_or(head AND early) THEN 1 ELSE 0 END + CASE WHEN count(*) >= 5 THEN 1 ELSE 0 END
+ CASE WHEN bool_or(said AND early) THEN 3 ELSE 0 END - CASE WHEN min(w) IN ('div main-nav', 'tbody footer') THEN 2 ELSE 0 END - CASE WHEN avg(size) FILTER (early) < 20 THEN 1 ELSE 0 END AS INT) AS score FROM k GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def repeated_siblings(t):
    """Lines of an order stand for elements, suppliers for pages; lines of one place are alike in all that counts."""
    part = lambda n: F.col("l_partkey") % n == 0
    size = F.col("l_quantity").cast("int")
    rows = t("lineitem").select(
        F.col("l_suppkey").alias("page"), F.col("l_linenumber").alias("parent"), (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 1000 + size * 10 + F.col("l_linenumber")).alias("at"), F.when(F.col("l_returnflag") == "N", "li").otherwise("div").alias("tag"),
        F.filter(F.split(pick("l_partkey", CLASSES), " "), lambda c: c != "").alias("classes"), pick("l_linenumber", WITHIN).alias("within"), (size % 6).alias("kids"), part(7).cast("int").alias("links"), part(11).cast("int").alias("heads"), part(5).alias("said"), size.alias("size"),
    )
    return blocks.repeated_siblings(rows, "page")


TITLES = ["All Jobs", "About us", "דרושים", None, "", "Vacancies"]
PATHS = ["/job/1", "/jobs/2", "/x", "/Careers/3/", "/about", "/משרה/5", "/jobs"]


@query(rf"""WITH d AS (SELECT doc_id, {pick_sql('doc_id', TITLES)} AS t, {pick_sql('(doc_id + 2)', TITLES)} AS h, [{pick_sql('doc_id', PATHS)}, {pick_sql('(doc_id + 1)', PATHS)}, {pick_sql('(doc_id + 3)', PATHS)}] AS u, coalesce(text, '') || repeat(' Apply', CAST(doc_id % 12 AS BIGINT)) AS x FROM documents),
k AS (SELECT *, coalesce(regexp_matches(lower(t), 'jobs|vacancies|דרושים'), false) AS kt, coalesce(regexp_matches(lower(h), 'jobs|vacancies|דרושים'), false) AS kh, len(list_filter(u, lambda p: p IN ('/job/1', '/jobs/2', '/Careers/3/', '/משרה/5'))) AS l, len(regexp_extract_all(lower(x), 'job|position|career|vacancy|opening|role|hiring|apply|משרה|תפקיד|דרושים|מועמדות')) AS w FROM d)
SELECT doc_id, least(100, 20 * kt::INT + 15 * kh::INT + 15 * kt::INT + CASE WHEN doc_id % 2 = 0 THEN 25 ELSE 0 END + CASE WHEN l >= 3 THEN 25 WHEN l >= 1 THEN 10 ELSE 0 END + CASE WHEN w >= 10 THEN 15 WHEN w >= 5 THEN 8 ELSE 0 END) / 100 AS likelihood FROM k""")
def page_likelihoods(t):
    """M9."""
    d = t("documents").withColumn("d2", F.col("doc_id") + 2).withColumn("d1", F.col("doc_id") + 1).withColumn("d3", F.col("doc_id") + 3)
    text = F.concat(F.coalesce("text", F.lit("")), F.expr("repeat(' Apply', CAST(doc_id % 12 AS INT))"))
    score = blocks.page_likelihood(pick("doc_id", TITLES), F.array(pick("d2", TITLES), pick("doc_id", TITLES)), F.col("doc_id") % 2 == 0, F.array(pick("doc_id", PATHS), pick("d1", PATHS), pick("d3", PATHS)), text)
    return d.select("doc_id", score.alias("likelihood"))


SAID = ["Nurse", "abc", "", None, "Driver in the north", "x" * 81]


@query(rf"""SELECT event_id, CASE WHEN {pick_sql('event_id', PATHS)} IN ('/job/1', '/jobs/2', '/Careers/3/', '/משרה/5') THEN 3 ELSE 0 END + CASE WHEN length(trim({pick_sql('event_id', SAID)})) BETWEEN 5 AND 80 THEN 2 ELSE 0 END + CASE WHEN event_id % 5 >= 3 THEN 2 ELSE 0 END + CASE WHEN user_id % 4 >= 3 THEN 1 ELSE 0 END AS score FROM events""")
def detail_link_scores(t):
    """M11."""
    return t("events").select("event_id", blocks.detail_link_score(pick("event_id", PATHS), pick("event_id", SAID), F.col("event_id") % 5, F.col("user_id") % 4).alias("score"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '#apply' WHEN event_id % 2 = 0 THEN '' END AS selector, CASE WHEN event_id % 2 = 0 THEN '{\"actionUrl\":\"' || CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END || '\",\"method\":\"' || CASE WHEN event_id % 7 = 0 THEN 'POST' ELSE 'GET' END || '\",\"fields\":[\"name\",\"u' || user_id || '\"]}' END AS blob FROM events WHERE event_id % 3 = 0 OR event_id % 2 = 0")
def form_captures(t):
    """Events of neither a selector nor fields give null and drop out."""
    fields = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("name"), F.concat(F.lit("u"), F.col("user_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    got = blocks.form_capture(F.when(F.col("event_id") % 3 == 0, "#apply"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")), F.when(F.col("event_id") % 7 == 0, "POST").when(F.col("event_id") % 7 == 1, ""), fields)
    return t("events").select("event_id", got.alias("c")).where("c is not null").select("event_id", "c.*")


@query("SELECT o_custkey, CAST(count_if(o_orderstatus <> 'P') AS INT) AS status, CAST(count_if(o_totalprice > 100000) AS INT) AS price FROM orders GROUP BY 1")
def extraction_diagnostics(t):
    """A customer's orders as the items of a page."""
    item = F.create_map(F.lit("status"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")), F.lit("price"), F.when(F.col("o_totalprice") > 100000, "x"))
    rows = t("orders").groupBy("o_custkey").agg(F.collect_list(item).alias("items"))
    return rows.select("o_custkey", blocks.field_hits(F.col("items"), ["status", "price"]).alias("h")).select("o_custkey", "h.*")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def point_lookup(t):
    """S2."""
    return tables.lookup(t("customer"), "c_custkey", 7).select("c_custkey", "c_name")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def seed_rows(t):
    """Customers without an open order are the new keys, once each."""
    new = t("customer").select("c_custkey")
    return tables.seeds(new.unionByName(new), t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query()
def page_selectors(t):
    """H6, H8, H9: of the last link of each page; compared with plain counting in the tests."""
    rows = t("pages").select("page_id", "html", blocks.elements_udf("html").alias("e"))
    last = F.array_max(F.transform(F.filter("e", lambda x: x.tag == "a"), lambda x: x["at"]))
    return rows.select("page_id", blocks.picked_udf(F.col("html"), last).alias("s")).select("page_id", "s.*")


@query()
def page_scores(t):
    """M9, M11 over pages."""
    return blocks.page_scores(t("pages").withColumn("body", F.regexp_replace("html", "<[^>]*>", " ")), "page_id", "html", "body")


@query()
def page_groups(t):
    """A29, M7 over pages."""
    return blocks.repeated_siblings(blocks.element_rows(t("pages"), "page_id", "html"), "page_id")
