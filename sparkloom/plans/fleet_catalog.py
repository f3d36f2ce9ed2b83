"""More named queries beside SQL: predicates, addresses, settings, verdicts and fleet reports.

Where the tables hold no such values, an id picks one of a list of texts, the same in
both, so that every branch is reached.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import dates, text, urls
from sparkloom.operators import blocks, config, fleet, groups, places
from sparkloom.plans.catalog import AS_OF, query


def pick(id_: str, values: list):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(id_) % len(values) + 1).cast("int"))


def pick_sql(id_: str, values: list) -> str:
    shown = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() for v in values]
    return f"[{', '.join(shown)}][{id_} % {len(values)} + 1]"


LINKS = ["", "#top", "javascript:void(0)", "/", "/jobs", "https://a.co.il/jobs", "http://b.com/locations/israel", "HTTPS://c.com/x.pdf?y=1", "mailto:me@d.org", "https://e.com/?country=il", "https://f.com/Privacy.docx", "https://g.com/takanon.doc#a", "https://cdn.h.com/app.js", "https://i.com/legal", None, "https://j.com/api/jobs?page=3&q=x#f", "https://k.com/list?q=x&page=7"]
_L = pick_sql("event_id", LINKS)


@query(rf"""SELECT event_id, length(trim(coalesce(u, ''))) > 0 AS filled, coalesce(regexp_matches(u, 'mailto:|[\w.+-]+@[\w.-]+\.\w+'), false) AS email, coalesce(regexp_matches(u, '^https?://', 'i'), false) AS scheme,
coalesce(u <> '' AND u NOT LIKE '#%' AND u NOT LIKE 'javascript:%' AND u <> '/', false) AS usable, coalesce(regexp_matches(u, '\bisrael\b|[?&](location|locations|country|region)=(israel|il)\b|/(locations?|regions?|countries)/israel\b|israelhome|\.co\.il(/|$)', 'i'), false) AS marked,
coalesce(regexp_matches(u, '\.(js|css|png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|eot|map)(\?|$)|/static/|/assets/|cdn\.|analytics|captcha', 'i'), false) AS skipped, coalesce(lower(u) = lower('HTTPS://I.COM/legal'), false) AS same
FROM (SELECT event_id, {_L} AS u FROM events)""")
def link_predicates(t):
    """F4, F16, F17, F19, F21, F25."""
    u = F.col("u")
    return t("events").select("event_id", pick("event_id", LINKS).alias("u")).select("event_id", text.filled(u).alias("filled"), text.has_email(u).alias("email"), text.has_scheme(u).alias("scheme"), urls.usable(u).alias("usable"), urls.country_marked(u).alias("marked"), urls.skipped(u).alias("skipped"), F.coalesce(text.same_text(u, F.lit("HTTPS://I.COM/legal")), F.lit(False)).alias("same"))


@query(rf"""SELECT event_id, CASE WHEN regexp_matches(p, '\.pdf$') THEN 'pdf' WHEN regexp_matches(p, '\.docx$') THEN 'docx' WHEN regexp_matches(p, '\.doc$') THEN 'doc' END AS file,
CASE WHEN contains(lower(u), 'privacy') THEN 'privacy' WHEN contains(lower(u), 'term') OR contains(lower(u), 'takanon') THEN 'terms' WHEN contains(lower(u), 'legal') THEN 'legal' ELSE 'unknown' END || CASE WHEN regexp_matches(p, '\.pdf$') THEN '_pdf' WHEN regexp_matches(p, '\.docx$') THEN '_docx' WHEN regexp_matches(p, '\.doc$') THEN '_doc' ELSE '' END AS kind,
coalesce(regexp_extract(lower(u), '^https?://([^/?#]+)', 1) = 'i.com', false) AS same,
CASE WHEN u = 'https://j.com/api/jobs?page=3&q=x#f' THEN 'https://j.com/api/jobs?q=x#f' WHEN u = 'https://k.com/list?q=x&page=7' THEN 'https://k.com/list?q=x' ELSE u END AS without,
CASE WHEN u = 'https://j.com/api/jobs?page=3&q=x#f' THEN 'https://j.com/api/jobs?q=x&page=9#f' WHEN u = 'https://k.com/list?q=x&page=7' THEN 'https://k.com/list?q=x&page=9'
ELSE regexp_replace(u, '#.*$', '') || CASE WHEN contains(regexp_replace(u, '#.*$', ''), '?') THEN '&' ELSE '?' END || 'page=9' || regexp_extract(u, '(#.*)$', 1) END AS paged
FROM (SELECT event_id, {_L} AS u, regexp_replace(lower({_L}), '[?#].*$', '') AS p FROM events) WHERE u IS NOT NULL""")
def link_parts(t):
    """F22, F23, T-31, T-34."""
    u = F.col("u")
    rows = t("events").select("event_id", pick("event_id", LINKS).alias("u")).where("u is not null")
    return rows.select("event_id", urls.file_type(u).alias("file"), urls.document_kind(u).alias("kind"), urls.same_host(u, F.lit("https://i.com/x")).alias("same"), urls.without_parameter(u, "page").alias("without"), urls.with_parameter(u, "page", F.lit(9)).alias("paged"))


ERRORS = ["", "Timeout 3000ms", "getaddrinfo x", "socket hang up " * 6, "", "", "", ""]
CODES = [200, 200, 200, 200, 0, 404, 200, 301]
FINALS = ["https://a.com/x", "", "", "", "", "https://a.com/x", "https://b.com/", "https://a.com/y"]


@query(f"""SELECT event_id, CASE WHEN regexp_matches(e, 'timeout', 'i') THEN 'no_timeout' WHEN regexp_matches(e, 'ERR_NAME_NOT_RESOLVED|getaddrinfo|ENOTFOUND', 'i') THEN 'no_dns' WHEN e <> '' THEN 'no_error:' || substr(e, 1, 60) WHEN s = 0 THEN 'no_no_status'
WHEN s >= 400 THEN 'no_' || s WHEN f NOT LIKE 'https://a.com/%' THEN 'redirected_to:' || f WHEN event_id % 3 = 0 THEN 'yes_url_fixed' ELSE 'yes' END AS outcome,
CASE WHEN event_id % 4 = 0 THEN 'seen' WHEN event_id % 4 = 1 THEN 'old; seen' WHEN event_id % 4 = 2 THEN 'seen; old' ELSE 'seen' END AS notes
FROM (SELECT event_id, {pick_sql('event_id', ERRORS)} AS e, {pick_sql('event_id', CODES)} AS s, {pick_sql('event_id', FINALS)} AS f FROM events)""")
def fetch_outcomes(t):
    """T-33, T-35."""
    cleaned = F.when(F.col("event_id") % 3 == 0, "https://a.com/z").otherwise("https://a.com/x")
    outcome = urls.fetch_outcome(F.lit("https://a.com/x"), cleaned, pick("event_id", CODES), pick("event_id", FINALS), pick("event_id", ERRORS))
    return t("events").select("event_id", outcome.alias("outcome"), text.append_note(pick("event_id", ["", "old", "seen; old", None]), F.lit("seen")).alias("notes"))


MARKS = ["main", ":R1ab:", "job-12345", "a_7", "x123", "3f2504e0-4f89-11d3-9a0c-0305e82c3301", "y" * 41, "css-1ab", "sc-AbCdE1", "Card__title-x9", "item12.big", "ul > li.row:nth-child(3)", "", "div.c1:first-child span.ok"]
_M = pick_sql("event_id", MARKS)


@query(rf"""SELECT event_id, length(m) BETWEEN 1 AND 40 AND m NOT LIKE ':R%' AND NOT regexp_matches(m, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}', 'i') AND len(list_filter(string_split_regex(m, '[-_:.]'), lambda x: regexp_matches(x, '^\d+$') OR length(regexp_replace(x, '\D', '', 'g')) >= 4)) = 0 AS stable,
regexp_matches(m, '^[a-z]{{1,3}}-[a-zA-Z0-9]{{5,}}$|^css-[a-zA-Z0-9]+$|^[A-Z][a-zA-Z]+__[a-zA-Z]+-[a-zA-Z0-9]+$') AS generated, regexp_replace(regexp_replace(m, ':nth-(child|of-type)\(\d+\)|:(first|last)-child', '', 'g'), '\.[\w-]*\d[\w-]*', '', 'g') AS general
FROM (SELECT event_id, {_M} AS m FROM events)""")
def selector_marks(t):
    """H7, T-32, T-40."""
    m = F.col("m")
    return t("events").select("event_id", pick("event_id", MARKS).alias("m")).select("event_id", text.stable_id(m).alias("stable"), F.coalesce(m.rlike(blocks.MADE_CLASS), F.lit(False)).alias("generated"), text.general_selector(m).alias("general"))


TITLES, IDS, APPLY = ["Driver", " ", "Cook", "Nurse", "Guard"], ["A1", "", "A2"], ["", "a@b.co", ""]


@query(f"""WITH s AS (SELECT source, {pick_sql('doc_id', TITLES)} AS title, CASE WHEN length(text) > 300 THEN text ELSE '' END AS description, CASE WHEN source < 'src3' THEN 'x' ELSE {pick_sql('doc_id', IDS)} END AS ident, CASE WHEN source < 'src5' THEN {pick_sql('doc_id', APPLY)} ELSE '' END AS apply FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 30),
r AS (SELECT source, avg(CAST(trim(title) <> '' AS INT)) AS a, avg(CAST(trim(description) <> '' AS INT)) AS b, avg(CAST(trim(ident) <> '' AS INT)) AS c, bool_or(trim(apply) <> '') AS d FROM s GROUP BY 1),
m AS (SELECT source, list_filter([CASE WHEN a < 0.8 THEN 'title fill ' || CAST(floor(a * 100 + 0.5) AS BIGINT) || '% < 80%' END, CASE WHEN b < 0.6 THEN 'description fill ' || CAST(floor(b * 100 + 0.5) AS BIGINT) || '% < 60%' END, CASE WHEN c < 0.9 THEN 'externalJobId fill ' || CAST(floor(c * 100 + 0.5) AS BIGINT) || '% < 90%' END, CASE WHEN NOT d THEN 'no apply path' END], lambda x: x IS NOT NULL) AS l FROM r)
SELECT source, CASE WHEN len(l) = 0 THEN 'ACTIVE' ELSE 'REVIEW' END AS status, coalesce(array_to_string(l, '; '), '') AS reason FROM m""")
def activation(t):
    """A9, A12, C8."""
    d = t("documents").select("doc_id", "source", pick("doc_id", TITLES).alias("title"), F.when(F.length("text") > 300, F.col("text")).otherwise("").alias("description"), F.when(F.col("source") < "src3", "x").otherwise(pick("doc_id", IDS)).alias("externalJobId"), F.when(F.col("source") < "src5", pick("doc_id", APPLY)).otherwise("").alias("applicationInfo"), F.lit("").alias("url"))
    return fleet.activation(d, "source", [F.col("doc_id")])


SPOTS = ["Unknown", "", "Haifa", None, "x / y", "Haifa"]


@query(f"""SELECT user_id, count(*) AS n, count_if(u) AS unknown, count_if(event_type = 'error') AS dead, CASE WHEN count_if(u) / count(*) > 0.4 THEN 'unknown_location_rate: ' || count_if(u) || '/' || count(*) END AS warning
FROM (SELECT user_id, event_type, coalesce(trim(l), '') IN ('', 'Unknown') AS u FROM (SELECT *, {pick_sql('event_id', SPOTS)} AS l FROM events)) GROUP BY 1""")
def location_warnings(t):
    """A19, A21, M15."""
    return fleet.warnings(t("events").select("user_id", pick("event_id", SPOTS).alias("location"), (F.col("event_type") == "error").alias("dead")), "user_id")


@query("""WITH v AS (SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1)
SELECT value, n, value IN ('click', 'view') AS before, value IN ('click', 'view', 'purchase') AS after, round(sum(CASE WHEN value IN ('click', 'view') THEN n ELSE 0 END) OVER () * 100.0 / sum(n) OVER (), 1) AS share_before, round(sum(CASE WHEN value IN ('click', 'view', 'purchase') THEN n ELSE 0 END) OVER () * 100.0 / sum(n) OVER (), 1) AS share_after FROM v""")
def canonical_share(t):
    """Values weighted by their count, before and after."""
    v = t("events").groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n"))
    v = v.withColumns({"before": F.col("value").isin("click", "view"), "after": F.col("value").isin("click", "view", "purchase")})
    whole = Window.partitionBy()  # a row a value
    share = lambda c: groups.percent(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).over(whole), F.sum("n").over(whole))
    return v.withColumns({"share_before": share("before"), "share_after": share("after")})


@query("SELECT count_if(o_orderstatus = 'O') AS \"O\", count_if(o_orderstatus = 'F') AS \"F\", count_if(o_orderstatus = 'P') AS \"P\", count_if(o_orderstatus = 'X') AS \"X\", count(*) AS total, count_if(o_orderstatus <> 'O') AS checked FROM orders")
def policy_coverage(t):
    """A3, A4."""
    return fleet.coverage(t("orders"), "o_orderstatus", ["O", "F", "P", "X"], "O")


@query("""WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1), g AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'structure_changed' WHEN 2 THEN 'empty_results' END AS c FROM f)
SELECT o_custkey, o_orderkey, CASE c WHEN 'timeout' THEN 'Timeout' WHEN 'structure_changed' THEN 'Structure Changed' WHEN 'empty_results' THEN 'Empty Results' ELSE 'Unknown Error' END AS label, CASE c WHEN 'structure_changed' THEN 'fix' WHEN 'empty_results' THEN 'investigate' ELSE 'retry' END AS action,
CASE WHEN o_orderkey % 100 >= 90 THEN '#22c55e' WHEN o_orderkey % 100 >= 70 THEN '#f59e0b' ELSE '#ef4444' END AS colour FROM g JOIN customer ON o_custkey = c_custkey""")
def latest_failures(t):
    """W2, W8, C17, C18."""
    runs = t("orders").withColumn("c", F.when(F.col("o_orderkey") % 4 == 0, "timeout").when(F.col("o_orderkey") % 4 == 1, "structure_changed").when(F.col("o_orderkey") % 4 == 2, "empty_results"))
    sites = t("customer").select(F.col("c_custkey").alias("o_custkey"))
    out = fleet.latest_failed(sites, runs, "o_custkey", F.col("o_orderstatus") == "O", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return out.select("o_custkey", "o_orderkey", fleet.failure_label(F.col("c")).alias("label"), fleet.failure_action(F.col("c")).alias("action"), fleet.health_colour(F.col("o_orderkey") % 100).alias("colour"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1 AND n >= 2""")
def commonest_parent(t):
    """The commonest value of a group, ties to the first seen."""
    return fleet.mode(t("events"), "user_id", "event_type", "event_id")


@query("""WITH s AS (SELECT user_id, event_type, round(avg(value), 4) AS mean, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, round(avg(mean) * least(1.0, count(*) / 5), 6) AS overall, max_by(event_type, mean) AS best, max(n) AS most FROM s GROUP BY 1""")
def overall_scores(t):
    """A32, N11."""
    s = t("events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.round(F.avg("mean") * F.least(F.lit(1.0), F.count("*") / 5), 6).alias("overall"), F.max_by("event_type", "mean").alias("best"), F.max("n").alias("most"))


@query("""WITH u AS (SELECT event_id AS pos, user_id AS k FROM events WHERE event_type = 'click' UNION ALL SELECT event_id + 1000000, user_id FROM events WHERE event_type = 'view'), d AS (SELECT * FROM u WHERE k % 11 <> 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos) = 1)
SELECT pos, k FROM d ORDER BY pos LIMIT 40 OFFSET 5""")
def union_pages(t):
    """Pages in a row, blank rows dropped, first of each key, from a start to a cap."""
    e = t("events")
    both = e.where("event_type = 'click'").select(F.col("event_id").alias("pos"), F.col("user_id").alias("k")).unionByName(e.where("event_type = 'view'").select((F.col("event_id") + 1000000).alias("pos"), F.col("user_id").alias("k")))
    return groups.first_occurrence(both.where("k % 11 <> 0"), F.col("k"), [F.col("pos")]).orderBy("pos").offset(5).limit(40)


@query("""WITH k AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'SKIPPED' ELSE 'FAILED' END AS status FROM customer WHERE c_custkey % 4 <> 0),
r AS (SELECT o_orderkey, o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS again FROM orders)
SELECT o_orderkey, CASE WHEN again THEN 'DUPLICATE' WHEN status IS NULL THEN 'NEW' WHEN status = 'ACTIVE' THEN 'EXISTS' WHEN status = 'SKIPPED' THEN 'SKIPPED' ELSE 'RETRY' END AS outcome FROM r LEFT JOIN k USING (k)""")
def work_list(t):
    """J12, C22."""
    sites = t("customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, "ACTIVE").when(F.col("c_custkey") % 3 == 1, "SKIPPED").otherwise("FAILED").alias("status"))
    return fleet.work_list(t("orders").select("o_orderkey", F.col("o_custkey").alias("k")), sites, "k", [F.col("o_orderkey")]).select("o_orderkey", "outcome")


@query("""WITH s AS (SELECT l_partkey AS k, l_orderkey AS seed FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1)
SELECT p_partkey, seed FROM part LEFT JOIN s ON p_partkey = k""")
def listing_seeds(t):
    """Detail rows beside the first listing row of their key."""
    seeds = t("lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("seed"), "l_linenumber")
    return fleet.seeded(t("part").select("p_partkey"), seeds, "p_partkey", [F.col("seed"), F.col("l_linenumber")]).select("p_partkey", "seed")


CONFIGS = ['{"title": {"selector": "h1"}, "_meta": {"itemSelector": "li", "pagination": {"type": "url", "param": "p", "start": 2, "maxPages": 500}}}', '{"title": {"selector": "h1", "method": "AI", "confidence": 0.5}, "x": {"method": "AI"}, "itemSelector": "tr", "_meta": {"pagination": {"type": "click", "nextSelector": "a.n", "settleMs": 99999, "maxPages": 3}}}', '{"_meta": {"pagination": {"type": "click"}}}', "{}", '{"_meta": {"pagination": {"type": "url", "param": "q", "step": 5, "settleMs": 700}}}']
_CONFIG = [("title:UNKNOWN:1.0", "li", "url|p|2|1|100|1200"), ("title:AI:0.5", "tr", "click|a.n|3|10000"), ("", None, None), ("", None, None), ("", None, "url|q|0|5|20|700")]


@query(f"SELECT event_id, {pick_sql('event_id', [c[0] for c in _CONFIG])} AS mappings, {pick_sql('event_id', [c[1] for c in _CONFIG])} AS item, {pick_sql('event_id', [c[2] for c in _CONFIG])} AS pages FROM events")
def site_settings(t):
    """What is parsed from five settings is written out in the SQL."""
    raw = pick("event_id", CONFIGS)
    rows = t("events").select("event_id", config.mappings(raw).alias("m"), config.structural(raw, "itemSelector").alias("item"), config.pagination(raw).alias("p"))
    shown = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e.key, e.value.method, e.value.confidence.cast("string"))), ",")
    return rows.select("event_id", shown.alias("mappings"), "item", F.when(F.col("p").isNotNull(), F.concat_ws("|", "p.type", "p.target", "p.start", "p.step", "p.maxPages", "p.settleMs")).alias("pages"))


@query("""SELECT event_id, '{"_meta":{"k":' || coalesce(CAST(k AS VARCHAR), 'null') || ',"note":null}}' AS saved, CASE WHEN event_id % 2 = 0 THEN coalesce(event_type, '') ELSE '' END AS description, CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END AS location,
array_to_string(list_sort(list_filter(['k', 'fields', 'title'], lambda x: NOT list_contains(CASE WHEN event_id % 3 = 0 THEN ['title', 'fields'] ELSE json_keys(props) END, x))), ',') AS missing FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def stored_fields(t):
    """P15, P22, J15."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    raw, own = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(""), F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("event_type"))
    stored = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("title"), F.lit("fields"))).otherwise(F.json_object_keys("props"))
    return t("events").select("event_id", config.saved({"k": k, "note": F.lit(None).cast("string")}).alias("saved"), config.two_source(own, raw, True).alias("description"), config.two_source(own, raw).alias("location"), F.array_join(config.missing_fields(F.array(*map(F.lit, ["k", "fields", "title"])), stored), ",").alias("missing"))


REPLIES = ['```json\n{"status": "RESTRICTED", "confidence": 250, "matched_terms": ["a", "b"], "language": "he", "short_reason": "x"}\n```', '{"status": "SURE", "confidence": -3}', "no json", '{"confidence": 61.5, "short_reason": "' + "y" * 310 + '"}']
_REPLY = [("RESTRICTED|100|he|a,b|1"), ("UNCLEAR_NEEDS_REVIEW|0|other||0"), None, ("UNCLEAR_NEEDS_REVIEW|62|other||300")]


@query(f"SELECT event_id, {pick_sql('event_id', _REPLY)} AS reply FROM events")
def checked_replies(t):
    """N6, T-39: what is made of four replies is written out in the SQL."""
    r = F.col("r")
    rows = t("events").select("event_id", config.reply(pick("event_id", REPLIES)).alias("r"))
    return rows.select("event_id", F.when(r.isNotNull(), F.concat(r.status, F.lit("|"), r.confidence.cast("string"), F.lit("|"), r.language, F.lit("|"), F.array_join(r.terms, ","), F.lit("|"), F.length(r.reason).cast("string"))).alias("reply"))


@query("""SELECT user_id, CASE WHEN max(value) > 480 THEN 'CAPTURED' WHEN count(*) >= 30 THEN 'NEEDS_MANUAL' WHEN count_if(event_type = 'error') > 4 THEN 'EMAIL' WHEN count_if(event_type = 'signup') > 3 THEN 'URL' ELSE 'NONE' END AS form,
CASE WHEN count_if(event_type = 'error') % 3 = 0 THEN 'BROKEN' WHEN count_if(event_type = 'view') % 2 = 0 THEN 'TIER_B_GAPS' ELSE 'OK' END AS bucket, CASE WHEN count_if(event_type = 'click') % 4 >= 2 THEN 'static' WHEN count_if(event_type = 'view') % 2 > 0 THEN 'live' ELSE 'none' END AS fields,
CASE WHEN (count_if(event_type = 'click') <= 1 OR count_if(event_type = 'view') < count_if(event_type = 'click')) AND count_if(event_type = 'error') > count_if(event_type = 'view') THEN 'auto' ELSE 'explicit' END AS strategy,
CASE WHEN max(value) < 300 THEN 'RED' WHEN max(value) > 480 THEN 'GREEN' WHEN count(*) >= 3 THEN 'YELLOW' ELSE 'GRAY' END AS lane, CASE WHEN count(*) % 3 <> 0 THEN 'plain' WHEN count(*) % 2 = 1 THEN 'needs_override' ELSE 'unreachable' END AS reach FROM events GROUP BY 1""")
def site_verdicts(t):
    """C6, C7, C15, C25, H3, H5."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    g = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("v"), *[n(k).alias(k) for k in ("error", "signup", "view", "click")])
    c = F.col
    return g.select(
        "user_id", fleet.form_status(c("v") > 480, c("n") >= 30, c("error") > 4, c("signup") > 3).alias("form"), fleet.bucket((c("error") % 3 == 0).cast("int"), (c("view") % 2 == 0).cast("int")).alias("bucket"),
        fleet.static_form(c("click") % 4, c("view") % 2).alias("fields"), fleet.strategy(c("view"), c("click"), c("error")).alias("strategy"), fleet.lane(c("v") >= 300, c("v") > 480, c("n")).alias("lane"), fleet.reach(c("n") % 3 == 0, c("n") % 2 == 0).alias("reach"),
    )


@query(f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS "failedAt", CASE WHEN o_orderstatus = 'O' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS "activeAt", coalesce(o_totalprice <> lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), false) AS changed, CASE WHEN o_totalprice > 100000 THEN ['big'] ELSE [] END AS tags,
CASE WHEN o_orderkey % 3 = 0 THEN '2024-02-01' WHEN o_orderkey % 3 = 1 THEN CAST(DATE '{AS_OF}' - 30 AS VARCHAR) END AS cutoff FROM orders WHERE o_orderkey <> 7""")
def site_updates(t):
    """D5, D8, F12, R10, S18."""
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "ACTIVE")
    made = fleet.stamps(status, F.col("o_orderdate").cast("date").cast("string"))
    k = F.col("o_orderkey") % 3
    cutoff = dates.cutoff(F.when(k == 0, "2024-02-01"), F.when(k == 1, 30), F.lit(AS_OF).cast("date"))
    o = t("orders").select("o_orderkey", made[3], made[2], fleet.changed("o_custkey", ["o_totalprice"], [F.col("o_orderdate"), F.col("o_orderkey")]).alias("changed"), F.when(F.col("o_totalprice") > 100000, F.array(F.lit("big"))).otherwise(F.array().cast("array<string>")).alias("tags"), cutoff.cast("string").alias("cutoff"))
    return o.where("o_orderkey <> 7")


@query("SELECT DISTINCT name, CASE WHEN regexp_matches(name, 'A$') THEN 'region' ELSE 'city' END AS kind, CAST(length(name) AS INTEGER) AS length FROM (SELECT n_name AS name FROM nation UNION ALL SELECT unnest(['Haifa', 'KENYA', 'CHINA']))")
def place_list(t):
    """S20, U5."""
    return fleet.place_list(t("nation"), "n_name", "A$", ["Haifa", "KENYA", "CHINA"])


@query()
def gazetteer_extract(t):
    """A place named in prose, over whole texts; tests hold golden sentences."""
    return t("documents").select("doc_id", places.from_prose("text").alias("location"))
