"""Named queries on where a site keeps its records, beside SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import urls
from sparkloom.operators import discovery
from sparkloom.plans.catalog import query
from sparkloom.plans.fleet_catalog import pick, pick_sql

NAMES = ["jobTitle", "Job_Name2", "תפקיד", "orgName", "employerId", "city", "workplace", "מיקום", "maxSalary", "payment", "שכר", "body", "aboutUs", "id", "תיאור", "name", "שם_חברה"]
SAID = ["", "ab", "Driver", "Remote", "חיפה והצפון", "12,000 ₪", "9000 NIS", "שקל", None, "x" * 51, "y" * 160, "z" * 201, "Tel Aviv"]


def _score_sql(exact, near, hebrew, more, odd):
    return f"floor(CASE WHEN b > 0 THEN least(1.0::DOUBLE, b + {more}) * (CASE WHEN {odd} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) ELSE 0.0::DOUBLE END * 100 + 0.5) / 100", f"(CASE WHEN regexp_full_match(k, '{exact}', 'i') THEN 0.9::DOUBLE WHEN regexp_matches(k, '{near}', 'i') THEN 0.7::DOUBLE WHEN regexp_matches(k, '{hebrew}') THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END)"


def _key_sql(field, more, odd):
    whole, base = _score_sql(*discovery.KEYS[field], more, odd)
    return whole.replace("b > 0", f"{base} > 0").replace("b + ", f"{base} + ") + f" AS {field}"


_IF = lambda p: f"(CASE WHEN {p} THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)"
_SCORES = ", ".join([
    _key_sql("title", _IF("length(v) BETWEEN 5 AND 100"), "length(v) < 3 OR length(v) > 200"), _key_sql("company", _IF("length(v) BETWEEN 2 AND 80"), "length(v) < 1 OR length(v) > 150"),
    _key_sql("location", "(" + _IF(r"regexp_matches(v, '\b(tel\s*aviv|jerusalem|haifa|israel|remote|hybrid)\b', 'i')") + " + " + _IF("contains(v, 'חיפה')") + ")", "length(v) < 1 OR length(v) > 100"),
    _key_sql("salary", "(" + _IF("contains(v, '₪')") + " + " + _IF("contains(lower(v), 'nis')") + " + " + _IF("contains(v, 'שקל')") + r" + (CASE WHEN regexp_matches(v, '\d') THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END))", "false"),
    _key_sql("description", _IF("length(v) > 50"), "length(v) < 10"),
])


@query(f"SELECT event_id, {_SCORES} FROM (SELECT event_id, {pick_sql('event_id', NAMES)} AS k, coalesce({pick_sql('event_id', SAID)}, '') AS v FROM events)")
def key_scores(t):
    """Every pair of 17 keys and 13 values comes up."""
    return t("events").select("event_id", *[discovery.key_score(f, pick("event_id", NAMES), pick("event_id", SAID)).alias(f) for f in discovery.KEYS])


_ARRAY = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"""WITH o AS (SELECT l_orderkey, count(*) AS n, list(l_partkey ORDER BY {_ARRAY})[1] % 12 AS first FROM lineitem GROUP BY 1), s AS (SELECT *, CASE WHEN first + 1 BETWEEN 5 AND 100 THEN 0.95::DOUBLE WHEN first + 1 < 3 THEN 0.45::DOUBLE ELSE 0.9::DOUBLE END AS a, 0.95::DOUBLE AS b FROM o WHERE n >= 3)
SELECT l_orderkey, n, '$' AS path, '$[*].jobTitle:' || a || ',$[*].city:' || b AS fields, round((a + b) / 2 * least(1.0, n / 5), 6) AS score FROM s""")
def listing_endpoints(t):
    """An order's lines as the items of an array, beside a second, longer one that holds no fields."""
    # items are made of the sorted keys, as a map can't be ordered; both arrays come from one pass over an order
    sorted_keys = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    item = lambda k: F.create_map(F.lit("jobTitle"), F.repeat(F.lit("x"), (k["l_partkey"] % 12 + 1).cast("int")), F.lit("city"), F.lit("Haifa"), F.lit("id"), k["l_linenumber"].cast("string"))
    one = F.struct(F.lit("$").alias("path"), F.lit(0).alias("at"), F.transform("k", item).alias("items"))
    other = F.struct(F.lit("meta.pages").alias("path"), F.lit(1).alias("at"), F.array_repeat(F.create_map(F.lit("id"), F.lit("1")), 9).alias("items"))
    arrays = t("lineitem").groupBy("l_orderkey").agg(sorted_keys.alias("k")).select("l_orderkey", F.inline(F.array(one, other)))
    best = discovery.endpoints(arrays, "l_orderkey", "path", "items", "at")
    shown = F.array_join(F.transform("fields", lambda x: F.concat(discovery.json_path(F.col("path"), x.key), F.lit(":"), x.confidence.cast("string"))), ",")
    return best.select("l_orderkey", F.col("n").cast("bigint").alias("n"), "path", shown.alias("fields"), F.round("score", 6).alias("score"))


HREFS = ["https://a.com/jobs/1", "https://a.com/about", "https://a.com/careers/privacy", "https://a.com/x", "https://a.com/terms.pdf", "https://a.com/legal/", "https://a.com/משרות", "https://a.com/tos", "https://a.com/TERMS.PDF", "https://a.com/login?n=/jobs"]
WORDS = ["Open Jobs", "", "Terms of Use", "דרושים", "Read our privacy policy", "about us", " legal "]


@query(f"""WITH l AS (SELECT event_id, lower({pick_sql('event_id', HREFS)}) AS u, lower({pick_sql('event_id', WORDS)}) AS w FROM events),
p AS (SELECT *, regexp_matches(w, 'terms|privacy|legal') AS by_text, regexp_matches(regexp_extract(u, 'https://a.com(/[^?]*)', 1), '/terms|/privacy|/legal|/tos') AS by_path FROM l)
SELECT event_id, 5 * CAST(regexp_matches(u, '/jobs|/careers|/משרות') AS INT) + 3 * CAST(regexp_matches(w, 'jobs|דרושים') AS INT) + CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END - 3 * CAST(regexp_matches(u, '/about|/privacy|/terms|/login') AS INT) - CASE WHEN event_id % 4 = 0 THEN 2 ELSE 0 END AS link,
CASE WHEN by_text AND by_path THEN 8 WHEN by_text THEN 6 WHEN by_path THEN 4 END + CASE WHEN trim(w) IN ('terms of use', 'legal') THEN 2 ELSE 0 END + CASE WHEN u LIKE '%.pdf' THEN 2 ELSE 0 END AS policy, CASE WHEN contains(u, '/terms') THEN 7 WHEN regexp_matches(u, 'privacy|legal') THEN 6 ELSE 4 END AS path FROM p""")
def link_scores(t):
    """M10, M14."""
    u, w = pick("event_id", HREFS), pick("event_id", WORDS)
    return t("events").select("event_id", discovery.link_score(u, w, F.col("event_id") % 3 == 0, F.col("event_id") % 4 == 0).alias("link"), discovery.policy_link_score(u, w).alias("policy"), discovery.policy_path_score(u).alias("path"))


@query(f"""WITH l AS (SELECT user_id, event_id, {pick_sql('event_id', HREFS)} AS u, event_id % 9 AS s FROM events), o AS (SELECT * FROM l WHERE s > 2 QUALIFY row_number() OVER (PARTITION BY user_id, regexp_replace(lower(u), '/$', '') ORDER BY event_id) = 1)
SELECT user_id, event_id, u, s FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) <= 4""")
def policy_candidates(t):
    """C21."""
    rows = t("events").select("user_id", "event_id", pick("event_id", HREFS).alias("u"), F.when(F.col("event_id") % 9 > 2, F.col("event_id") % 9).alias("s"))
    return discovery.policy_candidates(rows, "user_id", "u", "s", [F.col("event_id")])


@query(r"""WITH p AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS site, page_id, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages),
l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id) <= 20), g AS (SELECT site, min_by(s, page_id) AS f, list(s) AS l FROM l GROUP BY 1),
i AS (SELECT site, f, list_filter(range(1, len(f) + 1), lambda i: len(list_filter(l, lambda u: len(u) = len(f) AND u[i] <> f[i])) > 0)[1] AS v FROM g)
SELECT site, CASE WHEN v IS NOT NULL THEN '/' || array_to_string(list_transform(range(1, len(f) + 1), lambda j: CASE WHEN j = v THEN ':id' ELSE f[j] END), '/') END AS pattern FROM i""")
def detail_patterns(t):
    """T-29."""
    rows = t("pages").select("page_id", "url", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("site"))
    return discovery.detail_pattern(rows, "site", "url", "page_id")


CAPTURED = ["https://a.com/jobs", "https://a.com/jobs/7", "https://a.com/x?q=1", "", None]
SHAPES = ["https://a.com/jobs*", "https://a.com/jobs", "", "https://a.com/x?q=*"]


@query(f"""SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'listing' WHEN coalesce(u <> '' AND s <> '' AND u LIKE replace(s, '*', '%'), false) THEN 'listing' ELSE 'detail' END AS scope FROM (SELECT event_id, {pick_sql('event_id', CAPTURED)} AS u, {pick_sql('event_id', SHAPES)} AS s FROM events)""")
def field_scopes(t):
    """P16."""
    return t("events").select("event_id", discovery.field_scope(pick("event_id", CAPTURED), F.col("event_id") % 3, pick("event_id", SHAPES)).alias("scope"))


FRAMES = ['<iframe src="https://boards.greenhouse.io/x">', "<p>no frame", "<iframe class=a src='//jobs.lever.co/y'></iframe>", '<iframe src="https://a.com/z"><iframe src="https://app.civi.co.il/p?id=1">', '<iframe src="https://evil-lever.co/">', '<iframe src="/own"><IFRAME SRC="https://X.Comeet.com/w">']
_FRAME = ["greenhouse|https://boards.greenhouse.io/x", None, "lever|https://jobs.lever.co/y", "civi|https://app.civi.co.il/p?id=1", None, "comeet|https://X.Comeet.com/w"]


@query(f"SELECT event_id, {pick_sql('event_id', _FRAME)} AS board, CASE WHEN event_id % 2 = 0 THEN 'workday' END AS vendor FROM events")
def embedded_boards(t):
    """C14: what six snippets hold is written out in the SQL."""
    got = discovery.embedded_board(pick("event_id", FRAMES), F.lit("a.com"))
    host = F.when(F.col("event_id") % 2 == 0, "x.MyWorkdayJobs.com").otherwise("notmyworkdayjobs.com")
    return t("events").select("event_id", F.when(got.isNotNull(), F.concat_ws("|", got["vendor"], got["url"])).alias("board"), discovery.vendor(host).alias("vendor"))


@query("""SELECT c_custkey, coalesce(s.o, b.n_name) AS item FROM customer LEFT JOIN (SELECT o_custkey % 10 AS k, min(o_orderstatus) || '-' || (o_custkey % 10) AS o FROM orders GROUP BY 1) s ON c_custkey % 50 = s.k LEFT JOIN nation b ON c_custkey % 50 = n_nationkey""")
def vendor_skeletons(t):
    """Saved settings win over built-in ones."""
    saved = t("orders").groupBy((F.col("o_custkey") % 10).alias("k")).agg(F.min("o_orderstatus").alias("s")).select("k", F.concat_ws("-", "s", F.col("k").cast("string")).alias("item"))
    built_in = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("item"))
    return discovery.skeletons(t("customer").select("c_custkey", (F.col("c_custkey") % 50).alias("k")), saved, built_in, "k", "item").select("c_custkey", "item")


STATED = ["Showing 10 of 250", "1-20 of 99 jobs", "we have 042 open positions", "דרושים: 15 משרות", "found 7 results", "33 results", "0 jobs", "12345 results", "none", ""]
_STATED = ["10 of 250", "1 of 99", "42", "15", "7", "33", None, None, None, None]


@query(f"SELECT event_id, coalesce({pick_sql('event_id', _STATED)} || ' (extracted)', '') AS stated FROM events")
def stated_counts(t):
    """T-37: what ten texts state is written out in the SQL."""
    return t("events").select("event_id", discovery.visible_count(pick("event_id", STATED)).alias("stated"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type || '@' || user_id || '.org' END AS mail FROM events")
def hidden_mails(t):
    """T-36: addresses hidden with the event's number as the key come back."""
    plain, key = F.concat("event_type", F.lit("@"), F.col("user_id").cast("string"), F.lit(".org")), (F.col("event_id") % 256).cast("int")
    two = lambda n: F.lpad(F.lower(F.hex(n.cast("bigint"))), 2, "0")
    hidden = F.concat(two(key), F.array_join(F.transform(F.split(plain, ""), lambda c: two(F.ascii(c).bitwiseXOR(key))), ""))
    return t("events").select("event_id", discovery.hidden_mail(F.when(F.col("event_id") % 5 == 0, "no hex").otherwise(hidden)).alias("mail"))


@query("SELECT event_type, count_if(value > 20) AS hits, count(*) AS n, count_if(value > 20) / count(*) >= 0.5 AS accepted FROM events GROUP BY 1 UNION ALL SELECT event_type || '2', count_if(value > 300), count(*), count_if(value > 300) / count(*) >= 0.5 FROM events GROUP BY 1")
def accepted_selectors(t):
    """C28."""
    e = t("events")
    return discovery.accepted(e, "event_type", F.col("value") > 20).unionByName(discovery.accepted(e.withColumn("event_type", F.concat("event_type", F.lit("2"))), "event_type", F.col("value") > 300))


@query("""SELECT user_id, count(*) AS n, min_by(p || ' -> ' || c, event_id) AS example FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'center' ELSE 'Haifa' END AS p, CASE WHEN event_type = 'view' THEN 'Holon' WHEN event_type = 'click' THEN 'Haifa' END AS c FROM events) WHERE p = 'center' AND c IS NOT NULL GROUP BY 1""")
def coarse_places(t):
    """A20."""
    e = t("events").withColumns({"p": F.when(F.col("event_id") % 2 == 0, "center").otherwise("Haifa"), "c": F.when(F.col("event_type") == "view", "Holon").when(F.col("event_type") == "click", "Haifa")})
    return discovery.coarse_places(e, "user_id", "p", "c", F.col("p") == "center", "event_id")


@query("""WITH v AS (SELECT unnest([event_type, 'k' || (user_id % 7)]) AS name FROM events) SELECT name, count(*) AS n FROM v WHERE name NOT IN ('view', 'click', 'k1', 'k2') GROUP BY 1""")
def outside_vocabulary(t):
    """G7."""
    known = t("events").select(F.explode(F.array(*map(F.lit, ["view", "click", "k1", "k2"]))).alias("name")).distinct()
    return discovery.outside(t("events").select(F.array("event_type", F.concat(F.lit("k"), (F.col("user_id") % 7).cast("string"))).alias("v")), "v", known, "name")


@query("""WITH s AS (SELECT o_custkey, count(*) AS n, count_if(o_orderstatus = 'F') AS a, count_if(o_totalprice > 200000) AS b FROM orders GROUP BY 1)
SELECT count(*) AS sites, CAST(sum(n) AS BIGINT) AS records, CAST(sum(a) AS BIGINT) AS no_form, CAST(sum(b) AS BIGINT) AS no_location, count_if(b > 1) AS repeating, round(sum(a) * 100.0 / sum(n), 1) AS no_form_share, round(sum(b) * 100.0 / sum(n), 1) AS no_location_share FROM s""")
def fleet_totals(t):
    """Totals of the sites' own counts, and their shares."""
    s = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_totalprice") > 200000).alias("b"))
    share = lambda c: F.round(F.sum(c) * 100.0 / F.sum("n"), 1)
    return s.agg(F.count("*").alias("sites"), F.sum("n").alias("records"), F.sum("a").alias("no_form"), F.sum("b").alias("no_location"), F.count_if(F.col("b") > 1).alias("repeating"), share("a").alias("no_form_share"), share("b").alias("no_location_share"))
