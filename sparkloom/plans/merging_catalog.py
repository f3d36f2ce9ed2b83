"""Named queries of bounded merges, capture, near names, batches and the queue's stream, beside SQL with the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import audit, enrich, merging
from sparkloom.plans.catalog import ORACLE, QUERIES, _EVENT_STATUS, query
from sparkloom.sources import batches
from sparkloom.streaming import life_cycle

_STATUS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EVENT_STATUS.items()) + " END"
_RANK = "CASE s " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(merging.SEVERITY)) + " END"


@query(rf"""WITH e AS (SELECT user_id, event_id, value, {_STATUS} AS s, [event_type, 'k' || regexp_extract(props, '\d+')] AS w, props AS p, 'u' || CAST(floor(value) AS INT) % 7 AS u FROM events),
t AS (SELECT user_id, v, min(event_id * 10 + i) AS place FROM (SELECT user_id, event_id, unnest(w) AS v, unnest([0, 1]) AS i FROM e) GROUP BY 1, 2),
k AS (SELECT user_id, string_agg(v, ',' ORDER BY place) AS terms FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY place) <= 20) GROUP BY 1),
n AS (SELECT user_id, string_agg(p, ',' ORDER BY event_id) AS snippets FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5) GROUP BY 1),
m AS (SELECT user_id, max({_RANK}) AS r, CAST(round(avg(value)) AS INT) AS confidence, count(DISTINCT u) AS n_urls FROM e GROUP BY 1)
SELECT m.user_id, (SELECT min(s) FROM e WHERE e.user_id = m.user_id AND {_RANK} = r) AS status, (SELECT min(event_id) FROM e WHERE e.user_id = m.user_id AND {_RANK} = r) AS best, confidence, terms, snippets, n_urls FROM m JOIN k USING (user_id) JOIN n USING (user_id)""")
def merged_results(t):
    """Best row, first terms and snippets, addresses, without a group's list."""
    m = F.create_map(*[x for k, v in _EVENT_STATUS.items() for x in (F.lit(k), F.lit(v))])
    e = t("events").select("user_id", "event_id", "value", m[F.col("event_type")].alias("status"), F.array("event_type", F.concat(F.lit("k"), F.regexp_extract("props", r"\d+", 0))).alias("terms"), F.array("props").alias("snippets"), F.array(F.concat(F.lit("u"), (F.floor("value").cast("int") % 7).cast("string"))).alias("urls"))
    out = merging.merge_results(e, "user_id", "event_id", "status", "value", "terms", "snippets", "urls")
    return out.withColumns({c: F.array_join(c, ",") for c in ("terms", "snippets")})


@query(r"""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS admitted FROM events WHERE value < 80 AND event_type <> 'error' AND CAST(regexp_extract(props, '\d+') AS INT) % 5 <> 0 QUALIFY admitted <= 20""")
def captured_responses(t):
    """Events stand for responses of a page: their value for a status, the type for what they hold, every fifth is a picture; the limit is 20 a page."""
    k = F.regexp_extract("props", r"\d+", 0).cast("int")
    e = t("events").withColumns({"status": F.when(F.col("value") < 80, 200).otherwise(503), "kind": F.when(F.col("event_type") == "error", "text/html").otherwise("application/json; charset=utf-8"), "address": F.concat(F.lit("https://a.example/"), "event_id", F.when(k % 5 == 0, ".png").otherwise(".data"))})
    return batches.captured(e, "user_id", [F.col("ts"), F.col("event_id")], "status", "kind", "address", "props", most=20).select("user_id", "event_id", "admitted")


@query("""SELECT a.c_name AS name, count(*) AS near FROM customer a JOIN customer b ON length(a.c_name) BETWEEN length(b.c_name) - 1 AND length(b.c_name) + 1 AND levenshtein(a.c_name, b.c_name) = 1 GROUP BY 1""")
def near_names(t):
    """J9 over many names: an equal join of shorter forms in place of all pairs."""
    c = t("customer")
    return merging.one_edit_apart(c.select(F.col("c_name").alias("name")), c.select(F.col("c_name").alias("other")), "name", "other", "times").groupBy("name").agg(F.sum("times").alias("near"))


def _shared(spark: SparkSession) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names; a local one where it is unset, on a single machine only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{named or tempfile.mkdtemp(prefix='sparkloom-')}/{uuid.uuid4().hex}"


def blobs_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in batches by key, stopped after three and resumed; per source how many are unbroken walls of text before and after their sentences are set apart."""
    rows, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), _shared(spark)
    size = -(-rows.count() // 8)
    wall = lambda c: (F.length(c) >= 400) & ~F.contains(c, F.lit("\n"))
    broken = F.regexp_replace(F.coalesce("text", F.lit("")), r"([.!?]) ", "$1\n")
    work = lambda df: df.groupBy("source").agg(F.count("*").alias("n"), F.count_if(wall(F.coalesce("text", F.lit("")))).alias("before"), F.count_if(wall(broken)).alias("after"))
    batches.scanned(spark, rows, "doc_id", size, work, folder, most=3)
    done = batches.scanned(spark, rows, "doc_id", size, work, folder)
    return done.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("n", "before", "after")])


QUERIES["blobs_in_batches"] = blobs_in_batches
ORACLE["blobs_in_batches"] = r"""WITH d AS (SELECT source, coalesce(text, '') AS x FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (length(x) >= 400 AND NOT contains(x, chr(10))) AS before, count(*) FILTER (length(x) >= 400 AND NOT contains(regexp_replace(x, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) AS after FROM d GROUP BY 1"""


def queue_life_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a worker's queue, streamed; the tests replay them second by second. Runs are cut off after 12 hours, marked from 11 hours on."""
    path, folder = f"{sf_dir}/events.parquet", _shared(spark)
    kinds = F.create_map(*[F.lit(x) for p in {"signup": "queued", "view": "saved", "click": "finished", "error": "failed", "purchase": "restarted"}.items() for x in p])
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as the table may be one file
    events = stream.select(F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kinds[F.col("event_type")].alias("kind"), F.when(F.col("event_type") == "signup", F.col("event_id")).alias("job"), F.lit(1).alias("n"))
    life_cycle.run(events, f"{folder}/rows", f"{folder}/mark", cap=43_200, near=39_600)
    return spark.read.schema(life_cycle.ROWS).parquet(f"{folder}/rows")


QUERIES["queue_life_cycle"] = queue_life_cycle


@query(r"""WITH r AS (SELECT source, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS form, text AS d, CASE WHEN lang = 'fr' THEN NULL WHEN lang = 'de' THEN 'Unknown' ELSE lang END AS place, CASE WHEN length(text) % 3 = 0 THEN 'r' END AS req, substr(md5(text), 1, 8) AS id FROM documents),
c AS (SELECT source, count(*) AS jobs, count(*) FILTER (form = 0) AS noForm, count(*) FILTER (form = 0 AND regexp_matches(d, 'mailto:|[\w.+-]+@[\w.-]+\.\w+|(?i:^https?://)')) AS hasFallback, count(*) FILTER (place IS NULL) AS noLocation, count(*) FILTER (place = 'Unknown') AS unknownLocation,
count(*) FILTER (coalesce(trim(d), '') = '') AS noDescription, count(*) FILTER (req IS NULL) AS noRequirements, count(*) FILTER (id IS NULL) AS noExternalId, count(*) FILTER (trim(d) <> '') AS descriptions, count(*) FILTER (trim(d) <> '' AND length(d) > 200 AND NOT contains(d, chr(10))) AS blobs FROM r GROUP BY 1),
u AS (SELECT source, count(*) FILTER (m > 1) AS duplicateIds FROM (SELECT source, id, count(*) AS m FROM r WHERE id IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT *, array_to_string(list_filter([CASE WHEN noForm >= 0.1 * jobs THEN printf('No apply form (%.1f%%)', noForm * 100 / jobs) END, CASE WHEN noLocation >= 0.1 * jobs THEN printf('No location (%.1f%%)', noLocation * 100 / jobs) END, CASE WHEN noDescription >= 0.1 * jobs THEN printf('No description (%.1f%%)', noDescription * 100 / jobs) END, CASE WHEN noExternalId >= 0.1 * jobs THEN printf('No externalJobId (%.1f%%)', noExternalId * 100 / jobs) END,
CASE WHEN descriptions > 0 AND blobs >= 0.1 * descriptions THEN printf('Unstructured "blob" text (%.1f%%)', blobs * 100 / descriptions) END, CASE WHEN noRequirements >= 0.5 * jobs AND descriptions > 0 AND blobs >= 0.5 * descriptions THEN printf('No requirements AND unstructured (%.1f%% / %.1f%%)', noRequirements * 100 / jobs, blobs * 100 / descriptions) END, CASE WHEN duplicateIds > 0 THEN duplicateIds || ' duplicate externalJobId value(s)' END], lambda x: x IS NOT NULL), '; ') AS issues FROM c JOIN u USING (source)""")
def quality_audit(t):
    """The ten counts and seven gates over documents as records: their copies for repeated ids, addresses in their texts for another way to apply."""
    d = t("documents")
    raw = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in {"description": F.col("text"), "_formData": F.when(F.col("doc_id") % 4 == 0, '{"fields": ["name"]}').otherwise("none")}.items()]))
    rows = d.select("source", raw.alias("raw"), F.lit(None).cast("string").alias("description"), F.when(F.length("text") % 3 == 0, "r").alias("requirements"), F.when(F.col("lang") == "de", "Unknown").when(F.col("lang") != "fr", F.col("lang")).alias("location"), F.substring(F.md5("text"), 1, 8).alias("externalJobId"), F.col("text").alias("applicationInfo"), F.lit(None).cast("string").alias("detailUrl"))
    report = audit.audited(rows, "source")
    return report.withColumn("issues", F.array_join(audit.issues(F.lit("ACTIVE")), "; "))


@query(r"""WITH p AS (SELECT page_id, url, html, CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS s, CASE WHEN page_id % 23 = 0 THEN 'Timeout 30000ms' ELSE '' END AS e, repeat(html, CASE WHEN page_id % 5 = 0 THEN 3 ELSE 1 END) AS f, coalesce(regexp_extract(url, '^https?://([^/?#]+)', 1), '') AS h FROM pages),
r AS (SELECT *, length(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>[\s\S]*?</script>', '', 'gi'), '<style\b[^>]*>[\s\S]*?</style>', '', 'gi'), '<!--[\s\S]*?-->', '', 'g')) AS n, length(regexp_replace(regexp_replace(regexp_replace(f, '<script\b[^>]*>[\s\S]*?</script>', '', 'gi'), '<style\b[^>]*>[\s\S]*?</style>', '', 'gi'), '<!--[\s\S]*?-->', '', 'g')) AS m, e = '' AND s < 400 AS good FROM p)
SELECT page_id, CASE WHEN e <> '' THEN 'no_timeout' WHEN s >= 400 THEN 'no_404' ELSE 'yes' END AS careers_url_verified, CASE WHEN NOT good THEN 'unknown' WHEN n < 5000 OR (m > 2 * n AND n < 30000) THEN 'CSR-SPA' WHEN len(regexp_extract_all(lower(html), 'job|position|career|opening|משרה|תפקיד')) >= 15 THEN 'SSR' ELSE 'Hybrid' END AS rendering,
CASE WHEN good THEN '' WHEN e <> '' THEN e ELSE 'HTTP 404' END AS enrichment_notes FROM r""")
def enriched_pages(t):
    """C13, T-25: pages as fetches of their own addresses; some are lost, some are trebled by scripts."""
    p = t("pages").withColumns({"status": F.when(F.col("page_id") % 17 == 0, 404).otherwise(200), "final": F.col("url"), "error": F.when(F.col("page_id") % 23 == 0, "Timeout 30000ms").otherwise(""), "grown": F.when(F.col("page_id") % 5 == 0, F.repeat("html", 3)).otherwise(F.col("html")), "headers": F.lit(None).cast("map<string,string>")})
    out = enrich.enriched(p, "url", "status", "final", "error", "html", "grown", "headers", "html")
    return out.select("page_id", "careers_url_verified", "rendering", "enrichment_notes")


def analysed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods over pages and one that fails, under one result schema."""
    items = F.regexp_count("html", F.lit("<li>"))
    methods = {
        "headline": lambda p: p.where(F.contains("html", F.lit("<h1>"))).select("page_id", F.lit(0.8).alias("confidence"), F.create_map(F.lit("title"), F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)).alias("fields")),
        "menu": lambda p: p.where(items >= 5).select("page_id", (F.least(items, F.lit(10)) / 10).alias("confidence"), F.create_map(F.lit("items"), items.cast("string")).alias("fields")),
        "frames": lambda p: p.select("page_id", F.col("frames.confidence"), F.col("frames.fields")),  # the table has no such column
    }
    out = merging.analysed(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", methods, _shared(spark))
    value = F.coalesce(F.try_element_at("fields", F.lit("title")), F.try_element_at("fields", F.lit("items")))
    return out.select("page_id", "method", "found", "confidence", value.alias("value"), F.col("error").isNotNull().alias("failed"))


QUERIES["analysed_pages"] = analysed_pages
ORACLE["analysed_pages"] = r"""WITH p AS (SELECT DISTINCT page_id, html, contains(html, '<h1>') AS h, len(regexp_extract_all(html, '<li>')) AS n FROM pages)
SELECT page_id, 'headline' AS method, h AS found, CASE WHEN h THEN 0.8::DOUBLE ELSE 0 END AS confidence, CASE WHEN h THEN regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) END AS value, false AS failed FROM p
UNION ALL SELECT page_id, 'menu', n >= 5, CASE WHEN n >= 5 THEN least(n, 10) / 10 ELSE 0 END, CASE WHEN n >= 5 THEN CAST(n AS VARCHAR) END, false FROM p
UNION ALL SELECT page_id, 'frames', false, 0, NULL, true FROM p"""
