"""Where a site keeps its records: JSON listings scored by key and value, links, detail addresses, embedded boards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import urls
from sparkloom.functions.text import col, let
from sparkloom.operators.groups import latest_per_group

# For each field the names of JSON keys that are it, that hint at it, and the Hebrew ones; then what its
# value adds (pattern, amount) and the lengths below and above which the confidence is halved.
KEYS = {
    "title": ("title|jobTitle|job_title|position|positionName|position_name|name|jobName|job_name", "title|position|job.*name", "כותרת|שם_משרה|שםמשרה|תפקיד|שם.*משרה"),
    "company": ("company|companyName|company_name|employer|organization|org|orgName|org_name", "company|employer|org", "חברה|מעסיק|שם_חברה|שםחברה|ארגון"),
    "location": ("location|city|area|address|region|place", "location|city|area|address|region|place", "מיקום|עיר|אזור|כתובת"),
    "salary": ("salary|pay|wage|compensation|minSalary|maxSalary|salaryRange|salary_range|min_salary|max_salary", "salary|pay|wage|compensation", "שכר|משכורת|שכר_ברוטו"),
    "description": ("description|desc|summary|details|about|content|body", "description|desc|summary|details|about|content|body", "תיאור|פירוט|תיאור_המשרה"),
}
VALUES = {
    "title": ([(r"(?s)^.{5,100}$", 0.05)], 3, 200),
    "company": ([(r"(?s)^.{2,80}$", 0.05)], 1, 150),
    "location": ([(r"(?i)\b(tel\s*aviv|jerusalem|haifa|israel|remote|hybrid)\b", 0.05), ("תל אביב|ירושלים|חיפה|באר שבע|רמת גן|פתח תקווה|נתניה|הרצליה", 0.05)], 1, 100),
    "salary": ([("[₪$€£]", 0.05), (r"(?i)\b(nis|ils|shekel)\b", 0.05), ('ש"ח|שקל', 0.05), (r"[0-9]", 0.03)], 0, None),
    "description": ([(r"(?s)^.{51,}$", 0.05)], 10, None),
}
# Paths and words of links that lead to records, and paths that don't.
LINK_PATHS = ["/jobs", "/careers", "/positions", "/vacancies", "/openings", "/hiring", "/משרות", "/דרושים", "/קריירה"]
LINK_WORDS = ["jobs", "careers", "positions", "openings", "vacancies", "hiring", "משרות", "דרושים", "קריירה", "כל המשרות", "חיפוש משרות", "עבודות"]
OTHER_PATHS = ["/about", "/contact", "/login", "/register", "/blog", "/news", "/privacy", "/terms", "/faq"]
# Words and paths of links to a site's terms.
POLICY_WORDS = ["terms", "terms of use", "terms of service", "terms and conditions", "privacy policy", "privacy", "legal", "site terms", "user agreement", "conditions of use", "acceptable use", "disclaimer", "cookie policy", "תנאי שימוש", "מדיניות פרטיות", "תקנון", "הצהרה משפטית", "תנאי שימוש באתר", "פרטיות", "תנאים", "משפטי", "מדיניות", "תנאים והגבלות", "תנאי השירות"]
POLICY_PATHS = ["/terms", "/terms-of-use", "/terms-of-service", "/terms-and-conditions", "/tos", "/privacy", "/privacy-policy", "/legal", "/site-terms", "/user-agreement", "/takanon", "/takanim", "/conditions", "/disclaimer"]
# Hosts of recruiting systems.
BOARDS = {"workday": r"(^|\.)myworkdayjobs\.com$", "greenhouse": r"(^|\.)greenhouse\.io$", "lever": r"(^|\.)lever\.co$", "comeet": r"(^|\.)comeet\.(com|co)$", "icims": r"(^|\.)icims\.com$", "smartrecruiters": r"(^|\.)smartrecruiters\.com$", "ashby": r"(^|\.)ashbyhq\.com$", "civi": r"(^|\.)civi\.co\.il$"}
# Phrases that state a number of records, and how many numbers each has.
COUNTS = [(r"(?i)showing\s+(\d+)\s+of\s+(\d+)", 2), (r"(?i)(\d+)\s*[-–]\s*\d+\s+of\s+(\d+)\s+jobs?", 2), (r"(?i)(\d+)\s+(?:open\s+)?(?:jobs?|positions?|roles?|openings?|vacancies)", 1), (r"(\d{1,4})\s+(?:משרות|תפקידים|הזדמנויות|משרות פתוחות)", 1), (r"(?i)found\s+(\d+)\s+(?:jobs?|results)", 1), (r"(?i)(\d+)\s+results", 1)]


def _any(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def key_score(field: str, key: Column, value: Column) -> Column:
    """Confidence from 0 to 1 that a JSON key holds a field, by its name and one value; a null value counts as empty."""
    exact, near, hebrew = KEYS[field]
    marks, least, most = VALUES[field]
    value = F.coalesce(value, F.lit(""))
    more = reduce(lambda a, b: a + b, [F.when(value.rlike(p), x).otherwise(0.0) for p, x in marks])
    odd = (F.length(value) < least) | (F.length(value) > most if most else F.lit(False))
    score = lambda base: F.floor(F.least(F.lit(1.0), F.lit(base) + more) * F.when(odd, 0.5).otherwise(1.0) * 100 + 0.5) / 100
    return F.when(key.rlike(f"(?i)^({exact})$"), score(0.9)).when(key.rlike(f"(?i){near}"), score(0.7)).when(key.rlike(hebrew), score(0.85)).otherwise(0.0)


def listing(items: Column, seen: int = 5) -> Column:
    """What a JSON array of objects (maps of texts) holds: for each field the best key with its confidence, ties to the earlier key.

    Keys come from the first `seen` items, values from the first; `score` is the mean confidence of the fields found,
    less for arrays of fewer than five items. An empty or null array finds nothing and scores 0.
    """
    keys = F.array_distinct(F.flatten(F.transform(F.slice(items, 1, seen), F.map_keys)))
    keyed = let(F.get(items, 0), lambda first: F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.try_element_at(first, k).alias("value"), (-i).alias("at"))))

    def best(field, each):
        scored = F.transform(each, lambda x: F.struct(key_score(field, x["key"], x["value"]).alias("confidence"), x["at"].alias("at"), x["key"].alias("key")))
        top = F.array_compact(F.array(F.array_max(F.filter(scored, lambda x: x.confidence > 0))))
        return F.transform(top, lambda x: F.struct(F.lit(field).alias("field"), x["key"].alias("key"), x["confidence"].alias("confidence")))

    found = let(keyed, lambda each: F.concat(*[best(f, each) for f in KEYS]))
    return F.coalesce(found, F.array().cast("array<struct<field:string,key:string,confidence:double>>"))


def listing_score(fields: Column, items: Column) -> Column:
    total = F.aggregate(fields, F.lit(0.0), lambda a, x: a + x.confidence)
    return F.when(F.size(fields) > 0, total / F.size(fields) * F.least(F.lit(1.0), F.size(items) / 5)).otherwise(0.0)


def endpoints(arrays: DataFrame, group: str, path: str, items: str, position: str) -> DataFrame:
    """Per group the array of the best score among those of three items and two fields at least, ties to the first."""
    def scored(x: Column) -> Column:
        made = let(listing(x), lambda f: F.array(F.struct(f.alias("fields"), listing_score(f, x).alias("score"), F.size(x).alias("n"))))
        return F.filter(F.when(F.size(x) >= 3, made), lambda r: F.size(r["fields"]) >= 2)

    # the outer form: no filter that scores the arrays once more
    found = arrays.select(group, path, position, F.inline_outer(let(F.col(items), scored))).where(F.col("n").isNotNull())
    return latest_per_group(found, [group], [F.col("score").desc(), F.col(position)])


def json_path(path: Column, key: Column) -> Column:
    """Where a key of an array's items stands; $ is the root."""
    return F.concat(F.when(path == "$", "$").otherwise(F.concat(F.lit("$."), path)), F.lit("[*]."), key)


def link_score(url: Column, words: Column, in_menu: Column, in_footer: Column) -> Column:
    """How likely a link leads to records; the place on the screen isn't known and adds nothing."""
    url, words = F.lower(url), F.lower(words)
    points = [(_any(url, LINK_PATHS), 5), (_any(words, LINK_WORDS), 3), (in_menu, 2), (_any(url, OTHER_PATHS), -3), (in_footer, -2)]
    return reduce(lambda a, b: a + b, [F.when(c, n).otherwise(0) for c, n in points])


def policy_link_score(url: Column, words: Column) -> Column:
    """8, 6 or 4 for a link whose text and path, text, or path speak of terms, 2 more for a text that says nothing else and for a document; null for others."""
    low = F.lower(F.trim(words))
    by_text, by_path = _any(low, POLICY_WORDS), _any(F.lower(urls.path(url)), POLICY_PATHS)
    base = F.when(by_text & by_path, 8).when(by_text, 6).when(by_path, 4)
    return base + F.when(low.isin(POLICY_WORDS), 2).otherwise(0) + F.when(urls.file_type(url).isNotNull(), 2).otherwise(0)


def policy_path_score(url: Column) -> Column:
    path = F.lower(urls.path(url))
    return F.when(_any(path, ["terms", "takanon"]), 7).when(_any(path, ["privacy", "legal"]), 6).otherwise(4)


def policy_candidates(links: DataFrame, site: str, url: str, score: str, order: list[Column], most: int = 4) -> DataFrame:
    """The best-scored addresses of each site, one for each address without case and last slash (the first seen)."""
    key = F.regexp_replace(F.lower(url), "/$", "")
    once = latest_per_group(links.where(F.col(score).isNotNull()).withColumn("_key", key), [site, "_key"], order).drop("_key")
    return latest_per_group(once, [site], [F.col(score).desc(), *order], most)


def detail_pattern(links: DataFrame, site: str, url: str, order: str, seen: int = 20) -> DataFrame:
    """Per site the path of its first link with :id for the first segment that differs among its first links; null without one."""
    top = latest_per_group(links, [site], [F.col(order)], seen)
    parts = F.filter(F.split(urls.path(url), "/"), lambda s: s != "")
    got = top.groupBy(site).agg(F.min_by(parts, F.col(order)).alias("_f"), F.collect_list(parts).alias("_l"))
    differs = lambda s, i: F.exists("_l", lambda u: (F.size(u) == F.size("_f")) & (F.get(u, i) != s))
    at = F.array_position(F.transform("_f", differs), F.lit(True))
    shown = F.concat(F.lit("/"), F.array_join(F.transform("_f", lambda s, i: F.when(i + 1 == at, ":id").otherwise(s)), "/"))
    return got.select(site, F.when(at > 0, shown).alias("pattern"))


def field_scope(captured: Column, steps: Column, listing_page: Column) -> Column:
    """listing for every field of a flow of one step, and for those captured where its first pattern (* is any text) fits; else detail."""
    shape = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(listing_page, r"[.+?^${}()|\[\]\\]", r"\\$0"), r"\*", ".*"), F.lit("$"))
    fits = (F.length(captured) > 0) & (F.length(listing_page) > 0) & ((captured == listing_page) | F.rlike(captured, shape))
    return F.when(steps < 2, "listing").when(F.coalesce(fits, F.lit(False)), "listing").otherwise("detail")


def vendor(host: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(host).rlike(p), v) for v, p in BOARDS.items()])


def embedded_board(html: Column | str, host: Column) -> Column:
    """vendor and address of the first frame of another host that is a recruiting system's; null without one."""
    found = F.regexp_extract_all(col(html), F.lit(r"""(?i)<iframe\b[^>]*\bsrc=["']([^"']+)["']"""), 1)
    whole = F.transform(found, lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u))
    named = F.transform(whole, lambda u: F.struct(F.lower(F.regexp_extract(u, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)).alias("host"), u.alias("url")))
    good = F.filter(named, lambda x: (x.host != F.lower(host)) & vendor(x.host).isNotNull())
    first = F.get(good, 0)
    return F.when(first.isNotNull(), F.struct(vendor(first["host"]).alias("vendor"), first["url"].alias("url")))


def skeletons(sites: DataFrame, saved: DataFrame, built_in: DataFrame, key: str, value: str) -> DataFrame:
    """Sites with the settings of their vendor: what was saved last, else what is built in. Both lists have a row a vendor."""
    side = lambda d, n: d.select(key, F.col(value).alias(n))
    both = sites.join(side(saved, "_s"), key, "left").join(side(built_in, "_b"), key, "left")
    return both.withColumn(value, F.coalesce("_s", "_b")).drop("_s", "_b")


def visible_count(c: Column | str) -> Column:
    """The number of records that a page's text states, "a of b" or a number from 1 to 9,999, marked as extracted; empty without one."""
    text = col(c)

    def one(pattern, groups):
        a = F.regexp_extract(text, pattern, 1)
        if groups == 2:
            return F.when(a != "", F.concat(a, F.lit(" of "), F.regexp_extract(text, pattern, 2)))
        n = a.try_cast("bigint")
        return F.when(n.between(1, 9999), n.cast("string"))

    found = F.coalesce(*[one(*x) for x in COUNTS])
    return F.coalesce(F.concat(found, F.lit(" (extracted)")), F.lit(""))


def hidden_mail(c: Column | str) -> Column:
    """An address whose bytes are written in hexadecimal, each one xor the first; null if it isn't that."""
    hexed = col(c)
    number = lambda at: F.conv(F.substr(hexed, at, F.lit(2)), 16, 10).cast("int")
    each = F.transform(F.sequence(F.lit(3), F.length(hexed), F.lit(2)), lambda at: F.char(number(at).bitwiseXOR(number(F.lit(1)))))
    return F.when(hexed.rlike("^[0-9a-fA-F]{3,}$"), F.array_join(each, ""))


def accepted(rows: DataFrame, field: str, hit: Column, least: float = 0.5) -> DataFrame:
    """Per suggested selector its hits, rows and whether it holds on enough of them."""
    found = rows.groupBy(field).agg(F.count_if(hit).alias("hits"), F.count("*").alias("n"))
    return found.withColumn("accepted", F.col("hits") / F.col("n") >= least)


def coarse_places(records: DataFrame, site: str, place: str, city: str, coarse: Column, position: str) -> DataFrame:
    """Per site the records whose place is coarse while their text names a city, with the first example."""
    hit = coarse & F.col(city).isNotNull() & (F.col(city) != F.col(place))
    return records.where(hit).groupBy(site).agg(F.count("*").alias("n"), F.min_by(F.concat(place, F.lit(" -> "), city), position).alias("example"))


def outside(rows: DataFrame, values: str, vocabulary: DataFrame, name: str) -> DataFrame:
    """Values of an array column that a vocabulary lacks, with their number; counted before they are looked up."""
    counts = rows.select(F.explode(values).alias(name)).where(F.length(F.trim(name)) > 0).groupBy(name).agg(F.count("*").alias("n"))
    return counts.join(vocabulary.select(name).distinct(), name, "left_anti")
