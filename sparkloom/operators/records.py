"""Raw field maps to validated, deduplicated, identified records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import dates, ids, text
from sparkloom.operators import places
from sparkloom.operators.groups import first_occurrence, mark_duplicates

# The fields of a record, and lengths beyond which a value is suspect.
FIELDS = ["title", "description", "requirements", "location", "department", "externalJobId", "publishDate", "deadline", "applicationInfo"]
LONG = {"title": 200, "location": 150, "department": 150, "externalJobId": 100}
# What page furniture looks like when a selector catches it.
FURNITURE = [r"(?i)^\s*(?:about(?: us)?|home(?:page)?|contact(?: us)?|privacy(?: policy)?|terms(?: of (?:use|service))?)\s*$", r"על החברה|אודות|עמוד הבית|צור קשר|מדיניות פרטיות|תנאי שימוש|תקנון", r"(?i)לחצו עם העכבר|press esc"]

# How keys begin that say where a recovered field came from.
PROSE_MARK, TITLE_MARK = "_enrichedFromDescription_", "_enrichedFromTitle_"


def normalise(raw: DataFrame, fields: str = "raw") -> DataFrame:
    """The columns of FIELDS, url and additional (map) from a map of raw strings."""
    m = F.col(fields)
    get = lambda k: text.present(F.try_element_at(m, F.lit(k)))
    multi = {"description", "requirements"}
    clean = {f: (text.many_lines if f in multi else text.one_line)(text.strip_html(F.try_element_at(m, F.lit(f)))) for f in FIELDS}
    clean["description"] = text.let(clean["description"], lambda d: F.when(text.looks_like_css(d), "").otherwise(text.structure(d)))
    clean["applicationInfo"] = F.coalesce(text.present(clean["applicationInfo"]), get("_formData"), F.lit(""))
    url = F.coalesce(*[get(k) for k in ("detailUrl_href", "title_href", "_detailUrl", "detailUrl")], F.lit(""))
    standard = F.array(*[F.lit(x) for f in [*FIELDS, "detailUrl"] for x in (f, f + "_href")])
    extra = F.transform_values(F.map_filter(m, lambda k, v: ~F.array_contains(standard, k) & ~k.startswith("_")), lambda k, v: text.one_line(text.strip_html(v)))
    return raw.withColumns({**clean, "url": url, "additional": extra})


def recover(records: DataFrame) -> DataFrame:
    """Empty fields from the prose, never over a value; `additional` says which."""
    records = records.withColumn("_prose", F.concat_ws("\n", "description", "requirements"))
    prose = F.col("_prose")
    found = {
        "location": text.labelled(prose, "location"),
        "department": text.labelled(prose, "department", line_leading=True, most=60),
        "externalJobId": F.coalesce(text.clean_id(text.labelled(prose, "externalJobId")), text.job_code(prose)),
        "publishDate": dates.published(prose),
        "requirements": text.requirements("description"),
        "applicationInfo": text.contact(prose),
    }
    records = records.withColumns({f"_found_{f}": F.when(F.trim(f) == "", v) for f, v in found.items()})
    records = records.withColumn("_titled", F.when((F.trim("externalJobId") == "") & F.col("_found_externalJobId").isNull(), text.job_code("title", brackets_only=True)))
    named = {f"{PROSE_MARK}{f}": F.col(f"_found_{f}") for f in found} | {f"{TITLE_MARK}externalJobId": F.col("_titled")}
    marks = F.map_from_entries(F.filter(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in named.items()]), lambda x: x.isNotNull()))
    found = {f: F.col(f"_found_{f}") for f in found} | {"externalJobId": F.coalesce("_found_externalJobId", "_titled")}
    take = {f: v.isNotNull() for f, v in found.items()}
    out = {f: F.when(take[f], found[f]).otherwise(F.col(f)) for f in found}
    out["location"] = F.trim(F.regexp_replace(F.regexp_replace(out["location"], r"\s*/\s*", " "), r"\s+", " "))
    return records.withColumns({**out, "additional": F.map_concat("additional", marks)}).drop("_prose", "_titled", *[f"_found_{f}" for f in found])


def furniture(*columns: Column | str) -> Column:
    test = F.lit(False)
    for c in columns:
        for p in FURNITURE:
            test = test | F.coalesce(text.col(c).rlike(p), F.lit(False))
    return test


def validate(records: DataFrame) -> DataFrame:
    """missing, warnings (arrays) and status: valid, or invalid: and what is missing; warnings follow after ;warn:."""
    blank = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0
    missing = F.array_compact(F.array(F.when(blank("title"), "missing_title"), F.when(furniture("title", "location"), "non_job_content")))
    warnings = F.array_compact(F.array(F.when(blank("url"), "missing_url"), *[F.when(F.length(c) > n, f"{c}_too_long") for c, n in LONG.items()]))
    out = records.withColumns({"missing": missing, "warnings": warnings})
    status = F.when(F.size("missing") == 0, "valid").otherwise(F.concat(F.lit("invalid:"), F.array_join("missing", ",")))
    return out.withColumn("status", F.concat(status, F.when(F.size("warnings") > 0, F.concat(F.lit(";warn:"), F.array_join("warnings", ","))).otherwise("")))


def raw_key(url: str, ident: str, title: str, location: str) -> Column:
    """Address first: the key of rows as they are read."""
    return F.coalesce(text.present(url), text.present(ident), F.concat_ws("|", title, location))


def record_key(url: str, ident: str, title: str, location: str) -> Column:
    """Id first: the key of normalised records."""
    return F.coalesce(text.present(ident), text.present(url), F.concat_ws("|", title, location))


def deduplicate(records: DataFrame, order: list[Column]) -> DataFrame:
    """The first of valid records with one key; a key without any content is never a duplicate."""
    key = record_key("url", "externalJobId", "title", "location")
    # the generator holds the test above the fields: as a plain filter it is made once more from the raw map, all recovery included
    valid = records.withColumn("_valid", F.explode_outer(F.array(F.col("status").startswith("valid")))).where("_valid").drop("_valid")
    return first_occurrence(valid, key, order, exempt=key == "|")


def identify(records: DataFrame, order: list[Column]) -> DataFrame:
    """Missing ids from the content; says which were made and which of those occur again."""
    own = text.present(F.trim("externalJobId"))
    out = records.withColumn("jobId", F.coalesce(own, ids.synthetic("title", "department", "url"))).withColumn("synthesised", own.isNull() & F.col("jobId").isNotNull())
    return mark_duplicates(out, F.coalesce("jobId", F.lit("")), order, "repeated").withColumn("collision", F.col("repeated") & F.col("synthesised")).drop("repeated")


def override(records: DataFrame, overrides: DataFrame, site: str = "siteId") -> DataFrame:
    """location and locations by precedence: a manual override of the record's own key, the extracted value, Unknown.

    The right side stays a plain join: Spark broadcasts it only if its measured size allows.
    """
    key = F.coalesce(text.present("externalJobId"), F.col("url"))
    o = overrides.select(F.col(site).alias("_s"), F.col("jobKey").alias("_k"), F.col("locations").alias("_l"))
    out = records.withColumn("_key", key).join(o, F.expr(f"{site} = _s and _key = _k"), "left")
    out = out.withColumn("locations", F.coalesce("_l", text.split_values("location")))
    return out.withColumn("location", F.coalesce(F.try_element_at("locations", F.lit(1)), text.present("location"), F.lit("Unknown"))).drop("_s", "_k", "_l", "_key")


def recover_places(records: DataFrame) -> DataFrame:
    """The last resort for an empty location: a place that title or prose name without a label, marked in `additional`."""
    found = records.withColumn("_place", F.when(F.trim("location") == "", places.from_prose(F.concat_ws("\n", "title", "description", "requirements"))))
    marks = F.when(F.col("_place").isNotNull(), F.map_concat("additional", F.create_map(F.lit(f"{PROSE_MARK}location"), F.col("_place")))).otherwise(F.col("additional"))
    return found.withColumns({"location": F.coalesce("_place", "location"), "additional": marks}).drop("_place")


def stored(records: DataFrame) -> DataFrame:
    """As a row is kept: a title by default, empty texts as null."""
    empty = {f: text.present(F.trim(f)) for f in FIELDS if f != "title"}
    return records.withColumns({**empty, "title": F.coalesce(text.present(F.trim("title")), F.lit("Untitled"))})


def pipeline(raw: DataFrame, order: list[Column], fields: str = "raw") -> DataFrame:
    """raw -> normalise -> recover -> validate -> deduplicate -> identify."""
    return identify(deduplicate(validate(recover(normalise(raw, fields))), order), order)
