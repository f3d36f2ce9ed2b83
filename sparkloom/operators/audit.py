"""A site's records counted by what they lack, and the list of sites to repair.

Fields are read where a record has them: description and requirements from the raw map
first, all others from the record's own columns first. One aggregation by site; ids
that occur again are counted by site and id first, so no set of ids is held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a site's records from which on a lack is an issue, and the one for lacking requirements along with blobs.
ISSUE, JOINT = 0.1, 0.5
BLOB_LETTERS = 200
EMAIL, URL = r"mailto:|[\w.+-]+@[\w.-]+\.\w+", r"(?i)^https?://"
#: Statuses of sites in the order of the list; others follow.
STATUSES = ["ACTIVE", "REVIEW", "FAILED", "SKIPPED"]
FIELDS = ["description", "requirements", "location", "externalJobId", "applicationInfo", "detailUrl"]


def present(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def field(name: str, raw: str = "raw") -> Column:
    """A record's field from its column and its raw map; null where it has neither."""
    both = [F.col(name), F.try_element_at(F.col(raw), F.lit(name))]
    return F.coalesce(*(both[::-1] if name in ("description", "requirements") else both))


def has_form(raw: str = "raw") -> Column:
    """Whether a captured form is an object with at least one field; what doesn't parse is none."""
    form = F.trim(F.try_element_at(F.col(raw), F.lit("_formData")))
    return F.coalesce(form.startswith("{") & (F.size(F.from_json(form, "fields array<string>")["fields"]) >= 1), F.lit(False))


def audited(records: DataFrame, site: str, raw: str = "raw") -> DataFrame:
    """Per site its records and how many lack a form (and have another way to apply), a place, a text, requirements, an id; places that are Unknown; ids that occur again; texts and walls of text."""
    rows = records.select(site, has_form(raw).alias("form"), *[field(f, raw).alias(f) for f in FIELDS])
    text, no_form = F.col("description"), ~F.col("form")
    other = F.coalesce(F.col("applicationInfo").rlike(f"{EMAIL}|{URL}"), F.lit(False)) | F.coalesce(F.col("detailUrl").rlike(URL), F.lit(False))
    counts = {
        "noForm": no_form, "hasFallback": no_form & other, "noLocation": ~present(F.col("location")), "unknownLocation": F.col("location") == "Unknown", "noDescription": ~present(text),
        "noRequirements": ~present(F.col("requirements")), "noExternalId": ~present(F.col("externalJobId")), "descriptions": present(text), "blobs": present(text) & (F.length(text) > BLOB_LETTERS) & ~F.contains(text, F.lit("\n")),
    }
    per_id = rows.groupBy(site, F.when(present(F.col("externalJobId")), F.col("externalJobId")).alias("_id")).agg(F.count("*").alias("jobs"), *[F.count_if(c).alias(n) for n, c in counts.items()])
    return per_id.groupBy(site).agg(F.sum("jobs").alias("jobs"), *[F.sum(n).alias(n) for n in counts], F.count_if(F.col("_id").isNotNull() & (F.col("jobs") > 1)).alias("duplicateIds"))


def issues(status: Column) -> Column:
    """What is to be repaired on a site, as texts with shares; an active site without records is an issue of its own."""
    share = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0)
    shown = lambda n, d: F.when(F.col(d) > 0, F.format_string("%.1f%%", F.col(n) * 100 / F.col(d))).otherwise("—")
    lacks = [("noForm", "No apply form"), ("noLocation", "No location"), ("noDescription", "No description"), ("noExternalId", "No externalJobId")]
    found = [F.when(share(n, "jobs") >= ISSUE, F.concat(F.lit(f"{said} ("), shown(n, "jobs"), F.lit(")"))) for n, said in lacks]
    found.append(F.when(share("blobs", "descriptions") >= ISSUE, F.concat(F.lit('Unstructured "blob" text ('), shown("blobs", "descriptions"), F.lit(")"))))
    joint = (share("noRequirements", "jobs") >= JOINT) & (share("blobs", "descriptions") >= JOINT)
    found.append(F.when(joint, F.concat(F.lit("No requirements AND unstructured ("), shown("noRequirements", "jobs"), F.lit(" / "), shown("blobs", "descriptions"), F.lit(")"))))
    found.append(F.when(F.col("duplicateIds") > 0, F.concat(F.col("duplicateIds").cast("string"), F.lit(" duplicate externalJobId value(s)"))))
    empty = F.when(status == "ACTIVE", F.array(F.lit("ACTIVE site currently has 0 jobs"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.col("jobs") == 0, empty).otherwise(F.array_compact(F.array(*found)))


def worklist(sites: DataFrame, records: DataFrame, site: str, status: str, raw: str = "raw") -> DataFrame:
    """Every site with its counts, issues and `repair` (whether it has any); `rank` orders by status, then the largest, for those to repair."""
    report = sites.select(site, status).join(audited(records, site, raw), site, "left").na.fill(0)
    report = report.withColumn("issues", issues(F.col(status))).withColumn("repair", F.size("issues") > 0)
    order = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col(status)), F.lit(0)), F.lit(len(STATUSES) + 1))
    return report.withColumn("rank", F.when(F.col("repair"), order))
