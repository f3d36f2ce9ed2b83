"""Site policies: robots files, restrictive terms, merged verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.groups import carry_forward, severity_max, whole_mean

# Statuses from least to most severe.
SEVERITY = ["CHECK_FAILED", "NO_EXPLICIT_RESTRICTION", "POLICY_NOT_FOUND", "UNCLEAR_NEEDS_REVIEW", "REQUIRES_WRITTEN_PERMISSION", "RESTRICTED"]
CAREER_PATH = r"(?i)/jobs|/careers|/work|/משרות|/קריירה"


def robots(files: DataFrame, key: str, body: str) -> DataFrame:
    """checked, disallows_all, relevant_rules and sitemaps of robots files; of consecutive user agents the last counts."""
    lines = files.select(key, F.posexplode(F.split(F.col(body), r"\r?\n")).alias("pos", "raw")).withColumn("line", F.trim("raw"))
    lines = lines.where((F.length("line") > 0) & ~F.col("line").startswith("#") & F.contains("line", F.lit(":")))
    lines = lines.withColumn("directive", F.lower(F.trim(F.substring_index("line", ":", 1)))).withColumn("value", F.trim(F.regexp_replace("line", "^[^:]*:", "")))
    agent = carry_forward([key], [F.col("pos")], F.when(F.col("directive") == "user-agent", F.col("value")))
    lines = lines.withColumn("agent", agent)
    rule = (F.col("directive") == "disallow") & (F.col("agent") == "*")
    relevant = rule & (F.col("value").isin("/", "") | F.col("value").rlike(CAREER_PATH))
    ordered = lambda test, what: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", F.col(what).alias("x"))))), lambda s: s.x)
    found = lines.groupBy(key).agg(F.coalesce(F.bool_or(rule & (F.col("value") == "/")), F.lit(False)).alias("disallows_all"), ordered(relevant, "line").alias("relevant_rules"), ordered((F.col("directive") == "sitemap") & (F.col("value") != ""), "value").alias("sitemaps"))
    none = F.array().cast("array<string>")
    return files.select(key).join(found, key, "left").select(key, F.lit(True).alias("checked"), F.coalesce("disallows_all", F.lit(False)).alias("disallows_all"), F.coalesce("relevant_rules", none).alias("relevant_rules"), F.coalesce("sitemaps", none).alias("sitemaps"))


def merge_verdicts(rows: DataFrame, key: str, status: str, confidence: str, terms: str, most_terms: int = 20) -> DataFrame:
    """Per key the most severe status, mean confidence, and terms seen (sorted, at most so many)."""
    return rows.groupBy(key).agg(severity_max(F.col(status), SEVERITY).alias("status"), whole_mean(F.col(confidence)).alias("confidence"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(terms)))), 1, most_terms).alias("terms"))


def nudge(status: Column, disallows_all: Column) -> Column:
    """No explicit restriction becomes unclear where robots are kept out entirely."""
    return F.when((status == "NO_EXPLICIT_RESTRICTION") & disallows_all, "UNCLEAR_NEEDS_REVIEW").otherwise(status)


def link_score(text: Column, path: Column) -> Column:
    """Rank of a link that may lead to a policy: terms before privacy before legal."""
    both = F.lower(F.concat_ws(" ", text, path))
    return F.when(both.rlike("terms|תנאי"), 8).when(both.rlike("privacy|פרטיות"), 6).when(both.rlike("legal|policy|מדיניות"), 4).otherwise(0)
