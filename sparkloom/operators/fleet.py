"""Verdicts and reports over sites and their records: activation, coverage, warnings, work lists, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators.groups import latest_per_group
from sparkloom.operators.scoring import first_true

# Shares of filled fields that a site needs, and the labels and actions of failures.
NEEDED = {"title": 0.8, "description": 0.6, "externalJobId": 0.9}
FAILURES = {"timeout": ("Timeout", "retry"), "structure_changed": ("Structure Changed", "fix"), "empty_results": ("Empty Results", "investigate")}


def activation(records: DataFrame, site: str, order: list[Column], sample: int = 30) -> DataFrame:
    """Per site status and reason: ACTIVE where a sample of its records fills the fields and any has a way to apply."""
    rows = latest_per_group(records, [site], order, sample)
    rate = lambda f: F.avg(text.filled(f).cast("double"))
    found = rows.groupBy(site).agg(*[rate(f).alias(f"_{f}") for f in NEEDED], F.bool_or(text.filled("applicationInfo") | text.filled("url")).alias("_apply"))
    short = [F.when(F.col(f"_{f}") < least, F.concat(F.lit(f"{f} fill "), F.floor(F.col(f"_{f}") * 100 + 0.5).cast("string"), F.lit(f"% < {round(least * 100)}%"))) for f, least in NEEDED.items()]
    missing = F.array_compact(F.array(*short, F.when(~F.col("_apply"), "no apply path")))
    return found.withColumn("_m", missing).select(site, F.when(F.size("_m") == 0, "ACTIVE").otherwise("REVIEW").alias("status"), F.array_join("_m", "; ").alias("reason"))


def warnings(records: DataFrame, site: str, most_unknown: float = 0.4) -> DataFrame:
    """Per site the number of records without location and of dead pages, and a warning where the former are many."""
    unknown = ~text.filled("location") | (F.col("location") == "Unknown")
    found = records.groupBy(site).agg(F.count("*").alias("n"), F.count_if(unknown).alias("unknown"), F.count_if(F.coalesce(F.col("dead"), F.lit(False))).alias("dead"))
    text_ = F.concat(F.lit("unknown_location_rate: "), "unknown", F.lit("/"), "n")
    return found.withColumn("warning", F.when(F.col("unknown") / F.col("n") > most_unknown, text_))


def latest_failed(sites: DataFrame, runs: DataFrame, site: str, failed: Column, order: list[Column]) -> DataFrame:
    """Sites that have a failed run, with the latest one."""
    return sites.join(latest_per_group(runs.where(failed), [site], order), site)


def failure_label(category: Column) -> Column:
    return F.coalesce(*[F.when(category == k, label) for k, (label, _) in FAILURES.items()], F.lit("Unknown Error"))


def failure_action(category: Column) -> Column:
    return F.coalesce(*[F.when(category == k, action) for k, (_, action) in FAILURES.items()], F.lit("retry"))


def health_colour(rate: Column) -> Column:
    """green from 90 percent, amber from 70, else red."""
    return F.when(rate >= 90, "#22c55e").when(rate >= 70, "#f59e0b").otherwise("#ef4444")


def coverage(rows: DataFrame, status: str, domain: list[str], unchecked: str) -> DataFrame:
    """One row: the number of each status, of all, and of those that were checked."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in domain]
    return rows.agg(*counts, F.count("*").alias("total"), F.count_if(F.col(status) != unchecked).alias("checked"))


def mode(rows: DataFrame, group: str, value: str, position: str, least: int = 2) -> DataFrame:
    """The commonest value of each group with its count, ties to the first seen; groups whose mode is rarer than `least` go."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(position).alias("_first"))
    best = counts.groupBy(group).agg(F.max_by(F.struct(value, "n"), F.struct("n", (-F.col("_first")).alias("x"))).alias("b"))
    return best.select(group, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n")).where(F.col("n") >= least)


def form_status(captured: Column, manual: Column, email: Column, link: Column) -> Column:
    return first_true((captured, "CAPTURED"), (manual, "NEEDS_MANUAL"), (email, "EMAIL"), (link, "URL"), otherwise="NONE")


def bucket(missing: Column, low: Column) -> Column:
    """BROKEN if a needed field is missing, TIER_B_GAPS if only others are low."""
    return first_true((missing > 0, "BROKEN"), (low > 0, "TIER_B_GAPS"), otherwise="OK")


def static_form(static_fields: Column, live_fields: Column) -> Column:
    """Which capture of a form counts: the stored one from two fields on, else the live one if it has any."""
    return first_true((static_fields >= 2, "static"), (live_fields > 0, "live"), otherwise="none")


def strategy(explicit: Column, matched: Column, automatic: Column) -> Column:
    """explicit selectors, unless they match one item at most or lose rows where automatic detection finds more."""
    return F.when(((matched <= 1) | (explicit < matched)) & (automatic > explicit), "auto").otherwise("explicit")


def lane(reachable: Column, known: Column, cluster: Column) -> Column:
    """Triage of a new site: RED unreachable, GREEN a known system, YELLOW a listing, GRAY neither."""
    return first_true((~reachable, "RED"), (known, "GREEN"), (cluster >= 3, "YELLOW"), otherwise="GRAY")


def reach(plain: Column, override: Column) -> Column:
    """How a page can be had, from two fetches that may be blocked."""
    return first_true((~plain, "plain"), (~override, "needs_override"), otherwise="unreachable")


def work_list(requested: DataFrame, sites: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """outcome of each requested address: a repeat in the batch, what the known site's status says, or new."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    known = sites.select(F.col(key).alias("_k"), F.col("status").alias("_status"))
    rows = requested.withColumn("_again", rank > 1).join(known, F.col(key) == F.col("_k"), "left")
    outcome = first_true((F.col("_again"), "DUPLICATE"), (F.col("_status").isNull(), "NEW"), (F.col("_status") == "ACTIVE", "EXISTS"), (F.col("_status") == "SKIPPED", "SKIPPED"), otherwise="RETRY")
    return rows.withColumn("outcome", outcome).drop("_again", "_k", "_status")


def seeded(details: DataFrame, seeds: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Detail rows with the fields of the first listing row of their key."""
    first = latest_per_group(seeds, [key], order)
    return details.join(first, key, "left")


def place_list(rows: DataFrame, name: str, region: str, seeds: list[str]) -> DataFrame:
    """A vocabulary: names of a table and of a short list, once each, with kind and rank, the longest first."""
    made = rows.select(F.trim(name).alias("name")).union(rows.sparkSession.createDataFrame([(s,) for s in seeds], "name string")).where("length(name) > 0").distinct()
    return made.select("name", F.when(F.col("name").rlike(region), "region").otherwise("city").alias("kind"), F.length("name").alias("length"))


def changed(group: str, content: list[str], order: list[Column]) -> Column:
    """Whether a row's content differs from that of the one before in its group."""
    mark = F.sha1(F.concat_ws("\x01", *content))
    before = F.lag(mark).over(Window.partitionBy(group).orderBy(*order))
    return F.coalesce(mark != before, F.lit(False))


def stamps(new: Column, at: Column) -> list[Column]:
    """For each status the time at which a change to it is recorded."""
    names = {"ANALYZING": "analyzingAt", "REVIEW": "reviewAt", "ACTIVE": "activeAt", "FAILED": "failedAt", "SKIPPED": "skippedAt"}
    return [F.when(new == s, at).alias(n) for s, n in names.items()]
