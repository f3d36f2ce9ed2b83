"""Site settings kept as JSON: parsing with defaults and bounds, and replies that are checked field by field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import text

# Statuses that a reply may name.
STATUSES = ["RESTRICTED", "REQUIRES_WRITTEN_PERMISSION", "NO_EXPLICIT_RESTRICTION", "UNCLEAR_NEEDS_REVIEW", "POLICY_NOT_FOUND", "CHECK_FAILED"]
_MAPPING = "selector string, method string, confidence double"


def mappings(raw: Column) -> Column:
    """Field mappings that name a selector, with the method UNKNOWN and confidence 1 where they are missing."""
    each = F.transform_values(F.from_json(raw, "map<string,string>"), lambda k, v: F.from_json(v, _MAPPING))
    found = F.map_filter(each, lambda k, v: ~k.startswith("_") & v.selector.isNotNull())
    return F.transform_values(found, lambda k, v: F.struct(v.selector.alias("selector"), F.coalesce(v.method, F.lit("UNKNOWN")).alias("method"), F.coalesce(v.confidence, F.lit(1.0)).alias("confidence")))


def structural(raw: Column, name: str) -> Column:
    """A structural setting, from _meta first and the top level else."""
    return F.coalesce(text.present(F.get_json_object(raw, f"$._meta.{name}")), text.present(F.get_json_object(raw, f"$.{name}")))


def pagination(raw: Column) -> Column:
    """type, target, start, step, maxPages (100 at most, 20 by default), settleMs (10,000 at most, 1,200 by default); null if none is set up."""
    get = lambda n: F.get_json_object(raw, f"$._meta.pagination.{n}")
    number = lambda n: get(n).try_cast("int")
    clamp = lambda n, most, default: F.when(number(n) > 0, F.least(number(n), F.lit(most))).otherwise(default)
    kind = get("type")
    target = F.when(kind == "url", text.present(get("param"))).when(kind == "click", text.present(get("nextSelector")))
    start, step = F.when(number("start") >= 0, number("start")).otherwise(0), F.when(number("step") > 0, number("step")).otherwise(1)
    by_url = lambda x: F.when(kind == "url", x)
    out = F.struct(kind.alias("type"), target.alias("target"), by_url(start).alias("start"), by_url(step).alias("step"), clamp("maxPages", 100, 20).alias("maxPages"), clamp("settleMs", 10_000, 1200).alias("settleMs"))
    return F.when(target.isNotNull(), out)


def form_fields(raw: Column) -> Column:
    """Number of fields of a form that is kept as JSON, or as a JSON string in JSON."""
    own = F.json_array_length(F.get_json_object(raw, "$.fields"))
    return F.coalesce(own, F.json_array_length(F.get_json_object(F.get_json_object(raw, "$"), "$.fields")), F.lit(0))


def saved(meta: dict[str, Column]) -> Column:
    """The _meta block as it is stored: every key is there, null where it isn't set."""
    return F.to_json(F.struct(F.struct(*[c.alias(k) for k, c in meta.items()]).alias("_meta")), {"ignoreNullFields": "false"})


def reply(raw: Column) -> Column:
    """A classifier's reply: status (UNCLEAR_NEEDS_REVIEW unless it is known), confidence within 0 and 100 (50 without), language, at most 20 terms, reason of 300 characters; null if it isn't JSON."""
    body = text.unfenced(raw)
    got = F.from_json(body, "status string, confidence double, language string, matched_terms array<string>, short_reason string")
    good = F.get_json_object(body, "$").startswith("{")
    whole = F.struct(
        F.when(got.status.isin(STATUSES), got.status).otherwise("UNCLEAR_NEEDS_REVIEW").alias("status"),
        F.when(got.confidence.isNotNull(), F.least(F.lit(100), F.greatest(F.lit(0), F.floor(got.confidence + 0.5)))).otherwise(50).cast("int").alias("confidence"),
        F.coalesce(got.language, F.lit("other")).alias("language"), F.slice(F.coalesce(got.matched_terms, F.array().cast("array<string>")), 1, 20).alias("terms"),
        F.substring(F.coalesce(got.short_reason, F.lit("")), 1, 300).alias("reason"),
    )
    return F.when(F.coalesce(good, F.lit(False)), whole)


def two_source(record: Column, raw: Column, raw_first: bool = False) -> Column:
    """A field of the record or, where it is null, of its raw JSON; an empty text is a value."""
    return F.coalesce(raw, record) if raw_first else F.coalesce(record, raw)


def missing_fields(expected: Column, stored: Column) -> Column:
    """Expected fields that aren't stored."""
    return F.array_sort(F.array_except(expected, stored))
