"""Scores and ordered decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of fields, and fields that only add a bonus.
CORE = {"title": 0.40, "company": 0.30, "location": 0.30}
BONUS = {"salary": 0.05, "description": 0.05}
# Allowed changes of a site's status.
TRANSITIONS = {"ANALYZING": ["REVIEW", "ACTIVE", "FAILED"], "REVIEW": ["SKIPPED", "ACTIVE", "FAILED", "ANALYZING"], "ACTIVE": ["SKIPPED", "FAILED", "REVIEW", "ANALYZING"], "FAILED": ["SKIPPED", "ANALYZING", "ACTIVE"], "SKIPPED": ["ANALYZING", "FAILED"]}


def overall_confidence(scores: dict[str, Column]) -> Column:
    """Weighted mean of the core fields and a bonus, 1 at most, two digits."""
    get = lambda k: F.coalesce(scores.get(k, F.lit(0.0)), F.lit(0.0))
    total = sum((get(k) * w for k, w in CORE.items()), F.lit(0.0)) / sum(CORE.values())
    return F.round(F.least(F.lit(1.0), total + sum((get(k) * w for k, w in BONUS.items()), F.lit(0.0))), 2)


def rounded(value: Column, digits: int) -> Column:
    """The double shifted by so many digits to its nearest integer and back, as SQL and Math.round do it; F.round goes by the digits as printed."""
    return F.round(value * 10.0**digits) / 10.0**digits


def agreement(base: Column, methods: Column) -> Column:
    """A bonus for two (.10) or more (.15) methods that agree, 1 at most."""
    return F.least(F.lit(1.0), rounded(base + F.when(methods >= 3, 0.15).when(methods == 2, 0.10).otherwise(0.0), 2))


def ensemble(rows: DataFrame, key: list[str], field: str, method: str, confidence: str, value: str, preferred: str, tie: str) -> DataFrame:
    """Per key and field the preferred method's value, else the most confident; ties by `tie`."""
    w = Window.partitionBy(*key, field).orderBy((F.col(method) == preferred).desc(), F.col(confidence).desc(), F.col(tie))
    n = F.size(F.collect_set(method).over(Window.partitionBy(*key, field)))
    out = rows.withColumn("_r", F.row_number().over(w)).withColumn("methods", n).where("_r = 1")
    return out.select(*key, field, F.col(value).alias("value"), F.col(method).alias("method"), "methods", agreement(F.col(confidence), F.col("methods")).alias("score"))


def first_true(*choices: tuple[Column, str], otherwise: str) -> Column:
    """The name of the first test that holds."""
    out = F.lit(otherwise)
    for test, name in reversed(choices):
        out = F.when(test, name).otherwise(out)
    return out


def allowed(old: Column, new: Column) -> Column:
    """Whether a status may change so."""
    return F.coalesce(F.array_contains(F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])[old], new), F.lit(False))


def failure_category(error: Column, loaded: Column, matched: Column, found: Column) -> Column:
    """Why a run failed, from its message, whether the page loaded, whether selectors matched and how many items there were."""
    return first_true((F.lower(error).contains("timeout"), "timeout"), (loaded & ~matched, "structure_changed"), (loaded & matched & (found == 0), "empty_results"), otherwise="other")


def verdict(sampled: Column, complete: Column, form: Column, unmapped: Column, suspects: Column, description_suspect: Column, inconclusive: Column) -> Column:
    """What to do with a site after its sample was judged."""
    return first_true(
        (sampled == 0, "REQUEUE"), (complete & ((form == "NEEDS_MANUAL") | (unmapped > 0) | (suspects > 0)), "REVIEW"), (complete, "ACTIVE"),
        ((form == "NEEDS_MANUAL") | description_suspect | inconclusive, "REVIEW"), otherwise="SKIP",
    )
