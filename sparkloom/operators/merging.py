"""Merges that hold a bounded state a group, near names by deleted letters, and methods under one result schema."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.groups import severity_max, whole_mean
from sparkloom.operators.policy import SEVERITY

MOST_TERMS, MOST_SNIPPETS = 20, 5


def _first_distinct(rows: DataFrame, key: str, place: Column, values: str, most: int, distinct: bool = True) -> DataFrame:
    """Per key the first `most` values of array columns by the row's place, then by their place in the array; each once, if distinct.

    Values are reduced to their first place before they move; of those, ranks up to `most` are cut in each task.
    """
    each = rows.select(key, place.alias("_p"), F.posexplode(values).alias("_i", "_v")).where("_v is not null")
    if distinct:
        each = each.groupBy(key, "_v").agg(F.min(F.struct("_p", "_i")).alias("_at"))
    else:
        each = each.select(key, "_v", F.struct("_p", "_i").alias("_at"))
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_at", "_v"))).where(F.col("_r") <= most)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_v"))), lambda s: s["_v"]).alias(values))


def merge_results(rows: DataFrame, key: str, place: str, status: str, confidence: str, terms: str, snippets: str, urls: str) -> DataFrame:
    """Per key: the most severe status, where its first row stands (`best`), mean confidence, the first 20 distinct terms, the first
    5 snippets, and how many distinct addresses (`n_urls`; `reviewed` lists them as rows).

    No group is collected: each list is bounded before it is built, and partial results are merged before they
    move. Rows of one key need distinct places; a null list counts as empty, keys without values get empty lists.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col(status))
    top = rows.groupBy(key).agg(severity_max(F.col(status), SEVERITY).alias("status"), F.min_by(place, F.struct(-F.coalesce(rank, F.lit(0)), place)).alias("best"), whole_mean(F.col(confidence)).alias("confidence"))
    out = top
    for values, most, distinct in ((terms, MOST_TERMS, True), (snippets, MOST_SNIPPETS, False)):
        found = _first_distinct(rows, key, F.col(place), values, most, distinct)
        out = out.join(found, key, "left").withColumn(values, F.coalesce(values, F.array()))
    counted = reviewed(rows, key, urls).groupBy(key).agg(F.count("*").alias("n_urls"))
    return out.join(counted, key, "left").withColumn("n_urls", F.coalesce("n_urls", F.lit(0).cast("bigint")))


def reviewed(rows: DataFrame, key: str, urls: str) -> DataFrame:
    """A row for each key and distinct address."""
    return rows.select(key, F.explode(urls).alias("url")).where("url is not null").distinct()


def _without_a_letter(c: Column) -> Column:
    """What is left of a text without its first letter, without its second, and so on; null for a null."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.when(F.length(c) > 0, cut).when(c.isNotNull(), F.array().cast("array<string>"))


def one_edit_apart(left: DataFrame, right: DataFrame, a: str, b: str, times: str | None = None) -> DataFrame:
    """Pairs of texts (a of left, b of right, each distinct) with one insertion, deletion or substitution between; `times` names a column for how many pairs of rows hold them.

    Texts that differ in the letter at one place are equal without it; of others the shorter one is
    the longer one without a letter. So an equal join on place and rest (0: the right text is
    the longer one, -1: the left) finds each pair once, and beside them only texts paired with
    themselves. Nulls pair with nothing. Both sides are shuffled: Spark takes the tables' size for
    that of the rests, some twenty times as many letters, and would send these to each task.
    """

    def keyed(rows: DataFrame, c: str, n: str, whole: int) -> DataFrame:
        cut = _without_a_letter(F.col(c))
        same = F.transform(cut, lambda s, i: F.struct((i + 1).alias("_at"), s.alias("_s")))
        shorter = F.transform(F.array_distinct(cut), lambda s: F.struct(F.lit(-1 - whole).alias("_at"), s.alias("_s")))
        own = F.array(F.struct(F.lit(whole).alias("_at"), F.col(c).alias("_s")))
        return rows.groupBy(c).agg(F.count("*").alias(n)).select(c, n, F.inline(F.concat(same, shorter, own)))

    pairs = keyed(left, a, "_m", 0).join(keyed(right, b, "_n", -1).hint("merge"), ["_at", "_s"]).where(F.col(a) != F.col(b))
    return pairs.select(a, b, *([(F.col("_m") * F.col("_n")).alias(times)] if times else []))


RESULT = "found boolean, confidence double, fields map<string,string>, error string"


def analysed(pages: DataFrame, key: str, methods: dict[str, Callable[[DataFrame], DataFrame]], folder: str) -> DataFrame:
    """Results of all methods: key, method, found, confidence, fields, error.

    A method makes from the pages a table of key, confidence and fields (a map); what it
    doesn't return for a page is a zero result, and where it fails, in its plan or in its
    tasks, all its pages get one with the error, while the others stay. Each method's
    rows are written under the folder, which must be shared, as only then it is known to work.
    """
    spark, out = pages.sparkSession, None
    keys = pages.select(key).distinct()
    for name, method in methods.items():
        path, error = f"{folder}/{name}-{uuid.uuid4().hex}", None
        try:
            made = method(pages).select(key, F.col("confidence").cast("double").alias("confidence"), F.col("fields").cast("map<string,string>").alias("fields"))
            made.write.parquet(path)
            rows = keys.join(spark.read.parquet(path), key, "left")
        except Exception as e:  # noqa: BLE001  whatever a plug-in does
            error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:200]
            rows = keys.select(key, F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("map<string,string>").alias("fields"))
        rows = rows.select(key, F.lit(name).alias("method"), F.col("confidence").isNotNull().alias("found"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"), F.lit(error).cast("string").alias("error"))
        out = rows if out is None else out.unionByName(rows)
    return out
