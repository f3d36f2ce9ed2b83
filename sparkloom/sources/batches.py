"""Captured responses within limits, and scans in key order that resume where they stopped."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Responses of a page that are kept, and letters of each.
MOST_RESPONSES, MOST_LETTERS = 50, 500_000
# Endings of addresses and parts of them that mean assets, measuring or checks for robots.
ASSET_ENDS = "js css png jpg jpeg gif svg ico woff woff2 ttf eot map".split()
ASSET_PARTS = ["/static/", "/assets/", "/_next/", "/webpack", "google-analytics", "gtag", "googletagmanager", "facebook", "pixel", "hotjar", "analytics", "tracking", "beacon", "cdn.", "cloudflare", "cloudfront", "googleapis", "gstatic", "recaptcha", "captcha", "socket.io", "ws://"]
_PASSED_OVER = rf"\.({'|'.join(ASSET_ENDS)})(\?|$)|{'|'.join(map(re.escape, ASSET_PARTS))}"


def captured(responses: DataFrame, page: str, order: list[Column], status: str, kind: str, url: str, body: str, most: int = MOST_RESPONSES, letters: int = MOST_LETTERS) -> DataFrame:
    """Of each page the first `most` responses that succeeded, are JSON of at most so many letters, and aren't assets; `admitted` numbers them.

    Nulls aren't admitted. The cut at `most` runs in each task before rows move.
    """
    fits = (F.col(status) >= 200) & (F.col(status) < 400) & F.col(kind).rlike("json|text/plain") & ~F.lower(url).rlike(_PASSED_OVER) & (F.length(body) <= letters) & F.try_parse_json(body).isNotNull()
    ranked = responses.where(fits).withColumn("admitted", F.row_number().over(Window.partitionBy(page).orderBy(*order)))
    return ranked.where(F.col("admitted") <= most)


def scanned(spark: SparkSession, rows: DataFrame, key: str, size: int, work: Callable[[DataFrame], DataFrame], folder: str, most: int | None = None) -> DataFrame:
    """What `work` makes of the rows, done in batches in key order and kept under a folder; a call after a stop goes on behind the last whole batch.

    A batch holds all rows of its keys, so it may be larger than `size` where keys repeat. It is done when its
    folder is whole: the cursor is the bound in the name of the last one, so nothing is done twice or left out.
    most: batches at most in this call. Null keys form the first batch. The keys are ordered whole numbers.
    """
    done = _bounds(spark, folder)
    cursor, left = (max(done) if done else None), most
    if not done and (left is None or left > 0):
        _keep(work(rows.where(F.col(key).isNull())), folder, -(1 << 63))
        cursor, left = -(1 << 63), None if left is None else left - 1
    while left is None or left > 0:
        ahead = rows.where(F.col(key) > cursor).select(key).orderBy(key).limit(size).agg(F.max(key)).first()[0]
        if ahead is None:
            break
        _keep(work(rows.where((F.col(key) > cursor) & (F.col(key) <= ahead))), folder, ahead)
        cursor, left = ahead, None if left is None else left - 1
    return spark.read.parquet(*[f"{folder}/{b}" for b in _bounds(spark, folder)])


def _keep(rows: DataFrame, folder: str, bound: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/{bound}")


def _bounds(spark: SparkSession, folder: str) -> list[int]:
    """Upper bounds of the batches whose folders are whole."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    whole = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(top) if whole(s.getPath()))
