"""Sources and sinks: tables, CSV, JSON lines, URL lists, snapshot replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, quoted line ends, doubled quotes; missing cells are empty strings."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False).fillna("")


def write_csv(df: DataFrame, path: str) -> None:
    """Header, minimal quoting, line feeds: Spark's CSV writer takes one character as line end."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_csv_crlf(df: DataFrame, path: str) -> None:
    """The same with CR LF, as text: a cell is quoted where it holds a quote, a comma or a line end. Each file starts with the header."""
    quoted = lambda c: F.when(c.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.concat_ws(",", *[quoted(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns])
    head = F.concat_ws(",", *[quoted(F.lit(c)) for c in df.columns])
    rows = df.select(line.alias("value"), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"))
    first = (F.col("_i") % (1 << 33)) == 0
    rows.select(F.when(first, F.concat(head, F.lit("\r\n"), "value")).otherwise(F.col("value"))).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line; blank lines and lines that start with # are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where((F.length("url") > 0) & ~F.col("url").startswith("#"))


def replace_snapshot(df: DataFrame, path: str, partition: str) -> bool:
    """Replaces the partitions that df has rows of; an empty snapshot replaces nothing. Returns whether it wrote."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return True


def cascade_delete(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a unique key; the filter reaches the scan."""
    return df.where(F.col(key) == value).limit(1)


def seeds(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """New rows, one a key, of keys that aren't there yet: to append, and nothing when done again."""
    return new.where(F.col(key).isNotNull()).dropDuplicates([key]).join(existing.select(key).distinct(), key, "left_anti")


def slug(c: Column) -> Column:
    """A name for files: lower case, letters and digits, one hyphen between words."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


def mirror_json(df: DataFrame, path: str, name: str) -> None:
    """A folder of JSON lines for each slug of a name; replaces what is there."""
    df.withColumn("slug", slug(F.col(name))).write.mode("overwrite").partitionBy("slug").json(path)
