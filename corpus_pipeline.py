"""Corpus pipeline: toxicity, near duplicates, repeated passages, benchmark text, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents. Documents of null or empty text pass all stages;
an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import op2_suffix_dedup, op3_mixing, op7_minhash, op8_toxicity, op10_decontaminate
from sparkloom.llm.common import remove, scratch, sealed, table, tidy


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return op8_toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8."""
    return op7_minhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text that a document of smaller id has too (50 bytes or more) is cut out; no document goes."""
    rows, names = sealed(docs)
    found, changed = op2_suffix_dedup.remove_repeats(rows, names["doc_id"], names["text"]), F.col("_n_removed") > 0
    found = found.withColumn(names["text"], F.when(changed, F.col("_kept")).otherwise(F.col(names["text"])))
    if "n_chars" in names:
        kind = rows.schema[names["n_chars"]].dataType
        found = found.withColumn(names["n_chars"], F.when(changed, F.length("_kept").cast(kind)).otherwise(F.col(names["n_chars"])))
    return found.select(*names.values()).toDF(*docs.columns)


def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return op10_decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in the mixed order."""
    return op3_mixing.digest(op3_mixing.mix(docs.select("doc_id", "source")))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_text", benchmark_text),
    ("mixing", mixing),
]

#: SQL can't express the scorer, the hashing or the schedule; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written to the shared folder and read again.

    When a stage is written, its checkpoints and its predecessor's table go.
    """
    docs, folder, last = table(spark, sf_dir, "documents"), f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with tidy(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove(spark, last)
        last = f"{folder}/{name}"
    return docs
