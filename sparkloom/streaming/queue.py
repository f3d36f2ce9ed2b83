"""Queue and event streams with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.groups import latest_per_group

# Events that may be emitted, and the views that each makes stale.
EVENTS = {
    "site:status-changed": ["sites", "sites/counts", "dashboard/overview", "dashboard/failures"],
    "analysis:completed": ["sites", "sites/counts", "dashboard/overview"],
    "scrape:completed": ["sites", "jobs", "dashboard/overview", "dashboard/failures"],
    "scrape:failed": ["sites", "dashboard/overview", "dashboard/failures"],
}
FINAL = ["COMPLETED", "FAILED", "PARTIAL"]


def valid_events(events: DataFrame, column: str = "type") -> DataFrame:
    return events.where(F.col(column).isin(list(EVENTS)))


def stale_views(events: DataFrame, column: str = "type") -> DataFrame:
    """One row for each event and view that it makes stale."""
    views = F.create_map(*[x for k, v in EVENTS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return events.select("*", F.explode(views[F.col(column)]).alias("view"))


def queue_state(log: DataFrame, key: str = "job_id", order: list[Column] | None = None) -> DataFrame:
    """Latest status of each job from an append-only log, and how often it was started."""
    order = order or [F.col("ts").desc(), F.col("seq").desc()]
    started = F.sum(F.when(F.col("status") == "IN_PROGRESS", 1).otherwise(0)).over(Window.partitionBy(key)).cast("bigint")
    return latest_per_group(log.withColumn("attempts", started), [key], order)


def next_jobs(state: DataFrame, n: int = 1) -> DataFrame:
    """The oldest pending jobs, first in first out."""
    return state.where("status = 'PENDING'").orderBy("ts", "job_id").limit(n)


def admit(requests: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Requests without an active job of the same keys, one for each."""
    active = state.where(~F.col("status").isin(FINAL)).select(*keys).distinct()
    return requests.join(active, keys, "left_anti").dropDuplicates(keys)


def recover(state: DataFrame) -> DataFrame:
    """Events that fail what was in progress when the worker died."""
    return state.where("status = 'IN_PROGRESS'").withColumn("status", F.lit("FAILED"))


def timed_out(saved: Column) -> Column:
    """A run cut off is partial if it saved rows, else failed."""
    return F.when(saved > 0, "PARTIAL").otherwise("FAILED")


def run_available(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, column: str = "type") -> None:
    """Valid events of a folder of JSON lines to Parquet, exactly once over restarts: all that is there, then it stops."""
    stream = valid_events(spark.readStream.schema(schema).json(source), column)
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and window, with a watermark; an extension that works on batches and streams alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
