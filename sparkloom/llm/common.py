"""Helpers that the corpus operators share: tables, cut lineage, streamed groups."""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sealed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns named c0, c1, ..., so that none clashes with an operator's own, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def scratch(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; where it is unset, a local one, on a single machine only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


#: Checkpoints of the innermost `tidy` block.
_HELD: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder."""
    scratch(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _HELD and (file := checkpoint_file(out)):
        _HELD[-1].append(file)
    return out


def checkpoint_file(df: DataFrame) -> str | None:
    """Where a DataFrame that `cut` returned lies."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    return file.get() if file.isDefined() else None


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Checkpoints made inside go at the end, when what needs them is written."""
    _HELD.append([])
    try:
        yield
    finally:
        for path in _HELD.pop():
            remove(spark, path)


def spread_join(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner", by: list[str] | None = None, seen: DataFrame | None = None) -> DataFrame:
    """left.join(right, key) where one key may hold much of left; right has few rows a key.

    total: rows of left, about. Keys of more than a 1,000th of them (1,000 rows at least)
    are dealt over pieces by a hash of `by`, right's rows of such a key are repeated for
    each piece. They are looked for without a shuffle, in at most about 50,000 keys of
    `seen` (left, where it is a checkpoint or a narrow step from one) that the driver
    counts; a key that the sample misses is joined undivided, so no row depends on it.
    """
    most = max(1000, total // 1000)
    if total <= most:
        return left.join(right, key, how)
    some = seen if seen is not None else left
    share = min(1.0, 50_000 / total)
    if share < 1:
        some = some.where(F.pmod(F.xxhash64(F.lit(3), *some.columns), F.lit(1 << 20)) < int(share * (1 << 20)))
    some = some.select(F.col(key).alias("_hot")).where(F.col("_hot").isNotNull())
    found = Counter(bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in some.collect())  # about 50,000 keys
    rows = [(k, -(-int(n / share) // most)) for k, n in found.items() if n > most * share]
    if not rows:
        return left.join(right, key, how)
    hot = left.sparkSession.createDataFrame(rows, T.StructType([T.StructField("_hot", left.schema[key].dataType), T.StructField("_pieces", T.LongType())]))
    spread = lambda df: df.join(F.broadcast(hot), df[key] == F.col("_hot"), "left")
    one = spread(left).withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*(by or left.columns)), "_pieces"), F.lit(0))).drop("_hot", "_pieces")
    two = spread(right).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_hot", "_pieces")
    return one.join(two, [key, "_piece"], how).drop("_piece")


def first_by_hash(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """About `most` keys (all, if there are fewer), by a bound on their hashes: no sort, no rows through one task."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int((1 << 30) * most / n))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `most` bytes of a text column each; a longer text is alone."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        n = n or 0
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Groups of rows, one at a time, from a stream that is sorted by the keys."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(row)
    if held:
        yield now, held
