"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of documents in hash order. In exact proportion, a
source of weight w has w of the sum of the weights of those that aren't used up yet,
and when one is used up, the others' shares grow in proportion. A block is released
at the slot, rounded down, at which its source has had the blocks before it in this
exact flow, and due by the slot, rounded up, at which it has had the block too. Of
the released blocks the one with the earliest deadline takes the slot (ties by source,
then block). As the flow itself serves every block within its window, every deadline
is met: at any slot each source has had its exact share to within one block, whatever
the number of sources and the length of the schedule. Weights are exact fractions
(whole numbers over their sum), so no rounding adds up.

There is one rule for any size. The flow depends on the sources' sizes and weights
only, and distinct sizes are few (fewer than the root of twice the documents), so the
driver holds these, and tasks give each block its window. The schedule is made in
tasks too. Blocks are cut into classes by deadline and slots into spans, PARTS of each
at most. A span's class for each slot follows from counts: blocks of the first classes
that wait at a span's end are those from its start and its arrivals less its slots, or
what the span would leave by itself if that is more, so spans are summed up side by
side. A class then has its slots, and its blocks take them by deadline. The outcome is
that of one earliest-deadline schedule over all slots, wherever spans and classes end.
Documents are numbered within a source by counts of hash buckets and ranks within
a bucket, so no task holds a whole source.

`schedule`, `phases` and `slots_of` are the plain schedule of shares that don't change,
in spans, and begun anew where a source ends: for few sources, as each phase holds all
of them and each restart may put a source a block further off its share. `mix` doesn't
use them.

Null sources form one source, named "". Repeated rows each get a place. Weights not
given are the square root of the source's size; a given weight of 0 puts a source
last. An empty table gives an empty result. Columns of docs may have any names;
result columns replace those of their names.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import accumulate, chain, groupby, islice
from math import ceil, lcm
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sealed

BLOCK = 64
#: Slots that are scheduled at once, at least.
SPAN = 4096
#: Documents expected in a hash bucket, within which a rank is a sort of one key.
BUCKET = 2000
#: Spans and classes of a schedule, at most: beyond SPAN slots in each they grow longer.
PARTS = 1024
#: Sources that `phases` is meant for; `mix` takes any number.
MOST_SOURCES = 512


def shares(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers in exactly the same proportion."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * unit) for s, x in exact.items()}


def done_by(share: dict[str, int], total: int, slot: int) -> dict[str, int]:
    """Blocks that each source has had before a slot where a span starts: its share, rounded so that the spans on both sides can be scheduled.

    A block whose window crosses the slot counts as done or not. The schedule before the slot
    needs that of the blocks released at or after any time no more are done than their
    shares add up to, rounded up; the one behind it needs that of those due by any time
    as many are done as the shares add up to, rounded down. The shares themselves meet
    both, and as each set of bounds is a chain, so do whole numbers: blocks are taken by
    deadline, as long as the first bounds hold.
    """
    down = {s: divmod(slot * a, total) for s, a in share.items()}
    left = slot - sum(n for n, _ in down.values())
    late = sorted((s for s in down if down[s][1]), key=lambda s: (-(down[s][0] * total // share[s]), s))
    rooms, added, whole = [], 0, 0
    for s in late:  # by falling release: how many of the first ones may be done
        added += down[s][1]
        rooms.append(-(-added // total))
    room, at = np.array(rooms, np.int64), {s: i for i, s in enumerate(late)}
    # Blocks of one release share a bound, that of the last of them.
    for i in range(len(late) - 2, -1, -1):
        if down[late[i]][0] * total // share[late[i]] == down[late[i + 1]][0] * total // share[late[i + 1]]:
            room[i] = room[i + 1]
    up = set()
    for s in sorted(late, key=lambda s: (-(-(down[s][0] + 1) * total // share[s]), s)):
        if whole < left and (room[at[s] :] > 0).all():
            room[at[s] :] -= 1
            up.add(s)
            whole += 1
    return {s: n + (s in up) for s, (n, _) in down.items()}


def span_of(share: dict[str, int]) -> int:
    """Slots of a span: SPAN, or as many as keep any block from reaching over a whole span."""
    return max(SPAN, -(-sum(share.values()) // min(share.values())) + 1)


def schedule(share: dict[str, int], start: int, slots: int | None = None) -> Iterator[tuple[str, int]]:
    """(source, block) of each slot of a span, by earliest deadline of the released blocks."""
    slots, total = slots or span_of(share), sum(share.values())
    at, end = done_by(share, total, start), done_by(share, total, start + slots)
    release = [(at[s] * total // a, s) for s, a in share.items() if at[s] < end[s]]
    heapq.heapify(release)
    ready: list[tuple[int, str]] = []
    for t in range(start, start + slots):
        while release and release[0][0] <= t:
            _, s = heapq.heappop(release)
            heapq.heappush(ready, (min(-(-(at[s] + 1) * total // share[s]), start + slots), s))
        due, s = heapq.heappop(ready)
        assert t < due, "a deadline is missed"
        yield s, at[s]
        at[s] += 1
        if at[s] < end[s]:
            heapq.heappush(release, (at[s] * total // share[s], s))


def phases(blocks: dict[str, int], weights: dict[str, float]) -> list[dict]:
    """Stretches of the schedule between the ends of sources: shares, first block of each source, first slot, number of slots."""
    left = {s: n for s, n in blocks.items() if n}
    done, start, out = dict.fromkeys(left, 0), 0, []
    while left:
        share = shares({s: weights[s] for s in left if weights[s] > 0} or dict.fromkeys(left, 1.0))
        total, size = sum(share.values()), span_of(share)
        # No last block runs before its release: the span of the earliest such release is the first that can end a source.
        first = min((left[s] - 1) * total // a for s, a in share.items()) // size * size
        had, length = done_by(share, total, first), None
        while length is None:
            for t, (s, j) in enumerate(schedule(share, first), first):
                had[s] = j + 1
                if j == left[s] - 1:
                    length = t + 1
                    break
            first += size
        out.append({"share": share, "first": {s: done[s] for s in share}, "start": start, "length": length})
        for s in share:
            done[s] += had[s]
            left[s] -= had[s]
        start += length
        left = {s: n for s, n in left.items() if n}
    return out


def slots_of(spark, found: list[dict]) -> DataFrame:
    """(_group, _turn, _slot) of every block, made in tasks, a span at a time."""
    ends = [0]
    for p in found:
        ends.append(ends[-1] + ceil(p["length"] / span_of(p["share"])))
    shared = spark.sparkContext.broadcast((found, ends))  # at most MOST_SOURCES phases of at most MOST_SOURCES sources

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phase, begin = shared.value
        for batch in batches:
            for number in batch.column("id").to_pylist():
                at = bisect_right(begin, number) - 1
                p = phase[at]
                slot = (number - begin[at]) * span_of(p["share"])
                held = islice(schedule(p["share"], slot), p["length"] - slot)
                while some := list(islice(held, SPAN)):
                    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in some], pa.string()), pa.array([p["first"][s] + j for s, j in some], pa.int64()), pa.array(range(p["start"] + slot, p["start"] + slot + len(some)), pa.int64())], names=["_group", "_turn", "_slot"])
                    slot += len(some)

    return spark.range(ends[-1]).mapInArrow(run, "_group string, _turn bigint, _slot bigint")


class Flow:
    """The exact flow of sources whose shares grow when others are used up, by kinds of sources: (blocks, weight, sources of the kind)."""

    def __init__(self, kinds: list[tuple[int, float, int]], start: int = 0):
        self.share = shares({w: w for _, w, _ in kinds})
        ends = sorted((Fraction(b, self.share[w]), b * n, self.share[w] * n) for b, w, n in kinds)
        self.ends = [e for e, _, _ in ends]
        self.had = list(accumulate((b for _, b, _ in ends), initial=start))
        self.left = list(accumulate((-a for _, _, a in ends), initial=sum(a for _, _, a in ends)))

    def windows(self, weight: float, first: int, last: int) -> Iterator[tuple[int, int, int]]:
        """(block, release, deadline) of a source's blocks from first to before last."""
        a, i, begin = self.share[weight], 0, 0
        for j in range(first, last + 1):
            i = bisect_right(self.ends, Fraction(j, a), lo=i)  # kinds that are used up by then
            slots = self.had[i] * a + j * self.left[i]
            if j > first:
                yield j - 1, begin, -(-slots // a)
            begin = slots // a


def blocks_of(sized: DataFrame, flows: list[Flow]) -> DataFrame:
    """(_source, _block, _release, _due) of every block, made in tasks, a stretch of a source at a time."""
    shared, step = sized.sparkSession.sparkContext.broadcast(flows), SPAN  # a few numbers for each distinct size or given weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, n, w, late, stretch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(shared.value[late].windows(w, stretch * step, min(n, (stretch + 1) * step)))
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(found), pa.string()), *(pa.array(x, pa.int64()) for x in zip(*found, strict=True))], names=["_source", "_block", "_release", "_due"])

    stretches = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("b") - 1) / step)))
    each = sized.select("_source", "b", "w", "_late", stretches.alias("_stretch")).repartition("_source", "_stretch")
    return each.mapInArrow(run, "_source string, _block bigint, _release bigint, _due bigint")


def turns(arrivals: Iterable[tuple[int, int, int]], waiting: dict[int, int], slot: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(class, slot, slots) of a span, the first class that waits takes the slot; arrivals are (slot, class, blocks). Leaves in waiting what waits at the end."""
    heap = sorted(c for c, n in waiting.items() if n)
    for at, c, n in chain(arrivals, [(end, 0, 0)]):
        while slot < at and heap:
            had = min(at - slot, waiting[heap[0]])
            yield heap[0], slot, had
            slot += had
            waiting[heap[0]] -= had
            if not waiting[heap[0]]:
                heapq.heappop(heap)
        slot = max(slot, at)
        if n:
            if not waiting.get(c):
                heapq.heappush(heap, c)
            waiting[c] = waiting.get(c, 0) + n


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, int, int]]]]:
    """Spans and their arrivals, of a stream that is sorted by both."""
    rows = chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns), strict=True) for batch in batches)
    return ((span, (r[1:] for r in found)) for span, found in groupby(rows, itemgetter(0)))


def earliest_first(blocks: Iterable[tuple[int, int, str, int]], slots: Iterable[int]) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot): each slot goes to the released block that is due first; blocks are (release, deadline, source, block)."""
    coming, ready, at = sorted(blocks), [], 0
    for t in slots:
        while at < len(coming) and coming[at][0] <= t:
            heapq.heappush(ready, coming[at][1:])
            at += 1
        due, source, block = heapq.heappop(ready)
        assert t < due, "a deadline is missed"
        yield source, block, t


def scheduled(blocks: DataFrame, total: int) -> DataFrame:
    """(_source, _block, _slot) of every block of blocks_of; total: their number."""
    spark, size = blocks.sparkSession, max(SPAN, -(-total // PARTS))
    count = max(1, -(-total // size))
    dealt = cut(blocks.repartitionByRange(count, "_due", "_source", "_block").withColumn("_class", F.spark_partition_id().cast("bigint")))
    arrivals = dealt.groupBy(F.floor(F.col("_release") / size).alias("_span"), F.col("_release").alias("_at"), "_class").agg(F.count("*").alias("_n"))
    every = spark.range(count).select(F.col("id").alias("_span"), (F.col("id") * size).alias("_at"), F.lit(0).cast("bigint").alias("_class"), F.lit(0).cast("bigint").alias("_n"))
    arrivals = arrivals.union(every).repartition("_span").sortWithinPartitions("_span", "_at", "_class")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for span, found in _spans(batches):
            came: dict[int, int] = {}
            left: dict[int, int] = {}

            def counted(rows=found, came=came):
                for at, c, n in rows:
                    came[c] = came.get(c, 0) + n
                    yield at, c, n

            for _ in turns(counted(), left, span * size, (span + 1) * size):
                pass
            kept = [np.array([(c, n, left.get(c, 0)) for c, n in came.items()], np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([span], pa.int64()), pa.array(kept, pa.binary())], names=["span", "sums"])

    # A row a span with three numbers a class: at most PARTS * PARTS * 24 bytes.
    sums = {r["span"]: np.frombuffer(r["sums"], np.int64).reshape(-1, 3) for r in arrivals.mapInArrow(alone, "span bigint, sums binary").collect()}
    classes = 1 + max(int(x[:, 0].max()) for x in sums.values())
    waits, now = [], np.zeros(classes, np.int64)
    for span in range(count):  # now: blocks up to each class that wait where the span starts
        waits.append(np.diff(now, prepend=0))
        came, left = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        came[sums[span][:, 0]], left[sums[span][:, 0]] = sums[span][:, 1], sums[span][:, 2]
        now = np.maximum(now + np.cumsum(came) - size, np.cumsum(left))
    shared = spark.sparkContext.broadcast(waits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for span, found in _spans(batches):
            waiting = {int(c): int(shared.value[span][c]) for c in np.flatnonzero(shared.value[span])}
            held = turns(found, waiting, span * size, min(total, (span + 1) * size))
            while some := list(islice(held, SPAN)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*some, strict=True)], names=["_class", "_from", "_slots"])

    def place(rows: pa.Table, own: pa.Table) -> pa.Table:
        slots = chain.from_iterable(range(t, t + n) for t, n in sorted(zip(own["_from"].to_pylist(), own["_slots"].to_pylist(), strict=True)))
        out = list(earliest_first(zip(*(rows[c].to_pylist() for c in ("_release", "_due", "_source", "_block")), strict=True), slots))
        assert len(out) == rows.num_rows, "a block has no slot"
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["_source", "_block", "_slot"])

    spans = arrivals.mapInArrow(run, "_class bigint, _from bigint, _slots bigint")
    return dealt.groupBy("_class").cogroup(spans.groupBy("_class")).applyInArrow(place, "_source string, _block bigint, _slot bigint")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """All columns of docs with _source, _block (within the source), _slot (in the mixed order) and _place in the block."""
    rows, names = sealed(docs)
    ident = names[doc_id]
    rows = rows.withColumn("_source", F.coalesce(F.col(names[source]).cast("string"), F.lit(""))).withColumn("_hash", F.xxhash64(F.lit(17), ident))
    sized = rows.groupBy("_source").agg(F.count("*").alias("n"))
    if weights:
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "_source string, _given double")
        sized = sized.join(given, "_source", "left").withColumn("w", F.coalesce("_given", F.sqrt("n")))
    else:
        sized = sized.withColumn("w", F.sqrt("n"))
    late = F.isnan("w") | (F.col("w") <= 0)
    sized = cut(sized.select("_source", "n", F.ceil(F.col("n") / BLOCK).alias("b"), F.when(late, 1.0).otherwise(F.col("w")).alias("w"), late.cast("int").alias("_late")))
    kinds = sized.groupBy("_late", "n", "b", "w").agg(F.count("*").alias("k")).collect()  # as many as sizes, and weights given
    total, soon = sum(r["n"] * r["k"] for r in kinds), sum(r["b"] * r["k"] for r in kinds if not r["_late"])
    flows = [Flow([(r["b"], r["w"], r["k"]) for r in kinds if r["_late"] == late], start) for late, start in enumerate((0, soon))]
    slots = scheduled(blocks_of(sized, flows), sum(r["b"] * r["k"] for r in kinds))
    buckets = max(1, total // BUCKET)
    rows = rows.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    counts = rows.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("_source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_hash", ident)
    ranked = rows.withColumn("_r", F.row_number().over(inside) - 1).join(offset, ["_source", "_bucket"]).withColumn("_i", F.col("_offset") + F.col("_r"))
    ranked = ranked.withColumn("_block", F.floor(F.col("_i") / BLOCK)).withColumn("_place", F.col("_i") % BLOCK)
    kept = [(n, c) for c, n in names.items() if c not in ("_source", "_block", "_slot", "_place")]
    # One row a block on the right: a block's documents are BLOCK at most, so no key is hot.
    return ranked.join(slots, ["_source", "_block"]).select(*[F.col(n).alias(c) for n, c in kept], "_source", "_block", "_slot", "_place")


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", F.col("_source").alias("source"), F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_place").alias("place"))
