"""Jobs of a worker as one stateful stream: a queue with one job in flight, time-outs, recovery after a restart.

Keyed by worker. Events are `queued` (a job), `saved` (rows of the running job),
`finished`, `failed` and `restarted` (the worker). They settle in the order of their
time once the watermark has passed them, and what is due by time (a run that took too
long) settles in its place between them, so neither the cut into micro-batches nor a
restart of the query changes a row. State holds the running job, the waiting ones and
what has come since the watermark. Events later than the watermark are lost, as in any
stream; equal times go by `seq`. Events of unknown kind, of null worker or null time
are passed over.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds after which a run is cut off, and from which on one that ends is marked.
CAP, NEAR = 900, 840
KINDS = ["queued", "saved", "finished", "failed", "restarted"]
ROWS = "worker string, job bigint, ts timestamp, status string, note string, saved bigint"


class Worker:
    """A worker's queue as plain values: waiting jobs in order, the running one, events that haven't settled."""

    def __init__(self, held: dict | None, cap: int, near: int):
        held = held or {"waiting": [], "running": None, "events": []}
        self.waiting, self.running, self.events = held["waiting"], held["running"], held["events"]
        self.cap, self.near, self.rows = cap * 1_000_000, near * 1_000_000, []

    def held(self) -> dict | None:
        return {"waiting": self.waiting, "running": self.running, "events": self.events} if self.waiting or self.running or self.events else None

    def due(self) -> int | None:
        """When the next thing happens, in microseconds: an event, or the end of a run that takes too long."""
        times = [self.running["since"] + self.cap] if self.running else []
        return min([*times, self.events[0][0]] if self.events else times, default=None)

    def tell(self, job: int, at: int, status: str, note: str | None = None, saved: int = 0) -> None:
        self.rows.append((job, at, status, note, saved))

    def ends(self, at: int, status: str, note: str | None, saved: int) -> None:
        self.tell(self.running["job"], at, status, note, saved)
        self.running = None
        if self.waiting:
            self.starts(self.waiting.pop(0), at)

    def starts(self, job: int, at: int) -> None:
        self.running = {"job": job, "since": at, "saved": 0}
        self.tell(job, at, "IN_PROGRESS")

    def happens(self, at: int, kind: str, job: int | None, n: int) -> None:
        now = self.running
        if kind == "queued":
            if job is None or job in self.waiting or (now and now["job"] == job):
                return  # a job that waits or runs isn't queued again
            self.tell(job, at, "PENDING")
            if now:
                self.waiting.append(job)
            else:
                self.starts(job, at)
        elif now and (job is None or job == now["job"]):
            if kind == "saved":
                now["saved"] += n
            elif kind == "finished":
                took = at - now["since"]
                self.ends(at, "COMPLETED", f"near_timeout: {took // 1_000_000} s" if took >= self.near else None, now["saved"])
            elif kind == "failed":
                self.ends(at, "FAILED", None, now["saved"])
            else:  # what an interrupted run had saved is wiped
                self.ends(at, "FAILED", "Worker interrupted", 0)

    def settle(self, until: int) -> None:
        """All that happens up to a time; a run's end by time comes before events of the same time."""
        self.events.sort(key=lambda e: (e[0], e[1]))
        while (t := self.due()) is not None and t <= until:
            if self.running and self.running["since"] + self.cap == t:
                saved = self.running["saved"]
                self.ends(t, "PARTIAL" if saved else "FAILED", f"timeout after {saved} rows", saved)
            else:
                at, _, kind, job, n = self.events.pop(0)
                self.happens(at, kind, job, n)


def life_cycle(events: DataFrame, late: str = "10 minutes", cap: int = CAP, near: int = NEAR) -> DataFrame:
    """A row for each change of a job's status: worker, job, ts, status, note, saved. events: worker, ts, seq, kind, job (null: the running one), n."""

    def batch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        worker = Worker(json.loads(state.get[0]) if state.exists else None, cap, near)
        for frame in frames:
            for at, seq, kind, job, n in zip(frame["_at"], frame["seq"], frame["kind"], frame["job"], frame["n"]):
                worker.events.append([int(at), int(seq), kind, None if pd.isna(job) else int(job), 0 if pd.isna(n) else int(n)])
        mark = state.getCurrentWatermarkMs()
        worker.settle(mark * 1000)
        if (held := worker.held()) is None:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(-(-(worker.due() or 0) // 1000), mark + 1))
        if not worker.rows:
            return
        found = pd.DataFrame(worker.rows, columns=["job", "ts", "status", "note", "saved"])
        found.insert(0, "worker", key[0])
        found["ts"] = pd.to_datetime(found["ts"], unit="us", utc=True)
        yield found

    rows = events.where(F.col("kind").isin(KINDS) & F.col("worker").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    rows = rows.select(F.col("worker").cast("string"), "ts", F.unix_micros("ts").alias("_at"), F.col("seq").cast("bigint"), "kind", F.col("job").cast("bigint"), F.col("n").cast("bigint"))
    return rows.groupBy("worker").applyInPandasWithState(batch, ROWS, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def run(events: DataFrame, sink: str, checkpoint: str, **settings) -> None:
    """The stream over all that is there, to Parquet, exactly once over restarts; what the watermark hasn't passed waits for the next run."""
    out = life_cycle(events, **settings).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
