"""The stateful stream against a plain replay of all events, in one run, in many batches, and with restarts."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import life_cycle

SCHEMA = "worker string, ts timestamp, seq bigint, kind string, job bigint, n bigint"


def made():
    rng, t, out = random.Random(3), 1_704_067_200, []
    for i in range(500):
        t += rng.choice([0, 1, 30, 200, 500, 845, 900, 901])
        kind = rng.choice(["queued", "queued", "queued", "saved", "saved", "saved", "finished", "finished", "failed", "restarted", "noise"])
        out.append((rng.choice("abc"), t, i, kind, rng.randrange(40) if kind == "queued" else rng.choice([None, None, rng.randrange(40)]), rng.choice([None, 0, 5])))
    return out + [(None, t, 999, "queued", 1, 1)]


def replayed(events, until):
    """The same, second by second, by the rules alone."""
    out = []
    for worker in "abc":
        own = sorted((e for e in events if e[0] == worker and e[1] <= until), key=lambda e: (e[1], e[2]))
        queue, job, since, saved = [], None, 0, 0
        for t in range(own[0][1], until + 1):
            now = [e for e in own if e[1] == t]
            if job is not None and t == since + 900:
                out.append((worker, job, t, "PARTIAL" if saved else "FAILED", f"timeout after {saved} rows", saved))
                job = None
            for step in [None, *now]:
                if step is not None:
                    _, _, _, kind, j, n = step
                    if kind == "queued" and j != job and j not in queue:
                        out.append((worker, j, t, "PENDING", None, 0))
                        queue.append(j)
                    elif kind not in ("queued", "noise") and job is not None and j in (None, job):
                        if kind == "saved":
                            saved += n or 0
                        else:
                            status = "COMPLETED" if kind == "finished" else "FAILED"
                            note = f"near_timeout: {t - since} s" if kind == "finished" and t - since >= 840 else "Worker interrupted" if kind == "restarted" else None
                            out.append((worker, job, t, status, note, 0 if kind == "restarted" else saved))
                            job = None
                if job is None and queue:
                    job, since, saved = queue.pop(0), t, 0
                    out.append((worker, job, t, "IN_PROGRESS", None, 0))
    return sorted(out, key=str)


@pytest.mark.parametrize("files, runs", [(1, 1), (7, 1), (7, 7)])
def test_a_restart_changes_nothing(spark, tmp_path, files, runs):
    events = made()
    end = max(e[1] for e in events)
    events += [("z", end + 100_000, 5000 + i, "queued", 1, 0) for i in range(1)]  # moves the watermark past all others
    rows = spark.createDataFrame(events, SCHEMA.replace("ts timestamp", "s bigint")).select("worker", F.timestamp_seconds("s").alias("ts"), "seq", "kind", "job", "n")
    order = [e[2] for e in sorted(events, key=lambda e: (e[1], e[2]))]
    size = -(-len(order) // files)
    shuffled = random.Random(1)
    for run in range(runs):
        for f in range(files):
            if f * runs // files == run:
                part = order[f * size : (f + 1) * size]
                shuffled.shuffle(part)  # within a file the order is any
                rows.where(F.col("seq").isin(part)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))
        life_cycle.run(stream, str(tmp_path / "out"), str(tmp_path / "mark"), late="1 second")
    got = spark.read.parquet(str(tmp_path / "out")).where("worker <> 'z'").withColumn("ts", F.unix_seconds("ts"))
    want = replayed(made(), end + 90_000)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {"PARTIAL", "FAILED", "COMPLETED", "PENDING", "IN_PROGRESS"} == {w[3] for w in want} and any(w[4] == "Worker interrupted" for w in want) and any("near" in (w[4] or "") for w in want)
