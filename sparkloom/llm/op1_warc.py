"""WARC archives: write, read back, and a merged index of captures.

Every page becomes one record. Of equal payloads of at least 100 bytes the page
with the smallest id is a response, the others revisit it and carry no payload;
shorter payloads are all responses. Archives are gzip text files that Spark's
writer puts in the shared folder, one a task, so nothing passes through a local
disk or the driver. A reader task streams its files record by record, guided by
Content-Length, and returns the captures of its files as one sorted run.

Runs are merged without a global sort in one place: the key space (URL key, time,
page) is cut into ranges of about RANGE_ROWS captures, whatever the size of the
index; each range gets its piece of each run, in order from Spark's external sort,
and a loser tree merges these pieces by log2(runs) comparisons a capture. A range
holds columns of index entries, never payloads. A large host or URL spreads over
several ranges, as the time and the page belong to the key; the histories number
the captures of a URL key across them.

Null html is an empty payload; a null URL has an empty URL key. The table has no
capture time, so page_id seconds after EPOCH serve as WARC-Date, in UTC whatever
the session's time zone, kept within the years 1970 to 9999. Rows that share
a page_id get equal record types; a null page_id is larger than all others.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts, scratch

LEAST_PAYLOAD = 100
EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z
LAST = 253_402_300_799  # 9999-12-31T23:59:59Z
#: Captures that a range of the merge should hold.
RANGE_ROWS = 100_000
_END = "\r\n"
_FIELDS = "page_id bigint, url string, urlkey string, ts bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def surt(url: str | None) -> str:
    """URL key: host labels in reverse, then the path and query; scheme, www, port, fragment and case of the host don't count."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.\-]*://", "", url or "").split("#")[0]
    host, slash, path = rest.partition("/")
    host = re.sub(r":\d+$", "", host.lower())
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")/" + path if host or slash else ""


def with_types(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null: a response)."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), body.alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("bigint"), "payload_digest": F.sha2("html", 256)})
    light = rows.where(F.col("payload_bytes") >= LEAST_PAYLOAD)
    # Most payloads occur once: only what repeats is joined, on the page, and the small side has no payloads.
    first = light.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return rows.join(first, "payload_digest", "left").withColumn("refers_to", F.expr(f"case when payload_bytes >= {LEAST_PAYLOAD} and coalesce(page_id <> refers_to, true) then refers_to end"))


def record(rows: DataFrame) -> DataFrame:
    """One WARC record a row as text, without its last line end."""
    revisit = F.col("refers_to").isNotNull()
    at = F.greatest(F.lit(-EPOCH), F.least(F.lit(LAST - EPOCH), F.coalesce("page_id", F.lit(0)))) + EPOCH
    part = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    date = F.concat(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(at / 86400).cast("int")).cast("string"), F.lit("T"), part(at % 86400 / 3600), F.lit(":"), part(at % 3600 / 60), F.lit(":"), part(at % 60), F.lit("Z"))
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_END))
    optional = lambda test, name, value: F.when(test, line(name, value)).otherwise("")
    text = F.concat(
        F.lit("WARC/1.1" + _END),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", date),
        optional(F.col("url").isNotNull(), "WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        optional(revisit, "WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        optional(revisit, "WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(_END), F.when(revisit, "").otherwise(F.col("html")), F.lit(_END),
    )
    return rows.select(text.alias("value"))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    record(with_types(pages, page_id, url, html)).write.option("lineSep", _END).option("compression", "gzip").text(folder)


class Reader:
    """Records from lines that end with CR LF; a payload may hold such line ends itself."""

    def __init__(self) -> None:
        self.head: dict[str, str] | None = None
        self.left: int | None = None
        self.body: list[bytes] = []

    def feed(self, line: bytes) -> tuple[dict[str, str], bytes] | None:
        if self.left is not None:
            self.body.append(line)
            self.left -= len(line)
            if self.left <= 0:
                done = self.head, b"\r\n".join(self.body)
                self.head, self.left, self.body = None, None, []
                return done
            self.left -= 2
        elif self.head is None:
            if line.startswith(b"WARC/"):
                self.head = {}
        elif line:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            self.head[name.strip().lower()] = value.strip()
        else:
            self.left = int(self.head["content-length"])
        return None


def _page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def _seconds(date: str) -> int:
    return int(dt.datetime.strptime(date, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=dt.timezone.utc).timestamp())


def key_of(r: dict) -> tuple:
    return (r["urlkey"], r["ts"], r["page_id"] is None, r["page_id"] or 0)


def read_runs(df: DataFrame) -> DataFrame:
    """Captures of archives read as lines (value): one sorted run a task, run and seq beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        reader, rows = Reader(), []
        for batch in batches:
            for line in batch.column("value"):
                found = reader.feed(line.as_buffer().to_pybytes())
                if not found:
                    continue
                head, body = found
                payload = head["warc-type"] != "revisit"
                rows.append({
                    "page_id": _page(head["warc-record-id"]), "url": head.get("warc-target-uri"), "urlkey": surt(head.get("warc-target-uri")), "ts": _seconds(head["warc-date"]),
                    "payload_bytes": len(body) if payload else int(head["x-payload-length"]), "payload_digest": hashlib.sha256(body).hexdigest() if payload else head["warc-payload-digest"].partition(":")[2],
                    "record_type": head["warc-type"], "refers_to": _page(head.get("warc-refers-to")),
                })
        rows.sort(key=key_of)
        number = TaskContext.get().partitionId()
        for i in range(0, len(rows), 5000):
            part = [{**r, "run": number, "seq": i + k} for k, r in enumerate(rows[i : i + 5000])]
            yield pa.RecordBatch.from_pylist(part, schema=_SCHEMA)

    return df.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, _FIELDS + ", run bigint, seq bigint")


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("urlkey", pa.string()), ("ts", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("run", pa.int64()), ("seq", pa.int64())])


class LoserTree:
    """Smallest next item of k sorted lists: each inner node keeps the loser of its match, the winner moves up."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * len(runs)
        self.now = [key(r[0]) if r else None for r in runs]
        self.tree = [-1] * self.k
        for i in range(len(runs)):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        """Whether list a's item comes first; an empty list never does, equal items go by list."""
        x, y = self.now[a], self.now[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:  # while building: wait here for the other side
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        if not self.runs:
            return
        while self.now[w := self.tree[0]] is not None:
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.now[w] = self.key(self.runs[w][self.at[w]]) if self.at[w] < len(self.runs[w]) else None
            self._play(w)


class _Piece:
    """A run's part of a range, row by row, over Arrow columns."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.table = pa.Table.from_batches(batches).combine_chunks()
        self.keys = [self.table.column(c).combine_chunks() for c in ("urlkey", "ts", "page_id")]

    def __len__(self) -> int:
        return self.table.num_rows

    def __getitem__(self, i: int) -> tuple:
        urlkey, ts, page = (c[i].as_py() for c in self.keys)
        return (urlkey, ts, page is None, page or 0), i, self


def merge(runs: DataFrame) -> DataFrame:
    """Captures in global order of URL key, time and page; position counts the earlier captures of a range, range the ranges; nth counts those of the URL key within the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            at = batch.column("run").to_numpy()
            ends = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else []
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                pieces.setdefault(int(at[s]), []).append(batch.slice(s, e - s))
        held = [_Piece(pieces.pop(k)) for k in sorted(pieces)]
        offset = dict(zip(map(id, held), np.cumsum([0, *map(len, held)])[:-1].tolist(), strict=True)) if held else {}
        order, nth, last = [], [], None
        for key, i, piece in LoserTree(held, lambda x: x[0]):
            nth.append(nth[-1] + 1 if nth and key[0] == last else 1)
            last = key[0]
            order.append(offset[id(piece)] + i)
        if not held:
            return
        whole, number = pa.concat_tables([p.table for p in held]), TaskContext.get().partitionId()
        for i in range(0, len(order), 5000):
            part = whole.take(pa.array(order[i : i + 5000])).combine_chunks()
            n = part.num_rows
            columns = [part.column(c).combine_chunks() for c in _SCHEMA.names[:-2]] + [pa.array([number] * n, pa.int64()), pa.array(range(i, i + n), pa.int64()), pa.array(nth[i : i + n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*_SCHEMA.names[:-2], "range", "position", "nth"])

    spark = runs.sparkSession
    ranges = max(parts(spark), runs.count() // RANGE_ROWS)
    dealt = runs.repartitionByRange(ranges, "urlkey", "ts", F.col("page_id").asc_nulls_last()).sortWithinPartitions("run", "seq")
    return dealt.mapInArrow(run, _FIELDS + ", range bigint, position bigint, nth bigint")


def read_archives(df: DataFrame, folder: str) -> DataFrame:
    """The merged index of the archives in a folder; df names the session."""
    lines = df.sparkSession.read.option("lineSep", _END).text(folder)
    return merge(cut(read_runs(lines)))


def captures(pages: DataFrame) -> DataFrame:
    """The merged index of archives of the pages, with each capture's number in the history of its URL key."""
    folder = f"{scratch(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    return histories(read_archives(pages, folder))


def histories(index: DataFrame) -> DataFrame:
    """For every capture its number in the history of its URL key, by time and page: that in the range, and what earlier ranges hold of the key."""
    index = cut(index)
    held = index.groupBy("urlkey", "range").agg(F.max("nth").alias("n"))
    # A key in more than one range ends one and starts the next, so there are fewer such keys than ranges.
    several = held.groupBy("urlkey").agg(F.count("*").alias("ranges")).where("ranges > 1").select("urlkey")
    before = Window.partitionBy("urlkey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offset = held.join(several, "urlkey").select("urlkey", "range", F.sum("n").over(before).alias("before"))
    out = index.join(F.broadcast(offset), ["urlkey", "range"], "left")
    return out.withColumn("capture", F.col("nth") + F.coalesce("before", F.lit(0))).drop("nth", "before")
