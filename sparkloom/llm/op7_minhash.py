"""Near-duplicate documents: MinHash banding, verification, connected components.

1. Each document gets the minima of many universal hashes over its word shingles
   and a key of its whole normalised word sequence; equal keys form one class, so
   exact copies never meet in a bucket.
2. Bands of minima are bucket keys. In every bucket one pivot (the document that
   shares most buckets) is paired with the others: rows grow with the documents,
   not with the square of a bucket.
3. Pairs pass the signature estimate, then the exact ratio of the full sets.
4. Alternating large-star and small-star gives the components.
5. Buckets that still hold several components are compared fully, in slices of a
   fixed size, by signature inside the task. What is alike forms clusters (wider
   than components); each cluster that holds several components is compared once
   more, on full sets. Either leaves only a spanning forest, so rows stay in
   proportion to the documents, and no pivot choice loses a link.

Keys that hold many rows (a hub, a bucket, a class of copies) are dealt over tasks in
every join. Null or empty texts have no shingles, link with nothing and are kept. Rows
that share a doc_id are one node, whatever their texts. A null doc_id takes no part in links and is kept.
The probability that banding misses a pair at exactly 0.8 is about 2e-6, that
the estimate rejects it about 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_file, cut, groups, remove, row_slices, sealed, spread_join

BANDS, ROWS = 44, 6
#: Share of equal minima below which a pair isn't confirmed: 0.8 less five standard deviations of the estimate.
LEAST_EQUAL = 0.68
SLICE = 1024
_CHUNK = 1 << 14
_M = (1 << 64) - 1


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at white space of ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, k: int, cache: dict) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; of the whole text, if it has fewer."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))
    n = max(1, len(ids) - k + 1)
    h = np.full(n, min(k, len(ids)), np.uint64)
    for i in range(min(k, len(ids))):
        h = _mix(h ^ ids[i : i + n])
    return np.unique(h)


def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, _M, n, np.uint64) | np.uint64(1), rng.integers(0, _M, n, np.uint64)


def minima(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Minima (documents x hashes) of x -> (a x + b) >> 32 mod 2^32 over non-empty sets."""
    a, b = _universal(bands * rows)
    out = np.empty((len(sets), len(a)), np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= _CHUNK):
            n += len(sets[j])
            j += 1
        x = np.concatenate(sets[i:j])
        start = np.concatenate([[0], np.cumsum([len(s) for s in sets[i : j - 1]])]).astype(np.int64) if j - i > 1 else np.zeros(1, np.int64)
        y = np.empty_like(x)
        for p in range(len(a)):
            np.multiply(x, a[p], out=y)
            np.add(y, b[p], out=y)
            out[i:j, p] = np.minimum.reduceat(y, start) >> np.uint64(32)
        i = j
    return out


def signatures(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """doc_id, key of the word sequence, n shingles, band hashes, one byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in batches:
            for piece in row_slices(batch, "text", 4 << 20):
                texts = piece.column("text").to_pylist()
                sets = [shingle_set(t, k, cache) for t in texts]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, bands, sig = [None] * len(texts), [None] * len(texts), [None] * len(texts)
                if full:
                    m = minima([sets[i] for i in full])
                    low = (m & np.uint32(255)).astype(np.uint8)
                    h = np.tile(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (len(full), 1))
                    for r in range(ROWS):
                        h = _mix(h ^ m[:, r::ROWS][:, :BANDS].astype(np.uint64))
                    h = h.view(np.int64)
                    for x, i in enumerate(full):
                        keys[i] = xxhash.xxh3_128_digest(b" ".join(words(texts[i])))
                        bands[i], sig[i] = h[x], low[x].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    names=["doc_id", "key", "n", "bands", "sig"],
                )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, key binary, n bigint, bands array<bigint>, sig binary")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the edges, by alternating large-star and small-star.

    Each round is two joins on the node, in which the edges of a node with many are dealt
    over tasks; self loops are ignored; no edges give no rows.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark, n = None, now.count()
    while True:
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, low, "u", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # What large-star leaves has few edges a node on this side: no key is hot.
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        old, now = now, cut(small.where("u <> v").distinct())
        if file := checkpoint_file(old):
            remove(edges.sparkSession, file)
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        n = mark[0]
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal minima, less what bytes share by chance."""
    return ((x == y).mean(-1) - 1 / 256) / (1 - 1 / 256)


def _alike(pairs: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose set sizes and signatures allow the similarity."""
    one, two = (sig.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
    n = pairs.count()
    both = spread_join(spread_join(pairs, one, "a", n, by=["b"]), two, "b", n, by=["a"], seen=pairs).where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(t.num_rows, -1) for c in ("sa", "sb"))
                yield t.select(["a", "b"]).filter(pa.array(_estimate(x, y) >= LEAST_EQUAL - (0.8 - percent / 100)))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _full(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """doc_id and the full shingle set, as sorted hashes, of the documents in ids (doc_id)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for batch in batches:
            for piece in row_slices(batch, "text", 4 << 20):
                full = [shingle_set(t, k, cache).tobytes() for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(full, pa.binary())], names=["doc_id", "full"])

    return docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(sets, "doc_id bigint, full binary")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    n = len(np.intersect1d(x, y, assume_unique=True))
    return n > 0 and 100 * n >= percent * (len(x) + len(y) - n)


class _Sets:
    """Full sets of one unit; compares one with many by marking its elements and counting marks."""

    def __init__(self, full: list[np.ndarray], percent: int):
        self.full, self.percent, self.size = full, percent, np.array([len(f) for f in full], np.int64)
        self.flat: np.ndarray | None = None

    def linked(self, x: int, y: np.ndarray) -> np.ndarray:
        if len(y) < 8:
            return np.array([_linked(self.full[x], self.full[z], self.percent) for z in y], bool)
        if self.flat is None:
            names, flat = np.unique(np.concatenate(self.full), return_inverse=True)
            self.flat, self.mark = flat.astype(np.int32), np.zeros(len(names), bool)
            self.start = np.cumsum(self.size) - self.size
        own = self.flat[self.start[x] : self.start[x] + self.size[x]]
        self.mark[own] = True
        n = self.size[y]
        at = np.repeat(self.start[y] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.add.reduceat(self.mark[self.flat[at]].astype(np.int64), np.cumsum(n) - n)
        self.mark[own] = False
        return 100 * both >= self.percent * (self.size[x] + n - both)


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity."""
    ids = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id")
    full = cut(_full(ids, docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(t.column("fa"), t.column("fb"), strict=True)]
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (full.select(F.col("doc_id").alias(x), F.col("full").alias(f"f{x}")) for x in "ab")
    n = pairs.count()
    return spread_join(spread_join(pairs, one, "a", n, by=["b"]), two, "b", n, by=["a"], seen=pairs).select("a", "b", "fa", "fb").mapInArrow(run, "a bigint, b bigint").distinct()


def _forest(members: DataFrame, key: str, percent: int, exact: bool) -> DataFrame:
    """Edges that join what is alike in a group but has different components; members: key, rep, comp, n, sig, size and full, if exact.

    Alike is what the signatures say or, if exact, the full sets too. A group is
    cut into slices; each pair of slices is a unit of at most about twice SLICE
    rows, so a hot group spreads over many tasks. A unit returns a spanning
    forest, fewer edges than it has rows, whatever the number of pairs alike.
    """
    least = LEAST_EQUAL - (0.8 - percent / 100)
    slices = F.ceil(F.col("size") / SLICE).cast("int")
    own = F.pmod(F.xxhash64("rep"), slices.cast("bigint")).cast("int")
    units = members.withColumn("slices", slices).withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, slices - 1)")))
    units = units.select(F.col(key).alias("h"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "comp", "n", "sig", *["full"] * exact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in groups(batches, ["h", "i", "j"]):
            sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint8).reshape(len(rows), -1)
            own, rep, comp, n = (np.array([r[c] for r in rows]) for c in ("own", "rep", "comp", "n"))
            sets = _Sets([np.frombuffer(r["full"], np.uint64) for r in rows], percent) if exact else None
            a, b = [], []
            for x in np.flatnonzero(own == i):
                y = np.flatnonzero((comp != comp[x]) & (np.minimum(n, n[x]) * 100 >= np.maximum(n, n[x]) * percent) & ((own == j) if i != j else (np.arange(len(rows)) > x)))
                y = y[_estimate(sig[y], sig[x]) >= least] if len(y) else y
                if exact and len(y):
                    y = y[sets.linked(x, y)]
                for z in y.tolist():
                    if comp[z] != comp[x]:
                        a.append(min(rep[x], rep[z]))
                        b.append(max(rep[x], rep[z]))
                        comp[comp == max(comp[x], comp[z])] = min(comp[x], comp[z])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return units.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sig = cut(signatures(docs, doc_id, text, k))
    total = sig.count()
    rows = sig.where("key is not null and doc_id is not null")
    # One row a class of equal texts, by partial aggregation; an id with several texts stands in several classes.
    reps = cut(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n", "sig", "bands"), "doc_id").alias("s")).select("key", "rep", "s.n", "s.sig", "s.bands"))
    classes = reps.select("key", "rep")
    band = reps.select("rep", F.explode("bands").alias("h"))
    sizes = band.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(spread_join(band, sizes, "h", BANDS * total))
    many = shared.count()
    degree = shared.groupBy("rep").agg(F.sum("size").alias("degree"))
    hub = shared.join(degree, "rep").groupBy("h").agg(F.max(F.struct("degree", (-F.col("rep")).alias("r"))).alias("top")).select("h", (-F.col("top.r")).alias("hub"))
    pairs = cut(spread_join(shared, hub, "h", many).where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct())
    light = reps.select("rep", "n", "sig")
    links = cut(_confirmed(cut(_alike(pairs, light, percent).distinct()), plain, k, percent))
    comp = components(links)
    labelled = shared.join(comp, F.expr("rep = node"), "left").select("h", "rep", "size", F.coalesce("component", "rep").alias("comp"))
    mixed = labelled.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("h")
    alike = cut(_forest(spread_join(labelled, mixed, "h", many, seen=shared).join(light, "rep"), "h", percent, False))
    if not alike.isEmpty():
        cluster = components(links.union(alike)).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
        known = cluster.join(comp, F.expr("rep = node"), "left").select("rep", "cluster", F.coalesce("component", "rep").alias("comp"))
        several = known.groupBy("cluster").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("cluster", "size")
        members = cut(known.join(several, "cluster"))
        full = _full(members.select(F.col("rep").alias("doc_id")), plain, k).withColumnRenamed("doc_id", "rep")
        more = cut(_forest(members.join(light, "rep").join(full, "rep"), "cluster", percent, True))
        comp = components(links.union(more))
    named = classes.join(comp, F.expr("rep = node"), "left").select("key", F.coalesce("component", "rep").alias("c"))
    out = spread_join(sig.select("doc_id", "key", "n"), named, "key", total, "left", by=["doc_id"])
    linked = F.col("doc_id").isNotNull() & F.col("key").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.col("c")).otherwise(F.col("doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns, whatever their names; rows that repeat a doc_id stay together."""
    rows, names = sealed(docs)
    gone = near_duplicates(rows, names[doc_id], names[text], k, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return rows.join(gone, rows[names[doc_id]].cast("bigint") == F.col("_gone"), "left_anti").toDF(*docs.columns)


def brute(docs: list[tuple], k: int = 5, percent: int = 80) -> list[tuple]:
    """The same by comparing all pairs, for tests."""
    sets = []
    for d, t in docs:
        w = words(t)
        sets.append((d, {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()))
    root = {d: d for d, _ in docs}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                r, s = find(a), find(b)
                root[max(r, s)] = min(r, s)
    return [(d, len(s), find(d), find(d) == d) for d, s in sets]

