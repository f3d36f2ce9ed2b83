"""Approximate nearest neighbours by balanced posting lists (an inverted index in partitions).

1. Equal vectors become one, with their smallest ids (as many as a result can
   hold, and one more), so a vector that a third of the rows share costs one row.
2. Centroids are fitted on a bounded sample by k-means that splits large clusters,
   and every vector is indexed: in the list of its nearest centroid and, near a
   boundary, in up to REPLICAS lists whose centroids are nearly as near.
3. Centroids are searched through an in-memory neighbour graph, best first; where a
   large share of them is asked for, all are ranked.
4. A query goes to the lists of the nearest centroids: PROBE of them or a share of
   all, whichever is more, and on until they hold k + 1 vectors. A list is left out
   only if its radius shows that k + 1 vectors nearer than any of its are at hand.
   A list is cut into slices of a fixed size that queries visit one by one, so a
   long list spreads over tasks; each slice returns its nearest, a query's lists
   are merged at the end.

Distances are Euclidean in double precision on the original vectors; ties go to
the smaller id. Vectors that are null, zero or hold a null or non-finite component,
null ids and lengths other than the commonest take no part. Repeated rows of one
id count once; of different vectors of one id the smallest in the order of arrays
counts. Equal vectors are found by their components, not by a hash. As long as the lists are few (at most PROBE) the answer is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, first_by_hash, spread_join

#: Distinct vectors that the centroids are fitted on, about, chosen by a bound on hashes of ids.
SAMPLE = 20_000
#: Vectors that a list should hold; centroids, at most.
LIST, MOST_LISTS = 400, 4096
REPLICAS, BOUNDARY = 3, 1.12
#: Lists a query visits: so many, or this share of all lists if that is more.
PROBE, SHARE = 96, 1 / 6
SLICE = 2000
_DEGREE = 24


def clean(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v (array of doubles) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return rows.where(F.col(vec_id).isNotNull() & good).select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v"))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centroids; after each round those of the smallest clusters move next to those of the largest, which balances the lists."""
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for turn in range(rounds):
        near = np.concatenate([(((c * c).sum(1) - 2 * x[i : i + 4000] @ c.T).argmin(1)) for i in range(0, len(x), 4000)])
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if turn < rounds - 2:
            order = np.argsort(n, kind="stable")
            for small, large in zip(order, order[::-1], strict=False):
                if n[large] <= 2.5 * len(x) / k or n[small] >= 0.3 * len(x) / k:
                    break
                c[small] = c[large] + rng.normal(0, 1e-2, c.shape[1]) * np.abs(c[large]).mean()
    return c


class Centroids:
    """Centroids with a neighbour graph, searched best first from entry points spread over them."""

    def __init__(self, c: np.ndarray):
        self.c = c
        near = np.concatenate([np.argsort((c * c).sum(1) - 2 * c[i : i + 500] @ c.T, 1, kind="stable")[:, 1 : _DEGREE + 1] for i in range(0, len(c), 500)]) if len(c) > 1 else np.zeros((1, 0), int)
        graph: list[set[int]] = [set(r.tolist()) for r in near]
        for i, r in enumerate(near.tolist()):  # both ways, so that every centroid can be reached from its neighbours
            for j in r:
                graph[j].add(i)
        self.graph = [np.array(sorted(g), np.int64) for g in graph]
        self.entry = np.unique(np.linspace(0, len(c) - 1, min(len(c), 32)).astype(np.int64))

    def search(self, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n nearest centroids found, nearest first, and their distances."""
        if 8 * n >= len(self.c):  # the graph would visit most of them
            d = np.sqrt(((self.c - q) ** 2).sum(1))
            order = np.argsort(d, kind="stable")[:n]
            return order, d[order]
        width = min(len(self.c), 2 * n)
        seen = np.zeros(len(self.c), bool)
        seen[self.entry] = True
        d = np.sqrt(((self.c[self.entry] - q) ** 2).sum(1))
        open_ = list(zip(d.tolist(), self.entry.tolist(), strict=True))
        heapq.heapify(open_)
        best = [(-x, i) for x, i in open_]
        heapq.heapify(best)
        while open_:
            x, i = heapq.heappop(open_)
            if len(best) >= width and x > -best[0][0]:
                break
            new = self.graph[i][~seen[self.graph[i]]]
            seen[new] = True
            for y, j in zip(np.sqrt(((self.c[new] - q) ** 2).sum(1)).tolist(), new.tolist(), strict=True):
                if len(best) < width or y < -best[0][0]:
                    heapq.heappush(open_, (y, j))
                    heapq.heappush(best, (-y, j))
                    if len(best) > width:
                        heapq.heappop(best)
        found = sorted((-x, i) for x, i in best)[:n]
        return np.array([i for _, i in found], np.int64), np.array([x for x, _ in found])


def _batch(t: pa.RecordBatch, column: str) -> np.ndarray:
    return np.array(t.column(column).flatten().to_numpy(zero_copy_only=False), float).reshape(t.num_rows, -1)


def probes(lists: int) -> int:
    return min(lists, max(PROBE, ceil(SHARE * lists)))


def near_lists(index: Centroids, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists that a vector stands in, and its distances to their centroids."""
    c, d = index.search(q, REPLICAS)
    near = d <= BOUNDARY * d[0] + 1e-12
    return c[near], d[near]


def visited(index: Centroids, q: np.ndarray, sizes: np.ndarray, radii: np.ndarray, k: int) -> np.ndarray:
    """The lists that a query visits, nearest first."""
    full = (k + 1) * REPLICAS  # that many places hold k + 1 vectors, as a vector has at most REPLICAS
    for n in (probes(len(sizes)), len(sizes)):
        c, d = index.search(q, n)
        c, d = c[sizes[c] > 0], d[sizes[c] > 0]
        held = np.cumsum(sizes[c])
        if len(held) and held[-1] >= full:
            break
    else:
        return c
    first = int(np.searchsorted(held, full)) + 1
    bound = (d[:first] + radii[c[:first]]).max()  # k + 1 vectors are at most that far
    return c[d - radii[c] <= bound * (1 + 1e-9) + 1e-9]


def _listed(rows: DataFrame, how: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Rows (key, v) in each list that they go to, with a distance: (list, key, v, d)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            at, lists, far = [], [], []
            for i, q in enumerate(_batch(t, "v")):
                c, d = how(q)
                at += [i] * len(c)
                lists += c.tolist()
                far += d.tolist()
                if len(at) >= 20_000 or i + 1 == t.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), *(t.column(c).take(pa.array(at, pa.int64())) for c in ("key", "v")), pa.array(far, pa.float64())], names=["list", "key", "v", "d"])
                    at, lists, far = [], [], []

    return rows.select("key", "v").mapInArrow(run, "list bigint, key bigint, v array<double>, d double")


def search(rows: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows but itself."""
    spark = rows.sparkSession
    base = clean(rows, vec_id, embedding)
    size = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not size:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = size[0]["n"]
    one = lambda df: df.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    # One row a distinct vector: its smallest ids, kept by a rank that discards the others before the shuffle; its key is the smallest.
    same = Window.partitionBy("v")
    few = one(base).withColumn("_r", F.row_number().over(same.orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    few = cut(few.withColumn("key", F.min("vec_id").over(same)))
    ids = few.select("key", "vec_id")
    first = few.where("_r = 1").select("key", "v")
    sample = np.array([r["v"] for r in sorted(first_by_hash(first, "key", SAMPLE, 9).collect(), key=lambda r: r["key"])], float).reshape(-1, dim)
    total = first.count()
    lists = int(min(MOST_LISTS, max(1, total // LIST), max(1, len(sample) // 4)))
    index = Centroids(kmeans(sample, lists, np.random.default_rng(5)))
    shared = spark.sparkContext.broadcast(index)
    posts = cut(_listed(first, lambda v: near_lists(shared.value, v)))
    held = posts.groupBy("list").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect()  # at most MOST_LISTS rows
    sizes, radii = np.zeros(lists, np.int64), np.zeros(lists)
    for r in held:
        sizes[r["list"]], radii[r["list"]] = r["n"], r["r"]
    limits = spark.sparkContext.broadcast((sizes, radii))
    ask = cut(one(clean(queries, vec_id, embedding)).withColumn("key", F.min("vec_id").over(same)))

    def route(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = visited(shared.value, q, *limits.value, k)
        return c, np.zeros(len(c))

    routed = _listed(ask.where("vec_id = key").select("key", "v"), route)
    long = spark.createDataFrame([(r["list"], -(-r["n"] // SLICE)) for r in held], "list bigint, slices int")
    post = posts.join(F.broadcast(long), "list").select("list", F.pmod(F.xxhash64("key"), "slices").cast("int").alias("slice"), F.lit(0).alias("kind"), "key", "v")  # at most MOST_LISTS rows
    visit = routed.join(F.broadcast(long), "list").select("list", F.explode(F.expr("sequence(0, slices - 1)")).alias("slice"), F.lit(1).alias("kind"), "key", "v")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, names, x = None, [], [], None  # the vectors of one slice; its queries stream by
        for batch in batches:
            if not batch.num_rows:
                continue
            at, part, kind, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "slice", "kind", "key"))
            v = _batch(batch, "v")
            ends = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1]), [True]]))
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if now != (at[s], part[s]):
                    now, held, names, x = (at[s], part[s]), [], [], None
                own = kind[s:e] == 0
                if own.any():
                    held.append(v[s:e][own])
                    names.append(key[s:e][own])
                if own.all() or not held:
                    continue
                if x is None:
                    x, label = np.concatenate(held), np.concatenate(names)
                    norm = (x * x).sum(1)
                q, asked = v[s:e][~own], key[s:e][~own]
                out: tuple[list, list, list] = ([], [], [])
                for i in range(0, len(q), 256):
                    # squared distances by a product pick who is measured exactly; their rounding error is far below the slack
                    own_norm = (q[i : i + 256] ** 2).sum(1)
                    d = norm - 2 * q[i : i + 256] @ x.T + own_norm[:, None]
                    last = np.partition(d, k, 1)[:, k] if len(x) > k + 1 else np.full(len(d), np.inf)
                    last = last + 1e-9 * (own_norm + norm.max())
                    for j in range(len(d)):
                        pick = np.flatnonzero(d[j] <= last[j])
                        exact = np.sqrt(((x[pick] - q[i + j]) ** 2).sum(1))
                        # all ties of the last place stay, so the final order by id is exact
                        good = exact <= np.partition(exact, k)[k] if len(exact) > k + 1 else np.ones(len(exact), bool)
                        out[0].append(np.full(good.sum(), asked[i + j]))
                        out[1].append(label[pick[good]])
                        out[2].append(exact[good])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["q", "key", "score"])

    found = post.union(visit).repartition("list", "slice").sortWithinPartitions("list", "slice", "kind").mapInArrow(nearest, "q bigint, key bigint, score double")
    # A vector found in several lists counts once; k + 1 vectors suffice, as a query's own vector is one of them.
    best = found.groupBy("q", "key").agg(F.min("score").alias("score"))
    best = best.withColumn("_r", F.rank().over(Window.partitionBy("q").orderBy("score"))).where(F.col("_r") <= k + 1).drop("_r")
    named = best.join(ids.select("key", "vec_id"), "key").select("q", "vec_id", "score")
    top = cut(named.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("_r") <= k + 1).drop("_r"))
    pairs = spread_join(ask.select(F.col("vec_id").alias("query_id"), F.col("key").alias("q")), top, "q", ask.count()).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute(rows: list[tuple], k: int = 10) -> list[tuple]:
    """The exact answer by all distances, for tests."""
    good: dict[int, np.ndarray] = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and np.any(v) and (i not in good or list(v) < good[i].tolist()):
            good[i] = np.array(v, float)
    out = []
    for q in sorted(i for i in good if i % 100 == 0):
        near = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)[:k]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(near)]
    return out
