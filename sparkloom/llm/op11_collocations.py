"""Phrase collocations by hierarchical pair naming.

Words that occur often enough get an id. A phrase of k words is the pair of the
ids of its first and its last k - 1 words, which stand side by side in the text;
pairs that occur often enough get an id of their own, and so on. Ids are given
globally: the occurrences of a pair, added up by chunk, meet in one place, are
summed, named and sent back to their chunks. A phrase's id thus points at two
parents, and following them gives the counts of both sides of every cut and the
shorter phrases that a longer one covers. No phrase but a shown one is ever spelt
out in the text's order, and no count rests on a hash.

Texts are read once into chunks (a language's words of some MB of text as numbers,
packed, beside the chunk's own vocabulary), which are written. Each level reads
them again together with the names that occur in them, and sends their pairs, packed
by hash bucket, to be counted; a chunk or a bucket, both of bounded size, is the
most that a task holds. A very frequent pair has one row a chunk, so no count
gathers its occurrences. The best phrases are found in rounds over salted parts of
a language, so no task ranks a whole language.

Words and pieces: A-Z become a-z, text ends a piece at . , ; : ! ? and line ends,
words are parted by spaces and tabs. Null texts are empty, null languages are
`und`, and a row with that language joins them. Repeated rows count each time.
Equal scores go by count, then by the phrase's bytes. An empty table gives an empty
result. Columns of docs beside the two named are not read. Counts up to 10^15 are
exact: products are decimals of 38 digits.
"""

from __future__ import annotations

import itertools
import re
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts, remove, scratch

CHUNK_BYTES = 16 << 20
#: Buckets of pairs for each task that counts them, and words of text for each bucket at most: a bucket is held whole in its task.
BUCKETS, BUCKET_WORDS = 4, 8 << 20
_PIECES = re.compile(rb"[.,;:!?\n-\r]").split


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from -1 in few bytes: all first bytes, then all second ones, and so on, compressed."""
    return zstandard.compress(np.ascontiguousarray((values + 1).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 3)


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64) - 1


class Chunk:
    """A language's words so far: their codes in reading order, -1 between pieces."""

    def __init__(self):
        self.codes, self.sequence, self.bytes = defaultdict(itertools.count().__next__), array("i"), 0

    def add(self, text: str) -> None:
        raw = text.encode("utf-8", "surrogatepass").lower()
        self.bytes += len(raw)
        for piece in _PIECES(raw):
            if words := piece.split():  # what is left of white space is spaces and tabs
                self.sequence.extend([self.codes[w] for w in words])
                self.sequence.append(-1)

    def row(self, lang: str) -> dict:
        """The chunk with its words by falling count, so that most codes are small and pack well."""
        seen = np.frombuffer(self.sequence, np.int32)
        counts = np.bincount(seen[seen >= 0], minlength=len(self.codes))
        order = np.argsort(-counts, kind="stable")
        rank = np.append(np.argsort(order), -1)
        words = [w.decode("utf-8", "surrogatepass") for w in self.codes]
        return {"lang": lang, "words": [words[i] for i in order.tolist()], "counts": counts[order].tolist(), "sequence": packed(rank[seen])}


_CHUNK = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("sequence", pa.binary())])


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Chunk] = defaultdict(Chunk)
    for batch in batches:
        for lang, text in zip(batch.column("_lang"), batch.column("_text"), strict=True):
            lang = lang.as_py()
            held[lang].add(text.as_py())
            if held[lang].bytes >= CHUNK_BYTES:
                yield pa.RecordBatch.from_pylist([held.pop(lang).row(lang)], _CHUNK)
        if len(held) > 1 and sum(c.bytes for c in held.values()) >= 2 * CHUNK_BYTES:  # of many languages the fullest goes
            lang = max(held, key=lambda k: held[k].bytes)
            yield pa.RecordBatch.from_pylist([held.pop(lang).row(lang)], _CHUNK)
    for lang, chunk in held.items():
        if chunk.sequence:
            yield pa.RecordBatch.from_pylist([chunk.row(lang)], _CHUNK)


def pair_keys(left: np.ndarray, right: np.ndarray, lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
    """A number for each pair of ids, equal for equal pairs; -1 where an id isn't among the sorted lefts or rights."""
    if not len(lefts):
        return np.full(len(left), -1)
    i, j = (np.minimum(np.searchsorted(known, ids), len(known) - 1) for known, ids in ((lefts, left), (rights, right)))
    return np.where((lefts[i] == left) & (rights[j] == right), i * len(rights) + j, -1)


def renamed(ids: np.ndarray, left: np.ndarray, right: np.ndarray, name: np.ndarray) -> np.ndarray:
    """The ids of a chunk one level up: at each place the name of the pair that begins there, -1 if it has none."""
    lefts, rights = np.unique(left), np.unique(right)
    known = pair_keys(left, right, lefts, rights)
    order = np.argsort(known)
    known, name = known[order], name[order]
    here = pair_keys(ids[:-1], ids[1:], lefts, rights)
    if not len(known):
        return np.full(len(here), -1)
    at = np.minimum(np.searchsorted(known, here), len(known) - 1)
    return np.where((here >= 0) & (known[at] == here), name[at], -1)


def buckets_of(left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
    """Where a pair is counted: equal for equal pairs, even over the buckets."""
    h = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def pairs_of(chunk: pa.Table, names: pa.Table, buckets: int) -> pa.Table:
    """The pairs of ids that stand side by side in a chunk, with how often, from the chunk's words and the names given so far.

    A row holds the pairs of one bucket in order, packed: steps between left ids, right ids, counts.
    """
    values = code = np.zeros(0, np.int64)
    left, right, n, number = code, code, code, 0
    if chunk.num_rows and names.num_rows:
        number = chunk.column("chunk")[0].as_py()
        sequence = unpacked(chunk.column("sequence")[0].as_py())
        level = names.column("level").to_numpy()
        ids = np.full(int(sequence.max()) + 2, -1)  # the last stands for the ends of pieces
        single = names.filter(pa.array(level == 1))
        ids[single.column("code").to_numpy()] = single.column("id").to_numpy()
        now = ids[sequence]
        for k in range(2, int(level.max()) + 1):
            some = [unpacked(b.as_py()).reshape(3, -1) for b in names.filter(pa.array(level == k)).column("names")]
            now = renamed(now, *np.concatenate([np.stack([np.cumsum(x[0]), x[1], x[2]]) for x in some], axis=1))
        values, code = np.unique(now, return_inverse=True)
        beside = code[:-1] * len(values) + code[1:]
        key, n = np.unique(beside[(now[:-1] >= 0) & (now[1:] >= 0)], return_counts=True)
        left, right = values[key // len(values)], values[key % len(values)]
    bucket = buckets_of(left, right, buckets)
    order = np.argsort(bucket, kind="stable")
    own, start = np.unique(bucket[order], return_index=True)
    ends = np.append(start, len(order))[1:]
    blobs = [packed(np.concatenate([np.diff(left[o], prepend=0), right[o], n[o]])) for o in (order[a:b] for a, b in zip(start, ends, strict=True))]
    return pa.table({"chunk": pa.array(np.full(len(own), number), pa.int64()), "bucket": pa.array(own, pa.int64()), "pairs": pa.array(blobs, pa.binary())})


def counted(bucket: pa.Table, least: int, buckets: int, last: bool) -> pa.Table:
    """Of a bucket's pairs those that occur `least` times in all, with their totals and ids, in a row without a chunk, and for each chunk a row of those that it has, packed.

    The id is the place among the bucket's frequent pairs in order, times the number of
    buckets, plus the bucket's own number: unique, dense, and the same whenever it is made.
    On the last level only totals are wanted.
    """
    held = [unpacked(b.as_py()).reshape(3, -1) for b in bucket.column("pairs")]
    left, right, n = (np.concatenate([np.cumsum(h[k]) if k == 0 else h[k] for h in held]) for k in range(3))
    chunk = np.repeat(bucket.column("chunk").to_numpy(), [h.shape[1] for h in held])
    order = np.lexsort((chunk, right, left))
    left, right, n, chunk = left[order], right[order], n[order], chunk[order]
    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(left) != 0) | (np.diff(right) != 0)]))
    total, size = np.add.reduceat(n, fresh), np.diff(np.append(fresh, len(n)))
    kept = total >= least
    first = fresh[kept]
    number = np.arange(len(first)) * buckets + bucket.column("bucket")[0].as_py()
    lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (left[first], right[first], number, total[kept])]
    if last or not len(first):
        return pa.table([pa.array([None], pa.int64()), pa.array([None], pa.binary()), *lists], names=["chunk", "names", "left", "right", "id", "f"])
    rows, name = np.flatnonzero(np.repeat(kept, size)), np.repeat(number, size[kept])
    order = np.argsort(chunk[rows], kind="stable")  # within a chunk by pair
    rows, name = rows[order], name[order]
    own, start = np.unique(chunk[rows], return_index=True)
    blobs = [packed(np.concatenate([np.diff(left[rows[a:b]], prepend=0), right[rows[a:b]], name[a:b]])) for a, b in zip(start, np.append(start, len(rows))[1:], strict=True)]
    none = pa.nulls(len(own), pa.list_(pa.int64()))
    return pa.table([pa.array([*own.tolist(), None], pa.int64()), pa.array([*blobs, None], pa.binary()), *(pa.concat_arrays([none, x]) for x in lists)], names=["chunk", "names", "left", "right", "id", "f"])


def _counter(least: int, buckets: int, last: bool):
    return lambda bucket: counted(bucket, least, buckets, last)


def totals(found: DataFrame) -> DataFrame:
    """A row for each frequent pair: its parents, id and total."""
    rows = found.where("chunk is null").select(F.explode(F.arrays_zip("left", "right", "id", "f")).alias("_p"))
    return rows.select(*[F.col(f"_p.{c}").alias(c) for c in ("id", "left", "right", "f")])


def named(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows (keys, chunk, n, ...), dealt by keys or some of them, of what occurs `least` times in all, with its id; one row of each has the total f.

    One shuffle serves counting, naming and the way back. The id is the number of a row, so it
    only holds once the table is written; numbers are dense and follow the keys, so they pack well.
    """
    group, n = Window.partitionBy(*keys), parts(rows.sparkSession)
    numbered = rows.sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id())
    task = F.shiftright("_row", 33)
    number = F.when(task < n, F.col("_row").bitwiseAND((1 << 33) - 1) * n + task).otherwise(F.raise_error("more tasks than shuffle partitions").cast("bigint"))
    counted = numbered.withColumn("_row", number).withColumn("_f", F.sum("n").over(group)).withColumn("id", F.min("_row").over(group))
    return counted.where(F.col("_f") >= least).withColumn("f", F.when(F.col("_row") == F.col("id"), F.col("_f"))).drop("_row", "_f", "n")


def parents(level: DataFrame, below: DataFrame) -> DataFrame:
    """Language, words and the counts of every beginning and ending of each pair, from those of its two parents."""
    one = below.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("_first"), F.col("f").alias("_l"), F.col("heads").alias("_heads"))
    two = below.select(F.col("id").alias("right"), F.col("last"), F.col("f").alias("_r"), F.col("tails").alias("_tails"))
    both = level.join(one, "left").join(two, "right")
    return both.select("id", "left", "right", "lang", F.concat_ws(" ", "_first", "last").alias("phrase"), "last", "f", F.concat("_heads", F.array("_l")).alias("heads"), F.concat("_tails", F.array("_r")).alias("tails"))


def worst_cut(k: int) -> Column:
    """score, l and r of the cut with the lowest score; of equal ones the first."""
    big = lambda c: c.cast("decimal(19,0)")
    cuts = []
    for j in range(1, k):
        left, right = F.col("heads")[j - 1], F.col("tails")[k - j - 1]
        above, under = big(F.col("f")) * big(F.col("f")) * F.lit(1_000_000).cast("decimal(7,0)"), big(left) * big(right)
        cuts.append(F.struct(F.call_function("div", above, under).alias("score"), F.lit(j).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def first_of(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language with their rank: first of salted parts, then of what is left of them."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salts = parts(rows.sparkSession)
    while salts > 1:
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("rank")
        salts //= 64
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """Per language the `top` phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score.

    least: occurrences of a phrase; covered: a phrase goes if a longer one that holds it has so many percent of its count.
    """
    spark = docs.sparkSession
    folder = f"{scratch(spark)}/collocations-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang"), F.col(text).alias("_text")).where("_text is not null")
    made = rows.mapInArrow(chunks_of, "lang string, words array<string>, counts array<bigint>, sequence binary")
    base = stored(made.withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    total = base.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda x, y: x + y)).alias("n"))
    words = base.select("lang", "chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "_w"))
    words = words.select("lang", "chunk", F.col("code").cast("bigint"), F.col("_w.words").alias("word"), F.col("_w.counts").alias("n"))
    found = stored(named(words.repartition(parts(spark), "lang", "word"), ["lang", "word"], least), "level1")
    none = F.array().cast("array<bigint>")
    below = found.where("f is not null").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("heads"), none.alias("tails"))
    names = found.select("chunk", F.lit(1).alias("level"), "code", "id", F.lit(None).cast("binary").alias("names"))
    words_in_all = total.agg(F.sum("n")).first()[0] or 0
    levels, buckets = [], max(BUCKETS * parts(spark), words_in_all // BUCKET_WORDS)
    for k in range(2, longest + 1):
        beside = base.select("chunk", "sequence").groupBy("chunk").cogroup(names.groupBy("chunk")).applyInArrow(lambda a, b: pairs_of(a, b, buckets), "chunk bigint, bucket bigint, pairs binary")
        pairs = beside.groupBy("bucket").applyInArrow(_counter(least, buckets, k == longest), "chunk bigint, names binary, left array<bigint>, right array<bigint>, id array<bigint>, f array<bigint>")
        found = stored(pairs, f"level{k}")
        more = found.where("chunk is not null").select("chunk", F.lit(k).alias("level"), F.lit(None).cast("bigint").alias("code"), F.lit(None).cast("bigint").alias("id"), "names")
        names, level = names.unionByName(more), totals(found)
        below = stored(parents(level, below), f"phrases{k}")
        levels.append(below)
    shown = []
    for k, level in enumerate(levels, 2):
        if k < longest:
            longer = levels[k - 1].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("_f")).groupBy("id").agg(F.max("_f").alias("_f"))
            level = level.join(longer, "id", "left").where(F.coalesce(100 * F.col("_f") < covered * F.col("f"), F.lit(True)))
        scored = level.withColumn("_cut", worst_cut(k))
        shown.append(scored.select("lang", "phrase", F.col("f").alias("a"), F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score")))
    out = shown[0]
    for other in shown[1:]:
        out = out.unionByName(other)
    out = cut(first_of(out, top).join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
    remove(spark, folder)
    return out


def brute(rows: list[tuple], longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000) -> list[tuple]:
    """The same by counting every phrase as a string, from rows (lang, text), for tests."""
    f: Counter = Counter()
    total: Counter = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    held = {p: n for p, n in f.items() if len(p[1]) > 1 and n >= least}
    gone = {(lang, w[i : i + k]) for (lang, w), n in held.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * n >= covered * f[lang, w[i : i + k]]}
    out = []
    for (lang, w), a in held.items():
        if (lang, w) not in gone:
            score, _, left, right = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, left, right, total[lang], score))
    ranked = []
    for lang, group in itertools.groupby(sorted(out, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())), key=lambda r: r[0]):
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(itertools.islice(group, top), 1)]
    return ranked
