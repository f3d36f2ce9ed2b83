"""Benchmark decontamination with suffix arrays over shards of the corpus.

Every shard (some MB of whole documents) gets a word suffix array; every suffix
of the test items is found in it by binary search, which yields each verbatim
occurrence with its place. No shuffle: documents never leave the task that read
them; the test set goes to the tasks in blocks of a fixed size.

Nulls and empty texts have no words and are never hit. An item of no words is
skipped. Rows with one item_id count as one item; repeated documents are judged
one by one. Columns beside the two named are passed on by `remove_contaminated`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, row_slices, sealed

WINDOW = 13
SHARD_BYTES = 8 << 20
#: Words of the test set that one pass over the corpus carries; a larger set takes more passes.
BLOCK_WORDS = 1_000_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class TestSet:
    """Windows of the items as rows of word ids, and where in which items each occurs (at, text, offset)."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window, self.vocab, self.names = window, {}, [i for i, _ in items]
        rows: dict[tuple, int] = {}
        places: list[tuple[int, int, int]] = []
        for number, (_, text) in enumerate(items):
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                places.append((rows.setdefault(tuple(ids[i : i + window]), len(rows)), number, i))
        self.rows = np.zeros((len(rows), window), np.int32)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        for i, r in enumerate(rows):
            self.rows[i, : len(r)] = r
        found = np.array(sorted(places), np.int64).reshape(-1, 3)
        self.text, self.offset = found[:, 1], found[:, 2]
        self.at = np.searchsorted(found[:, 0], np.arange(len(rows) + 1))
        self.single = np.unique(self.rows[self.lengths == 1, 0]) if len(rows) else np.zeros(0, np.int64)
        two = self.rows[self.lengths > 1].astype(np.int64)
        self.pairs = np.unique(two[:, 0] * self.base + two[:, 1])

    @property
    def base(self) -> int:
        return len(self.vocab) + 1


def suffix_array(ids: np.ndarray, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """Start positions in the order of their first `window` words, and those words.

    Suffixes whose first two words (one, for items of one word) start no test
    suffix are left out: no search interval can hold them.
    """
    padded = np.concatenate([ids, np.zeros(test.window, np.int64)])
    first, second = padded[: len(ids)], padded[1 : len(ids) + 1]
    start = np.flatnonzero(first)
    keep = np.isin(first[start], test.single)
    key = first[start] * test.base + second[start]
    if len(test.pairs):
        at = np.minimum(np.searchsorted(test.pairs, key), len(test.pairs) - 1)
        keep |= test.pairs[at] == key
    start = start[keep]
    rows = padded[start[:, None] + np.arange(test.window)]
    order = np.lexsort(rows.T[::-1])
    return start[order], rows[order]


def search(rows: np.ndarray, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """For every test window the interval of the suffix array that starts with it, by binary search."""
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(len(test.rows), np.int64), np.full(len(test.rows), len(rows), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            at = rows[np.minimum(mid, len(rows) - 1)]
            differ = (at != test.rows) & (np.arange(test.window) < test.lengths[:, None])
            where = differ.argmax(1)
            pick = np.arange(len(where))
            less = np.where(differ.any(1), at[pick, where] < test.rows[pick, where], upper)
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        bounds.append(lo)
    return bounds[0], bounds[1]


def longest(place: np.ndarray, text: np.ndarray, offset: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of every maximal match, from occurrences of windows: those that follow one another on one diagonal of document and item join."""
    order = np.lexsort((place, offset - place, text))
    p, t, d = place[order], text[order], (offset - place)[order]
    fresh = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1]) | (np.diff(p) != 1)])) if len(p) else np.zeros(0, np.int64)
    return p[fresh], np.diff(np.append(fresh, len(p))) + length[order][fresh] - 1


def judge(texts: list[str | None], test: TestSet, before: list[dict | None]) -> list[dict]:
    """One shard and one block of the test set: what is known of each document, added to what earlier blocks found.

    words: how many; hit: runs of hit words as [first, end]; items: names; longest, longest_at: the longest match.
    """
    found = [words(t) for t in texts]
    size = np.array([len(w) for w in found], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])[: len(size)].astype(np.int64)  # a gap of one ends each document
    mask = np.zeros(int(size.sum()) + len(size) + 1, bool)
    held: list[set[str]] = [set(b["items"]) if b else set() for b in before]
    far = [(b["longest"], b["longest_at"]) if b else (0, None) for b in before]
    for first, b in zip(begin.tolist(), before, strict=True):
        for s, e in b["hit"] if b else ():
            mask[first + s : first + e] = True
    get, ids = test.vocab.get, np.zeros(len(mask), np.int64)
    for b, w in zip(begin, found, strict=True):
        ids[b : b + len(w)] = [get(x, 0) for x in w]
    start, rows = suffix_array(ids, test) if len(test.rows) else (np.zeros(0, np.int64), None)
    if len(start):
        lo, hi = search(rows, test)
        count = hi - lo
        window = np.repeat(np.arange(len(count)), count)
        place = start[np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        cover = np.zeros(len(ids) + test.window + 1, np.int64)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + test.lengths[window], -1)
        mask |= np.cumsum(cover)[: len(mask)] > 0
        many = test.at[window + 1] - test.at[window]
        of = np.repeat(test.at[window] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        place, window = np.repeat(place, many), np.repeat(window, many)
        p, n = longest(place, test.text[of], test.offset[of], test.lengths[window])
        for d, at, k in zip((np.searchsorted(begin, p, side="right") - 1).tolist(), p.tolist(), n.tolist(), strict=True):
            best, where = far[d]
            if k > best or k == best and at - begin[d] < where:
                far[d] = (k, int(at - begin[d]))
        pair = np.unique((np.searchsorted(begin, place, side="right") - 1) * len(test.names) + test.text[of])
        for d, i in zip((pair // len(test.names)).tolist(), (pair % len(test.names)).tolist(), strict=True):
            held[d].add(test.names[i])
    edge = np.diff(mask.astype(np.int8), prepend=0)
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.searchsorted(s, np.append(begin, len(mask)))
    return [
        {"words": int(size[i]), "hit": [[int(x - begin[i]), int(y - begin[i])] for x, y in zip(s[ends[i] : ends[i + 1]], e[ends[i] : ends[i + 1]], strict=True)], "items": sorted(held[i]), "longest": far[i][0], "longest_at": far[i][1]}
        for i in range(len(texts))
    ]


def test_blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """The test set, read as a stream, in blocks of a bounded number of words."""
    block, size = [], 0
    for item, t in benchmark.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        n = len(words(t))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((item or "", t))
        size += n
    yield block


_STATE = pa.struct([("words", pa.int64()), ("hit", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_at", pa.int64())])
_DDL = "_m struct<words:bigint,hit:array<array<int>>,items:array<string>,longest:bigint,longest_at:bigint>"


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: bool = False) -> DataFrame:
    """Per document, in `_m`: words, hit (runs of hit words), items, longest and longest_at (in words); with `keep` beside all of its columns.

    Each block of the test set is searched in a pass of its own; the hit words of a
    document are the union over the blocks, so the blocks change no result.
    """
    spark = docs.sparkSession
    source = docs if keep else docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    column, kept = (text, source.columns) if keep else ("text", ["doc_id", "text"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    out, waiting = source, None

    def searched(df: DataFrame, block: list[tuple[str, str | None]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(TestSet(block, window))  # at most block_words words and one item

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in row_slices(batch, column, SHARD_BYTES):
                    before = piece.column("_m").to_pylist() if "_m" in piece.schema.names else [None] * piece.num_rows
                    state = judge(piece.column(column).to_pylist(), shared.value, before)
                    yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(state, _STATE)], names=[*kept, "_m"])

        return df.mapInArrow(run, f"{fields}, {_DDL}")

    for block in test_blocks(benchmark, item_id, item_text, block_words):
        if waiting is not None:
            out = cut(searched(out, waiting))
        waiting = block
    return searched(out, waiting)


def _hits():
    return F.aggregate("_m.hit", F.lit(0).cast("bigint"), lambda n, r: n + r[1] - r[0])


def is_contaminated():
    return (_hits() > 0) & (_hits() * 20 >= F.col("_m.words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of which less than a twentieth of the words is verbatim test text, all columns kept."""
    rows, names = sealed(docs)
    return matches(rows, benchmark, names[doc_id], names[text], keep=True).filter(~is_contaminated()).drop("_m").toDF(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", F.col("_m.words").alias("n_words"), _hits().alias("n_hit"), F.size("_m.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_m.items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
        F.col("_m.longest").alias("longest_match"), F.col("_m.longest_at").alias("longest_at"),
    )


def brute(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same by comparing every window with every place, for tests."""
    out = []
    for doc, text in docs:
        w, hit, held, best = words(text), set(), set(), (0, 0)
        for item, t in items:
            x = words(t)
            for i, j in ((i, j) for i in range(len(w)) for j in range(len(x)) if w[i] == x[j] and not (i and j and w[i - 1] == x[j - 1])):
                k = 0
                while i + k < len(w) and j + k < len(x) and w[i + k] == x[j + k]:
                    k += 1
                if k >= min(window, len(x)):
                    best = max(best, (k, -i))
            n = min(window, len(x))
            wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x else set()
            for i in range(len(w) - n + 1) if x else ():
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    held.add("" if item is None else str(item))
        out.append((doc, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), best[0], -best[1] if best[0] else None))
    return out
