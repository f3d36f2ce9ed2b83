"""Suffix-array removal of byte strings that a document with a smaller id also holds.

A byte goes if it lies in a 50-byte string that starts in a document of smaller
id too. Four steps, each over blocks of whole documents (a few MB, compressed
once, so later steps move compressed bytes):

1. Per block: content-defined chunks, extended by 49 bytes so that each window of
   50 bytes starts in one chunk, and anchors: every window is assigned to its
   minimal 24-byte string, so equal windows have equal anchors.
2. By hash bucket: the smallest document of each chunk; the anchors that more than
   one document has.
3. Per block: windows in a chunk that a smaller document holds are settled. Of the
   rest, those with shared anchors go out as short segments, once a block.
4. By hash bucket of the anchor: a suffix sort of the windows, a mergesort that
   compares suffixes by their common extension (binary search over prefix
   polynomial hashes), verified byte by byte; runs of neighbours with 50 bytes in
   common give the smallest document of each window. Then the bytes are removed.

What leaves a block is one entry a distinct string, so hot strings cost a bucket
one entry a block. Null or empty texts give an empty result. Rows that share a
doc_id count as one document; a null doc_id is neither a source nor cleaned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, groups, parts, row_slices

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1
BLOCK_BYTES = 1 << 20
#: Text that a bucket of anchors and chunks should stand for.
BUCKET_BYTES = 32 << 20
_B = 0x9E3779B97F4A7C15 | 1
_INV = pow(_B, -1, 1 << 64)
_NONE = np.iinfo(np.int64).max
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    made = []
    for base in (_B, _INV):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=np.uint64))
    if n <= 4 * BLOCK_BYTES:  # those of a very long text aren't kept
        _POWERS[:] = made
    return made[0], made[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class PrefixHash:
    """Prefix polynomial hashes of a byte string: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.h = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.h[1:])
        self.data = data

    def all(self, k: int) -> np.ndarray:
        """Of every substring of k bytes."""
        n = max(0, len(self.data) - k + 1)
        return _mix((self.h[k : k + n] - self.h[:n]) * self.down[:n])

    def at(self, start: np.ndarray, k) -> np.ndarray:
        return (self.h[start + k] - self.h[start]) * self.down[start]

    def extension(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common prefix, up to `most`, of the suffixes at a and b: binary search over the hashes."""
        out = np.full(len(a), most, np.int64)
        rest = np.flatnonzero(self.at(a, most) != self.at(b, most))  # equal to the end is the commonest case
        x, y = a[rest], b[rest]
        lo, hi = np.zeros(len(rest), np.int64), np.full(len(rest), most - 1, np.int64)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.at(x, mid) == self.at(y, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        out[rest] = lo
        return out

    def less(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Whether the suffix at a sorts before that at b; equal over `most` bytes: the smaller position does."""
        n = self.extension(a, b, most)
        tie = n >= most
        n = np.where(tie, 0, n)
        return np.where(tie, a < b, self.data[a + n] < self.data[b + n])


def suffix_sort(text: PrefixHash, start: np.ndarray, most: int) -> np.ndarray:
    """Suffix positions in the order of their first `most` (16 at least) bytes.

    Eight-byte words at two depths give the coarse order; within their ties a
    bottom-up mergesort places every suffix of a run by binary search in its
    partner run, all runs at once, comparing by common extension.
    """
    word = lambda at: np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text.data, 8)[at]).view(">u8")[:, 0]
    one, two = word(start), word(start + 8)
    order = np.lexsort((start, two, one))
    sa, one, two = start[order], one[order], two[order]
    fresh = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    group = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(sa)))
    width = 1
    while (live := size > width).any():
        at = np.flatnonzero(live[group])
        first, n = begin[group[at]], size[group[at]]
        run = (at - first) // width
        left = first + (run - run % 2) * width
        middle, right = np.minimum(left + width, first + n), np.minimum(left + 2 * width, first + n)
        is_left = run % 2 == 0
        lo0 = np.where(is_left, middle, left)
        lo, hi = lo0.copy(), np.where(is_left, right, middle)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            before = text.less(sa[mid], sa[at[open_]], most)
            lo[open_[before]] = mid[before] + 1
            hi[open_[~before]] = mid[~before]
        place = left + (at - np.where(is_left, left, middle)) + (lo - lo0)
        merged = sa.copy()
        merged[place] = sa[at]
        sa = merged
        width *= 2
    return sa


def window_minima(data: np.ndarray, start: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Smallest owner among the windows of LENGTH bytes with the same bytes, for each window."""
    out = owner.copy()
    text = PrefixHash(data)
    h = text.at(start, LENGTH)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    some = order[again]  # a window whose hash is alone has no equal
    if not len(some):
        return out
    sa = suffix_sort(text, start[some], LENGTH)
    by_start = np.argsort(start[some], kind="stable")
    at = some[by_start][np.searchsorted(start[some][by_start], sa)]
    bytes_ = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[sa]
    joined = text.extension(sa[1:], sa[:-1], LENGTH) >= LENGTH
    joined &= (bytes_[1:] == bytes_[:-1]).all(1)  # collision verification
    run = np.cumsum(np.concatenate([[True], ~joined])) - 1
    low = np.full(run[-1] + 1, _NONE, np.int64)
    np.minimum.at(low, run, owner[at])
    out[at] = low[run]
    return out


class Block:
    """Whole documents as one byte string, its chunks and its anchored runs of windows.

    start, doc: first byte and document of each window of LENGTH bytes that lies in
    one document; fresh: where the anchor or the document of a window isn't that of
    the one before. Positions are 32-bit.
    """

    def __init__(self, ids: list[int | None], texts: list[str | None], hashed: bool = True):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.ids = np.array([_NONE if i is None else i for i in ids], np.int64)
        self.raw = b"".join(texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        known = np.array([i is not None for i in ids], bool)
        n = np.where(known, np.maximum(self.size - LENGTH + 1, 0), 0)
        first = np.cumsum(n) - n  # the first window of each document
        self.doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.start = np.arange(len(self.doc), dtype=np.int32) + np.repeat((self.begin - first).astype(np.int32), n)
        if not hashed:
            return
        self.text = PrefixHash(self.data)
        self.key = key = self.text.all(GRAM)
        # Chunks start at the first window of a document and where the hash says so.
        self.fresh = np.zeros(len(self.start), bool)
        self.fresh[first[n > 0]] = True
        c = np.flatnonzero(self.fresh | ((key[self.start] & np.uint64(255)) == 0))
        self.chunk_doc, self.chunk_size = self.doc[c], np.diff(np.append(c, len(self.start)))
        last = self.start[c + self.chunk_size - 1] + LENGTH
        names = [hashlib.blake2b(self.raw[s:e], digest_size=16).digest() for s, e in zip(self.start[c].tolist(), last.tolist(), strict=True)]
        self.chunk_name = np.frombuffer(b"".join(names), ">u8").reshape(-1, 2).astype(np.uint64)
        self.anchor = self._anchors()
        self.fresh[1:] |= self.anchor[1:] != self.anchor[:-1]
        self.run = np.flatnonzero(self.fresh)
        self.run_hash = key[self.anchor[self.run]] >> np.uint64(17)

    def _anchors(self) -> np.ndarray:
        """Place of the minimal gram of each window: hash above, position below, minima by doubling."""
        bits, low = 22, self.key
        if len(low) < 1 << bits:
            low = low & ~np.uint64((1 << bits) - 1)
        else:  # a text longer than a block: ranks of the hashes
            bits, order = 32, np.argsort(low, kind="stable")
            value = np.cumsum(np.concatenate([[0], low[order][1:] != low[order][:-1]])).astype(np.uint64)
            low = np.empty(len(low), np.uint64)
            low[order] = value << np.uint64(32)
        low |= np.arange(len(low), dtype=np.uint64)
        have = 1
        while have < SPAN:
            step = min(have, SPAN - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        return (low[self.start] & np.uint64((1 << bits) - 1)).astype(np.int32) if len(self.start) else np.zeros(0, np.int32)

    def runs(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last of the wanted windows in a row with one anchor and document."""
        begin = wanted & self.fresh
        begin[1:] |= wanted[1:] & ~wanted[:-1]
        end = wanted.copy()
        end[:-1] &= begin[1:] | ~wanted[1:]
        return np.flatnonzero(begin), np.flatnonzero(end)

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct chunk names, the smallest document of each here, and the place of each chunk among them."""
        name, place = np.unique(self.chunk_name, axis=0, return_inverse=True) if len(self.chunk_name) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
        low = np.full(len(name), _NONE, np.int64)
        np.minimum.at(low, place.ravel(), self.ids[self.chunk_doc])
        return name, low, place.ravel()

    def anchors(self) -> np.ndarray:
        """Distinct anchor hashes of 47 bits; the lowest bit says whether two documents here have it."""
        order = np.argsort(self.run_hash, kind="stable")
        h, d = self.run_hash[order], self.ids[self.doc[self.run]][order]
        fresh = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        if not len(fresh):
            return h
        many = np.minimum.reduceat(d, fresh) != np.maximum.reduceat(d, fresh)
        return (h[fresh] << np.uint64(1)) | many.astype(np.uint64)


def _pack6(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack6(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in one compressed string: dtype, length and bytes of each."""
    raw = b"".join(len(x).to_bytes(4, "little") + np.dtype(x.dtype).str[1:].encode() + x.tobytes() for x in arrays)
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(b: bytes) -> list[np.ndarray]:
    raw, at, out = pa.decompress(b[4:], int.from_bytes(b[:4], "little"), codec="zstd", asbytes=True), 0, []
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 4], "little"), np.dtype(raw[at + 4 : at + 6].decode())
        out.append(np.frombuffer(raw, kind, n, at + 6))
        at += 6 + n * kind.itemsize
    return out


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 7))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


#: What moves between the steps: a bucket or a block, the kind of row, and packed arrays.
_WIRE = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("a", "b", "c"))])
_DDL = "bucket bigint, block bigint, kind int, a binary, b binary, c binary"
_BLOCK, _ASK, _REPLY, _SEGMENT, _MINIMA = range(5)


def _row(bucket: int | None, block: int | None, kind: int, a: bytes = b"", b: bytes = b"", c: bytes = b"") -> dict:
    return {"bucket": bucket, "block": block, "kind": kind, "a": a, "b": b, "c": c}


def _blocks(docs: DataFrame, text: str) -> DataFrame:
    """The documents, all columns, in compressed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in row_slices(batch, text, BLOCK_BYTES):
                yield _rows([_row(None, (task << 32) + n, _BLOCK, _ipc(piece))], _WIRE)
                n += 1

    return docs.mapInArrow(run, _DDL)


def _open(row: dict, names: tuple[str, str]) -> tuple[pa.RecordBatch, Block]:
    batch = pa.ipc.open_stream(row["a"]).read_next_batch()
    return batch, Block(batch.column(names[0]).to_pylist(), batch.column(names[1]).to_pylist())


def _dealt(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket that has any, the indices of its rows, in order."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        yield k, order[ends[k] : ends[k + 1]]


def _ask(buckets: int, names: tuple[str, str]):
    """Blocks -> by bucket, the anchors and the chunks that they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, block = _open(row, names)
                h, (name, low, _) = block.anchors(), block.chunks()
                anchors = dict(_dealt((h >> np.uint64(1)) % np.uint64(buckets), buckets))
                chunks = dict(_dealt(name[:, 0] % np.uint64(buckets), buckets))
                none = np.zeros(0, np.int64)
                out = []
                for k in sorted(anchors.keys() | chunks.keys()):
                    x, y = anchors.get(k, none), chunks.get(k, none)
                    out.append(_row(k, row["block"], _ASK, _pack6(h[x]), name[y].tobytes(), low[y].tobytes()))
                if out:
                    yield _rows(out, _WIRE)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By bucket -> for each block its shared anchors, and its chunks that a smaller document has, with that document."""
    for _, rows in groups(batches, ["bucket"]):
        h = [_unpack6(r["a"]) for r in rows]
        of = np.cumsum([0, *map(len, h)])
        h = np.concatenate(h)
        order = np.argsort(h >> np.uint64(1), kind="stable")
        v = h[order] >> np.uint64(1)
        fresh = np.concatenate([[True], v[1:] != v[:-1]])[: len(v)]
        run = np.cumsum(fresh) - 1
        begin = np.flatnonzero(fresh)
        shared = (np.diff(np.append(begin, len(v))) > 1) | (np.maximum.reduceat(h[order] & np.uint64(1), begin) > 0) if len(v) else np.zeros(0, bool)
        keep = np.zeros(len(h), bool)
        keep[order] = shared[run] if len(v) else False
        names = [np.frombuffer(r["b"], np.uint64).reshape(-1, 2) for r in rows]
        low = np.concatenate([np.frombuffer(r["c"], np.int64) for r in rows])
        of_name = np.cumsum([0, *map(len, names)])
        name, place = np.unique(np.concatenate(names), axis=0, return_inverse=True) if len(low) else (None, np.zeros(0, np.int64))
        least = np.full(len(name) if name is not None else 0, _NONE, np.int64)
        np.minimum.at(least, place.ravel(), low)
        least = least[place.ravel()]
        smaller = least < low
        for i, r in enumerate(rows):
            x, y = keep[of[i] : of[i + 1]], smaller[of_name[i] : of_name[i + 1]]
            if x.any() or y.any():  # a bit for each anchor and each chunk that was asked for, in the order asked
                yield _rows([_row(r["bucket"], r["block"], _REPLY, np.packbits(x).tobytes(), np.packbits(y).tobytes(), _zip(least[of_name[i] : of_name[i + 1]][y]))], _WIRE)


class _Open:
    """What the answers leave open in a block: which windows are settled, and the distinct segments of the others.

    settled: by window; a, b: first and last window of each run; of: the segment
    of each run; start, n, least: bytes and smallest document of each segment.
    """

    def __init__(self, *fields: np.ndarray):
        self.settled, self.a, self.of, self.pick, self.start, self.n, self.least = fields


def _opened(block: Block, answers: list[dict], buckets: int) -> _Open:
    asked, (name, low, place) = block.anchors(), block.chunks()
    anchors = dict(_dealt((asked >> np.uint64(1)) % np.uint64(buckets), buckets))
    chunks = dict(_dealt(name[:, 0] % np.uint64(buckets), buckets))
    is_shared = np.zeros(len(asked), bool)
    for r in answers:
        x, y = anchors.get(r["bucket"]), chunks.get(r["bucket"])
        if x is not None:
            is_shared[x] = np.unpackbits(np.frombuffer(r["a"], np.uint8), count=len(x)).astype(bool)
        if y is not None:
            y = y[np.unpackbits(np.frombuffer(r["b"], np.uint8), count=len(y)).astype(bool)]
            low[y] = np.minimum(low[y], _unzip(r["c"])[0])
    shared = asked[is_shared] >> np.uint64(1)
    settled = np.repeat(low[place] < block.ids[block.chunk_doc], block.chunk_size) if len(name) else np.zeros(0, bool)
    at = np.minimum(np.searchsorted(shared, block.run_hash), max(0, len(shared) - 1))
    asked_for = shared[at] == block.run_hash if len(shared) else np.zeros(len(at), bool)
    a, b = block.runs(~settled & np.repeat(asked_for, np.diff(np.append(block.run, len(block.start)))))
    # Distinct segments of this block, and the smallest document of each.
    start, n = block.start[a], (b - a + LENGTH).astype(np.int32)
    mark = block.text.at(start, n) * np.uint64(_INV) + _mix(n.astype(np.uint64)) + _mix(block.key[block.anchor[a]])
    order = np.argsort(mark, kind="stable")
    fresh = np.concatenate([[True], mark[order][1:] != mark[order][:-1]])[: len(a)]
    group = np.cumsum(fresh) - 1
    lead = order[fresh][group] if len(a) else order
    again = np.flatnonzero(order != lead)
    raw = block.raw
    for x, y in zip(order[again].tolist(), lead[again].tolist(), strict=True):
        if raw[start[x] : start[x] + n[x]] != raw[start[y] : start[y] + n[y]]:  # a collision of hashes must not merge segments
            order = group = np.arange(len(a))
            fresh = np.ones(len(a), bool)
            break
    of = np.empty(len(a), np.int32)
    of[order] = group
    pick = order[fresh]
    least = np.full(len(pick), _NONE, np.int64)
    np.minimum.at(least, of, block.ids[block.doc[a]])
    return _Open(settled, a, of, pick, start[pick], n[pick], least)


def _segments(buckets: int, names: tuple[str, str]):
    """Blocks and answers -> by bucket, the open segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number,), rows in groups(batches, ["block"]):
            _, block = _open(rows[0], names)
            left, raw, out = _opened(block, rows[1:], buckets), block.raw, []
            for k, x in _dealt((block.key[block.anchor[left.a[left.pick]]] % np.uint64(buckets)).astype(np.int64), buckets):
                data = b"".join(raw[s : s + m] for s, m in zip(left.start[x].tolist(), left.n[x].tolist(), strict=True))
                out.append(_row(k, number, _SEGMENT, _zip(np.frombuffer(data, np.uint8), left.n[x].astype(np.int16), left.least[x], x.astype(np.int32))))
            if out:
                yield _rows(out, _WIRE)

    return run


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By bucket: segments -> for each block the smallest document of each window of its segments, where it is another's."""
    for _, rows in groups(batches, ["bucket"]):
        parts_ = [_unzip(r["a"]) for r in rows]
        n = [p[1].astype(np.int64) for p in parts_]
        of = np.cumsum([0, *map(len, n)])
        size, owner = np.concatenate(n), np.concatenate([p[2] for p in parts_])
        begin = np.cumsum(size) - size
        count = size - LENGTH + 1
        segment = np.repeat(np.arange(len(size)), count)
        offset = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
        low = window_minima(np.concatenate([p[0] for p in parts_]), begin[segment] + offset, owner[segment])
        less = np.flatnonzero(low < owner[segment])
        if not len(less):
            continue
        seg, off, low = segment[less], offset[less], low[less]
        fresh = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (np.diff(off) != 1) | (low[1:] != low[:-1])]))
        length = np.diff(np.append(fresh, len(seg)))
        seg, off, low = seg[fresh], off[fresh], low[fresh]
        own = np.concatenate([p[3] for p in parts_])
        ends = np.searchsorted(seg, of)  # segments of a block are in a row
        for r, x, y in zip(rows, ends[:-1], ends[1:], strict=True):
            if x < y:
                yield _rows([_row(r["bucket"], r["block"], _MINIMA, _zip(own[seg[x:y]], off[x:y].astype(np.int8), length[x:y].astype(np.int8), low[x:y]))], _WIRE)


def _spans(block: Block, rows: list[dict], buckets: int) -> np.ndarray:
    """Which bytes of the block go."""
    left = _opened(block, [r for r in rows if r["kind"] == _REPLY], buckets)
    gone, a, of = left.settled, left.a, left.of
    count = left.n.astype(np.int64) - LENGTH + 1
    base = np.cumsum(count) - count
    low, lowest = np.repeat(left.least, count), left.least.copy()
    for r in rows:
        if r["kind"] == _MINIMA:
            seg, off, length, value = (x.astype(np.int64) for x in _unzip(r["a"]))
            at = np.repeat(base[seg] + off - (np.cumsum(length) - length), length) + np.arange(length.sum())
            low[at] = np.minimum(low[at], np.repeat(value, length))
            np.minimum.at(lowest, seg, value)
    own = block.ids[block.doc[a]]
    some = np.flatnonzero(lowest[of] < own)  # runs that a smaller document shares in part
    m = count[of[some]]
    index = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    smaller = low[np.repeat(base[of[some]], m) + index] < np.repeat(own[some], m)
    gone[(np.repeat(a[some], m) + index)[smaller]] = True
    begun = np.zeros(len(block.data) + 1, np.int32)
    begun[block.start[gone] + 1] = 1
    np.cumsum(begun, out=begun)  # windows that go and start before a byte
    return begun[1:] > begun[np.maximum(np.arange(len(block.data)) - LENGTH + 1, 0)]


def _text(raw: bytes, gone: np.ndarray) -> str:
    """The kept text: a character that is partly outside a removed run stays whole."""
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    keep = np.zeros(char[-1] + 1 if len(char) else 0, bool)
    keep[char[~gone]] = True
    return np.frombuffer(raw, np.uint8)[keep[char]].tobytes().decode("utf-8", "replace") if len(char) else ""


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, then _n_bytes, _n_removed, _n_spans, _kept_sha256 and _kept (the text that is left), in place of columns of those names."""
    docs = docs.drop("_n_bytes", "_n_removed", "_n_spans", "_kept_sha256", "_kept")
    columns, names = list(docs.columns), (doc_id, text)
    blocks = cut(_blocks(docs, text))
    buckets = max(4 * parts(docs.sparkSession), blocks.count() * BLOCK_BYTES // BUCKET_BYTES)
    by = lambda df, key: df.repartition(key).sortWithinPartitions(key, "kind")
    answers = cut(by(blocks.mapInArrow(_ask(buckets, names), _DDL), "bucket").mapInArrow(_answer, _DDL))
    segments = by(blocks.union(answers), "block").mapInArrow(_segments(buckets, names), _DDL)
    lows = by(segments, "bucket").mapInArrow(_sorted, _DDL)
    last = by(blocks.union(answers).union(lows), "block")
    extra = pa.schema([("_n_bytes", pa.int64()), ("_n_removed", pa.int64()), ("_n_spans", pa.int64()), ("_kept_sha256", pa.string()), ("_kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, ["block"]):
            batch, block = _open(rows[0], names)
            gone = _spans(block, rows[1:], buckets)
            out: dict[str, list] = {f.name: [] for f in extra}
            for b, n in zip(block.begin.tolist(), block.size.tolist(), strict=True):
                g, raw = gone[b : b + n], block.data[b : b + n]
                out["_n_bytes"].append(n)
                out["_n_removed"].append(int(g.sum()))
                out["_n_spans"].append(int((np.diff(g.astype(np.int8), prepend=0) == 1).sum()))
                out["_kept_sha256"].append(hashlib.sha256(raw[~g].tobytes()).hexdigest())
                out["_kept"].append(_text(raw.tobytes(), g))
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(out[f.name], f.type) for f in extra], names=[*columns, *out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return last.mapInArrow(run, f"{fields}, _n_bytes bigint, _n_removed bigint, _n_spans bigint, _kept_sha256 string, _kept string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])


def brute(docs: list[tuple]) -> list[tuple]:
    """The same with a table of all strings, for tests."""
    low: dict[bytes, int] = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for d, t in raw:
        for i in range(len(t) - LENGTH + 1):
            low[t[i : i + LENGTH]] = min(low.get(t[i : i + LENGTH], d), d)
    out = []
    for d, t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - LENGTH + 1):
            if low[t[i : i + LENGTH]] < d:
                gone[i : i + LENGTH] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((d, len(t), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
