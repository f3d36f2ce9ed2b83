"""Fill-in-middle transformation with a streaming matcher of constant memory.

A text is cut at two ranks of its units (words with the white space before them,
and white space at the end) into prefix, middle and suffix. A first pass over
the matches counts the units; the ranks come from a hash of the seed and the
document's id; a second pass advances a lazy iterator of matches to the smaller
rank, then to the larger. Only the current match is held, never the units or
their places, so beside the text and its output a text of any length takes the
same memory. Texts are cut in the tasks that read them: no shuffle, and a lost
task is made again with the same cuts.

A null text is empty. An empty text, one that holds a sentinel, and one that the
hash leaves alone stay plain. Equal ids are cut at equal ranks, so repeated rows
repeat; a null id hashes as no digits. An empty table gives an empty result.
Columns of docs are passed on, result columns replace those of their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_slices, sealed

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are transformed, and of those so many start with the suffix.
RATE, SPM_RATE = 50, 80
SLICE_BYTES = 8 << 20
#: White space is taken without going back, so a run of it at the end is read once.
_UNIT = re.compile(r"[ \t-\r]*+[^ \t-\r]+|[ \t-\r]+")


def count(text: str) -> int:
    """First pass: how many units there are."""
    return sum(1 for _ in _UNIT.finditer(text))


def ends(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the first `low` and the first `high` units end, in characters."""
    units = _UNIT.finditer(text)
    first = next(islice(units, low - 1, None)).end() if low else 0
    return first, next(islice(units, high - low - 1, None)).end() if high > low else first


def numbers(seed: int, doc_id: object) -> list[int]:
    """Four numbers of 32 bits from a seed and an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def cut_text(text: str, doc_id: object, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and middle (null where plain), and the output."""
    n = count(text)
    one, two, rare, order = numbers(seed, doc_id)
    if not text or rare % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((one % (n + 1), two % (n + 1)))
    a, b = ends(text, low, high)
    if order % 100 < spm_rate:
        return n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


_MADE = {"n": (pa.int64(), "bigint"), "form": (pa.string(), "string"), "prefix_chars": (pa.int64(), "bigint"), "middle_chars": (pa.int64(), "bigint"), "output": (pa.string(), "string")}


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """All columns of docs with n (units), form, prefix_chars, middle_chars and output."""
    rows, names = sealed(docs)
    ident, body = names[doc_id], names[text]
    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), *(f"_{c} {kind}" for c, (_, kind) in _MADE.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_slices(batch, body, SLICE_BYTES):
                # One text at a time leaves Arrow's buffer.
                made = [cut_text(t.as_py() or "", i.as_py(), seed, rate, spm_rate) for t, i in zip(piece.column(body), piece.column(ident), strict=True)]
                columns = [pa.array(values, kind) for values, (kind, _) in zip(zip(*made, strict=True), _MADE.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *columns], names=[*piece.schema.names, *(f"_{c}" for c in _MADE)])

    found = rows.mapInArrow(run, fields)
    return found.select(*[F.col(n).alias(c) for c, n in names.items() if c not in _MADE], *[F.col(f"_{c}").alias(c) for c in _MADE])


def restored(output: str = "output", form: str = "form"):
    """The text that an output was made of: no transformed text holds a sentinel, so each occurs once."""
    out, kind = F.col(output), F.col(form)
    between = lambda mark, end: F.substring_index(F.substring_index(out, end, 1), mark, -1)
    middle = F.substring_index(out, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(kind == "plain", out).when(kind == "psm", psm).otherwise(spm)


def digest(made: DataFrame) -> DataFrame:
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


def brute(rows: list[tuple], seed: int = 42) -> list[tuple]:
    """The same from a list of all units, for tests."""
    out = []
    for doc_id, text in rows:
        units = re.findall("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text or "")
        h = [int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[i * 8 : i * 8 + 8], 16) for i in range(4)]
        low, high = sorted(x % (len(units) + 1) for x in h[:2])
        a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
            out.append((doc_id, len(units), "plain", None, None, text or ""))
        elif h[3] % 100 < 80:
            out.append((doc_id, len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"))
        else:
            out.append((doc_id, len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"))
    return out
