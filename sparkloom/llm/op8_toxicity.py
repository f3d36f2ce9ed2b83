"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words counts their common subsequences of four characters,
gaps allowed and discounted by the length that they span, so an insult with
inserted characters or a suffix still resembles it. Landmark words give the
Nystroem map; a linear support vector machine is trained on it. Its units are
the words of labelled sentences: only documents are labelled, so each toxic
document names the word that speaks most for toxicity as its witness, and
witnesses and machine are refined in turn. A document scores as its worst word.

In the end the machine is one weight a subsequence (landmarks and weights folded
together), so a word costs one lookup for each of its subsequences, and every
distinct word of a batch is scored once. The model (a few hundred kB) is
broadcast; the documents are not shuffled.

Training reads at most MOST_ROWS labelled rows of the training folds, chosen by
hash, and whole texts of them. Null and empty texts score as the share of toxic
rows among the training rows, at most 0.49. Without labels of both kinds the
score is that share everywhere. Repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_slices, sealed

MOST_ROWS = 4000
LANDMARKS = 128
#: Words of clean documents, beside the hardest ones, that the machine learns from.
CLEAN_WORDS = 6000
SPREAD = 6  # characters that a subsequence may span
DECAY = 0.6
WIDTH = 20  # longer words are read in overlapping parts
_BITS = 17
_DIM = 1 << _BITS
_SPACED = re.compile(r"(?<!\S)\w(?:[\s.*_\-]\w){2,}(?!\S)")
_WORD = re.compile(r"\S+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def sentence_words(text: str | None) -> list[list[str]]:
    """Lower-cased words by sentence; single letters in a row, as in a spaced insult, form a word."""
    out = []
    for s in _SENTENCE.split((text or "").lower()):
        w = _WORD.findall(s)
        out.append(w + ["".join(re.findall(r"\w", x)) for x in _SPACED.findall(s)])
    return out


def all_words(text: str | None) -> set[str]:
    low = (text or "").lower()
    return set(low.split()).union("".join(re.findall(r"\w", x)) for x in _SPACED.findall(low))


def _pieces(word: str) -> list[str]:
    if len(word) <= WIDTH:
        return [word]
    return [word[i : i + WIDTH] for i in range(0, len(word) - SPREAD, WIDTH - SPREAD)]


_GAPS = [(i, j, k) for k in range(3, SPREAD) for j in range(2, k) for i in range(1, j)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word its subsequences of four characters: (word, hashed subsequence, value), values of unit length.

    A mark before the first character counts as one, so where a word begins is
    part of the kernel.
    """
    parts = [(i, "\x02" + p) for i, w in enumerate(words) for p in _pieces(w)]
    owner = np.array([i for i, _ in parts], np.int64)
    size = np.array([len(p) for _, p in parts], np.int64)
    text = np.frombuffer("".join(p for _, p in parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    # Seven bits a character: letters of ASCII, digits as one, all others by a hash of the code point.
    code = np.where((text >= 97) & (text <= 122), text - 96, np.where(text == 2, 0, np.where((text >= 48) & (text <= 57), 27, 28 + (text * 0x9E3779B1 >> 7) % 100)))
    begin = np.cumsum(size) - size
    part = np.repeat(np.arange(len(size)), size)
    left = np.repeat(begin + size, size) - np.arange(len(code))  # characters from here to the end of the part
    whose, what, value = [], [], []
    for i, j, k in _GAPS:
        at = np.flatnonzero(left > k)
        whose.append(owner[part[at]])
        key = (code[at] << 21) | (code[at + i] << 14) | (code[at + j] << 7) | code[at + k]
        what.append(((key * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - _BITS))
        value.append(np.full(len(at), DECAY ** (k - 3)))
    whose, what, value = map(np.concatenate, (whose, what, value))
    norm = np.sqrt(np.bincount(whose, value * value, len(words)))
    return whose, what, value / np.maximum(norm[whose], 1e-9)


def dense(words: list[str]) -> np.ndarray:
    whose, what, value = subsequences(words)
    out = np.zeros((len(words), _DIM), np.float32)
    np.add.at(out, (whose, what), value)
    return out


class Model:
    """Folded weights of the machine, and the line that turns its output into a probability."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float, share: float):
        self.weights, self.bias, self.slope, self.shift, self.share = weights, bias, slope, shift, share

    def margins(self, words: list[str]) -> np.ndarray:
        whose, what, value = subsequences(words)
        return np.bincount(whose, value * self.weights[what], len(words)) + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def similarities(words: list[str], basis: np.ndarray) -> np.ndarray:
    """Kernel of every word with every landmark."""
    columns, out = np.ascontiguousarray(basis.T), np.zeros((len(words), len(basis)), np.float32)
    for i in range(0, len(words), 400):
        whose, what, value = subsequences(words[i : i + 400])
        order = np.argsort(whose, kind="stable")
        whose = whose[order]
        first = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]])) if len(whose) else np.zeros(0, np.int64)
        if len(first):
            out[i + whose[first]] = np.add.reduceat(columns[what[order]] * value[order, None].astype(np.float32), first)
    return out.astype(np.float64)


def _svm(x: np.ndarray, y: np.ndarray, times: np.ndarray, rounds: int = 30, c: float = 1e-6) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, classes weighted alike and rows by `times`, by Newton's method on the rows within the margin."""
    weight = times * np.where(y > 0, 0.5 / times[y > 0].sum(), 0.5 / times[y < 0].sum())
    ones = np.c_[x, np.ones(len(x))]
    w, inside = np.zeros(ones.shape[1]), np.ones(len(x), bool)
    for _ in range(rounds):
        z, v = ones[inside], weight[inside]
        w = np.linalg.solve(z.T @ (v[:, None] * z) + c * np.eye(len(w)), z.T @ (v * y[inside]))
        now = y * (ones @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], float(w[-1])


def _grams(word: str) -> set[str]:
    w = "\x02" + word
    return {w[i : i + 4] for i in range(max(1, len(w) - 3))}


def _evidence(a: int, b: int, n: int, m: int) -> float:
    """Likelihood-ratio evidence that a part of a word belongs to toxic documents (a of n, clean: b of m); 0 where under nine tenths of its share does."""
    if a / n < 9 * (b / m):
        return 0.0
    p = (a + b) / (n + m)
    return a * np.log(a / n / p) + (b * np.log(b / m / p) if b else 0.0)


def bag(text: str | None) -> list[str]:
    """The distinct words of a text's sentences."""
    return sorted({w for s in sentence_words(text) for w in s})


def train(rows: list[tuple[str | None, int]], share: float | None = None, landmarks: int = LANDMARKS, seed: int = 7) -> Model:
    """Model from (text, label) rows."""
    return train_bags([(bag(t), int(y)) for t, y in rows if y is not None], share, landmarks, seed)


def train_bags(rows: list[tuple[list[str], int]], share: float | None = None, landmarks: int = LANDMARKS, seed: int = 7) -> Model:
    """Model from (words, label) rows; share: of toxic rows where the sample comes from.

    Every fourth row is kept from the machine and sets the line to probabilities.
    """
    toxic = sum(y for _, y in rows)
    own = toxic / len(rows) if rows else 0.0
    share = max(1e-3, min(0.49, own if share is None else share))
    flat = Model(np.zeros(_DIM), 0.0, 0.0, float(np.log(share / (1 - share))), share)
    if not 0 < toxic < len(rows):
        return flat
    rng = np.random.default_rng(seed)
    rng.shuffle(rows)
    every = rows
    bags, aside = ([b for i, b in enumerate(every) if (i % 4 == 3) == side] for side in (False, True))
    if len({y for _, y in bags}) < 2 or len({y for _, y in aside}) < 2:
        bags = aside = every
    df = (Counter(), Counter())
    for words, y in bags:
        df[y].update({g for w in words for g in _grams(w)})
    n = (sum(1 - y for _, y in bags), sum(y for _, y in bags))
    proof = {g: _evidence(df[1][g], df[0][g], n[1], n[0]) for g in df[1]}
    sure = float(np.log(max(1, len(proof)))) + 3.0  # evidence that chance hardly gives any of so many parts
    bad = [w for w, y in bags if y and w]
    clean = sorted({w for words, y in bags if not y for w in words})
    if not bad or not clean:
        return flat
    rng.shuffle(clean)
    told = {w: max((proof.get(g, 0.0) for g in _grams(w)), default=0.0) for words in bad for w in words}
    witness = [w for words in bad for top in [max(told[w] for w in words)] for w in words if told[w] >= max(sure, 0.2 * top)]
    witness = witness or [max(w, key=lambda x: (told[x], x)) for w in bad]
    hard: list[str] = []
    for turn in range(3):
        often = Counter(witness)
        marks = [w for w, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))[: landmarks // 2]]
        marks += [w for w in clean if w not in often][: landmarks - len(marks)]
        basis = dense(marks)
        e, v = np.linalg.eigh((basis @ basis.T).astype(np.float64) + 1e-6 * np.eye(len(marks)))
        root = (v / np.sqrt(np.maximum(e, 1e-4))) @ v.T
        pos, neg = sorted(often), list(dict.fromkeys([*hard, *clean[:CLEAN_WORDS]]))
        x = similarities(pos + neg, basis) @ root
        w, b = _svm(x, np.r_[np.ones(len(pos)), -np.ones(len(neg))], np.r_[[often[p] for p in pos], np.ones(len(neg))])
        model = Model(((root @ w).astype(np.float32) @ basis).astype(np.float64), b, 1.0, 0.0, share)
        margin = np.concatenate([model.margins(clean[i : i + 20_000]) for i in range(0, len(clean), 20_000)])
        hard = list(dict.fromkeys([*hard, *(clean[i] for i in np.argsort(-margin, kind="stable")[:1500] if margin[i] > -0.8)]))
        named = set(clean)
        found = [(words, model.margins(words)) for words in bad]
        witness = [w for words, m in found for i, w in enumerate(words) if (m[i] == m.max() > 0 or told[w] >= sure) and w not in named] or witness
    worst = np.array([model.margins(w).max() if w else -1.0 for w, _ in aside])
    label = np.array([y for _, y in aside], float)
    weight = np.where(label > 0, share / own, (1 - share) / (1 - own))
    x, line = np.c_[worst, np.ones(len(worst))], np.array([1.0, 0.0])

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((weight * (np.logaddexp(0, z) - label * z)).sum() + 0.005 * (at @ at))

    for _ in range(60):  # Platt's line, by Newton's method with a little shrinkage; steps are halved until they help
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        grad = x.T @ (weight * (p - label)) + 0.01 * line
        step = np.linalg.solve(x.T @ ((weight * p * (1 - p))[:, None] * x) + 0.01 * np.eye(2), grad)
        while loss(line - step) > loss(line) and np.abs(step).max() > 1e-9:
            step = step / 2
        line = line - step
    slope = float(line[0])
    # The line's zero goes where it tells the rows kept aside apart best, in the middle of the widest such gap.
    order = np.argsort(worst, kind="stable")
    m, gain = worst[order], np.cumsum((weight * (1 - 2 * label))[order])  # of predicting clean up to here
    gap = np.append(m[1:] > m[:-1], True)
    top = np.flatnonzero(gap & (gain >= gain[gap].max() - 1e-9))
    upper = np.append(m[1:], m[-1] + 1.0)
    cut_ = top[np.argmax(upper[top] - m[top])]
    slope = max(slope, 1.0)
    model.slope, model.shift = slope, -slope * float((m[cut_] + upper[cut_]) / 2)
    return model


def fitted(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Trained on labelled rows whose crc32 of the id isn't 0 modulo 5: `most` of them at most, half of each label, the first by hash."""
    rows = labels.select(F.col("doc_id").alias("_l"), F.col("toxic").alias("_y")).where("_y in (0, 1) and _l is not null and crc32(cast(_l as string)) % 5 <> 0")
    first = lambda y: rows.where(F.col("_y") == y).orderBy(F.xxhash64("_l"), "_l").limit(most // 2)
    joined = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).join(F.broadcast(first(0).union(first(1))), F.expr("d = _l")).select("d", "t", "_y")  # at most `most` ids

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_slices(batch, "t", 4 << 20):
                words = [" ".join(bag(t)) for t in piece.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("d").cast(pa.int64()), pa.array(words, pa.string()), piece.column("_y").cast(pa.int32())], names=["d", "words", "y"])

    found = sorted(tuple(r) for r in joined.mapInArrow(bags, "d bigint, words string, y int").collect())
    return train_bags([(w.split(" ") if w else [], y) for _, w, y in found], rows.agg(F.avg("_y")).first()[0] or 0.0)


def scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs and _score, in place of a column of that name."""
    docs = docs.drop("_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for batch in batches:
            for piece in row_slices(batch, text, 2 << 20):
                bags = [all_words(t) for t in piece.column(text).to_pylist()]
                fresh = list(set().union(*bags).difference(known))
                if len(known) + len(fresh) > 200_000:
                    known, fresh = {}, list(set().union(*bags))
                for i in range(0, len(fresh), 20_000):
                    known.update(zip(fresh[i : i + 20_000], m.margins(fresh[i : i + 20_000]).tolist(), strict=True))
                worst = np.array([max(map(known.__getitem__, b)) if b else 0.0 for b in bags])
                p = np.where([bool(b) for b in bags], m.probability(worst), m.share)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(p, pa.float64())], names=[*piece.schema.names, "_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, _score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fitted(docs, labels)
    held = F.expr("crc32(cast(doc_id as string)) % 5 = 0")
    return scores(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that score under a half, with all their columns, whatever their names."""
    rows, names = sealed(docs)
    model = fitted(rows, labels, doc_id=names[doc_id], text=names[text])
    return scores(rows, model, names[text]).where("_score < 0.5").drop("_score").toDF(*docs.columns)

