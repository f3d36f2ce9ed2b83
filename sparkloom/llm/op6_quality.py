"""Quality by weak labels: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

1. Labellers, all DataFrame expressions, vote good (1), bad (0) or abstain (-1).
2. The votes of all documents are counted by pattern: at most 3^labellers rows,
   whatever the corpus, and that table alone goes to the driver.
3. Expectation-maximisation on the counts, weighted, so every document has its
   part: a prior and each labeller's rates of the votes under good and bad.
4. Each pattern has a posterior; documents take it by their pattern.
5. A logistic scorer on hashed word features learns from the posteriors of about
   MOST_ROWS documents, chosen by a bound on hashes, and scores every whole text; the
   weight of a word is looked up once for each distinct word.

Null and empty texts are bad by the length labeller and score by the bias alone.
Repeated rows count each and score alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_slices

MOST_ROWS = 3000
_BITS = 14


def labellers() -> dict[str, Column]:
    """Votes of each labeller over a column `text` that isn't null."""
    text, n = F.col("text"), F.length("text")
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(n, F.lit(1))
    vote = lambda bad, good: F.when(bad, 0).when(good, 1).otherwise(-1)
    words = F.regexp_count(text, F.lit(r"\S+"))
    lines = F.split(text, "\n")
    distinct = F.size(F.array_distinct(lines)) / F.size(lines)
    return {
        "length": vote(words < 20, words > 80),
        "symbols": vote(share(r"[#$%&*|<>{}\[\]=~^\\_@]") > 0.02, share(r"[#$%&*|<>{}\[\]=~^\\_@]") < 0.002),
        "capitals": vote(share(r"\p{Lu}") > 0.25, share(r"\p{Lu}") < 0.08),
        "sentences": vote(share(r"[.?!]") < 0.002, share(r"[.?!]").between(0.004, 0.05)),
        "repeated_lines": vote((F.size(lines) > 3) & (distinct < 0.7), distinct > 0.95),
        "word_length": vote((n / F.greatest(words, F.lit(1)) < 3.0) | (n / F.greatest(words, F.lit(1)) > 12), (n / F.greatest(words, F.lit(1))).between(4, 8)),
        "shouting": vote(share(r"!") > 0.01, share(r"!") == 0),
    }


def votes(docs: DataFrame) -> DataFrame:
    """doc_id, text (empty for null) and votes, one character a labeller: 0 bad, 1 good, 2 abstain."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.concat(*[F.when(v < 0, "2").otherwise(v.cast("string")) for v in labellers().values()]).alias("votes"))


def expectation_maximisation(patterns: list[str], counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each pattern, and each labeller's accuracy where it votes; it starts from the majority of votes."""
    if not patterns:
        return np.zeros(0), np.zeros(0)
    v = np.array([[int(c) for c in p] for p in patterns])
    good = ((v == 1).sum(1) + 0.5) / ((v < 2).sum(1) + 1.0)
    one = np.stack([(v == c) for c in range(3)], 2).astype(float)
    for _ in range(rounds):
        w = np.stack([counts * (1 - good), counts * good])
        prior = w.sum(1) / w.sum()
        rate = (np.einsum("cp,plv->clv", w, one) + 1.0) / (w.sum(1)[:, None, None] + 3.0)
        like = np.log(np.clip(prior, 1e-9, 1))[:, None] + np.einsum("plv,clv->cp", one, np.log(rate))
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -60, 60)))
        done = np.abs(new - good).max() < 1e-7
        good = new
        if done:
            break
    right = (w[1][:, None] * (v == 1) + w[0][:, None] * (v == 0)).sum(0) / np.maximum((counts[:, None] * (v < 2)).sum(0), 1e-9)
    return good, right


def word_features(word: str) -> list[tuple[int, float]]:
    """Hashed word and word shape, each with a sign."""
    shape = ("U" if word.isupper() else "l" if word.islower() else "C" if word[0].isupper() else "x") + str(min(len(word), 12)) + ("" if word[-1].isalnum() else word[-1])
    hashes = [crc32(f.encode("utf-8", "replace")) for f in (word.lower(), "\x01" + shape)]
    return [(h >> (32 - _BITS), 1.0 if h & 1 else -1.0) for h in hashes]


def features(text: str) -> dict[int, float]:
    """Sum of the words' features over the root of their number."""
    out: dict[int, float] = {}
    words = text.split()
    for w in words:
        for k, x in word_features(w):
            out[k] = out.get(k, 0.0) + x
    n = max(1, len(words)) ** 0.5
    return {k: x / n for k, x in out.items()}


def train(rows: list[tuple[dict[int, float], float]], rounds: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of the logistic scorer, by stochastic gradients over rows of features in a fixed order."""
    w, total = np.zeros((1 << _BITS) + 1), np.full((1 << _BITS) + 1, 1e-3)
    every = [(np.array(list(f), np.int64), np.array(list(f.values())), y) for f, y in rows]
    for _ in range(rounds):
        for k, x, y in every:
            g = 1 / (1 + np.exp(-np.clip(w[k] @ x + w[-1], -30, 30))) - y
            total[k] += (g * x) ** 2
            total[-1] += g * g
            w[k] -= 0.1 * g * x / np.sqrt(total[k])
            w[-1] -= 0.1 * g / np.sqrt(total[-1])
    return w


class _Weights(dict):
    """What a word adds to the margin, before division by the root of the number of words."""

    def __init__(self, w: np.ndarray):
        self.w = w.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:
            self.clear()
        self[word] = x = sum(self.w[k] * sign for k, sign in word_features(word))
        return x


def score(docs: DataFrame) -> DataFrame:
    """doc_id, weak (posterior of the votes), score, predicted of every document."""
    voted = votes(docs)
    table = voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()  # at most 3^7 rows
    patterns = [r["votes"] for r in table]
    good, _ = expectation_maximisation(patterns, np.array([r["n"] for r in table], float))
    of = dict(zip(patterns, good.tolist(), strict=True))
    total = sum(r["n"] for r in table)
    near = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, MOST_ROWS / max(1, total)))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("votes"), pa.array([list(x) for x in f], pa.list_(pa.int32())), pa.array([list(x.values()) for x in f], pa.list_(pa.float64()))], names=["id", "votes", "k", "x"])

    # Votes are computed for the sampled documents only, features in tasks; what comes to the driver is a sparse row a document.
    sample = votes(docs.where(near)).mapInArrow(reduced, "id string, votes string, k array<int>, x array<double>").collect()
    rows = sorted(((r["id"] or "", r["votes"], r["k"], r["x"]) for r in sample))
    shared = docs.sparkSession.sparkContext.broadcast((of, train([(dict(zip(k, x, strict=True)), of[v]) for _, v, k, x in rows])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weak, w = shared.value
        known = _Weights(w)
        for batch in batches:
            for piece in row_slices(batch, "text", 4 << 20):
                words = [t.split() for t in piece.column("text").to_pylist()]
                margin = [sum(map(known.__getitem__, x)) / max(1, len(x)) ** 0.5 + w[-1] for x in words]
                p = 1 / (1 + np.exp(-np.clip(np.array(margin, float), -30, 30)))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([weak[v] for v in piece.column("votes").to_pylist()], pa.float64()), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "weak", "score", "predicted"])

    kind = voted.schema["doc_id"].dataType.simpleString()
    return voted.mapInArrow(run, f"doc_id {kind}, weak double, score double, predicted int")
