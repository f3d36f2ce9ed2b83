"""Language of web pages by Bayesian fusion of independent evidence.

Evidence of a page: the likelihood of its text under byte-trigram models, the
language that the markup declares, the language that the address ends or begins
with, and a prior from its host. Host priors are counts of all pages by grouped
aggregation, smoothed from host to registered domain to all pages. In log space
the four terms add up; the posterior is their softmax.

The trigram models (a table of _BUCKETS rows and one column a language, broadcast)
are fitted on about MOST_ROWS documents a language, chosen by a bound on hashes, and
counted in tasks. Every language that documents name has a model, so the table grows
with their number alone. Every page is counted in the priors. Null or empty html has no text evidence and falls back on address and
host; a null URL has the empty host. Repeated rows count each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, row_slices, spread_join
from .op4_html import blocks

MOST_ROWS = 600
#: Weight of the domain and the whole in a host's prior, in pages.
DOMAIN_PAGES, ALL_PAGES = 8.0, 4.0
#: Reliability of declared and address languages: the chance that they name the language of the text.
DECLARED, ADDRESS = 0.85, 0.7
#: Trigrams of one text aren't independent: their log likelihood counts for so much, and for so many trigrams at most.
TEMPER, MOST_GRAMS = 0.25, 400.0
_BUCKETS = 1 << 15
_LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2})", re.I)


def _grams(text: str) -> np.ndarray:
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if len(b) > 2 else np.zeros(0, np.uint32)
    return (h * np.uint32(2654435761)) >> np.uint32(17)


def fit(docs: DataFrame, most: int = MOST_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of the trigram buckets in each."""
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    langs = [r["lang"] for r in docs.where("lang is not null").select(F.col("lang").cast("string").alias("lang")).distinct().orderBy("lang").collect()]
    share = F.broadcast(sizes)  # one row a language
    some = rows.join(share, "lang").where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) * F.col("n") < F.lit(most << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held = total.setdefault(lang, np.zeros(_BUCKETS, np.int64))
                held += np.bincount(_grams(t), minlength=_BUCKETS)
        for lang, held in total.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], names=["lang", "bucket", "n"])

    counts = np.full((_BUCKETS, max(1, len(langs))), 0.05)
    found = some.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    for r in found.collect():  # at most _BUCKETS rows a language
        counts[r["bucket"], langs.index(r["lang"])] += r["n"]
    return langs, np.log(counts / counts.sum(0))


def evidence(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """page_id, url, host, domain, and the log evidence of each language from text, markup and address."""
    shared = pages.sparkSession.sparkContext.broadcast((langs, table.astype(np.float32)))
    k = max(1, len(langs))
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#:]*", 0))
    rows = pages.select("page_id", "url", "html", host.alias("host"), F.regexp_extract(host, r"[^.]+\.[^.]+$", 0).alias("domain"), F.lower(F.regexp_extract(rest, r"^[^/]*/([A-Za-z]{2})(?:[/?#]|$)", 1)).alias("_first"))

    def told(names: list[str], lang: str | None, trust: float) -> np.ndarray:
        out = np.zeros(k)
        if lang in names and k > 1:
            out[:] = log((1 - trust) / (k - 1))
            out[names.index(lang)] = log(trust)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, t = shared.value
        for batch in batches:
            for piece in row_slices(batch, "html", 4 << 20):
                out = []
                for page, domain, first in zip(*(piece.column(c).to_pylist() for c in ("html", "domain", "_first")), strict=True):
                    g = _grams(" ".join(x for x, _ in blocks(page)))
                    text = t[g].sum(0, dtype=np.float64) * TEMPER * min(1.0, MOST_GRAMS / max(1, len(g))) if len(names) else np.zeros(k)
                    declared = _LANG.search(page or "")
                    top = domain.rpartition(".")[2]
                    address = first if first in names else top
                    e = text + told(names, declared[1].lower() if declared else None, DECLARED) + told(names, address, ADDRESS)
                    out.append((e - e.max()).tolist())
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in ("page_id", "url", "host", "domain")] + [pa.array(out, pa.list_(pa.float64()))], names=["page_id", "url", "host", "domain", "e"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, host string, domain string, e array<double>")


def _soft(e, k: int) -> list:
    """Softmax of an array column, as k columns."""
    total = sum((F.exp(e[i]) for i in range(k)), F.lit(0.0))
    return [F.exp(e[i]) / total for i in range(k)]


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, url, host, lang, posterior of every page."""
    langs, table = fit(docs)
    k = max(1, len(langs))
    seen = cut(evidence(pages, langs, table))
    soft = seen.select("host", "domain", *[p.alias(f"p{i}") for i, p in enumerate(_soft(F.col("e"), k))])
    hosts = soft.groupBy("host", "domain").agg(F.count("*").alias("n"), *[F.sum(f"p{i}").alias(f"h{i}") for i in range(k)])
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("dn"), *[F.sum(f"h{i}").alias(f"d{i}") for i in range(k)])
    whole = hosts.agg(F.sum("n").alias("an"), *[F.sum(f"h{i}").alias(f"a{i}") for i in range(k)])
    mean = lambda i: (F.col(f"a{i}") + 1) / (F.col("an") + k)
    domain = lambda i: (F.col(f"d{i}") + ALL_PAGES * mean(i)) / (F.col("dn") + ALL_PAGES)
    prior = [((F.col(f"h{i}") + DOMAIN_PAGES * domain(i)) / (F.col("n") + DOMAIN_PAGES)) for i in range(k)]
    priors = hosts.join(domains, "domain").join(F.broadcast(whole)).select("host", F.array(*[F.log(p) for p in prior]).alias("prior"))  # whole: one row
    fused = spread_join(seen, priors, "host", seen.count(), by=["page_id"]).withColumn("f", F.zip_with("e", "prior", lambda a, b: a + b))
    fused = fused.withColumn("best", F.array_max("f")).withColumn("f", F.transform("f", lambda x: x - F.col("best")))
    posterior = F.array(*_soft(F.col("f"), k))
    names = F.array(*[F.lit(x) for x in langs or ["und"]])
    return fused.withColumn("p", posterior).select("page_id", "url", "host", F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("lang"), F.array_max("p").alias("posterior"))
