"""The corpus operators against brute force, round trips and held-out labels, with odd rows in every table."""

import hashlib
import itertools
import os
import random
import re
import time
import tracemalloc
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from sparkloom.llm import common, op1_warc, op2_suffix_dedup, op3_mixing, op4_html, op5_language, op6_quality, op7_minhash, op8_toxicity, op9_ann, op10_decontaminate

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}é" if rng.random() < 0.05 else f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, short, empty, null and very long texts."""
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(1, 120)) for _ in range(40)]
    passage = prose(rng, 30)
    out = list(base)
    out += [base[3]] * 4 + [base[5].upper(), base[5]]
    for b in base[:12]:
        w = b.split()
        if len(w) > 10:
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(6)]
    out += [None, "", " \n ", "one", "one", "a b c", prose(rng, 30000), "x" * 49, "x" * 50, "x" * 120, "x" * 50]
    rng.shuffle(out)
    return [(i * 3 % 101 + 101 * (i * 3 // 101), t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s" if i % 2 else None, 0) for i, t in rows], DOC).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


def test_near_duplicates(docs, rows, nothing):
    for k in (4, 5):
        got = sorted(tuple(r) for r in op7_minhash.near_duplicates(docs, k=k).collect())
        assert got == sorted(op7_minhash.brute(rows, k))
    assert op7_minhash.near_duplicates(nothing).count() == 0
    assert op7_minhash.keep_one(docs).columns == docs.columns


def test_near_duplicates_of_a_hot_group(spark):
    """Many texts near one base, of which few pairs are linked directly."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    made = []
    for i in range(60):
        w = list(base)
        for j in rng.sample(range(120), 2):
            w[j] = f"n{i}x{j}"
        made.append((i, " ".join(w)))
    got = op7_minhash.near_duplicates(spark.createDataFrame(made, "doc_id bigint, text string"), k=5)
    assert sorted(tuple(r) for r in got.collect()) == sorted(op7_minhash.brute(made, 5))


def test_null_id_links_with_nothing(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in op7_minhash.near_duplicates(df).collect()) == [(0, 0, True), (1, 1, True), (1, 1, True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50), (50, 75), (7, 7)]
    got = {r["node"]: r["component"] for r in op7_minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 50: 50, 75: 50, 100: 50}


def test_repeats(docs, rows, nothing):
    got = sorted(tuple(r) for r in op2_suffix_dedup.digest(op2_suffix_dedup.remove_repeats(docs)).collect())
    assert got == sorted(op2_suffix_dedup.brute(rows))
    assert op2_suffix_dedup.remove_repeats(nothing).count() == 0


def test_repeats_keep_characters_and_columns(spark):
    shared = "é" * 40
    df = spark.createDataFrame([(1, "ab" + shared, 5), (2, "cd" + shared + "ef", 6), (None, shared, 7)], "doc_id bigint, text string, _id int")
    out = {r["doc_id"]: r for r in op2_suffix_dedup.remove_repeats(df).collect()}
    assert out[2]["_kept"] == "cdef" and out[2]["_id"] == 6 and out[None]["_n_removed"] == 0 and out[1]["_n_removed"] == 0


def test_suffix_sort():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1200] = data[:200]
    start = rng.permutation(3900)
    got = op2_suffix_dedup.suffix_sort(op2_suffix_dedup.PrefixHash(data), start, 50)
    raw = data.tobytes()
    assert got.tolist() == sorted(start.tolist(), key=lambda i: (raw[i : i + 50], i))


def test_window_minima_survives_equal_hashes(monkeypatch):
    monkeypatch.setattr(op2_suffix_dedup.PrefixHash, "at", lambda self, s, k: np.zeros(len(s), np.uint64))
    data = np.frombuffer(b"a" * 60 + b"b" * 60, np.uint8)
    assert op2_suffix_dedup.window_minima(data, np.array([0, 60]), np.array([1, 2])).tolist() == [1, 2]


def test_decontamination(spark, docs, rows, nothing):
    long = [t for _, t in rows if t and 60 < len(t.split()) < 200]
    items = [(1, " ".join(long[0].split()[5:30])), (2, long[1]), (3, "w1 w2"), (4, None), (5, ""), (10, long[0]), (6, "one"), (None, " ".join(long[0].split()[2:20] + long[1].split()[3:20]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(op10_decontaminate.brute(rows, items), key=str)
    for words in (10_000, 40):  # in one block and in several
        got = op10_decontaminate.digest(op10_decontaminate.matches(docs, bench, block_words=words))
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    kept = op10_decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)
    assert op10_decontaminate.matches(nothing, bench).count() == 0
    assert op10_decontaminate.matches(docs, bench.limit(0)).where("size(_m.hit) > 0").count() == 0


def test_schedule_stays_within_a_block_of_the_exact_weights():
    for weights in ({"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, {"x": 2**0.5, "y": 1.0, "z": 3**0.5}, {f"s{i}": 1 / (i + 1) for i in range(40)}):
        share = op3_mixing.shares(weights)
        total = sum(share.values())
        done = dict.fromkeys(share, 0)
        for span in (*range(3), 200):  # spans may be made in any order
            t = span * op3_mixing.SPAN
            if span == 200:
                done = op3_mixing.done_by(share, total, t)
            for s, j in op3_mixing.schedule(share, t):
                assert done[s] == j and j * total // share[s] <= t < -(-(j + 1) * total // share[s])
                done[s] += 1
                t += 1
                assert t % 97 or all(abs(done[x] * total - t * share[x]) < total for x in share)


def test_no_span_misses_a_deadline(monkeypatch):
    """Random shares and starts, spans of few slots: each block in its window, each source within a block, each span ends where the next one starts."""
    rng, spans = random.Random(21), 0
    while spans < 3000:
        n = rng.choice([2, 3, 5, 8, 8, 13, 60])
        weights = {f"s{i}": rng.choice([rng.randrange(1, 3000) ** 0.5, float(rng.randrange(1, 40)), rng.random() + 1e-3]) for i in range(n)}
        share = op3_mixing.shares(weights)
        total = sum(share.values())
        monkeypatch.setattr(op3_mixing, "SPAN", rng.choice([1, 5, 64, 300]))
        size = op3_mixing.span_of(share)
        for t in [rng.randrange(10 ** rng.randrange(1, 12)) for _ in range(5 if size < 5000 else 0)]:
            done = op3_mixing.done_by(share, total, t)
            assert sum(done.values()) == t
            for s, j in op3_mixing.schedule(share, t):
                assert done[s] == j and j * total // share[s] <= t < -(-(j + 1) * total // share[s])
                done[s] += 1
                t += 1
                assert t % 29 or all(abs(done[x] * total - t * share[x]) < total for x in share)
            assert done == op3_mixing.done_by(share, total, t)
            spans += 1


def test_sources_of_uneven_weights(spark):
    """Eight sources whose largest remainders, rounded up together, leave no schedule."""
    blocks = dict(zip("abcdefgh", (14, 43, 1478, 46, 1279, 1481, 41, 29), strict=True))
    found = op3_mixing.phases(blocks, dict(zip("abcdefgh", (16.0, 51.0, 1821.0, 55.0, 1576.0, 1825.0, 49.0, 34.0), strict=True)))
    out = op3_mixing.slots_of(spark, found).toPandas()
    assert sorted(out._slot) == list(range(sum(blocks.values()))) and out.groupby("_group")._turn.agg(["min", "nunique", "max"]).to_dict("index") == {s: {"min": 0, "nunique": n, "max": n - 1} for s, n in blocks.items()}
    assert sum(p["length"] for p in found) == sum(blocks.values())


def brute_mix(blocks, weights):
    """(source, block) by slot: earliest deadline first, slot by slot, with a new phase where a source ends."""
    left, done, out = dict(blocks), dict.fromkeys(blocks, 0), []
    while left:
        now = {s: Fraction(weights[s]) for s in left if weights[s] > 0} or dict.fromkeys(left, Fraction(1))
        w = {s: x / sum(now.values()) for s, x in now.items()}
        had, t = dict.fromkeys(w, 0), 0
        while all(had[s] < left[s] for s in w):
            ready = [s for s in w if had[s] / w[s] < t + 1]
            s = min(ready, key=lambda s: (-(-(had[s] + 1) / w[s] // 1), s)) if ready else None
            out.append((s, done[s] + had[s]))
            had[s] += 1
            t += 1
        for s in w:
            done[s] += had[s]
            left[s] -= had[s]
        left = {s: n for s, n in left.items() if n}
    return out


def test_phases_equal_brute_force():
    rng = random.Random(9)
    for _ in range(20):
        blocks = {f"s{i}": rng.randrange(1, 60) for i in range(rng.randrange(1, 6))}
        weights = {s: rng.choice([0.0, 1.0, n**0.5, rng.random()]) for s, n in blocks.items()}
        got = []
        for p in op3_mixing.phases(blocks, weights):
            assert p["start"] == len(got)
            got += [(s, p["first"][s] + j) for s, j in itertools.islice(op3_mixing.schedule(p["share"], 0, max(op3_mixing.SPAN, p["length"])), p["length"])]
        assert got == brute_mix(blocks, weights)


def test_mixing(spark, docs, nothing):
    many = spark.createDataFrame([(i, "a" if i % 3 else "b" if i % 2 else None) for i in range(3000)], "doc_id bigint, source string")
    out = op3_mixing.mix(many, {"a": 0.7, "b": 0.2, "": 0.1}).toPandas()
    assert len(out) == 3000 == out.doc_id.nunique() and out.groupby("_slot")._source.nunique().max() == 1 and out._slot.max() + 1 == out._slot.nunique()
    assert len(out.groupby(["_slot", "_place"])) == 3000 and out._place.max() < op3_mixing.BLOCK
    assert op3_mixing.mix(nothing).count() == 0
    again = many.union(many.limit(10)).withColumns({"_hash": F.lit(1), "_source": F.lit("mine")})
    odd = op3_mixing.mix(again)
    assert odd.count() == 3010 and odd.columns == ["doc_id", "source", "_hash", "_source", "_block", "_slot", "_place"]
    assert {r["_source"] for r in odd.select("_source").distinct().collect()} == {"", "a", "b"} and {r["_hash"] for r in odd.collect()} == {1}


def test_mixing_of_many_sources(spark):
    n = op3_mixing.MOST_SOURCES + 400
    rows = [(i, f"s{i % n}") for i in range(n * 2)] + [(10**6 + i, "big") for i in range(64 * 40)] + [(10**7 + i, "last") for i in range(100)]
    out = op3_mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string"), {"last": 0.0}).toPandas()
    assert len(out) == len(rows) == out.doc_id.nunique() and out._slot.min() == 0 and out._slot.max() + 1 == out._slot.nunique() == n + 40 + 2
    assert out.groupby("_slot")._source.nunique().max() == 1 and set(out[out._source == "last"]._slot) == {n + 40, n + 41}
    big = np.sort(out[out._source == "big"]._slot.unique())
    assert (np.diff(out[out._source == "big"].groupby("_block")._slot.first().sort_index()) > 0).all() and big[-1] > n  # it lasts when the small ones have ended


def brute_flow(sizes, weights):
    """(source, block) by slot: one earliest-deadline schedule over all slots, windows from a sum over all sources for each block."""
    blocks, out = {s: -(-n // op3_mixing.BLOCK) for s, n in sizes.items()}, []
    given = {s: Fraction(weights.get(s, n**0.5)) for s, n in sizes.items()}
    for some in ({s: w for s, w in given.items() if w > 0}, {s: Fraction(1) for s, w in given.items() if w <= 0}):
        reached = lambda v: sum(min(Fraction(blocks[s]), w * v) for s, w in some.items())  # noqa: B023, E731
        jobs = [(reached(j / w) // 1, -(-reached((j + 1) / w) // 1), s, j) for s, w in some.items() for j in range(blocks[s])]
        for t in range(len(jobs)):
            due, s, j = min(x[1:] for x in jobs if x[0] <= t)
            assert t < due
            jobs.remove(next(x for x in jobs if x[2:] == (s, j)))
            out.append((s, j))
    return out


def test_mixing_equals_one_schedule_over_all_slots(spark, monkeypatch):
    """Whatever the spans and classes; with sources of one size, of many, of given weights, some last."""
    rng = random.Random(5)
    for span, parts, given, sizes in (
        (4096, 1024, {}, [500] * 6),
        (8, 1024, {}, [rng.choice([1, 64, 65, 700, 5000]) for _ in range(30)]),
        (8, 5, {"s0": 0.0, "s1": 1e-7, "s2": 1000.0, "s3": 1 / 3, "s4": 0.0}, [rng.randrange(1, 1500) for _ in range(25)]),
        (1, 1024, {"s1": 0.1}, [rng.randrange(1, 900) for _ in range(8)]),
    ):
        monkeypatch.setattr(op3_mixing, "SPAN", span)
        monkeypatch.setattr(op3_mixing, "PARTS", parts)
        sizes = {f"s{i}": n for i, n in enumerate(sizes)}
        rows = [(f"{s}-{i}", s) for s, n in sizes.items() for i in range(n)]
        out = op3_mixing.mix(spark.createDataFrame(rows, "doc_id string, source string"), given).toPandas()
        assert len(out) == len(rows) == out.doc_id.nunique() and out.groupby("_slot")._block.nunique().max() == 1
        got = out.groupby("_slot")[["_source", "_block"]].first().sort_index()
        assert list(got.index) == list(range(len(got)))
        assert list(got.itertuples(index=False, name=None)) == brute_flow(sizes, given)


def test_mixing_of_any_number_of_sources_within_a_block(spark):
    """Below 512 sources and above by one rule: no source is a block off its exact share at any slot."""
    for n in (300, 700):
        sizes = {f"s{i}": 1 + i * 37 % 300 for i in range(n)} | {"big0": 9000, "big1": 5000, "big2": 2500}
        docs = spark.createDataFrame([(s, k) for s, k in sizes.items()], "source string, k int").selectExpr("source", "explode(sequence(1, k)) AS i").selectExpr("concat(source, '-', i) AS doc_id", "source")
        out = op3_mixing.mix(docs).groupBy("_slot").agg(F.first("_source").alias("s")).toPandas().sort_values("_slot")
        names = list(sizes)
        blocks, w = np.array([-(-k // op3_mixing.BLOCK) for k in sizes.values()]), np.array([k**0.5 for k in sizes.values()])
        ends = np.sort(blocks / w)
        slots = np.minimum(blocks, np.outer(np.append(0, ends), w)).sum(1)
        shares = np.minimum(blocks, np.outer(np.interp(np.arange(len(out) + 1), slots, np.append(0, ends)), w))
        had = np.zeros((len(out) + 1, len(names)))
        had[np.arange(1, len(out) + 1), [names.index(s) for s in out.s]] = 1
        assert len(out) == blocks.sum() and np.abs(had.cumsum(0) - shares).max() < 1 + 1e-9


PAGES = [
    (1, "https://a.org/x/1", "<nav>menu</nav><article><h1>T &amp; u</h1><p>one  two<br>three</article><footer>f</footer>"),
    (2, "https://a.org/x/2", "<div>shared line</div><div>own text of two</div><div class='sidebar'>s</div>"),
    (3, "https://a.org/x/3", "<div>shared line</div><div>own text of three</div><script>var x='</div>'</script>"),
    (4, None, "<p>no address</p>"), (5, "https://b.org/", None), (6, "", ""), (7, "https://a.org/x/2", "<div>shared line</div><div>own text of two</div>"),
]


def test_html(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in op4_html.extract(df).collect()}
    assert got[1] == "T & u\n\none two\n\nthree" and got[4] == "no address" and got[5] == got[6] == ""
    assert got[3] == "own text of three"
    assert op4_html.extract(df.limit(0)).count() == 0


def test_html_differences_pages_with_an_article(spark):
    page = "<div>top line</div><main><h1>Title {0}</h1><p>Read more of this</p></main><div>body {0} outside</div>"
    df = spark.createDataFrame([(i, f"https://a.org/x/{i}", page.format(i)) for i in (1, 2)] + [(3, "https://c.org/x/1", page.format(3)), (4, "https://c.org/x/2", page.format(3))], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in op4_html.extract(df).collect()}
    assert got[1] == "Title 1\n\nbody 1 outside" and got[2] == "Title 2\n\nbody 2 outside"
    assert got[3] == got[4] == "top line\n\nTitle 3\n\nRead more of this\n\nbody 3 outside"


def test_html_partners_within_the_whole_host(spark):
    paths = [f"2024/{m:02}/slug{m * 7919}/" for m in range(1, 13)] + [f"article/{84213 * i}" for i in range(1, 13)]
    rows = [(i, f"https://{h}.org/{p}", f"<div>top line</div><p>own text {i}</p>") for i, (h, p) in enumerate((h, p) for h in "ab" for p in paths)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in op4_html.extract(df).collect()}
    assert got == {i: f"own text {i}" for i, _, _ in rows}


def test_html_copies_do_not_erase_each_other(spark):
    got = {r["page_id"]: r["text"] for r in op4_html.extract(spark.createDataFrame(PAGES, "page_id bigint, url string, html string")).collect()}
    assert got[2] == got[7] == "shared line\n\nown text of two"  # the nearest other page, 1, shares nothing
    rng, body = random.Random(6), "<div>top line</div><p>{0}</p>"
    for copies in (3, 300):  # many copies fill whole ranges; they lead their host, stand inside it or end it
        for texts in (["one"] * copies + ["two"], ["one", *["two"] * copies, "three"], ["one"] + ["two"] * copies):
            rows = [(i, f"https://a.org/x?i={i}", body.format(t)) for i, t in enumerate(texts)]
            df = spark.createDataFrame(rng.sample(rows, len(rows)), "page_id bigint, url string, html string")
            assert [r["text"] for r in op4_html.extract(df).orderBy("page_id").collect()] == texts
    alone = spark.createDataFrame([(i, "https://a.org/x", body.format("one")) for i in range(4)], "page_id bigint, url string, html string")
    assert {r["text"] for r in op4_html.extract(alone).collect()} == {"top line\n\none"}


def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        got = op4_html.shared(a, b)
        picked, it = [x for x, g in zip(a, got, strict=True) if g], iter(b)
        assert len(picked) == t[-1][-1] and all(x in it for x in picked)


def test_warc_round_trip(spark):
    big = "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9
    rows = [(3, "https://WWW.a.org:80/p?q#f", big), (1, "http://a.org/p", big), (2, None, "tiny"), (4, "http://a.org/p", "tiny"), (5, "http://b.org", None), (6, "x\ny", big + "\r"), (None, "http://c.org", big)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in op1_warc.captures(df).collect()}
    for i, _, h in rows:
        raw = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if r["refers_to"]} == {3: ("revisit", 1), None: ("revisit", 1)}
    assert got[3]["urlkey"] == "org,a)/p?q" and got[2]["urlkey"] == ""
    ordered = op1_warc.captures(df).orderBy("range", "position").collect()
    assert [op1_warc.key_of(r.asDict()) for r in ordered] == sorted(op1_warc.key_of(r.asDict()) for r in ordered)
    assert op1_warc.captures(df.limit(0)).count() == 0


def test_warc_times_and_histories(spark, monkeypatch):
    monkeypatch.setattr(op1_warc, "RANGE_ROWS", 20)
    rows = [(i, "http://a.org/p" if i % 3 else f"http://b.org/{i}", "x") for i in range(300)] + [(10**15, "http://a.org/p", "x"), (-(10**15), "http://a.org/p", "x"), (2**62, None, None)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = op1_warc.captures(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {r["page_id"]: r["ts"] for r in got} == {i: max(0, min(op1_warc.LAST, i + op1_warc.EPOCH)) for i, _, _ in rows}
    hot = sorted((r["ts"], r["page_id"], r["capture"]) for r in got if r["urlkey"] == "org,a)/p")
    assert [c for _, _, c in hot] == list(range(1, 203)) and len({r["range"] for r in got if r["urlkey"] == "org,a)/p"}) > 1


def test_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(op1_warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_nearest(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(1500, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(v)] + [(1500 + i, [float(x) for x in v[0]]) for i in range(40)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8), (2100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted(tuple(r) for r in op9_ann.search(df, df.where("vec_id % 100 = 0")).collect())
    want = op9_ann.brute([r for r in rows if r[0] < 2000])
    hit = {x[::2] for x in got} & {x[::2] for x in want}
    assert len(got) == len(want) and len(hit) / len(want) >= 0.9
    few = spark.createDataFrame(rows[:3], df.schema)
    assert sorted(tuple(r) for r in op9_ann.search(few, few.where("vec_id = 0")).collect()) == op9_ann.brute(rows[:3])
    assert op9_ann.search(df.limit(0), df).count() == 0


def test_nearest_counts_repeated_rows_once(spark):
    near, far = [1.0, 0.0], [0.0, 1.0]
    rows = [(0, near)] * 30 + [(i, near) for i in range(1, 9)] * 4 + [(100, far)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted(tuple(r) for r in op9_ann.search(df, df.where("vec_id % 100 = 0")).collect())
    assert got == op9_ann.brute(rows) and {r[2] for r in got if r[0] == 0} == {*range(1, 9), 100}
    rows = [(5, near)] * 12 + [(6, near), (100, far), (100, near), (200, far)]  # an id with two vectors counts with the smaller
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r) for r in op9_ann.search(df, df.where("vec_id % 100 = 0")).collect()) == op9_ann.brute(rows)


def test_nearest_of_many_ties(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r) for r in op9_ann.search(df, df.where("vec_id % 100 = 0")).collect()) == op9_ann.brute(rows)


def test_lists_visited_grow_with_the_lists():
    assert op9_ann.probes(50) == 50 and op9_ann.probes(128) == 96 and op9_ann.probes(2500) > 400
    rng = np.random.default_rng(2)
    index = op9_ann.Centroids(rng.normal(size=(3000, 8)))
    sizes, radii = np.ones(3000, np.int64), np.full(3000, 0.5)
    for q in (index.c[7], rng.normal(size=8)):  # at its centroid a query visits enough lists too
        d = np.sqrt(((index.c - q) ** 2).sum(1))
        seen = op9_ann.visited(index, q, sizes, radii, 10)
        assert sizes[seen].sum() >= 33
        inside = np.argsort(d)[: op9_ann.probes(3000)]
        bound = np.sort(d)[32] + 0.5
        assert set(seen) == {i for i in inside if d[i] - 0.5 <= bound}
    sizes[np.argsort(np.sqrt(((index.c - index.c[7]) ** 2).sum(1)))[:2980]] = 0  # few vectors: every list that holds some
    assert sizes[op9_ann.visited(index, index.c[7], sizes, radii, 10)].sum() == 20


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_toxicity_of_held_out_rows(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in read("labels").collect()}
    out = op8_toxicity.digest(read("documents"), read("labels")).collect()
    held = [(labels[r["doc_id"]], r["predicted"]) for r in out if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    right = sum(a == b for a, b in held) / len(held)
    # On these rows 44 of 97 toxic labels are on texts without any insult, so no scorer passes 0.95.
    assert right > 0.92 and all(0 <= r["score"] <= 1 for r in out)


def test_toxicity_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = op8_toxicity.digest(docs, labels).collect()
    assert len(out) == docs.count() and len({round(r["score"], 9) for r in out}) == 1
    assert op8_toxicity.all_words("you i d i o t !") >= {"idiot"}


def test_gapped_insults_resemble_the_insult():
    rows = [(f"calm text number {i} about trees rivers and stones", 0) for i in range(60)] + [(f"calm text number {i} you moronic idiot", 1) for i in range(60)]
    m = op8_toxicity.train(rows, 0.1)
    near, far = m.margins(["id.iot", "idi-ot", "idiotic"]), m.margins(["stones", "rivers"])
    assert near.min() > far.max()


def test_quality(spark, docs, nothing):
    out = op6_quality.score(docs).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and 0 <= r["weak"] <= 1 for r in out)
    assert op6_quality.score(nothing).count() == 0


def test_labeller_accuracies_are_recovered():
    rng = np.random.default_rng(3)
    truth, right = rng.random(20000) < 0.7, np.array([0.95, 0.8, 0.7, 0.6])
    v = np.where(rng.random((20000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    v[rng.random((20000, 4)) < 0.2] = 2
    names, counts = np.unique(["".join(map(str, r)) for r in v], return_counts=True)
    good, found = op6_quality.expectation_maximisation(names.tolist(), counts.astype(float))
    assert np.abs(found - right).max() < 0.04 and good[names.tolist().index("1111")] > 0.95 > 0.2 > good[names.tolist().index("0000")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_language(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    out = op5_language.identify(read("pages"), read("documents")).collect()
    assert sum(f"/{r['lang']}/" in r["url"] for r in out) / len(out) > 0.95
    odd = spark.createDataFrame([(1, None, None), (2, "http://x.de/", ""), (2, "http://x.de/", "")], "page_id bigint, url string, html string")
    got = sorted((r["page_id"], r["lang"]) for r in op5_language.identify(odd, read("documents")).collect())
    assert got[1:] == [(2, "de"), (2, "de")]
    assert op5_language.identify(odd.limit(0), read("documents").limit(0)).count() == 0


def test_texts_of_one_id_link_one_node(spark):
    x, y = "a b c d e f g h i j", "k l m n o p q r s t"  # sets of one size
    df = spark.createDataFrame([(5, x), (5, y), (7, x), (9, y)], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in op7_minhash.near_duplicates(df).collect()) == [(5, 5), (5, 5), (7, 5), (9, 5)]


def test_a_join_with_a_hot_key(spark):
    left = spark.createDataFrame([(0, i) for i in range(3000)] + [(i, 0) for i in range(1, 50)] + [(None, 7)], "k int, v int")
    right = spark.createDataFrame([(i, str(i)) for i in range(40)], "k int, w string")
    got = sorted((r["k"], r["v"], r["w"]) for r in common.spread_join(left, right, "k", 3050).collect())
    assert got == sorted((r["k"], r["v"], r["w"]) for r in left.join(right, "k").select("k", "v", "w").collect())
    assert common.spread_join(left, right, "k", 3050, "left").count() == 3050
    left, right = (df.withColumn("k", F.col("k").cast("string").cast("binary")) for df in (left, right))
    assert common.spread_join(left, right, "k", 3050).count() == len(got)


def test_tidy_removes_checkpoints(spark):
    with common.tidy(spark):
        assert common.cut(spark.range(3)).count() == 3
        held = list(common._HELD[-1])
    assert len(held) == 1 and not os.path.exists(held[0].removeprefix("file:"))


def brute_html(rows):
    """Texts by sorting each host's pages and walking to the nearest page that holds another article."""
    keyed = []
    for page, url, html in rows:
        rest = re.sub(r"[?#].*$", "", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url or ""), flags=re.S)
        host, path = re.match(r"[^/]*", rest)[0].lower(), re.sub(r"^[^/]*", "", rest)
        keyed.append((host, path, page, op4_html.blocks(html)))
    out = {}
    for host in {k[0] for k in keyed}:
        line = [k for k in sorted(keyed, key=lambda k: k[:3]) if k[0] == host]
        for i, (_, _, page, mine) in enumerate(line):
            others = [k[3] for k in [*reversed(line[:i]), *line[i + 1 :]] if k[3] and op4_html.core(k[3]) != op4_html.core(mine)]
            before = [o for o in others if host and mine][:1]
            out[page] = op4_html.main_text(mine, before[0] if before else None)
    return out


def test_html_equals_brute_force(spark):
    rng = random.Random(12)
    line = lambda: f"<p>{rng.choice('abcdefghij') * 3}</p>"
    rows = [(i, rng.choice([None, "", f"https://{rng.choice('xy')}.org/{rng.choice(['d/', '', 'e/f/'])}{rng.randrange(30)}"]), rng.choice(["", "<main>", "<nav>n</nav>"]) + "".join(line() for _ in range(rng.randrange(5)))) for i in range(150)]
    got = {r["page_id"]: r["text"] for r in op4_html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)).collect()}
    assert got == brute_html(rows)


def test_html_blocks_of_odd_markup():
    text = lambda page: [t for t, _ in op4_html.blocks(page)]
    assert text('<article><p class="notice">ad<p>real text<p>more</article>') == ["real text", "more"]
    assert text('<ul><li class="ad">x<li>y</ul><dl><dt class="menu">a<dd>b</dl>') == ["y", "b"]
    assert text("<p>1 < 2 <b>&amp;</b> 3<!-- c --> <a href='x>y'>z</a>") == ["1 < 2 & 3 z"]
    assert text("<script>var x = '<p>';</script>t<textarea><p>u</textarea>") == ["t"]
    began = time.perf_counter()
    op4_html.blocks('<a href="x>' * 40_000)
    op4_html.blocks("<a b='" * 40_001)
    op4_html.blocks("<!-- " * 40_000)
    assert time.perf_counter() - began < 5


def test_differencing_of_many_lines_holds_rows_only():
    a, b = [str(i % 3000) for i in range(6000)], [str(i * 7 % 3000) for i in range(6000)]
    tracemalloc.start()
    op4_html.shared(a[:3000], b[:3000])
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_scorer_adds_up_words():
    w = np.random.default_rng(1).normal(size=(1 << 14) + 1)
    known = op6_quality._Weights(w)
    for t in ("", "One two, TWO x1", "a " * 50):
        words = t.split()
        want = sum(w[k] * x for k, x in op6_quality.features(t).items())
        assert abs(sum(map(known.__getitem__, words)) / max(1, len(words)) ** 0.5 - want) < 1e-9


def test_quality_equals_brute_force(spark, docs, rows):
    """Every vote by plain Python, the posterior of its pattern, the margin by summed features."""
    got = {r["doc_id"]: r for r in op6_quality.score(docs).collect()}
    share = lambda t, p: len(regex.findall(p, t)) / max(1, len(t))
    vote = lambda bad, good: "0" if bad else "1" if good else "2"
    patterns = {}
    for i, t in rows:
        t = t or ""
        n, k, lines = len(re.findall(r"[^ \t\n\x0b\f\r]+", t)), r"[#$%&*|<>{}\[\]=~^\\_@]", t.split("\n")
        d, m = len(set(lines)) / len(lines), len(t) / max(1, n)
        patterns[i] = "".join([
            vote(n < 20, n > 80), vote(share(t, k) > 0.02, share(t, k) < 0.002), vote(share(t, r"\p{Lu}") > 0.25, share(t, r"\p{Lu}") < 0.08),
            vote(share(t, "[.?!]") < 0.002, 0.004 <= share(t, "[.?!]") <= 0.05), vote(len(lines) > 3 and d < 0.7, d > 0.95), vote(m < 3 or m > 12, 4 <= m <= 8), vote(share(t, "!") > 0.01, share(t, "!") == 0),
        ])
    names, counts = np.unique(list(patterns.values()), return_counts=True)
    good, _ = op6_quality.expectation_maximisation(names.tolist(), counts.astype(float))
    of = dict(zip(names.tolist(), good.tolist(), strict=True))
    w = op6_quality.train([(f, y) for _, _, f, y in sorted((str(i), patterns[i], op6_quality.features(t or ""), of[patterns[i]]) for i, t in rows)])
    for i, t in rows:
        z = sum(w[k] * x for k, x in op6_quality.features(t or "").items()) + w[-1]
        assert abs(got[i]["weak"] - of[patterns[i]]) < 1e-9 and abs(got[i]["score"] - 1 / (1 + np.exp(-z))) < 1e-6


def test_toxicity_scores_equal_the_kernel_written_out():
    rows = [(f"calm text number {i} about trees rivers and stones", 0) for i in range(60)] + [(f"calm text number {i} you moronic idiot", 1) for i in range(60)]
    m = op8_toxicity.train(rows, 0.1)

    def margin(word):
        """Sum over all four-character subsequences within a span, gaps discounted, of the machine's weights."""
        total, norm = 0.0, 0.0
        for part in op8_toxicity._pieces(word):
            p = "\x02" + part
            for q in itertools.combinations(range(len(p)), 4):
                if q[3] - q[0] < op8_toxicity.SPREAD:
                    x = op8_toxicity.DECAY ** (q[3] - q[0] - 3)
                    total, norm = total + x * m.weights[hashed("".join(p[i] for i in q))], norm + x * x
        return total / max(norm**0.5, 1e-9) + m.bias

    def hashed(four):
        code = [0 if c == "\x02" else ord(c) - 96 if "a" <= c <= "z" else 27 if "0" <= c <= "9" else 28 + (ord(c) * 0x9E3779B1 >> 7) % 100 for c in four]
        key = code[0] << 21 | code[1] << 14 | code[2] << 7 | code[3]
        return (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - op8_toxicity._BITS)

    for w in ("idiot", "i.d.i.o.t", "naïve7", "ab", "идиот", "x" * 45):
        assert abs(m.margins([w])[0] - margin(w)) < 1e-9
    one, two = op8_toxicity.dense(["идиот", "рмхфц"])
    assert one @ two < 0.05


def test_toxicity_of_an_empty_table(spark, nothing):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert op8_toxicity.digest(nothing, labels).count() == 0 and op8_toxicity.remove_toxic(nothing, labels).count() == 0


def test_columns_of_any_name_pass_through(spark):
    names = ["_score", "_m", "_kept", "_n_removed", "_gone", "key", "n", "c0", "score", "text", "doc_id"]
    df = spark.createDataFrame([(*range(9), "some text here", 1), (*range(9), None, None)], ", ".join(f"`{n}` {'string' if n == 'text' else 'bigint'}" for n in names))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "other words")], "item_id bigint, text string")
    for out in (op8_toxicity.remove_toxic(df, labels), op7_minhash.keep_one(df), op10_decontaminate.remove_contaminated(df, bench)):
        assert out.columns == names and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert op2_suffix_dedup.remove_repeats(df).count() == 2


def test_language_equals_brute_force(spark):
    """Posteriors by plain loops over pages, from the same trigram table."""
    docs = spark.createDataFrame([(i, f"the cat and the dog number {i} of them", "en") for i in range(20)] + [(100 + i, f"die katze und der hund nummer {i} von denen", "de") for i in range(20)], "doc_id bigint, text string, lang string")
    rows = [(1, "http://a.de/x", "<html lang=en><p>the cat and the dog</p>"), (2, "http://a.de/y", "<p>die katze</p>"), (3, None, None), (4, "http://b.a.de/en/x", ""), (4, "http://b.a.de/en/x", ""), (5, "http://c.org", "<p>und der hund</p>")]
    langs, table = op5_language.fit(docs)
    assert langs == ["de", "en"]

    def told(lang, trust):
        return np.array([np.log(trust) if x == lang else np.log(1 - trust) for x in langs]) if lang in langs else np.zeros(2)

    soft = lambda e: np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    seen = []
    for page, url, html in rows:
        rest = re.sub(r"^\w+://", "", url or "")
        host, first = re.match(r"[^/]*", rest)[0], (re.match(r"[^/]*/([a-z]{2})/", rest) or ["", ""])[1]
        g = op5_language._grams(" ".join(t for t, _ in op4_html.blocks(html)))
        e = table[g].sum(0) * op5_language.TEMPER * min(1.0, op5_language.MOST_GRAMS / max(1, len(g)))
        lang = re.search(r"lang=(\w\w)", html or "")
        e = e + told(lang and lang[1], op5_language.DECLARED) + told(first if first in langs else host.rpartition(".")[2], op5_language.ADDRESS)
        seen.append((page, host, ".".join(host.split(".")[-2:]) if "." in host else "", e))
    whole = (sum(soft(e) for *_, e in seen) + 1) / (len(seen) + 2)
    want = []
    for page, host, domain, e in seen:
        d = [soft(x) for _, _, y, x in seen if y == domain]
        h = [soft(x) for _, y, _, x in seen if y == host]
        dom = (sum(d) + op5_language.ALL_PAGES * whole) / (len(d) + op5_language.ALL_PAGES)
        prior = (sum(h) + op5_language.DOMAIN_PAGES * dom) / (len(h) + op5_language.DOMAIN_PAGES)
        p = soft(e + np.log(prior))
        want.append((page, langs[int(p.argmax())], round(float(p.max()), 5)))
    got = op5_language.identify(spark.createDataFrame(rows, "page_id bigint, url string, html string"), docs)
    assert sorted((r["page_id"], r["lang"], round(r["posterior"], 5)) for r in got.collect()) == sorted(want)
