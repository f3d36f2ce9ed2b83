"""Bounded merges, capture, batches, near names and methods against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import merging
from sparkloom.operators.policy import SEVERITY
from sparkloom.sources import batches


def test_merge_of_a_hot_key(spark):
    """A third of all rows on one key; null, empty and repeated terms, snippets and addresses."""
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        some = lambda p, most: rng.choice([None, []]) if rng.random() < 0.1 else [rng.choice([None, f"{p}{rng.randrange(60)}"]) for _ in range(rng.randrange(most))]
        rows.append(("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i * 7 % 3000, rng.choice([*SEVERITY[:5], None]), rng.choice([None, rng.randrange(100)]), some("t", 4), some("s", 3), some("u", 3)))
    rows.append(("none", 1, None, None, None, None, None))
    df = spark.createDataFrame(rows, "key string, place int, status string, confidence int, terms array<string>, snippets array<string>, urls array<string>").repartition(6)
    got = {r["key"]: r for r in merging.merge_results(df, "key", "place", "status", "confidence", "terms", "snippets", "urls").collect()}
    assert len(got) == len({r[0] for r in rows})
    for key, out in got.items():
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        ranks = [SEVERITY.index(r[2]) if r[2] else -1 for r in own]
        assert out["best"] == own[ranks.index(max(ranks))][1] and out["status"] == (SEVERITY[max(ranks)] if max(ranks) >= 0 else out["status"])
        terms = list(dict.fromkeys(t for r in own for t in r[4] or [] if t))
        assert out["terms"] == terms[:20] and out["snippets"] == [s for r in own for s in r[5] or [] if s][:5]
        assert out["n_urls"] == len({u for r in own for u in r[6] or [] if u})
        said = [r[3] for r in own if r[3] is not None]
        assert out["confidence"] == (int(sum(said) / len(said) + 0.5) if said else None)
    assert merging.merge_results(df.limit(0), "key", "place", "status", "confidence", "terms", "snippets", "urls").count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_merged_means_of_a_half_go_up_in_any_order(spark, parts):
    """The mean is 53.5; the doubles, added in this order, fall short of it."""
    cents = [597, 9921, 355, 3189, 3031, 11766, 2030, 7852, 3451, 11914, 13120, 1001, 11131, 374, 518]
    df = spark.createDataFrame([("k", i, SEVERITY[0], c / 100, [], [], []) for i, c in enumerate(cents)], "key string, place int, status string, confidence double, terms array<string>, snippets array<string>, urls array<string>").coalesce(1)
    df = df if parts == 1 else df.repartition(parts)
    assert merging.merge_results(df, "key", "place", "status", "confidence", "terms", "snippets", "urls").first().confidence == 54


def test_one_edit_apart(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(6))) for _ in range(150)})

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    df = spark.createDataFrame([(w,) for w in [*words, *words[:9], None]], "a string")
    got = sorted((r["a"], r["b"]) for r in merging.one_edit_apart(df, df.toDF("b"), "a", "b").collect())
    assert got == sorted((a, b) for a in words for b in words if apart(a, b)) and len(got) > 200


def test_captured(spark):
    rows = [(1, i, 200, "application/json", f"https://a/{i}", '{"a": 1}') for i in range(60)] + [(2, 0, 404, "application/json", "u", "{}"), (2, 1, 200, "text/html", "u", "{}"), (2, 2, 204, "text/plain; x", "u", "[1]"), (2, 3, 200, "application/json", "https://cdn.x/a", "{}"), (2, 4, 200, "application/json", "a.PNG?x", "{}"), (2, 5, 200, "application/json", "u", "no json"), (2, 6, 200, "application/json", "u", '"' + "x" * 600_000 + '"'), (2, 7, None, None, None, None), (None, 8, 200, "application/json", "u", "{}")]
    df = spark.createDataFrame(rows, "page int, i int, status int, kind string, url string, body string")
    got = sorted((r["page"] or 0, r["i"], r["admitted"]) for r in batches.captured(df, "page", [F.col("i")], "status", "kind", "url", "body").collect())
    assert got == [(0, 8, 1)] + [(1, i, i + 1) for i in range(50)] + [(2, 2, 1)]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_batches_resume(spark, tmp_path, size):
    """Stopped after each batch and in the middle of one; repeated and null keys; nothing twice, nothing left out."""
    keys = [None, None, *range(20), 5, 5, 5, -3, 10**12]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k bigint, i int").repartition(3)
    done = []

    def work(df):
        if len(done) == 2:
            done.append(0)
            raise RuntimeError("stopped")
        done.append(df.count())
        return df

    folder = str(tmp_path / "b")
    for _ in range(60):
        try:
            out = batches.scanned(spark, rows, "k", size, work, folder, most=1 if size == 1 else None)
        except RuntimeError:
            continue
        if out.count() == len(keys):
            break
    assert sorted(r["i"] for r in out.collect()) == list(range(len(keys))) and sum(done) == len(keys)
    more = rows.union(spark.createDataFrame([(10**13, 99)], "k bigint, i int"))
    assert batches.scanned(spark, more, "k", size, lambda df: df, folder).count() == len(keys) + 1


def test_a_failing_method_leaves_the_others(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, html string")

    def good(df):
        return df.where("k = 1").select("k", F.lit(0.5).alias("confidence"), F.create_map(F.lit("title"), F.lit("h1")).alias("fields"))

    def bad_plan(df):
        return df.select("missing")

    def bad_task(df):
        return df.select("k", F.raise_error(F.lit("boom")).cast("double").alias("confidence"), F.create_map(F.lit("a"), F.lit("b")).alias("fields"))

    out = merging.analysed(pages, "k", {"good": good, "plan": bad_plan, "task": bad_task}, str(tmp_path))
    got = {(r["k"], r["method"]): r for r in out.collect()}
    assert len(got) == 6 and got[1, "good"]["found"] and got[1, "good"]["fields"] == {"title": "h1"} and not got[2, "good"]["found"] and got[2, "good"]["error"] is None
    assert all(got[k, m]["confidence"] == 0 and got[k, m]["fields"] == {} and got[k, m]["error"] for k in (1, 2) for m in ("plan", "task"))


def test_one_edit_apart_of_repeated_rows(spark):
    """Pairs of rows are counted, each pair of texts comes once; the plan sends no side whole to each task, however small the table is thought to be."""
    a = spark.createDataFrame([("ab",), ("ab",), ("a",), ("",), (None,), ("xab",)], "a string")
    b = spark.createDataFrame([("ac",), ("ac",), ("ac",), ("b",), ("aa",), ("ab",), (None,), ("a",)], "b string")
    pairs = merging.one_edit_apart(a, b, "a", "b", "n")
    got = sorted(tuple(r) for r in pairs.collect())
    assert got == [("", "a", 1), ("", "b", 1), ("a", "aa", 1), ("a", "ab", 1), ("a", "ac", 3), ("a", "b", 1), ("ab", "a", 2), ("ab", "aa", 2), ("ab", "ac", 6), ("ab", "b", 2), ("xab", "ab", 1)]
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_near_names_of_repeated_customers(spark, tmp_path):
    from sparkloom.plans import merging_catalog

    spark.createDataFrame([("C1",), ("C1",), ("C2",), ("C3",), ("D",)], "c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["name"]: r.near for r in merging_catalog.QUERIES["near_names"](spark, str(tmp_path)).collect()}
    assert got == {"C1": 4, "C2": 3, "C3": 3}
