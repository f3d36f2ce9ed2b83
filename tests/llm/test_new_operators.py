"""Collocations, secret scans and the fill-in-middle transformation against brute force, with odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import op11_collocations as op11
from sparkloom.llm import op12_secrets as op12
from sparkloom.llm import op13_fill_in_middle as op13

DOC = "doc_id bigint, text string, lang string"


def made(rng, n):
    """Prose of few words with cuts, tabs, capitals, letters beyond ASCII and now and then a fixed phrase."""
    words = ["Of", "the", "New", "york", "über", "a", "tokens", "x y", "ſ"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "; New York Times "]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(i, made(rng, rng.randrange(1, 60)), rng.choice(["en", "en", None, "und", "fr"])) for i in range(120)]
    out += [(200, None, "en"), (201, "", None), (202, " \t ", "en"), (203, "... !\n", "en"), (204, made(rng, 20000), "en"), (204, "one", "en"), (204, "one", "en"), (None, "New York Times", None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("longest, least", [(2, 1), (3, 10), (5, 4)])
def test_collocations(docs, rows, nothing, longest, least):
    got = sorted(tuple(r) for r in op11.collocations(docs, longest=longest, least=least, top=300).collect())
    assert got == sorted(op11.brute([(r[2], r[1]) for r in rows], longest, least, top=300)) and len(got) > 30
    assert op11.collocations(nothing).collect() == []


def test_collocations_of_many_chunks(docs, rows, spark, monkeypatch):
    """Small chunks, ties of score and count at the limit, and clashing columns."""
    monkeypatch.setattr(op11, "CHUNK_BYTES", 200)
    got = op11.collocations(docs.withColumn("chunk", F.lit(1)).withColumn("n", F.lit("x")).withColumn("left", F.lit(None)), least=2, top=7)
    assert sorted(tuple(r) for r in got.collect()) == sorted(op11.brute([(r[2], r[1]) for r in rows], least=2, top=7))


def test_large_counts_are_exact(spark):
    big = 10**15 - 7
    df = spark.createDataFrame([(big, [big + 3], [big + 11])], "f bigint, heads array<bigint>, tails array<bigint>")
    assert df.select(op11.worst_cut(2)["score"]).first()[0] == 1_000_000 * big * big // ((big + 3) * (big + 11))


SECRETS = [
    "password=hunter22", "PASSWORD : 'hunter22'", "passwd\":  \"abc\"", "secret=token: abcdefgh", "api_key=abcdef apikey:abcdefg API_KEY := abcdef", "token==abcde",
    "AKIA" + "A" * 15, "AKIA" + "A" * 16, "éAKIAAKIA" + "B2" * 8, "deadbeef" * 3, "deadbeef" * 2 + "DEADBEEF", "ghp_" + "a1" * 18, "xoxb-" + "1" * 12, "AIza" + "x" * 35, "sk_live_" + "q" * 16,
    "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "Authorization: BEARER " + "z" * 20, "see https://me:pw@host/", "paſſword=hunter22 toKen=hunter22",
    "toke", "n=abcdefgh", "tokén=abcdefgh", "secret" + " " * 50 + "=" + " " * 50 + "abcdef",
]


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(12)
    out = [(i, s) for i, s in enumerate(SECRETS)]
    for i in range(60):
        out.append((100 + i, "".join(rng.choice([*SECRETS, " ", "é", "\n", "word ", "'"]) for _ in range(rng.randrange(12)))))
    out += [(300, None), (301, ""), (302, "x" * 300_000 + " token=abcdefg " + "€" * 100_000 + "0123456789abcdef" * 4), (1, "password=hunter22"), (1, "password=hunter22"), (None, "AKIA" + "Z" * 20)]
    return out


def test_secrets(spark, leaks, monkeypatch):
    df = spark.createDataFrame(leaks, "doc_id bigint, text string").repartition(3)
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(op12.brute(leaks), key=order)
    assert sorted((tuple(r) for r in op12.digest(op12.scan(df)).collect()), key=order) == want
    monkeypatch.setattr(op12, "SHARD_BYTES", 100)
    monkeypatch.setattr(op12, "STEP", 64)
    found = op12.scan(df.withColumn("spans", F.lit(3)).withColumn("_spans", F.lit(1)))
    assert found.columns == ["doc_id", "text", "_spans", "spans"]
    assert sorted((tuple(r) for r in op12.digest(found).collect()), key=order) == want
    assert op12.digest(op12.scan(df.limit(0))).collect() == []


def test_every_kind_of_secret_is_found(leaks):
    assert {s.split(":")[0] for r in op12.brute(leaks) for s in r[-1].split(",") if s} == {r.kind for r in op12.RULES}


def fits(query, text: bytes) -> bool:
    if query is True:
        return True
    if isinstance(query, bytes):
        return query in text.lower()
    return (all if query[0] == "and" else any)(fits(q, text) for q in query[1])


MATCHED = {
    r"abc": ["abc"], r"ab?c": ["abc", "ac"], r"(abc|de)f": ["abcf", "def"], r"(?:ab){2,}c": ["ababc", "abababababc"], r"a[bc]d[e-g]h": ["abdeh", "acdgh"], r"x*abc+d": ["abcd", "xxabcccd"],
    r"(foo|ba[rz])+qux": ["fooqux", "barbazqux", "bazfoofooqux"], r"^abc$": ["abc"], r"a.c.def": ["axcxdef", "aéc def"], r"(ab|cd)(ef|gh)(ij|kl)": ["abefij", "cdghkl", "abghij"], r"[^a]bcd": ["zbcd", "ébcd"],
    r"(?=abc)abcd": ["abcd"], r"é?abcé": ["abcé", "éabcé"], r"a{3}b{2,4}c": ["aaabbc", "aaabbbbc"], r"(|abc)def": ["def", "abcdef"], r"((a|b)(c|d)|ef)gh": ["acgh", "efgh"], r"(abc)*": ["", "x"],
    r"abc(de)?f(gh){0,2}ij": ["abcfij", "abcdefghghij"], r"[a-z]+_key": ["a_key", "zz_key"], r"\babc\b": ["abc"], r"(a|b|c|d)(a|b|c|d)(a|b|c|d)(a|b|c|d)x": ["abcdx", "ddddx"], r"abc|": ["", "zz"], r"(?>ab|a)cde": ["abcde", "acde"],
    r"(a)\1bcd": ["aabcd"], r"ABC\dDEF": ["ABC1DEF"], r"a{2}b{3}": ["aabbb"], r"(ab){5}": ["ababababab"], r"(abcd|efgh)?ijk": ["ijk", "efghijk"], r"(?i:abc)d": ["ABCd"], r"[ab][ab][ab][ab][ab][ab][ab]c": ["abababac"],
}


@pytest.mark.parametrize("pattern", MATCHED)
def test_queries_let_every_match_through(pattern):
    """Whatever matches an expression answers its query."""
    query = op12.query_of(op12.Rule("k", pattern))
    for text in MATCHED[pattern]:
        assert re.search(pattern, text, re.ASCII) and fits(query, f"{text}".encode())


def test_queries_are_selective():
    ask = lambda p: op12.query_of(op12.Rule("k", p))
    assert ask(r"abc") == b"abc" and ask(r"a.*") is True and ask(r"[0-9a-f]{24,}") is True
    assert ask(r"(abc|def)") == ("or", frozenset([b"abc", b"def"]))
    assert ask(r"ABC\d+def") == ("and", frozenset([b"abc", b"def"]))
    assert all(op12.query_of(r) is not True for r in op12.RULES if r.kind != "hex")


def test_fill_in_middle(spark, rows, nothing):
    rng = random.Random(13)
    some = [(i, t) for i, t, _ in rows if i is not None] + [(400, "a <P> b"), (401, "<"), (402, " lead and trail \x0b"), (403, "\x1c a b"), *((500 + i, "".join(rng.choice("<PSM> \né") for _ in range(9))) for i in range(300))]
    df = spark.createDataFrame(some, "doc_id bigint, text string").repartition(3)
    out = op13.transform(df.withColumn("output", F.lit(1)).withColumn("_n", F.lit(2)))
    assert out.columns == ["doc_id", "text", "_n", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect())
    assert got == sorted(op13.brute(some), key=lambda r: tuple(-1 if x is None else x for x in r)) or sorted(map(str, got)) == sorted(map(str, op13.brute(some)))
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    same = out.select(F.coalesce("text", F.lit("")).alias("t"), op13.restored().alias("r"))
    assert same.where("not (t <=> r)").count() == 0
    assert op13.digest(op13.transform(nothing)).collect() == []


def test_fill_in_middle_of_a_null_id(spark):
    df = spark.createDataFrame([(None, "a b c d")] * 2, "doc_id bigint, text string")
    assert op13.transform(df).distinct().count() == 1


def test_fill_in_middle_holds_no_units():
    """Beside the text no memory grows with its units."""
    import tracemalloc

    text = "a " * 500_000
    tracemalloc.start()
    op13.ends(text, 200_000, 400_000)
    op13.count(text)
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()
