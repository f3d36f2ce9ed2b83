"""Places of a vocabulary against alternatives in regular expressions, in one block and in many."""

import random
import re
import time

import pytest
import regex
from pyspark.sql import functions as F

from sparkloom.operators import vocabulary as v

CITIES = ["אשדוד", "כנות", "קרית גת", "רחובות", "תל אביב", "תל אביב-יפו", "מלאה", "משמרות", "אזור", "מצליח", "עכו", "גת", "קרית גת דרום", "לוד"]
REGIONS = ["צפון", "דרום", "רמת הגולן", "השרון", "גוש דן"]
GOLDEN = [
    ("מחסנאי/ת לנמל אשדוד דרוש/ה מחסנאי/ת!", "אשדוד"), ("דרוש/ה נהג/ת חלוקה 12 טון למושב כנות חברת ישרקו", "כנות"), ("דרוש/ה מפעיל/ת CNC למפעל מצליח ברמת הגולן!!", "רמת הגולן"),
    ("דרוש/ה עובד/ת למפעל גדול בקרית גת", "קרית גת"), ("דרוש/ה עובד/ת למשרה מלאה בתנאים טובים", None), ("העבודה במשמרות בוקר וערב", None), ("", None), (None, None),
    ('לארגון בצפון ת"א דרוש\\ה מהנדס\\ת מכונות', "תל אביב-יפו"), ("דרוש/ה עובד/ת לחברה בדרום תל אביב", "תל אביב"), ("המשרה בצפון הארץ, נדרשת ניידות", "צפון"), ('דרוש/ה מנהל/ת חשבונות בת"א', "תל אביב-יפו"),
    ("דרוש/ה מלצר/ית בב״ש למשמרות ערב", "באר שבע"), ('לבסיס של צה"ל באזור צומת שוקת דרוש/ה טכנאי/ת', None), ("לחברה מובילה ברחובות דרוש/ה מבקר/ת טיב", "רחובות"), ("📍 פארק המדע רחובות", "רחובות"), ("עבודה באזור תעשיה עכו", "עכו"),
]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(n, "city") for n in CITIES] + [(n, "region") for n in REGIONS] + [("", "city"), ("לוד", "city"), (None, None)], "name string, kind string")


@pytest.mark.parametrize("letters", [10**6, 12])
def test_prose(spark, names, letters, monkeypatch):
    monkeypatch.setattr(v, "BLOCK_LETTERS", letters)
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(GOLDEN)], "i int, t string, _other string")
    out = v.from_prose(df, "t", names)
    assert out.columns == ["i", "t", "_other", "place"]
    assert [r["place"] for r in out.orderBy("i").collect()] == [p for _, p in GOLDEN]


def patterns():
    alt = lambda ns: "|".join(map(re.escape, sorted(ns, key=lambda n: -len(n))))
    city, area = ([n for n in ns if n not in v.NEVER] for ns in (CITIES, REGIONS))
    sure = lambda ns: alt([n for n in ns if len(n) >= 4 and n not in v.NOT_BARE])
    short = "|".join(re.escape(s).replace('"', '["״]') for s in v.SHORT)
    b, a = f"(?<!{v.HEBREW})", f"(?!{v.HEBREW})"
    return [rf"(?:ל?אזור|בעיר)\s+({alt(area)}){a}", rf"(?:ל?אזור|בעיר|במשרדי?(?:\s+ה[A-Za-z0-9_]+)?\s+ב)\s*({alt(city)}){a}", rf"{v.CUE}[\s\S]{{0,30}}?{b}({alt(city)}){a}", rf"{b}ב{v.DIRECTION}\s+({short}|{alt(city)}){a}", rf"{b}ב({short})", rf"{b}ב({sure(city)}){a}", rf"{b}ב({sure(area)}){a}", rf"{b}ל[א-ת]{{2,}}\s+({sure(city)}){a}"]


def test_prose_equals_alternatives():
    rng, found = random.Random(6), 0
    bits = [*CITIES, *REGIONS, *v.SHORT, "ב", "ל", "ה", "ו", " ", " ", " ", "לאזור ", "בעיר ", "📍", "מיקום", "סניף", "צפון ", "ת״א", "במשרדי ב", "xyz ", "לנמל ", "!", "\n"]
    ways = [regex.compile(p) for p in patterns()]
    prose = v.Prose(CITIES, REGIONS)
    for _ in range(5000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        m = next((m for w in ways if (m := w.search(t))), None)
        want = m and v.SHORT.get(m[1].replace("״", '"'), m[1])
        got = prose.find(t)
        assert (got[0]["name"] if got else None) == want, t
        found += bool(want)
    assert found > 500


@pytest.mark.parametrize("letters", [10**6, 15])
def test_scan(spark, names, letters, monkeypatch):
    monkeypatch.setattr(v, "BLOCK_LETTERS", letters)
    rng = random.Random(8)
    bits = [*CITIES, *REGIONS, "ו", "ה", " ", " ", ", ", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(400)] + ["קרית גת דרום וחיפה ולוד", None, ""]
    every = re.compile(rf"(?:(?<!{v.HEBREW})|(?<=(?<!{v.HEBREW})ו))(?:{'|'.join(map(re.escape, sorted({*CITIES, *REGIONS}, key=lambda n: -len(n))))})(?!{v.HEBREW})")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r["i"]: r["places"] for r in v.scan(df, "t", names).collect()}
    assert got == {i: list(dict.fromkeys(every.findall(t or ""))) for i, t in enumerate(texts)}


def test_a_large_vocabulary_takes_time_in_proportion_to_the_text(spark):
    """10,000 names cost a text no more than ten times what ten names do."""
    rng = random.Random(1)
    many = ["".join(rng.choice("אבגדהוזחטיכלמנסעפצקרשת") for _ in range(rng.randrange(4, 9))) for _ in range(10_000)]
    text = " ".join("".join(rng.choice("אבגדהוזחטיכלמנסעפצקרשת") for _ in range(5)) for _ in range(30_000))

    def seconds(names):
        find = v._hits(v.Trie(names), re.compile(v.HEBREW), re.compile(f"{v.HEBREW}$"))
        began = time.perf_counter()
        find(text)
        return time.perf_counter() - began

    assert seconds(many) < 10 * seconds(many[:10]) + 0.5
    vocabulary = spark.createDataFrame([(n,) for n in many], "name string")
    found = v.scan(spark.range(1).withColumn("t", F.lit(f"{many[0]} {many[1]}")), "t", vocabulary).first()["places"]
    assert found == [many[0], many[1]]
