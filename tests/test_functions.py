"""Golden values of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import dates, ids, text, urls
from sparkloom.operators.places import Gazetteer, one_edit


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_dates(spark):
    rows = ["31.07.2026", "15/01/2026", "2026-01-01", "Jan 15, 2026", "31/02/2026", "1/2/49", "1/2/50", "", "3 days ago", "not a date", "2026-13-01", None]
    d = dt.date
    assert values(spark, dates.parse("x"), rows) == [d(2026, 7, 31), d(2026, 1, 15), d(2026, 1, 1), d(2026, 1, 15), d(2026, 3, 3), d(2049, 2, 1), d(1950, 2, 1), None, None, None, None, None]


def test_age_buckets(spark):
    rows = ["2026-03-20", "2026-06-17", "2026-07-01", "2026-03-19", "2025-12-20", "2025-12-19", "2025-06-18", "2025-06-17", "", None]
    got = values(spark, dates.age_bucket(dates.parse("x"), F.lit("2026-06-17").cast("date")), rows)
    assert got == ["fresh", "fresh", "fresh", "d90", "d90", "d180", "d180", "d365", None, None]


def test_cutoff_keeps_what_has_no_date(spark):
    got = values(spark, dates.before_cutoff(dates.parse("x"), F.lit("2026-01-01").cast("date")), ["31.07.2026", "03.06.2021", ""])
    assert got == [False, True, False]


def test_job_codes(spark):
    rows = ["Analyst - (JB-3138)", "Role [AB-1234]", "Role (REQ_99)", "Senior Dev (jb-2683)", "Founded (2024)", "Part time (50%)", "5+ years experience", "", "Reference (JR-7788). Apply now."]
    assert values(spark, text.job_code("x"), rows) == ["JB-3138", "AB-1234", "REQ-99", "JB-2683", None, None, None, None, "JR-7788"]


def test_clean_id_is_idempotent(spark):
    once = values(spark, text.clean_id("x"), ["JB-1234 גודל הקובץ עד: 1MB", "#769,", "REQ-2024-00123", "none here", ""])
    assert once == ["JB-1234", "769", "REQ-2024-00123", None, None]
    assert values(spark, text.clean_id("x"), once[:3]) == once[:3]


def test_white_space_of_unicode(spark):
    rows = ["a  b \n c", "  x  ", None]
    got = values(spark, text.one_line("x"), rows)
    assert got == ["a b c", "x", ""]
    assert values(spark, text.one_line("x"), got) == got
    assert values(spark, text.many_lines("x"), ["a \r\n\n\n\n b\t c "]) == ["a\n\nb c"]


def test_hash_matches_an_independent_computation(spark):
    def expect(s):
        h = 5381
        for u in memoryview(s.encode("utf-16-le")).cast("H"):
            h = ((h * 33) & 0xFFFFFFFF) ^ u
        digits, out = "0123456789abcdefghijklmnopqrstuvwxyz", ""
        while h:
            h, r = divmod(h, 36)
            out = digits[r] + out
        return out or "0"

    rows = ["אבc", "a", "title|dept", "📩"]
    assert values(spark, ids.hash36("x"), rows) == [expect(r) for r in rows]


def test_language_and_terms(spark):
    assert values(spark, text.language("x"), ["שלום עולם", "hello", "שלום hello", "123", None])[:4] == ["he", "en", "mixed", "other"]
    assert values(spark, text.terms("x"), ["No web scraping, robots"])[0] == ["robots", "web scraping", "scraping"]


def test_structure(spark):
    blob = "תיאור המשרה: " + " ".join(f"• פריט מספר {i} עם טקסט ארוך מספיק לשורה" for i in range(7))
    got = values(spark, text.structure("x"), [blob, "short", "a\nb" * 100, None, "• א " * 60])
    assert got[0].count("\n") >= 6 and "•" not in got[0]
    assert got[1:] == ["short", "a\nb" * 100, "", "• א " * 60]


def test_sentences_once(spark):
    assert values(spark, text.dedup_sentences("x"), ["One sentence here. ONE sentence here. No. No. Other one is here"]) == ["One sentence here. No. No. Other one is here"]


def test_chunks(spark):
    (got,) = values(spark, text.chunks("x", 10, 2), ["abcdefghijklmnopqrst"])
    assert got == ["abcdefghij", "ijklmnopqr", "qrst"]


def test_css_and_contact(spark):
    assert values(spark, text.looks_like_css("x"), [".a { color: red } .b { x: y }", "plain prose of some length here", None]) == [True, False, False]
    assert values(spark, text.contact("x"), ["mail me@x.co.il or 050-123-4567", "call 03-123-4567", "none"]) == ["me@x.co.il", "03-123-4567", None]


def test_labelled(spark):
    rows = ["ניסיון בניהול מחלקה - חובה\nיחסי אנוש", "מחלקה: בקרת איכות\nדרישות: ניסיון", "• אגף: משאבי אנוש\n• ניסיון קודם"]
    assert values(spark, text.labelled("x", "department", True, 60), rows) == [None, "בקרת איכות", "משאבי אנוש"]


def test_urls(spark):
    rows = ["Example.COM/a/ ", "https://X.com/A//?q=1#f", ""]
    assert values(spark, urls.normal("x"), rows) == ["https://example.com/a", "https://x.com/A?q=1#f", ""]
    assert values(spark, urls.key("x"), rows[:2]) == ["example.com/a", "x.com/a?q=1"]
    assert values(spark, urls.pattern("x"), ["https://x.com/jobs/123/deadbeef1"]) == ["x.com/jobs/*/*"]


@pytest.mark.parametrize(("raw", "expected"), [("תל אביב-יפו, ירושלים", ["תל אביב-יפו", "ירושלים"]), ('ת"א, ירושלים', ["תל אביב-יפו", "ירושלים"]), ('כרמיאל, עפולה, גלילות, ב"ש', ["כרמיאל", "עפולה", "גלילות", "באר שבע"]), ("חיפה, חיפה", ["חיפה"]), ("חיפה,", ["חיפה"]), ("הגליל", None), ("  ", None), ("Unknown", [])])
def test_strict_places(raw, expected):
    assert Gazetteer().strict(raw) == expected


def test_places():
    g = Gazetteer()
    assert g.scan("חיפה חדרה והצפון") == ["חיפה", "חדרה", "אזור צפון"]
    assert g.normalise("Tel Aviv, Israel") == ["תל אביב-יפו"]
    assert g.normalise("אשקלוון") == ["אשקלון"] and g.normalise("nowhere") == ["nowhere"] and g.normalise(None) == []
    assert [one_edit(a, b) for a, b in (("ab", "ab"), ("ab", "abc"), ("ab", "ac"), ("ab", "ba"), ("abc", "ac"))] == [False, True, True, False, True]
