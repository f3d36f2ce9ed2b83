"""Dates kept as text: parsing, age buckets, cutoffs. The reference day is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, present

# Months, shapes of dates and labels of a date of publication.
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_NAMES = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"


def parse(c: Column | str) -> Column:
    """ISO, day-month-year or English month; a day past the month's end rolls over, as a year under 50 is of this century."""
    return let(F.trim(col(c)), _parse)


def _parse(s: Column) -> Column:
    whole = lambda pattern, i: F.regexp_extract(s, pattern, i).try_cast("int")
    iso, dmy, eng = r"^(\d{4})-(\d{2})-(\d{2})", r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})$", rf"(?i)^({_NAMES})\s+(\d{{1,2}}),?\s+(\d{{4}})$"
    short = whole(dmy, 3)
    year = F.when(short < 50, short + 2000).when(short < 100, short + 1900).otherwise(short)
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.substring(F.regexp_extract(s, eng, 1), 1, 3))).cast("int")

    def day(y: Column, m: Column, d: Column) -> Column:
        good = m.between(1, 12) & d.between(1, 31)
        return F.when(good, F.date_add(F.make_date(F.when(good, y), F.when(good, m), F.lit(1)), d - 1))

    return F.when(s.rlike(iso), day(whole(iso, 1), whole(iso, 2), whole(iso, 3))).when(s.rlike(dmy), day(year, whole(dmy, 2), whole(dmy, 1))).when(s.rlike(eng), day(whole(eng, 3), month, whole(eng, 2)))


def age_bucket(day: Column, as_of: Column) -> Column:
    """fresh under 90 days or in the future, d90, d180, d365; null without a day."""
    n = F.datediff(as_of, day)
    return F.when(n < 90, "fresh").when(n < 180, "d90").when(n < 365, "d180").when(n.isNotNull(), "d365")


def before_cutoff(day: Column, least: Column) -> Column:
    """Whether a day is before the cutoff; without a day it isn't."""
    return F.coalesce(day < least, F.lit(False))


def cutoff(absolute: Column, days: Column, as_of: Column) -> Column:
    """An ISO day as given, else as_of less a number of days of one at least, else null."""
    fixed = F.when(absolute.rlike(r"^\d{4}-\d{2}-\d{2}$"), absolute.try_cast("date"))
    return F.coalesce(fixed, F.when(days >= 1, F.date_sub(as_of, F.floor(days).cast("int"))))


def published(c: Column | str) -> Column:
    """The date text after a publication label."""
    label = r"(?:פורסם(?:\s+בתאריך)?|תאריך\s+פרסום|Posted(?:\s+on)?|Published(?:\s+on)?|Date\s+Posted|Publish\s+Date)"
    value = rf"(?:\d{{1,2}}[/.\-]\d{{1,2}}[/.\-]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|(?:{_NAMES})\s+\d{{1,2}},?\s+\d{{4}})"
    return present(F.regexp_extract(col(c), rf"(?iu)(?:^|[\s|.(]){label}\s*[:\-–]?\s*({value})", 1))
