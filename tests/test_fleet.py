"""Places in prose, settings, addresses and verdicts: golden values."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import urls
from sparkloom.operators import config, fleet, places


@pytest.mark.parametrize(
    ("prose", "place"),
    [
        ("דרוש עובד לאזור השרון למשרה", "אזור השרון"), ("משרה בעיר חיפה", "חיפה"), ("סניף: קניון גדול רחובות", "רחובות"), ('עבודה בצפון ת"א', "תל אביב-יפו"), ('בב"ש דרוש טבח', "באר שבע"),
        ("דרושים בנתניה עובדים", "נתניה"), ("מפעל ברמת הגולן", "רמת הגולן"), ("לנמל אשדוד דרוש", "אשדוד"), ("למשרה מלאה דרוש", None), ("no place", None), ("", None), (None, None), ("שבנתניהו", None),
    ],
)
def test_places_in_prose(spark, prose, place):
    assert spark.createDataFrame([(prose,)], "t string").select(places.from_prose("t")).first()[0] == place


def test_pages_of_a_listing(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(urls.with_parameter(F.lit("https://a.com/x?p=1&q=2#f"), "p", F.lit(3))) == "https://a.com/x?q=2&p=3#f"
    assert one(urls.without_parameter(F.lit("https://a.com/x?p=1"), "p")) == "https://a.com/x"
    assert not one(urls.same_host(F.lit("https://a.com.evil/x"), F.lit("https://a.com/")))


def test_settings_of_broken_json(spark):
    rows = spark.createDataFrame([(x,) for x in ("{", None, "[]", '{"a": 1}')], "r string")
    got = rows.select(config.mappings(F.col("r")).alias("m"), config.pagination(F.col("r")).alias("p"), config.reply(F.col("r")).alias("y"), config.form_fields(F.col("r")).alias("n")).collect()
    assert all(not r["m"] and r["p"] is None and r["n"] == 0 for r in got) and got[0]["y"] is None and got[1]["y"] is None and got[3]["y"]["confidence"] == 50
    assert spark.range(1).select(config.form_fields(F.lit('{"fields": [1, 2]}'))).first()[0] == 2


def test_triage_order(spark):
    rows = spark.createDataFrame([(False, True, 9), (True, True, 0), (True, False, 3), (True, False, 2)], "r boolean, k boolean, c int")
    assert [r[0] for r in rows.select(fleet.lane(F.col("r"), F.col("k"), F.col("c"))).collect()] == ["RED", "GREEN", "YELLOW", "GRAY"]
