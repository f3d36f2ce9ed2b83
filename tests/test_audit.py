"""Counts of a site's records and its issues against plain Python."""

import json
import random
import re


from sparkloom.operators import audit

COLUMNS = ["site", "raw", *audit.FIELDS]


def made():
    rng = random.Random(7)
    out = []
    for i in range(900):
        some = lambda *x: rng.choice([None, "", " ", *x])
        raw = {"_formData": rng.choice(["", "no", "{bad", '{"fields": []}', '{"fields": ["a"]}', '{"fields": [{"n": 1}]}', '{"x": 1}']), "description": rng.choice(["d", "x" * 250, "x" * 200 + "\n", ""]), "location": "raw place"}
        raw = {k: v for k, v in raw.items() if rng.random() < 0.7} or None
        out.append((rng.choice(["a", "b", "hot", "hot", None]), raw, some("text", "y" * 300), some("r"), rng.choice([None, "Unknown", "Haifa", ""]), some(*[f"J{rng.randrange(80)}"] * 5), some("mail me@x.org", "http://a", "call"), some("https://x/1", "/x")))
    return out


def plain(rows, status):
    def form(raw):
        s = ((raw or {}).get("_formData") or "").strip()
        try:
            return s.startswith("{") and len(json.loads(s).get("fields") or []) >= 1
        except ValueError:
            return False

    ok = lambda v: v is not None and v.strip(" ") != ""
    n = dict.fromkeys(["jobs", "noForm", "hasFallback", "noLocation", "unknownLocation", "noDescription", "noRequirements", "noExternalId", "descriptions", "blobs", "duplicateIds"], 0)
    ids = [r[5] for r in rows if ok(r[5])]
    n["jobs"], n["duplicateIds"] = len(rows), len({i for i in ids if ids.count(i) > 1})
    for _, raw, d, q, place, i, info, url in rows:
        raw = raw or {}
        d, q = raw.get("description", d), raw.get("requirements", q)
        place = place if place is not None else raw.get("location")
        if not form(raw):
            n["noForm"] += 1
            n["hasFallback"] += bool(re.search(audit.EMAIL, info or "", re.ASCII) or re.search(audit.URL, info or "") or re.search(audit.URL, url or ""))
        n["noLocation"] += not ok(place)
        n["unknownLocation"] += place == "Unknown"
        n["noDescription"] += not ok(d)
        n["descriptions"] += ok(d)
        n["blobs"] += ok(d) and len(d) > 200 and "\n" not in d
        n["noRequirements"] += not ok(q)
        n["noExternalId"] += not ok(i)
    return n


def test_counts(spark):
    rows = made()
    df = spark.createDataFrame(rows, "site string, raw map<string,string>, " + ", ".join(f"{f} string" for f in audit.FIELDS)).repartition(5)
    got = {r["site"]: r.asDict() for r in audit.audited(df, "site").collect()}
    for site in ("a", "b", "hot", None):
        assert {k: v for k, v in got[site].items() if k != "site"} == plain([r for r in rows if r[0] == site], "")
    assert audit.audited(df.limit(0), "site").count() == 0


def test_worklist(spark):
    sites = spark.createDataFrame([("a", "FAILED"), ("empty", "ACTIVE"), ("idle", "REVIEW"), ("fine", "ACTIVE")], "site string, status string")
    good = ("fine", {"_formData": '{"fields": ["a"]}', "description": "short"}, None, "r", "Haifa", "J1", None, None)
    bad = [("a", None, "x" * 201, None, None, "same", None, None)] * 3
    df = spark.createDataFrame([good, *bad], "site string, raw map<string,string>, " + ", ".join(f"{f} string" for f in audit.FIELDS))
    got = {r["site"]: (r["issues"], r["repair"], r["rank"]) for r in audit.worklist(sites, df, "site", "status").collect()}
    assert got["empty"] == (["ACTIVE site currently has 0 jobs"], True, 1) and got["idle"] == ([], False, None) and got["fine"] == ([], False, None)
    assert got["a"] == (["No apply form (100.0%)", "No location (100.0%)", 'Unstructured "blob" text (100.0%)', "No requirements AND unstructured (100.0% / 100.0%)", "1 duplicate externalJobId value(s)"], True, 3)
