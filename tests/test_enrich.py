"""Enriched rows by hand-made fetches, and the small filters."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import enrich

SCHEMA = "i int, url string, status int, final string, error string, raw string, html string, headers map<string,string>, shown string, notes string, estimated string, skip_reason string"
BIG = "<p>" + "x" * 6000 + "</p>"
OK = ("https://a.co.il/jobs", 200, "https://a.co.il/jobs", None, BIG, BIG, None, "we have 12 open positions", None, None, None)


def row(i, **changes):
    names = SCHEMA.split(", ")[1:]
    values = dict(zip([n.split()[0] for n in names], OK, strict=True)) | changes
    return (i, *values.values())


CASES = [
    ({}, {"careers_url_verified": "yes", "rendering": "Hybrid", "anti_bot": "none", "pagination": "unknown", "auth_required": "no", "israel_filtered_url": "https://a.co.il/jobs", "detected_job_count": "12 (extracted)", "estimated": "12 (extracted)", "skip_reason": "", "enrichment_notes": "", "http_status": "200"}),
    ({"url": "https://a. co.il/jobs ", "notes": "old"}, {"careers_url_verified": "redirected_to:https://a.co.il/jobs", "url": "https://a.co.il/jobs", "notes": 'old; URL whitespace fixed ("https://a. co.il/jobs " -> "https://a.co.il/jobs")'}),
    ({"url": "https://a.co.il/jo bs"}, {"careers_url_verified": "yes_url_fixed"}),
    ({"url": "https://careers"}, {"careers_url_verified": "no_invalid_url", "ats_or_cms": "unknown", "israel_filtered_url": "needs-manual-research", "final_url": "", "http_status": "", "enrichment_notes": "URL appears malformed (missing TLD?). Skipped fetch.", "estimated": ""}),
    ({"url": None}, {"careers_url_verified": "no_invalid_url", "url": ""}),
    ({"error": "Timeout 30000ms", "status": 0}, {"careers_url_verified": "no_timeout", "anti_bot": "unknown", "enrichment_notes": "Timeout 30000ms", "http_status": ""}),
    ({"error": "getaddrinfo failed"}, {"careers_url_verified": "no_dns"}),
    ({"error": "x" * 90}, {"careers_url_verified": "no_error:" + "x" * 60}),
    ({"status": None, "html": None}, {"careers_url_verified": "no_no_status", "enrichment_notes": "HTTP 0"}),
    ({"status": 403, "headers": {"CF-Ray": "1"}}, {"careers_url_verified": "no_403", "anti_bot": "Cloudflare", "rendering": "unknown", "enrichment_notes": "HTTP 403", "skip_reason": "", "detected_job_count": ""}),
    ({"html": BIG + "<title>Just a moment...</title>"}, {"anti_bot": "Cloudflare", "skip_reason": "cloudflare-hard"}),
    ({"html": BIG + "_abck load more", "raw": "job" * 20 + BIG}, {"anti_bot": "Akamai", "rendering": "SSR", "pagination": "load-more-button", "skip_reason": "load-more-button"}),
    ({"html": BIG + "<ul class='pager'>", "skip_reason": "mine"}, {"pagination": "numbered", "skip_reason": "mine"}),
    ({"html": BIG + "<input type='password'> Sign in to view"}, {"auth_required": "yes", "skip_reason": "login-wall"}),
    ({"raw": "<script>" + "y" * 9000 + "</script>short"}, {"rendering": "CSR-SPA"}),
    ({"raw": BIG, "html": BIG * 3}, {"rendering": "CSR-SPA"}),
    ({"estimated": " 30+ Jobs"}, {"estimated": "12 (extracted)"}),
    ({"estimated": "7", "final": "https://b.com/x"}, {"estimated": "7", "careers_url_verified": "redirected_to:https://b.com/x", "israel_filtered_url": "needs-manual-research"}),
]


def test_enriched(spark):
    df = spark.createDataFrame([row(i, **c) for i, (c, _) in enumerate(CASES)], SCHEMA)
    out = {r["i"]: r.asDict() for r in enrich.enriched(df, "url", "status", "final", "error", "raw", "html", "headers", "shown").collect()}
    for i, (_, want) in enumerate(CASES):
        assert {k: out[i][k] for k in want} == want, i
    bare = enrich.enriched(df.drop("notes", "estimated", "skip_reason"), "url", "status", "final", "error", "raw", "html", "headers", "shown")
    assert bare.count() == len(CASES) and {"notes", "estimated", "skip_reason"} <= set(bare.columns)
    assert enrich.enriched(df.limit(0), "url", "status", "final", "error", "raw", "html", "headers", "shown").count() == 0


@pytest.mark.parametrize("part, exact, want", [("EXAMPLE", "https://b.org", [1, 3]), (None, "https://b.org", [2]), (None, None, [1, 2, 3, 4]), ("", "", [1, 2, 3, 4])])
def test_found_sites(spark, part, exact, want):
    df = spark.createDataFrame([(1, "https://example.com"), (2, "https://b.org"), (3, "https://b.org/Example"), (4, None)], "i int, url string")
    assert sorted(r["i"] for r in enrich.found_sites(df, "url", part, exact).collect()) == want


def test_small_filters(spark):
    df = spark.createDataFrame([(1, " " * 60 + "x" * 99), (2, "x" * 100), (3, None)], "i int, t string")
    assert [r["i"] for r in enrich.long_enough(df, "t").collect()] == [2]
    df = spark.createDataFrame([("ACTIVE",), ("ERROR",), (None,), ("REVIEW",), ("REQUEUE",)], "v string")
    assert [r["v"] for r in df.orderBy(enrich.verdict_rank(F.col("v")), "v").collect()] == [None, "ERROR", "REVIEW", "REQUEUE", "ACTIVE"]
