"""Rows of career addresses enriched from a fetch of their page: what was reached, what builds and guards it, how it lists, why to skip it; and small filters of review.

A fetch is columns beside the row: status, final address, error, raw and final html, response
headers (a map) and visible text. All are Column expressions; no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text, urls
from sparkloom.operators import pages
from sparkloom.operators.discovery import visible_count

# Guards of sites with parts of response headers and of pages (in lower case) that give them away, in the order of the test.
GUARDS = {
    "Cloudflare": (["cf-ray", "cf-mitigated"], ["just a moment...", "cf_chl_", "challenge-platform", "cloudflare"]),
    "Reblaze": (["x-rbz-", "rbzns.", "rbz-"], ["rbzid", "rbzsessionid"]),
    "Akamai": (["x-akamai"], ["_abck", "akamaihd.net", "akam-"]),
    "DataDome": (["x-datadome"], ["datadome.js", "dd_cookie_test"]),
    "Imperva Incapsula": (["x-iinfo"], ["incapsula", "_incap_"]),
    "PerimeterX": ([], ["perimeterx", "_pxhd"]),
}
# Words of listings, in markup before scripts run.
LISTING_WORDS = ["job", "position", "career", "משרה", "תפקיד", "opening"]
LOGIN_COPY = r"(?i)sign in to view|please log in to see (open )?(jobs|positions)"
CHALLENGE = r"(?i)just a moment|challenge-platform"
#: Letters under which a page counts as built by scripts, and up to which a doubled one does; listing words of a page that comes whole.
SMALL_PAGE, DOUBLED_PAGE, WHOLE_WORDS = 5000, 30_000, 15
LEAST_POLICY = 100
VERDICTS = {"ACTIVE": 3, "REQUEUE": 2, "REVIEW": 1}
UNKNOWN = ["ats_or_cms", "rendering", "pagination", "anti_bot", "language_rtl", "structured_data", "auth_required"]
BY_HAND = "needs-manual-research"


def bare_url(c: Column | str) -> Column:
    """T-25: an address without any white space; null as empty."""
    return F.regexp_replace(F.coalesce(text.col(c), F.lit("")), r"\s+", "")


def guard(page: Column, headers: Column) -> Column:
    """The guard that a page or its headers name, else `none`."""
    sent = F.lower(F.array_join(F.transform(F.coalesce(F.map_entries(headers), F.array()), lambda e: F.concat_ws(":", e["key"], e["value"])), "\n"))
    low = F.lower(F.coalesce(page, F.lit("")))
    any_of = lambda where, parts: reduce(lambda a, b: a | b, [F.contains(where, F.lit(p)) for p in parts], F.lit(False))
    return F.coalesce(*[F.when(any_of(sent, h) | any_of(low, b), name) for name, (h, b) in GUARDS.items()], F.lit("none"))


def rendering(raw: Column, final: Column) -> Column:
    """CSR-SPA for a small page or one that scripts doubled, SSR for one with many listing words before them, else Hybrid."""
    kept = lambda c: F.length(reduce(lambda s, p: F.regexp_replace(s, p, ""), [r"(?i)<script\b[^>]*>[\s\S]*?</script>", r"(?i)<style\b[^>]*>[\s\S]*?</style>", r"<!--[\s\S]*?-->"], c))
    r, f = kept(raw), kept(final)
    words = F.regexp_count(F.lower(raw), F.lit("|".join(LISTING_WORDS)))
    return F.when((r < SMALL_PAGE) | ((f > r * 2) & (r < DOUBLED_PAGE)), "CSR-SPA").when(words >= WHOLE_WORDS, "SSR").otherwise("Hybrid")


def needs_login(page: Column) -> Column:
    return F.when(page.rlike(r"(?i)<input[^>]+type=[\"']password[\"']") & page.rlike(LOGIN_COPY), "yes").otherwise("no")


def reached(given: Column, url: Column, status: Column, final: Column, error: Column) -> Column:
    """What became of an address: yes, yes_url_fixed, redirected_to:, or no_ with the reason."""
    failed = F.when(error.rlike("(?i)timeout"), "no_timeout").when(error.rlike("(?i)ERR_NAME_NOT_RESOLVED|getaddrinfo|ENOTFOUND"), "no_dns").otherwise(F.concat(F.lit("no_error:"), F.substring(error, 1, 60)))
    return (
        F.when(F.length(error) > 0, failed)
        .when(F.coalesce(status, F.lit(0)) == 0, "no_no_status")
        .when(status >= 400, F.concat(F.lit("no_"), status.cast("string")))
        .when(~urls.same_host(given, final), F.concat(F.lit("redirected_to:"), F.coalesce(final, F.lit(""))))
        .when(given != url, "yes_url_fixed")
        .otherwise("yes")
    )


def enriched(rows: DataFrame, url: str, status: str, final: str, error: str, raw: str, html: str, headers: str, shown: str) -> DataFrame:
    """The rows with their address mended and, beside it, what the fetch tells. Columns notes, estimated and skip_reason are read where they are, and kept where they hold more.

    An address without a domain isn't judged by its fetch; one that failed has `unknown` marks and its reason as a note.
    """
    have = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    given, mended = F.coalesce(F.col(url), F.lit("")), bare_url(url)
    whole = mended.rlike(r"(?i)^https?://[^/]+\.[a-z]{2,}")
    told = F.length(F.coalesce(F.col(error), F.lit(""))) > 0
    good = whole & ~told & (F.coalesce(F.col(status), F.lit(0)) < 400) & (F.length(F.coalesce(F.col(html), F.lit(""))) > 0)
    page, last = F.col(html), F.coalesce(text.present(final), mended)
    seen = {"ats_or_cms": pages.vendor(F.coalesce(F.col(final), F.lit("")), page), "rendering": rendering(F.col(raw), page), "pagination": pages.pagination(page), "anti_bot": guard(page, F.col(headers)), "language_rtl": pages.page_language(page), "structured_data": pages.structured_data(page), "auth_required": needs_login(page)}
    marks = {c: F.when(good, seen[c]).otherwise("unknown") for c in UNKNOWN}
    marks["anti_bot"] = F.when(good, seen["anti_bot"]).when(whole & ~told, guard(F.col(raw), F.col(headers))).otherwise("unknown")
    marked = F.when(good, F.coalesce(F.col(final), F.lit(""))).when(whole, last).otherwise(mended)
    count = F.when(good, visible_count(shown)).otherwise("")
    old = F.when(F.trim(have("estimated")).rlike(r"(?i)^30\+\s*jobs$|built\s+in\s+article"), "").otherwise(have("estimated"))
    fixed = F.concat(F.lit('URL whitespace fixed ("'), given, F.lit('" -> "'), mended, F.lit('")'))
    out = rows.withColumns({
        **marks, "careers_url_verified": F.when(whole, reached(given, mended, F.col(status), F.col(final), F.coalesce(F.col(error), F.lit("")))).otherwise("no_invalid_url"),
        "final_url": F.when(whole, F.coalesce(F.col(final), F.lit(""))).otherwise(""), "http_status": F.when(whole & (F.col(status) > 0), F.col(status).cast("string")).otherwise(""),
        "israel_filtered_url": F.when(urls.country_marked(marked), marked).otherwise(BY_HAND), "detected_job_count": count, "estimated": F.when(old == "", count).otherwise(old),
        "enrichment_notes": F.when(~whole, "URL appears malformed (missing TLD?). Skipped fetch.").when(good, "").when(told, F.col(error)).otherwise(F.concat(F.lit("HTTP "), F.coalesce(F.col(status).cast("string"), F.lit("0")))),
        "notes": F.when(given != mended, text.append_note(have("notes"), fixed)).otherwise(have("notes")), url: mended,
    })
    skip = F.when((F.col("anti_bot") == "Cloudflare") & page.rlike(CHALLENGE), "cloudflare-hard").when(F.col("pagination") == "load-more-button", "load-more-button").when(F.col("pagination") == "numbered", "numbered-pagination").when(F.col("auth_required") == "yes", "login-wall").otherwise("")
    return out.withColumn("skip_reason", F.when(have("skip_reason") != "", have("skip_reason")).when(good, skip).otherwise(""))


def found_sites(sites: DataFrame, url: str, part: str | None = None, exact: str | None = None) -> DataFrame:
    """F8: sites whose address holds a part, in either case; an exact address counts only without a part."""
    if part:
        return sites.where(F.contains(F.lower(url), F.lit(part.lower())))
    return sites.where(F.col(url) == exact) if exact else sites


def long_enough(policies: DataFrame, cleaned: str) -> DataFrame:
    """policies with 100 letters or more of text, without the space around it."""
    return policies.where(F.length(F.trim(cleaned)) >= LEAST_POLICY)


def verdict_rank(verdict: Column) -> Column:
    """Failures and unknown verdicts first (0), then review, requeue, active."""
    return F.coalesce(*[F.when(verdict == v, n) for v, n in VERDICTS.items()], F.lit(0))
