"""URLs as Column expressions: normal form, keys, patterns, slugs, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

_PARTS = r"^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def normal(c: Column | str) -> Column:
    """No white space, a scheme, the host in lower case, no slash at the end of a path other than the root."""
    u = F.regexp_replace(col(c), r"\s+", "")
    u = F.when(u.rlike("(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    part = lambda i: F.regexp_extract(u, "(?i)" + _PARTS, i)
    path = F.when(part(3) == "", "/").when(part(3).rlike("^/+$"), "/").otherwise(F.regexp_replace(part(3), "/+$", ""))
    return F.when(F.length(F.regexp_replace(col(c), r"\s+", "")) == 0, "").otherwise(F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, part(4), part(5)))


def key(c: Column | str) -> Column:
    """Host, path and query in lower case: equal for addresses of one page."""
    return F.lower(F.regexp_replace(F.regexp_replace(normal(c), "^https?://", ""), "#.*$", ""))


def valid(c: Column | str) -> Column:
    return F.coalesce(normal(c).rlike(r"^https?://[^/\s:]+\.[^/\s]+"), F.lit(False))


def path(c: Column | str) -> Column:
    return F.regexp_extract(normal(c), _PARTS, 3)


def pattern(c: Column | str) -> Column:
    """Host and path, numbers, UUIDs and long hexadecimal segments as *."""
    wild = r"^\d+$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[0-9a-f]{7,}$"
    parts = F.transform(F.split(path(c), "/"), lambda s: F.when(F.lower(s).rlike(wild), "*").otherwise(s))
    return F.concat(F.regexp_extract(normal(c), _PARTS, 2), F.array_join(parts, "/"))


def slug(c: Column | str) -> Column:
    """Letters and digits of a text in lower case, joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def site_slug(c: Column | str) -> Column:
    """The host without www, as a slug."""
    return slug(F.regexp_replace(F.regexp_extract(normal(c), _PARTS, 2), r"^www\.", ""))


def last_segment(c: Column | str) -> Column:
    return F.element_at(F.split(path(c), "/"), -1)


def looks_like_login(c: Column | str) -> Column:
    return col(c).rlike(r"(?i)/(login|signin|sign-in|log-in|auth|sso|account/login)(/|\?|$)|^https?://(login|auth|sso|accounts|id)\.")


def matches_glob(c: Column | str, glob: str) -> Column:
    """Whether a URL has the shape of a pattern in which * is one path segment."""
    import re

    return col(c).rlike("^" + "[^/]+".join(re.escape(p) for p in glob.split("*")) + "$")


# Requests that carry no records, marks of a country's address, file types of policies.
SKIPPED = r"(?i)\.(js|css|png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|eot|map)(\?|$)|/static/|/assets/|/_next/|/webpack|google-analytics|gtag|googletagmanager|facebook|pixel|hotjar|analytics|tracking|beacon|cdn\.|cloudflare|cloudfront|googleapis|gstatic|recaptcha|captcha|socket\.io|ws://"
COUNTRY_MARKS = r"(?i)\bisrael\b|[?&](location|locations|country|region)=(israel|il)\b|/(locations?|regions?|countries)/israel\b|israelhome|\.co\.il(/|$)"
POLICY_FILES = ["pdf", "docx", "doc"]


def usable(c: Column | str) -> Column:
    """Neither empty, nor an anchor, a script or the root."""
    c = col(c)
    return F.coalesce((F.length(c) > 0) & ~c.startswith("#") & ~c.startswith("javascript:") & (c != "/"), F.lit(False))


def skipped(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(SKIPPED), F.lit(False))


def country_marked(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(COUNTRY_MARKS), F.lit(False))


def file_type(c: Column | str) -> Column:
    """pdf, docx or doc by the path's end, else null."""
    bare = F.lower(F.regexp_replace(col(c), r"[?#].*$", ""))
    return F.coalesce(*[F.when(bare.endswith("." + t), t) for t in POLICY_FILES])


def document_kind(c: Column | str) -> Column:
    """What policy an address leads to, with the file type where it is one."""
    low = F.lower(col(c))
    kind = F.when(low.contains("privacy"), "privacy").when(low.contains("term") | low.contains("takanon"), "terms").when(low.contains("legal"), "legal").otherwise("unknown")
    return F.concat_ws("_", kind, file_type(c))


def same_host(a: Column | str, b: Column | str) -> Column:
    """Equal hosts; a prefix of the text isn't enough."""
    host = lambda x: F.lower(F.regexp_extract(col(x), r"(?i)^https?://([^/?#]+)", 1))
    return F.coalesce((host(a) == host(b)) & (host(a) != ""), F.lit(False))


def without_parameter(c: Column | str, name: str) -> Column:
    """The address without one query parameter."""
    bare = F.regexp_replace(col(c), rf"([?&]){name}=[^&#]*&?", "$1")
    return F.regexp_replace(bare, r"[?&](#|$)", "$1")


def with_parameter(c: Column | str, name: str, value: Column) -> Column:
    """The address with one query parameter set, before any fragment."""
    bare = without_parameter(c, name)
    head, tail = F.regexp_replace(bare, r"#.*$", ""), F.regexp_extract(bare, r"(#.*)$", 1)
    return F.concat(head, F.when(head.contains("?"), "&").otherwise("?"), F.lit(name + "="), value.cast("string"), tail)


def fetch_outcome(asked: Column, cleaned: Column, status: Column, final: Column, error: Column) -> Column:
    """How a check of an address ended."""
    return (
        F.when(error.rlike("(?i)timeout"), "no_timeout").when(error.rlike("(?i)ERR_NAME_NOT_RESOLVED|getaddrinfo|ENOTFOUND"), "no_dns")
        .when(F.length(error) > 0, F.concat(F.lit("no_error:"), F.substring(error, 1, 60))).when(F.coalesce(status, F.lit(0)) == 0, "no_no_status")
        .when(status >= 400, F.concat(F.lit("no_"), status.cast("string"))).when(~same_host(asked, final), F.concat(F.lit("redirected_to:"), final))
        .when(asked != cleaned, "yes_url_fixed").otherwise("yes")
    )
