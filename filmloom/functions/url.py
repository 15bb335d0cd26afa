"""Column expressions on URLs: normal form, validity, file names, links in pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, paths and endings that are no content, link prefixes to skip.
TRACKING = ("utm_", "ref=", "source=", "campaign=", "medium=")
EXCLUDED_PATHS = (
    "/user/", "/api/", "/search", "/login", "/signup", "/edit/", "/submit", "/account/", "/cart/", "/checkout/", "/auth/", "/oauth/", "/admin/", "/static/", "/assets/", "/videos", "/pictures",
)
EXTENSIONS = (".html", ".htm", ".php", ".jsp", ".asp", "")
SKIPPED_SCHEMES = ("javascript:", "mailto:", "#", "tel:")
SKIPPED_ENDINGS = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".css", ".js")

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, which: str) -> Column:
    """scheme, host (with port), path or query of a URL; '' where it has none. White space at the ends does not count."""
    return F.regexp_extract(F.trim(url), _PARTS, {"scheme": 1, "host": 2, "path": 3, "query": 4}[which])


def normalize(url: Column) -> Column:
    """https, host in lower case without www., no slash at the end (but for the root), no tracking parameters, no
    fragment and no path parameters. NULL stays NULL."""
    host = F.regexp_replace(F.lower(part(url, "host")), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(part(url, "path"), r";[^/]*$", ""), "/+$", "")
    kept = F.filter(F.split(part(url, "query"), "&"), lambda p: ~F.lower(p).rlike("|".join(TRACKING)))
    query = F.array_join(kept, "&")
    return F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def is_content(url: Column, hosts: tuple[str, ...], wanted: str = "/m/", blocked: tuple[str, ...] = ()) -> Column:
    """Whether a URL is a page to fetch: a known host, no excluded or blocked path, a content path, a page's extension."""
    path = part(url, "path")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    extension = F.lower(F.regexp_extract(F.regexp_replace(name, r"^\.+", ""), r"(\.[^.]*)$", 1))
    excluded = F.lit(False)
    for p in EXCLUDED_PATHS:
        excluded = excluded | path.contains(p)
    for p in blocked:
        excluded = excluded | path.startswith(p)
    return F.coalesce(F.regexp_replace(part(url, "host"), r"^www\.", "").isin(*hosts) & ~excluded & path.contains(wanted) & extension.isin(*EXTENSIONS), F.lit(False))


def file_name(url: Column) -> Column:
    """A file name for a URL: its first 100 characters as letters and digits, and 12 of its MD5."""
    safe = F.substring(F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "[^a-zA-Z0-9]", "_"), 1, 100)
    return F.concat(safe, F.lit("_"), F.substring(F.md5(url), 1, 12), F.lit(".html"))


def resolve(base: Column, link: Column) -> Column:
    """link as an absolute URL, seen from base: absolute, //host, /path, ?query, and relative forms (.. and . resolved)."""
    scheme, host, path = F.coalesce(F.nullif(part(base, "scheme"), F.lit("")), F.lit("https")), part(base, "host"), part(base, "path")
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    tail = F.regexp_extract(link, r"([?#].*)$", 1)
    plain = F.regexp_replace(link, r"[?#].*$", "")
    steps = F.split(F.concat(F.when(folder == "", "/").otherwise(folder), plain), "/")
    walked = F.aggregate(
        F.slice(steps, 2, 100_000),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    relative = F.when(plain.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(walked, "/"))).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), plain))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path, link))
        .otherwise(F.concat(root, relative, tail))
    )


def links(html: Column, base: Column) -> Column:
    """Distinct normal forms of the links of a page (href, data-href and data-url, either quote), in order of place."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)(?:href|data-url)=([\"'])(.*?)\1"), 2)

    def wanted(x: Column) -> Column:
        keep = F.lit(True)
        for s in SKIPPED_SCHEMES:
            keep = keep & ~x.startswith(s)
        for s in SKIPPED_ENDINGS:
            keep = keep & ~x.endswith(s)
        return keep

    return F.array_distinct(F.transform(F.filter(found, wanted), lambda x: normalize(resolve(base, x))))
