"""URL columns, by the generic URI syntax of RFC 3986.

Regular expressions take the URL apart, because scraped links hold characters
a strict URI parser refuses.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# The component pattern of RFC 3986, appendix B.
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"

# Printable ASCII without parameters, whose last segment is neither empty nor a dot.
_PLAIN = r"""^https?://[!-"$-:<->@-~]+/(?!\.\z)[!-"$-.0-:<->@-~]+\z"""


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def url_scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def url_host(url: Column) -> Column:
    """Network location, user and port included, without the slashes."""
    return F.substring(_part(url, 2), 3, 2**31 - 1)


def url_path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(_part(url, 3), r";[^/]*$", "")


def _collapse_dots(segments: Column) -> Column:
    """Apply ``.`` and ``..``; going above the root is ignored."""
    dots = F.element_at(segments, -1).isin(".", "..")
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda kept, seg: F.when(
            seg == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        )
        .when(seg == ".", kept)
        .otherwise(F.concat(kept, F.array(seg))),
    )
    walked = F.when(dots, F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    path = F.array_join(walked, "/")
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def resolve_url(href: Column, base: Column | None) -> Column:
    """Absolute form of a link found on page ``base``; unchanged without one."""
    if base is None:
        return href
    scheme, base_path = _part(base, 1), _part(base, 3)
    root = F.concat(scheme, F.lit(":"), _part(base, 2))
    foreign = (_part(href, 1) != "") & (url_scheme(href) != F.lower(scheme))
    link = F.concat(_part(href, 2), _part(href, 3), _part(href, 4), _part(href, 5))
    tail = F.concat(_part(href, 4), _part(href, 5))

    absolute = F.split(_part(href, 3), "/")
    folder = F.split(F.regexp_replace(base_path, r"[^/]*$", ""), "/")
    joined = F.concat(folder, absolute)
    inner = F.slice(joined, F.lit(2), F.greatest(F.size(joined) - 2, F.lit(0)))
    relative = F.concat(
        F.slice(joined, 1, 1),
        F.filter(inner, lambda s: s != ""),
        F.slice(joined, -1, 1),
    )
    resolved = (
        F.when(link == "", base)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("?"), F.concat(root, base_path, tail))
        .when(link.startswith("#"), F.concat(root, base_path, _part(base, 4), tail))
        .when(link.startswith("/"), F.concat(root, _collapse_dots(absolute), tail))
        .otherwise(F.concat(root, _collapse_dots(relative), tail))
    )
    def tidy(url: Column) -> Column:
        return F.when(url.contains("?") | url.contains("#"), F.regexp_replace(url, r"\?(?=#|$)|#$", "")).otherwise(url)

    # Nearly all links are whole or begin at the root of a web page: these need not be taken apart.
    secure, open_ = (href.startswith(s) & base.startswith(s) for s in ("https://", "http://"))
    web = (base.startswith("https://") | base.startswith("http://")) & ~base.contains("?") & ~base.contains("#")
    rooted = web & href.startswith("/") & ~href.startswith("//") & ~href.contains("/.")
    return (
        F.when(secure | open_, tidy(href))
        .when(rooted, tidy(F.concat(F.substring_index(base, "/", 3), href)))
        .when(base.isNull() | (base == "") | foreign, href)
        .otherwise(tidy(resolved))
    )


def has_suffix(url: Column, suffixes: tuple[str, ...]) -> Column:
    """The whole lower-cased URL ends with one of the suffixes."""
    lowered = F.lower(url)
    hit = F.lit(False)
    for suffix in suffixes:
        hit = hit | lowered.endswith(suffix)
    return hit


def file_name(url: Column, fallback: str | None = "download") -> Column:
    """Last path segment; closing slashes and ``.`` segments do not count."""
    name = F.regexp_extract(F.regexp_replace(url_path(url), r"(?:/+\.?)+$", ""), r"([^/]*)$", 1)
    # A plain web address without parameters ends with the name.
    name = F.when(url.rlike(_PLAIN), F.substring_index(url, "/", -1)).otherwise(name)
    if fallback is None:
        return name
    return F.when(name == "", F.lit(fallback)).otherwise(name)


def query_value(url: Column, key: str) -> Column:
    """First non-empty value of a query parameter, decoded; null if absent."""
    raw = F.regexp_extract(_part(url, 4), rf"[?&]{key}=([^&]+)", 1)
    return F.when(raw != "", F.try_url_decode(raw))


def link_expiry(url: Column) -> Column:
    """When a signed link lapses (query parameter ``se``), null if not stated."""
    text = query_value(url, "se")
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(text))


def is_fresh(url: Column, now: Column, margin: timedelta = timedelta(minutes=2)) -> Column:
    """The link lives longer than ``margin`` from ``now``.

    No link is never fresh; a link without an expiry always is.
    """
    expiry = link_expiry(url)
    return (
        F.when(url.isNull() | (url == ""), False)
        .when(expiry.isNull(), True)
        .otherwise(expiry - now > F.lit(margin))
    )
