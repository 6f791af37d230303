"""URL columns built from regular expressions; invalid input gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylamp.functions.text import strip_space

# scheme :// [userinfo@] host [:port] [/path] [?query] [#fragment]
_ABSOLUTE = (
    r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]*)"
    r"(?::([0-9]*))?(/[^?#]*)?(?:\?([^#]*))?(?:#[\s\S]*)?$"
)
_SCHEME, _HOST, _PORT, _PATH, _QUERY = 1, 2, 3, 4, 5

# Characters Go-style path encoding leaves alone although form encoding escapes them.
_PATH_SAFE = {
    "+": "%20",
    "%2F": "/",
    "%24": "$",
    "%26": "&",
    "%2B": "+",
    "%2C": ",",
    "%3A": ":",
    "%3B": ";",
    "%3D": "=",
    "%40": "@",
    "%7E": "~",
}


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _ABSOLUTE, group)


def _clean(url: Column) -> Column:
    return F.regexp_replace(strip_space(url), "[\t\r\n]", "")


def _port_suffix(scheme: Column, port: Column) -> Column:
    """`:port` without leading zeros, or empty for a missing or default port."""
    number = F.regexp_replace(port, "^0+(?=[0-9])", "")
    default = ((scheme == "http") & (number == "80")) | ((scheme == "https") & (number == "443"))
    return F.when((number == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), number))


def _valid_port(port: Column) -> Column:
    number = F.regexp_replace(port, "^0+(?=[0-9])", "")
    return (F.length(number) < 6) & (F.coalesce(number.try_cast("int"), F.lit(0)) <= 65535)


def _short_path(path: Column) -> Column:
    trimmed = F.regexp_replace(path, "/+$", "")
    return F.when(trimmed == "", F.lit("/")).otherwise(trimmed)


def _query_suffix(query: Column) -> Column:
    return F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))


def canonical_url(url: Column) -> Column:
    """Canonical absolute HTTP(S) URL, NULL for anything else."""
    text = _clean(url)
    scheme = F.lower(_part(text, _SCHEME))
    host = F.lower(_part(text, _HOST))
    port = _part(text, _PORT)
    joined = F.concat(
        scheme,
        F.lit("://"),
        host,
        _port_suffix(scheme, port),
        _short_path(_part(text, _PATH)),
        _query_suffix(_part(text, _QUERY)),
    )
    usable = scheme.isin("http", "https") & ~host.isin("", "[]") & _valid_port(port)
    return F.when(usable, joined)


def _encode_path(path: Column) -> Column:
    """Percent-encode a path after decoding it; NULL when an escape is malformed."""
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    encoded = F.url_encode(decoded)
    for escaped, plain in _PATH_SAFE.items():
        encoded = F.replace(encoded, F.lit(escaped), F.lit(plain))
    return F.replace(encoded, F.lit("*"), F.lit("%2A"))


def normalize_url(url: Column) -> Column:
    """Lenient form: any scheme or a relative reference; unparsable input comes back unchanged."""
    absolute = url.rlike(_ABSOLUTE)
    scheme = F.lower(_part(url, _SCHEME))
    host = F.lower(_part(url, _HOST))
    full = F.concat(
        scheme,
        F.lit("://"),
        host,
        _port_suffix(scheme, _part(url, _PORT)),
        _short_path(_encode_path(_part(url, _PATH))),
        _query_suffix(_part(url, _QUERY)),
    )
    relative = r"^([^:/?#][^:?#]*|/(?:[^/?#][^?#]*)?|)(?:\?([^#]*))?(?:#[\s\S]*)?$"
    local = F.concat(
        _short_path(_encode_path(F.regexp_extract(url, relative, 1))),
        _query_suffix(F.regexp_extract(url, relative, 2)),
    )
    control = url.rlike(r"[\x00-\x1F\x7F]")
    parsed = F.when(control, F.lit(None)).when(absolute, full).when(url.rlike(relative), local)
    return F.coalesce(parsed, url)


def source_host(url: Column) -> Column:
    """Lower-cased host name without port or brackets."""
    return F.regexp_replace(F.lower(_part(_clean(url), _HOST)), r"^\[|\]$", "")


def display_host(url: Column) -> Column:
    """`scheme://host[:port]` as shown next to a result; empty when unparsable."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#]*@)?([^/?#@]*)"
    shown = F.concat(
        F.lower(F.regexp_extract(url, pattern, 1)),
        F.lit("://"),
        F.regexp_extract(url, pattern, 2),
    )
    return F.when(url.rlike(_ABSOLUTE), shown).otherwise(F.lit(""))


def display_path(url: Column) -> Column:
    """Decoded path shown next to a result; empty when unparsable."""
    path = F.replace(_part(url, _PATH), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(path), F.lit(""))


def same_host(url: Column, start_url: Column) -> Column:
    """Whether two URLs have one host; plain ones that begin alike are not taken apart."""
    begin = F.substring_index(url, "/", 3)
    alike = (begin == F.substring_index(start_url, "/", 3)) & begin.rlike(r"^https?://[A-Za-z0-9.\-]+$")
    return F.when(alike, F.lit(True)).otherwise(source_host(url) == source_host(start_url))


def is_start_url(url: Column) -> Column:
    """A crawl may only start at an absolute HTTP(S) URL with a host."""
    return canonical_url(url).isNotNull()


def _without_dots(path: Column) -> Column:
    """Resolve `.` and `..` segments of an absolute path."""
    segments = F.split(F.regexp_replace(path, r"/\.{1,2}$", "$0/"), "/")
    kept = F.aggregate(
        F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(1))),
        F.array().cast("array<string>"),
        lambda done, segment: F.when(
            segment == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        )
        .when(segment == ".", done)
        .otherwise(F.array_append(done, segment)),
    )
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), resolved).otherwise(path)


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute form of a link found on page `base`; NULL for blank or non-HTTP links."""
    link = strip_space(href)
    scheme = F.regexp_extract(link, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    path = F.regexp_extract(link, r"^([^?#]*)", 1)
    rest = F.regexp_extract(link, r"^[^?#]*([\s\S]*)$", 1)
    joined = F.when(path.startswith("/"), path).otherwise(
        F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)
    )
    return (
        F.when(link == "", F.lit(None))
        .when(F.lower(scheme).isin("http", "https"), link)
        .when(scheme != "", F.lit(None))
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#[\\s\\S]*$", ""), link))
        .when(link.startswith("?"), F.concat(F.regexp_replace(base, "[?#][\\s\\S]*$", ""), link))
        .otherwise(F.concat(origin, _without_dots(joined), rest))
    )
