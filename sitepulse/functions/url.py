"""URL, referrer and origin functions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitepulse.functions.text import sanitize_string

UTM = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term")
#: What a host contains, or is, and the source it stands for, in the order they are tried.
SOURCES = (
    ("google", "Google"),
    ("bing", "Bing"),
    ("yahoo", "Yahoo"),
    ("duckduckgo", "DuckDuckGo"),
    ("twitter|^t\\.co$", "Twitter"),
    ("facebook|fb\\.com", "Facebook"),
    ("linkedin", "LinkedIn"),
    ("reddit", "Reddit"),
    ("github", "GitHub"),
)


def _no_scheme(url: Column) -> Column:
    return F.regexp_replace(url, r"^(?:https://|http://)", "")


def pathname(url: Column) -> Column:
    """The path from the first slash after the host, without query and fragment; '/' if there is none."""
    path = F.regexp_extract(_no_scheme(url), r"(?s)/([^?#]*)", 1)
    return sanitize_string(F.concat(F.lit("/"), path), 2048)


def utm(url: Column, name: str) -> Column:
    """The last non-empty value of a query parameter, as it stands; the query runs to the end, fragments included."""
    value = F.regexp_extract(url, rf"(?s)^[^?]*\?(?:.*&)?{name}=([^&]+)", 1)
    return F.when(url.contains(f"{name}=") & (value != ""), sanitize_string(value, 256))


def utm_struct(url: Column) -> Column:
    return F.struct(*(utm(url, name).alias(name) for name in UTM))


def referrer_source(referrer: Column) -> Column:
    """The name of a known source, else the host; null for none."""
    host = F.regexp_extract(_no_scheme(referrer), r"^([^/:]*)", 1)
    named = F.when(F.coalesce(host, F.lit("")) == "", F.lit(None))
    for pattern, name in SOURCES:
        named = named.when(host.rlike(pattern), F.lit(name))
    return named.otherwise(host)


def strip_query(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)[?#].*$", "")


def origin_of(referrer: Column) -> Column:
    """Scheme and authority, or null."""
    return F.nullif(F.regexp_extract(referrer, r"^(https?://[^/]*)", 1), F.lit(""))


def origin_allowed(origin: Column, allowed: tuple[str, ...]) -> Column:
    """No list and no origin allow; else the authority is a listed site, with or without a port."""
    if not allowed:
        return F.lit(True)
    authority = F.substring_index(_no_scheme(origin), "/", 1)
    hit = authority.isin(*allowed)
    for site in allowed:
        hit = hit | authority.startswith(f"{site}:")
    return F.coalesce(hit, F.lit(True))


def client_ip(forwarded_for: Column, real_ip: Column) -> Column:
    """The first forwarded address, else the proxy's, else 'unknown'."""
    return F.coalesce(F.trim(F.substring_index(forwarded_for, ",", 1)), real_ip, F.lit("unknown"))
