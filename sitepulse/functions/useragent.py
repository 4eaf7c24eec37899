"""User-agent functions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitepulse.functions.text import let

# What names a bot, a browser, a version and a system, in the order they are tried.
BOT_WORDS = (
    "bot crawler spider slurp fetch headless phantom lighthouse pingdom python-requests python-urllib go-http-client java/ wget "
    "mediapartners apis-google facebookexternalhit whatsapp sogou"
).split()
BOT_STARTS = ("curl", "libwww", "lwp-", "scrapy")
BROWSERS = (
    (("Edg/", "Edge/"), "Edge"),
    (("OPR/", "Opera"), "Opera"),
    (("Vivaldi/",), "Vivaldi"),
    (("Brave",), "Brave"),
    (("SamsungBrowser/",), "Samsung Internet"),
    (("UCBrowser/", "UCWEB/"), "UC Browser"),
)
VERSIONS = ("Edg/", "Edge/", "OPR/", "Vivaldi/", "SamsungBrowser/", "UCBrowser/", "Chrome/", "Firefox/", "Version/")
SYSTEMS = (
    (("Windows",), "Windows"),
    (("iPhone", "iPad", "iOS"), "iOS"),
    (("Mac OS X", "macOS"), "macOS"),
    (("Android",), "Android"),
    (("Linux",), "Linux"),
    (("CrOS",), "Chrome OS"),
)


def _has(ua: Column, *words: str) -> Column:
    found = ua.contains(words[0])
    for word in words[1:]:
        found = found | ua.contains(word)
    return found


def _after(ua: Column, prefix: Column, signs: str) -> Column:
    """What follows the first ``prefix``, of ``signs`` only; null if nothing."""
    rest = F.substring(ua, F.position(prefix, ua) + F.length(prefix), F.lit(1 << 30))
    found = let(rest, lambda r: F.left(r, F.length(r) - F.length(F.ltrim(r, F.lit(signs)))))
    return F.when(F.contains(ua, prefix), F.nullif(found, F.lit("")))


def is_bot(ua: Column) -> Column:
    def any_of(low):
        found = _has(low, *BOT_WORDS)
        for start in BOT_STARTS:
            found = found | low.startswith(start)
        return found

    return F.coalesce(let(F.lower(ua), any_of), F.lit(False))


def browser(ua: Column) -> Column:
    named = F.when(_has(ua, *BROWSERS[0][0]), BROWSERS[0][1])
    for words, name in BROWSERS[1:]:
        named = named.when(_has(ua, *words), name)
    return (
        named.when(_has(ua, "Chrome/") & ~_has(ua, "Chromium/"), "Chrome")
        .when(_has(ua, "Safari/") & ~_has(ua, "Chrome/"), "Safari")
        .when(_has(ua, "Firefox/"), "Firefox")
    )


def browser_version(ua: Column) -> Column:
    """A loop over the prefixes: nine branches would make the generated code too long to be compiled."""
    found = F.transform(F.array(*map(F.lit, VERSIONS)), lambda prefix: _after(ua, prefix, "0123456789."))
    return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))


def system(ua: Column) -> Column:
    named = F.when(_has(ua, *SYSTEMS[0][0]), SYSTEMS[0][1])
    for words, name in SYSTEMS[1:]:
        named = named.when(_has(ua, *words), name)
    return named


def system_version(ua: Column) -> Column:
    prefix = F.when(_has(ua, "Windows NT"), "Windows NT ").when(_has(ua, "iPhone OS"), "iPhone OS ").when(_has(ua, "Mac OS X"), "Mac OS X ").when(_has(ua, "Android"), "Android ")

    def version(p):
        found = _after(ua, p, "0123456789._")
        return F.when(p.isin("iPhone OS ", "Mac OS X "), F.replace(found, F.lit("_"), F.lit("."))).otherwise(found)

    return let(prefix, version)


def user_agent(ua: Column) -> Column:
    """A struct of all; nulls and false for an empty or missing user agent."""
    return F.struct(
        browser(ua).alias("browser"),
        browser_version(ua).alias("browser_version"),
        system(ua).alias("os"),
        system_version(ua).alias("os_version"),
        is_bot(ua).alias("is_bot"),
    )


def device(width: Column) -> Column:
    return F.when(width < 768, "mobile").when(width < 1024, "tablet").when(width.isNotNull(), "desktop")
