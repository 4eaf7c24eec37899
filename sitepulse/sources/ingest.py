"""From requests to events: parse, check, enrich.  All in column expressions, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitepulse.config import EngineConfig
from sitepulse.functions import text, url, useragent
from sitepulse.functions.geo import locate
from sitepulse.functions.identity import KeySchedule, keyed_id, suppressed_id, visitor_id
from sitepulse.params import site_id_valid
from sitepulse.schema import PAYLOAD, conform

#: Why requests are refused, in the order of the checks.
REASONS = ("origin", "empty", "too_long", "site_id", "rate", "bot")
KEYS = PAYLOAD.names


def parse_json(requests: DataFrame, column: str = "body") -> DataFrame:
    """The payload's keys as columns, from a JSON body."""
    own = [c for c in requests.columns if c != column]
    return requests.select(*own, F.from_json(column, PAYLOAD).alias("__p")).select(*own, "__p.*")


def _pixel(query: Column) -> dict[str, Column]:
    """The payload of a query string, where ``n`` may be missing: a pageview."""

    def value(name: str) -> Column:
        pairs = F.filter(F.split(query, "&"), lambda p: p.startswith(f"{name}="))
        return F.try_url_decode(F.substring(F.get(pairs, F.lit(0)), len(name) + 2, 1 << 30))

    none = {"p": "string", "ra": "double", "rc": "string"}
    found = {c: value(c) for c in ("d", "n", "u", "r", "w")}
    return found | {"n": F.coalesce(found["n"], F.lit("pageview")), "w": found["w"].try_cast("int")} | {c: F.lit(None).cast(t) for c, t in none.items()}


def parse_pixel(requests: DataFrame, column: str = "query") -> DataFrame:
    """The payload's keys as columns, from a pixel's query string."""
    own = [c for c in requests.columns if c != column]
    return requests.select(*own, *(v.alias(c) for c, v in _pixel(F.col(column)).items()))


def parse(requests: DataFrame) -> DataFrame:
    """Requests of both kinds with the payload's keys: of the query string where there is one, else of the body."""
    pixel = F.struct(*(v.alias(c) for c, v in _pixel(F.col("query")).items()))
    payload = F.when(F.col("query").isNotNull(), pixel).otherwise(F.from_json("body", PAYLOAD))
    own = [c for c in requests.columns if c not in KEYS]
    return requests.select(*own, payload.alias("__p")).select(*own, "__p.*")


def form_reason(config: EngineConfig) -> Column:
    """Why a request's form isn't taken, by the first check that fails, or null.  Lengths are in bytes."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return (
        F.when(~url.origin_allowed(F.col("origin"), config.allowed_sites), "origin")
        .when((size("d") == 0) | (size("n") == 0) | (size("u") == 0), "empty")
        .when((size("d") > 256) | (size("n") > 256) | (size("u") > 2048) | (size("r") > 2048) | (size("p") > 4096), "too_long")
        .when(~site_id_valid(F.col("d")), "site_id")
    )


def reject_reason(config: EngineConfig) -> Column:
    """Why a request isn't taken where no rate limit counts: its form, or that a bot sent it."""
    reason = form_reason(config)
    return F.coalesce(reason, F.when(useragent.is_bot(F.col("user_agent")), "bot")) if config.filter_bots else reason


def enrich(requests: DataFrame, config: EngineConfig, salt: str | KeySchedule, ranges: DataFrame | None = None) -> DataFrame:
    """Events from requests that have passed: payload keys, user_agent, x_forwarded_for, x_real_ip, received.

    ``salt``: a schedule, by which each request gets the salt of its day, or the salt of the one
    day that all are of.  ``ranges``: the places of addresses, without which they stay null.
    Addresses and user agents go no further than here.
    """
    config = config.resolved()
    ip = url.client_ip(F.col("x_forwarded_for"), F.col("x_real_ip"))
    rows = requests.withColumn("__addr", ip)
    by_day = isinstance(salt, KeySchedule) and not config.suppress_visitor_id
    if by_day:
        rows = salt.joined(rows)
    if ranges is not None and config.geoip_precision != "none":
        rows = locate(rows, ranges, "__addr", config.geoip_precision)
    place = {c: F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in ("country_code", "region", "city")}
    agent = F.coalesce(F.col("user_agent"), F.lit(""))
    if config.suppress_visitor_id:
        visitor = suppressed_id()
    else:
        visitor = keyed_id(F.col("__addr"), agent, F.col("__inner"), F.col("__outer")) if by_day else visitor_id(F.col("__addr"), agent, salt)
    parsed, hidden = useragent.user_agent(agent), F.lit(None).cast("string")
    referrer = url.strip_query(F.col("r")) if config.strip_referrer_query else F.col("r")
    utm = {name: url.utm(F.col("u"), name).alias(name) for name in url.UTM}
    return conform(
        rows.select(
            text.sanitize_string(F.col("d")).alias("site_id"),
            visitor.alias("visitor_id"),
            (text.round_to_hour(F.col("received")) if config.round_timestamps else F.date_trunc("second", "received").cast("timestamp_ntz")).alias("timestamp"),
            text.sanitize_string(F.col("n")).alias("event_name"),
            url.pathname(F.col("u")).alias("pathname"),
            text.sanitize_string(F.col("d")).alias("hostname"),
            text.sanitize_string(referrer, 2048).alias("referrer"),
            url.referrer_source(F.col("r")).alias("referrer_source"),
            *utm.values(),
            parsed["browser"].alias("browser"),
            (hidden if config.suppress_browser_version else parsed["browser_version"]).alias("browser_version"),
            parsed["os"].alias("os"),
            (hidden if config.suppress_os_version else parsed["os_version"]).alias("os_version"),
            (hidden if config.suppress_screen_size else useragent.device(F.col("w"))).alias("device_type"),
            (hidden if config.suppress_screen_size else F.col("w").cast("string")).alias("screen_size"),
            *(c.alias(name) for name, c in place.items()),
            text.sanitize_string(F.col("p"), 4096).alias("props"),
            F.col("ra").cast("decimal(12,2)").alias("revenue_amount"),
            text.sanitize_string(F.col("rc"), 3).alias("revenue_currency"),
        )
    )


def split(requests: DataFrame, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """(taken, refused with ``reject_reason``)"""
    judged = requests.withColumn("reject_reason", reject_reason(config))
    return judged.where("reject_reason IS NULL").drop("reject_reason"), judged.where("reject_reason IS NOT NULL")
