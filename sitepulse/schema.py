"""The event table, and the driver's events in its shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_REQUIRED = ("site_id", "visitor_id", "timestamp", "event_name", "pathname")
_COLUMNS = (
    "site_id visitor_id timestamp event_name pathname hostname referrer referrer_source utm_source utm_medium utm_campaign utm_content "
    "utm_term browser browser_version os os_version device_type screen_size country_code region city props revenue_amount revenue_currency"
).split()
_KINDS = {"timestamp": T.TimestampNTZType(), "revenue_amount": T.DecimalType(12, 2)}

#: The 25 columns of an event.
EVENT = T.StructType([T.StructField(c, _KINDS.get(c, T.StringType()), c not in _REQUIRED) for c in _COLUMNS])

#: The wire form of an event: short keys, and what the request's headers say.
PAYLOAD = T.StructType([T.StructField(c, t) for c, t in (*((c, T.StringType()) for c in "dnur"), ("w", T.IntegerType()), ("p", T.StringType()), ("ra", T.DoubleType()), ("rc", T.StringType()))])
#: A request as it was received: a JSON body or a pixel's query string, headers, and an id of the server's, which breaks ties of time.
REQUEST = T.StructType([T.StructField(c, T.StringType()) for c in ("body", "query", "origin", "user_agent", "x_forwarded_for", "x_real_ip", "request_id")] + [T.StructField("received", T.TimestampNTZType())])


def conform(df: DataFrame) -> DataFrame:
    """``df`` with exactly the 25 columns; those it lacks are null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT))


#: Columns of the driver's ``events`` as an event; text that Spark and DuckDB both read.
WEB_EVENT = {
    "event_id": "event_id",
    "site_id": "'site-' || CAST(user_id % 3 AS VARCHAR(9)) || '.example'",
    "visitor_id": "CAST(user_id AS VARCHAR(20))",
    "timestamp": "ts",
    "event_name": "CASE WHEN event_type = 'view' THEN 'pageview' ELSE event_type END",
    "pathname": "'/p/' || CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 10 AS VARCHAR(9))",
    "referrer_source": "CASE event_id % 5 WHEN 0 THEN 'Google' WHEN 1 THEN 'Bing' WHEN 2 THEN 'Twitter' WHEN 3 THEN 'blog.example' END",
    "browser": "CASE event_id % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Firefox' WHEN 2 THEN 'Safari' END",
    "os": "CASE event_id % 6 WHEN 0 THEN 'Windows' WHEN 1 THEN 'macOS' WHEN 2 THEN 'Linux' WHEN 3 THEN 'iOS' WHEN 4 THEN 'Android' END",
    "device_type": "CASE event_id % 7 WHEN 0 THEN 'mobile' WHEN 1 THEN 'tablet' WHEN 2 THEN 'desktop' WHEN 3 THEN 'desktop' END",
    "country_code": "CASE event_id % 8 WHEN 0 THEN 'DE' WHEN 1 THEN 'FR' WHEN 2 THEN 'US' WHEN 3 THEN 'JP' WHEN 4 THEN 'BR' END",
    "revenue_amount": "CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(12, 2)) END",
}


def web_events(events: DataFrame) -> DataFrame:
    """The driver's events as events, with ``event_id`` to break ties."""
    return events.select(*(F.expr(text).alias(f"`{name}`".strip("`")) for name, text in WEB_EVENT.items()))


def web_events_sql() -> str:
    columns = ", ".join(f'{text} AS "{name}"' for name, text in WEB_EVENT.items())
    return f"SELECT {columns} FROM events"
