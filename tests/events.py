"""Small events for tests."""

from datetime import datetime

COLUMNS = "event_id long, site_id string, visitor_id string, timestamp timestamp_ntz, event_name string, pathname string, browser string, referrer_source string"
SITE = "example.com"


def at(text):
    return datetime.fromisoformat(text if len(text) > 10 else f"2024-01-15 {text}")


def events(spark, rows, site=SITE):
    """rows: (visitor, time or timestamp, event, path[, browser])"""
    full = [(i, site, r[0], at(r[1]), r[2], r[3], r[4] if len(r) > 4 else None, None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)
