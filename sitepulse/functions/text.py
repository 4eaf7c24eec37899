"""Text and time functions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sanitize_string(text: Column, longest: int = 256) -> Column:
    """Without control characters, then the first ``longest`` characters."""
    return F.substring(F.regexp_replace(text, r"\p{Cc}", ""), 1, longest)


def round_to_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def csv_field(text: Column) -> Column:
    """Quoted, quotes doubled, and with ' before a sign that a spreadsheet takes for a formula."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""'))
    guard = F.when(doubled.rlike(r"^[=+\-@]"), F.lit("'")).otherwise(F.lit(""))
    return F.concat(F.lit('"'), guard, doubled, F.lit('"'))


def anonymize_ip(ip: Column) -> Column:
    """For logs: the last part of a v4 address, all but the first group of a v6 one, left out."""
    v4 = F.regexp_extract(ip, r"^([^.:]*\.[^.:]*\.[^.:]*)\.[^.:]*$", 1)
    return (
        F.when(F.contains(ip, F.lit(":")), F.concat(F.substring_index(ip, ":", 1), F.lit(":...")))
        .when(v4 != "", F.concat(v4, F.lit(".x")))
        .otherwise(F.lit("?.?.?.x"))
    )


def hash_api_key(key: Column) -> Column:
    return F.sha2(key, 256)
