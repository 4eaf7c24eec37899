"""Pseudonymous visitor ids: HMAC-SHA256 of address and user agent under a salt that changes daily."""

from __future__ import annotations

import hashlib
import hmac
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
CONTEXT = "sitepulse-visitor-salt"


def daily_salt(secret: str, day: date, context: str = CONTEXT) -> str:
    """64 hex digits, made at the driver; the secret never enters a plan.  ``context`` tells deployments apart."""
    return hmac.new(context.encode(), f"{secret}:{day.isoformat()}".encode(), hashlib.sha256).hexdigest()


def pads(salt: str) -> tuple[bytes, bytes]:
    """Inner and outer key of the HMAC under a salt, each as long as the hash's block."""
    key = salt.encode()
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def keyed_id(ip: Column, user_agent: Column, inner: Column, outer: Column) -> Column:
    """Hex HMAC of ``ip|user_agent`` under given keys, in native functions."""
    message = F.concat(ip, F.lit("|"), F.coalesce(user_agent, F.lit(""))).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def visitor_id(ip: Column, user_agent: Column, salt: str) -> Column:
    """The same under one salt, whose keys are literals."""
    inner, outer = pads(salt)
    return keyed_id(ip, user_agent, F.lit(inner), F.lit(outer))


class KeySchedule:
    """A salt for each day, made from a secret that stays at the driver; plans see the keys of the days that they need only.

    The days of some requests are found by one aggregation, so a stream that asks for each of
    its batches changes salts at midnight, and a batch over many days gives each its own.
    """

    def __init__(self, secret: str, context: str = CONTEXT):
        self._secret, self._context = secret, context

    def __repr__(self) -> str:
        return "KeySchedule(...)"

    def salt(self, day: date) -> str:
        return daily_salt(self._secret, day, self._context)

    def days(self, at: Column) -> Column:
        """The day that a time is of; a missing time has one of its own."""
        return F.coalesce(F.to_date(at), F.lit(date(1970, 1, 1)))

    def joined(self, requests: DataFrame, at: str = "received", inner: str = "__inner", outer: str = "__outer") -> DataFrame:
        """``requests`` with the keys of their days; a row for each day is sent to all."""
        days = [r.d for r in requests.select(self.days(F.col(at)).alias("d")).distinct().collect()]
        table = requests.sparkSession.createDataFrame([(d, *pads(self.salt(d))) for d in days], f"__day date, {inner} binary, {outer} binary")
        return requests.withColumn("__day", self.days(F.col(at))).join(F.broadcast(table), "__day", "left").drop("__day")


def suppressed_id() -> Column:
    """A random id for each event."""
    return F.uuid()
