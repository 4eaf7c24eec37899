"""A token bucket for each site: ``capacity`` tokens, as many again each second, one for a request; full at first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE = "tokens double, refilled double"
IDLE_SECONDS = 300


def take(tokens: float, refilled: float, now: float, capacity: float) -> tuple[float, bool]:
    """(tokens left, whether the request is allowed)"""
    tokens = min(capacity, tokens + (now - refilled) * capacity)
    return (tokens - 1, True) if tokens >= 1 else (tokens, False)


def limit(requests: DataFrame, capacity: int, site_col: str = "site_id", time_col: str = "timestamp", tie: str | None = None, buckets: DataFrame | None = None) -> DataFrame:
    """``requests`` with ``allowed``, each site's in the order of time; 0 allows all.

    A task streams through its sorted rows and holds one bucket, however many rows a site has.
    buckets: (site, tokens, refilled) from which sites go on; then rows also have their site's
    bucket after them, and ``turn``, their place among the site's.  A request that's older than its bucket counts as of that moment.
    """
    schema = T.StructType([*requests.schema.fields, T.StructField("allowed", T.BooleanType())])
    carry = buckets is not None
    if carry:
        own = buckets.select(F.col("site").alias(site_col), F.col("tokens").alias("tokens_before"), F.col("refilled").alias("refilled_before"))
        requests = requests.join(own, site_col, "left")
        schema = T.StructType([*schema.fields, *(T.StructField(c, t) for c, t in (("tokens", T.DoubleType()), ("refilled", T.DoubleType()), ("turn", T.LongType())))])
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site, tokens, refilled, turn = None, 0.0, 0.0, 0
        for rows in batches:
            found = []
            before = zip(rows["tokens_before"].tolist(), rows["refilled_before"].tolist()) if carry else [(None, None)] * len(rows)
            for own, at, (left, since) in zip(rows[site_col].tolist(), (rows[time_col].astype("int64") / (1e9 if rows[time_col].dtype == "datetime64[ns]" else 1e6)).tolist(), before):
                if own != site:
                    site, turn = own, 0
                    tokens, refilled = (left, since) if left is not None and left == left else (float(capacity), at)
                now = max(at, refilled)
                tokens, ok = take(tokens, refilled, now, capacity) if capacity else (tokens, True)
                refilled, turn = now, turn + 1
                found.append((ok, tokens, refilled, turn))
            allowed, *state = zip(*found) if found else ((), (), (), ())
            out = rows.assign(allowed=list(allowed))
            if carry:
                out = out.assign(**{c: list(v) for c, v in zip(("tokens", "refilled", "turn"), state)})
            yield out[names]

    order = [F.col(site_col), F.col(time_col).asc_nulls_last() if carry else F.col(time_col), *([F.col(tie)] if tie else [])]
    return requests.repartition(site_col).sortWithinPartitions(*order).mapInPandas(run, schema)
