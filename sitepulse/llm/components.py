"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitepulse.llm.common import written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 24)).alias("h")).first()
    return row.n, row.h or 0


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node u (large: the greater ones; small: u and the smaller ones) to the least of them and u.

    ``edges`` has u > v.  The least neighbour is a partial aggregate, and a node with very many
    neighbours stands on the side of the join that can be split.
    """
    around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = around.join(least, "u")
    if large:
        new = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return new.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v) that aren't the least of their component, which is ``component``.

    Null ends and loops are ignored; repeated links count once; no links give no rows.
    Every round is written to the shared folder.
    """
    clean = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = written(clean, "links")
    state = _state(current)
    while True:
        after = written(_stars(_stars(current, True), False), "links")
        new = _state(after)
        if new == state:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        current, state = after, new
