"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import remove, stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """``(node, root)`` for every node with a link to another; root is the smallest node of its component.

    ``links`` has two columns of longs.  Links from a node to itself and repeated links change nothing; no links give no rows.  ``rows``
    is the most links there can be, if known.  Each
    step joins tables read from the shared folder, so that Spark can split a node with a large share of the links; the number of steps grows with the logarithm of the longest chain."""
    a, b = links.columns
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges = stored(pairs, "links", rows)
    state = _state(edges)
    while state[0]:
        lows = stored(edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")), "lows", state[0])
        large = edges.join(lows, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        large = stored(large, "large", state[0])
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least", state[0])
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        after = stored(small, "small", 2 * state[0])
        remove(edges, lows, large, least)
        edges, before, state = after, state, _state(after)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
