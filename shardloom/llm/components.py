"""Connected components of a table of links, as DataFrame rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.session import materialize


# Up to so many links, which each round counts, the smallest neighbours are sent to all tasks; more are joined by a shuffle.
BROADCAST_LINKS = 1_000_000


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); ``root`` is the smallest node of the component.

    Large-star and small-star rounds: each node hands its larger neighbours, then its smaller ones, to its smallest one.
    The number of rounds grows with the logarithm of the nodes. Minima combine before they shuffle, and the joins on
    a hot node are ordinary joins that Spark splits. Self links and repeated links do no harm; no links give no rows.
    """
    links = materialize(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "links")
    state = _state(links)
    while state[0]:
        sent = F.broadcast if state[0] <= BROADCAST_LINKS else lambda df: df
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(sent(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # A node's own link to its smallest one is a row of ``low``; only its other neighbours are joined, and none is copied.
        others = large.join(sent(low), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = low.select("u", F.col("m").alias("v")).union(others).distinct()
        links = materialize(small, "links")
        last, state = state, _state(links)
        if state == last:
            break
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
