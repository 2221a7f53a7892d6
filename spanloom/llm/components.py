"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    return row[0], row[1] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """Nodes (bigint) and the smallest node that each reaches, from edges (u, v).

    Rows: node and root, one for every node of an edge; nodes without edges don't occur. Loops and repeated edges are
    harmless, an edge with a null end is none, and no edges give no rows.

    Alternates the large-star and small-star steps, which point a node's neighbours at its smallest one, until the
    edges are stars; rounds grow with the logarithm of the longest path. Minima are combined before the shuffle and each round is
    written to the shared folder, so neither a hub's neighbours nor the lineage pile up anywhere.
    """
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u is not null and v is not null and u <> v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = stored(small.filter("u <> v").distinct(), "edges")
        if (now := _state(edges)) == state:
            break
        state = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
