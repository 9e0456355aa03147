"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, m, busy): smallest of each node and its neighbours; busy unless the node is the root or a leaf of a star."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    below, above = F.when(F.col("v") < F.col("u"), F.col("v")), F.when(F.col("v") > F.col("u"), F.col("v"))
    ends = both.groupBy("u").agg(F.min(below).alias("low"), F.max(below).alias("next"), F.max(above).alias("above"))
    busy = F.coalesce(F.col("low") < F.col("next"), F.lit(False)) | (F.col("low").isNotNull() & F.col("above").isNotNull())
    return ends.select("u", F.coalesce("low", "u").alias("m"), busy.alias("busy"))


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest id reachable from each id that has a link.

    ``links`` has columns ``a``, ``b``; direction, repetition and self links don't
    matter, null ends are dropped. Returns (id, component); an empty table gives none.
    Each round hangs neighbours on the smallest neighbour (larger ones, then smaller
    ones with the node itself), a logarithmic number of rounds on chains as on stars, until
    stars alone are left; every round is written to the shared folder. Minima are combined before they are
    shuffled, and the joins are plain inner joins, so that a node with very many links
    is split among tasks.
    """
    clean = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = materialize(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        lowest = materialize(_lowest(edges), "lowest")
        if not lowest.agg(F.max("busy").alias("busy")).first()["busy"]:
            return lowest.select(F.col("u").alias("id"), F.col("m").alias("component"))
        # links aren't distinct in between: they are as many as before
        large = edges.withColumnRenamed("u", "larger").join(lowest.select(F.col("u").alias("v"), "m"), "v").select(F.col("larger").alias("u"), F.col("m").alias("v"))
        large = materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
