"""Connected components of a link table by alternating star contractions.

Every round is two joins with an aggregated minimum; a node with very many links is pre-aggregated before the shuffle
and its join partitions can be split. Each round is written to the shared folder, so the lineage stays short and a lost
executor costs one round. Nothing but two counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """`links` has two id columns. Returns (id, component) for every id that is linked to another one; component is the
    least id that can be reached. Links to itself, repeated links and null ids are ignored."""
    a, b = links.columns[:2]
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("k"), F.col(b).alias("z"))
        .where("k and z is not null and u <> v").select("u", "v").distinct()
    )
    edges = scratch.keep(edges, f"{name}-0")
    step, before = 0, None
    while True:
        tally = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tally == before or tally[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        before, step = tally, step + 1
        edges = scratch.keep(_small_star(scratch.keep(_large_star(edges), f"{name}-{step}a")), f"{name}-{step}")
        scratch.drop(f"{name}-{step}a", f"{name}-{step - 1}")
