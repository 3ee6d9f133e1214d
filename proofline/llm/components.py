"""Connected components of a link table, without gathering links anywhere.

Alternating large-star and small-star rounds (Kiveris et al., 2014): each round rewires
links towards the smallest neighbour by one algebraic ``min`` and one join, and never makes
more links than there are. It ends when a round changes nothing; every component is then a
star around its smallest node.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import shared_dir


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    low = low.select("a", F.least("a", "m").alias("m"))
    return (both.join(low, "a").where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(e: DataFrame) -> DataFrame:
    # a > b in every link here
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    near = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(low.select("a", F.col("m").alias("b"))).distinct()


def _state(e: DataFrame):
    return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of a link: ``component`` is the smallest node that
    links reach. ``edges`` has two columns of one integer type; direction, repeats and self
    links do not matter; a link with a null end is ignored. No links: no rows."""
    shared_dir(edges.sparkSession)
    a, b = edges.columns
    e = (edges.where(F.col(a) != F.col(b))
         .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct().checkpoint())
    before = _state(e)
    while before[0]:
        e = _small_star(_large_star(e)).checkpoint()
        now = _state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
