"""Connected components of links by alternating stars; each round is a shuffle of the links that are left, written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, stored


def _least(links: DataFrame) -> DataFrame:
    """u and m: the least of u and its partners v; summed up in each task before the shuffle. Written, so that a join can split a hot u."""
    return stored(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))


def large_star(links: DataFrame) -> DataFrame:
    """Each node's greater partners are linked to its least partner."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Each node and its lesser partners are linked to the least of them. ``links`` have a > b."""
    down = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    joined = down.join(_least(down), "u")
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(joined.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and component, the least node that it is connected with, of every node in ``links`` (a, b; any order, repeats allowed) that isn't the least itself."""
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not links.isEmpty():
        large = stored(large_star(links))
        fresh = stored(small_star(large))
        # both sets are distinct: they are equal if as many, and none is new
        done = fresh.count() == links.count() and fresh.join(links, ["a", "b"], "left_anti").isEmpty()
        dropped(large), dropped(links)
        links = fresh
        if done:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
