"""Connected components of a table of links, by alternating stars; every step is a grouping and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import common


def components(links: DataFrame, folder: str) -> DataFrame:
    """(id, component) of every end of links (a, b): component is the smallest id that links reach.

    Links may repeat, point either way or join an id to itself; none gives an empty table. Each round points every id
    to the smallest id near it, first for larger neighbours, then for smaller ones; ids end up one step from their
    component's smallest after a number of rounds that grows with the logarithm of the longest path.
    """
    known = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct()
    known, state, k = common.written(known, f"{folder}/links-0"), None, 0
    while True:
        both = known.unionByName(known.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        near = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        large = both.filter("lo > hi").join(near, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        k += 1
        new = common.written(small.unionByName(least.withColumnRenamed("m", "lo")).distinct(), f"{folder}/links-{k}")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            break
        if k > 1:
            common.remove(links.sparkSession, f"{folder}/links-{k - 2}")
        known, state = new, now
    return new.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(new.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
