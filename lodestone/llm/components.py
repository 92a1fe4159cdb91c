"""Connected components of a table of links, by stars that grow and shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, keep_table


def star(links: DataFrame, large: bool) -> DataFrame:
    """Join every node's neighbours, the larger ones or those not larger, to the least of its neighbours and itself."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if large else both.filter("v < u")
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")).withColumnRenamed("u", "of")
    joined = around.join(least, F.col("u") == F.col("of"))
    if large:
        found = joined.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        found = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).union(least.select(F.col("of").alias("u"), F.col("least").alias("v")))
    return found.filter("u <> v").distinct()


def components(links: DataFrame, name: str) -> DataFrame:
    """node, root: the least node that ``links(u, v)`` lead to.  Nodes that are their own root are left out.

    Each round is written to the shared folder; the driver sees a count and a sum of hashes, which tell that nothing changed.
    """
    now = keep_table(links.filter("u <> v").distinct(), name)
    before = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or mark[0] == 0:
            found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            found.kept_at = now.kept_at
            return found
        before = mark
        large = keep_table(star(now, True), name)
        small = keep_table(star(large, False), name)
        forget(now, large)
        now = small
