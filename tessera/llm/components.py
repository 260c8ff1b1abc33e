"""Connected components of a table of links, by large and small stars, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import written


#: Links in a file of a round's table: later rounds have no more links than the one before, and need no more files.
FILE_ROWS = 20_000


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node that it is connected with) of every node of links (a, b) that isn't a root itself.

    Each round links every node's larger neighbours to its smallest one, then its smaller neighbours
    likewise; the table of links shrinks to stars around the roots, in rounds that grow with the logarithm of the nodes' number. Each round is written, so a lost
    executor costs one round at most. The driver gets two numbers a round.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    pairs, before, width = written(pairs, "links"), None, None
    while True:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct()
        pairs = written(small if width is None else small.coalesce(width), "stars")
        row = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if (row.n, row.s) == before:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before, width = (row.n, row.s), row.n // FILE_ROWS + 1
