"""Connected components of links that are spread over the cluster, by alternating large and small stars.

Both steps take the least neighbour by an aggregate that combines in the map tasks, then join it to the
links, so a node with very many links is split by the join. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import scratch_path

#: Links in a file, and so in a task, at least, where there are that many.
LINKS = 200_000


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``links`` (two columns ``a``, ``b``); the root is the least node of its component.

    Links to itself, repeated and reversed links change nothing; a link with a null is no link. A root
    stands in the result too. No links: an empty result.
    """
    spark = links.sparkSession

    def written(df: DataFrame, links: int | None = None) -> DataFrame:
        path = scratch_path(spark, "links")
        (df if links is None else df.coalesce(1 + links // LINKS)).write.parquet(path)  # few links: few files, in the shuffles that read them too
        return spark.read.parquet(path)

    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen or not mark.n:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, mark.n)
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), mark.n)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
