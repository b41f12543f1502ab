"""What the training-data operators share: shipping, global order, prefix sums, components.

Wherever rows need a place in one global order, they are dealt out by range, written with the number of
their range (a bucket of about equal size, whatever key is hot), and summed up bucket by bucket. No
window ever runs over a hot source, host or group of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

# Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# Rows of a checked table that may be sent to every task (8 to 16 bytes each, so 64 MB at most).
BROADCAST_ROWS = 4_000_000


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Rows of a narrow table that one file of a stage holds.
FILE_ROWS = 1_000_000


def cut(table: DataFrame, at_most: int) -> DataFrame:
    """Write a narrow table that has at most so many rows, in files of about ``FILE_ROWS`` rows."""
    return cut_lineage(table.coalesce(max(1, -(-at_most // FILE_ROWS))))


def small(table: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if its counted rows are few; else as it is (shuffled)."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def ranged(rows: DataFrame, *keys: Column) -> DataFrame:
    """Rows dealt out by key range and written, with the range's number in ``_bucket``."""
    spark = rows.sparkSession
    return cut_lineage(rows.repartitionByRange(tasks(spark), *keys).withColumn("_bucket", F.spark_partition_id()))


def numbered(rows: DataFrame, within: list[str], order: list[Column], into: str) -> DataFrame:
    """1-based place of each ``ranged`` row in the order, per group; groups must lead the range keys."""
    keys = [*within, "_bucket"]
    before = W.partitionBy(*within).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = cut(counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")), rows.count())
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return (rows.withColumn("_inside", inside).join(offsets, keys)
            .withColumn(into, F.col("_inside") + F.col("_offset")).drop("_inside", "_offset", "_bucket"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes that have an edge (a, b).

    Alternating large-star and small-star steps over a written edge table until every tree is a star. A
    step takes a minimum per node, so a node with very many edges is combined before the shuffle. No
    step makes more edges than it was given, so the written tables shrink from round to round.
    """
    now = cut_lineage(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        size = now.count()
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), 2 * size)
        # large star: every larger neighbour is hung below the smallest one
        large = cut(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct(), size)
        # small star: a node's smaller neighbours are hung below the smallest of them
        low = cut(large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n")), size)
        tops = low.select(F.col("m").alias("b")).distinct()
        if low.where("n > 1").isEmpty() and low.join(tops, "b", "leftsemi").isEmpty():
            stars = low.select(F.col("b").alias("node"), F.col("m").alias("component"))
            return cut(stars.unionAll(tops.select(F.col("b").alias("node"), F.col("b").alias("component"))), 2 * size)
        hung = large.join(low, "b").select("m", F.explode(F.array("a", "b")).alias("b"))
        now = cut(hung.where("m < b").select(F.col("m").alias("a"), "b").distinct(), 2 * size)
