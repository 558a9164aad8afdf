"""Connected components by alternating large-star and small-star steps over tables in the shared folder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of links (a, b); both are longs.

    A node with many links only ever meets one number, its smallest neighbour, which is found by aggregation; the
    join that hands it out has one row per node on that side, so a hot node is split like any skewed join.
    """
    edges = stored(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        following = stored(small, "small-star")
        now = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(edges)
        dropped(large)
        edges = following
        if now == before:
            break
        before = now
    # every edge now points at the smallest node of its component
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


SALT_ROWS = 2_000  # members compared with one left side in one group


def paired(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (a, salt, b, text) sorted for streaming: per a and salt, first the text of a (b null), then those of its b.

    The pairs of one a are dealt over as many salts as their number demands, and a task holds one text of a at a time.
    texts: id, text.
    """
    salted = pairs.select("a", "b").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(1 << 20)))
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(SALT_ROWS)).cast("long").alias("parts"))
    salted = salted.join(parts, "a").withColumn("salt", F.pmod("salt", F.col("parts"))).select("a", "salt", "b")
    left = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
    left = left.join(texts, left.a == texts.id).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    right = salted.join(texts, salted.b == texts.id).select("a", "salt", "b", "text")
    rows = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return rows.select("a", "salt", "b", "text")
