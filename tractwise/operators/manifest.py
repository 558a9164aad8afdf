"""Fold manifests: which fold held which row out, with fingerprints that tell later whether that still describes anything."""

import hashlib
import inspect
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import splits

MIN_ROWS = 40


def split_code() -> str:
    """Digest of the code that places groups; other code means other folds, whatever the rows."""
    return hashlib.sha256("".join(inspect.getsource(f) for f in (splits.placements, splits.stratified_folds)).encode()).hexdigest()


def scratch(spark, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fingerprints(df: DataFrame, key: str, columns) -> DataFrame:
    """(key, n_rows, fingerprint): one digest per key, independent of the order of rows and changed by any of them.

    Row digests are added up as four wide whole numbers, so tasks combine them before anything is exchanged.
    """
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    piece = lambda i: F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    sums = df.select(key, F.sha2(text, 256).alias("_h")).groupBy(key).agg(F.count("*").alias("n_rows"), *[F.sum(piece(i)).alias(f"_s{i}") for i in range(4)])
    whole = F.concat_ws(":", F.col("n_rows").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(4)])
    return sums.select(key, "n_rows", F.sha2(whole, 256).alias("fingerprint"))


def build(rows: DataFrame, label: str, k: int = 5, least: int = MIN_ROWS, provenance: str = "reconstructed"):
    """(assignments, meta). rows: head, record_id, group_id and the label whose classes are spread evenly.

    Assignments hold one fold per row; meta one row per head with counts and fingerprints. Heads of fewer than
    `least` rows have neither. Provenance is what the writer claims: "historical" only from a training run.
    """
    sizes = rows.groupBy("head").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("head")
    rows = rows.join(F.broadcast(sizes), "head")  # one row per head
    placed = splits.stratified_folds(rows, "group_id", label, k, ["head"])
    held = rows.join(placed.select("head", "group_id", "fold"), ["head", "group_id"], "left").select("head", "record_id", "group_id", "fold")
    folds = placed.groupBy("head").agg(F.count("*").alias("n_groups"), (F.max("fold") + 1).alias("n_folds"))
    meta = fingerprints(rows, "head", ["record_id"]).withColumnRenamed("fingerprint", "rows_fingerprint").join(folds, "head")
    return held, meta.withColumns({"split_code": F.lit(split_code()), "claimed": F.lit(provenance)})


def write(held: DataFrame, meta: DataFrame, path: str) -> None:
    """One folder of rows per head, and the meta rows beside them."""
    held.write.mode("overwrite").partitionBy("head").parquet(f"{path}/folds")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def read(spark, path: str):
    return spark.read.parquet(f"{path}/folds"), spark.read.parquet(f"{path}/meta")


def states(meta: DataFrame, now: DataFrame) -> DataFrame:
    """Per head of `now` (head, fingerprint): historical, reconstructed, stale or missing, and whether it may clear a number.

    What the writer claimed counts only where rows and code are unchanged; anything absent or unequal fails closed.
    """
    recorded = meta.select("head", F.col("rows_fingerprint").alias("_then"), F.col("split_code").alias("_code"), "claimed")
    j = now.select("head", F.col("fingerprint").alias("rows_fingerprint")).join(recorded, "head", "left")
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    j = j.withColumns({"rows_match": same(F.col("_then"), F.col("rows_fingerprint")), "split_unchanged": same(F.col("_code"), F.lit(split_code()))})
    state = (F.when(F.col("_then").isNull(), "missing").when(~(F.col("rows_match") & F.col("split_unchanged")), "stale")
             .when(F.col("claimed") == "historical", "historical").otherwise("reconstructed"))
    return j.withColumn("state", state).withColumn("usable", F.col("state") == "historical").drop("_then", "_code")
