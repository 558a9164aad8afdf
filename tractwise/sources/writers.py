"""Sinks: resumable per-chromosome tables, CSV export with a run record, quarantine."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(df: DataFrame, done: DataFrame, part: str = "chrom") -> DataFrame:
    """Rows of partitions that hold nothing yet; an empty partition does not count as done."""
    return df.join(done.select(part).distinct(), part, "left_anti")


def write_resumable(df: DataFrame, path: str, part: str = "chrom") -> DataFrame:
    """Append only the partitions that are still missing under `path`; returns the rows written."""
    spark = df.sparkSession
    try:
        df = pending(df, spark.read.parquet(path), part)
    except Exception as exc:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
            raise
    df.write.mode("append").partitionBy(part).parquet(path)
    return df


def flat_export(df: DataFrame, columns) -> DataFrame:
    """Text columns in a fixed order; an absent number is blank, never zero."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns, record: DataFrame):
    flat_export(df, columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    record.write.mode("overwrite").json(path.rstrip("/") + ".run")


def run_record(df: DataFrame, settings: dict, defaulted, excluded) -> DataFrame:
    """One row beside a result: what ran, on how many rows, what was defaulted and what was left out."""
    return df.agg(F.count("*").alias("n_in"), F.count_if(excluded).alias("n_excluded"), F.count_if(F.size(defaulted) > 0).alias("n_defaulted")).withColumn(
        "settings", F.lit(json.dumps(settings, sort_keys=True)))


def quarantine(candidates: DataFrame, known: DataFrame, key: str, source: str) -> DataFrame:
    """Candidate sequences the table does not hold, one row each, their sources joined."""
    new = candidates.where(F.col(key).isNotNull()).join(known.select(key).distinct(), key, "left_anti")
    n = new.groupBy(key).agg(F.count("*").alias("n_rows"))
    names = new.select(key, source).distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(source)), ";").alias("sources"))
    return n.join(names, key)
