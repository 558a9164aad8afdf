"""Cleaning pipeline over `documents`: each stage works on what the stage before it kept.

Stages name documents by doc_id. A document goes when any row of its doc_id is rejected; null doc_ids are never
rejected by name. Verdicts are narrow tables of ids, so that text is not exchanged where their counted number is small.
"""

from pyspark.sql import functions as F

from tractwise.llm import common, decontaminate, lines, mixing, neardup, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
IDS_BOUND = 500_000  # rejected ids that may be broadcast


def _without(docs, rejected):
    """docs but for the ids in `rejected` (column doc_id)."""
    ids = rejected.select(F.col("doc_id").cast("long").alias("gone")).where("gone is not null").distinct()
    ids = common.small(common.stored(ids, "rejected"), IDS_BOUND)
    return docs.select(*COLUMNS).join(ids, F.col("doc_id") == F.col("gone"), "left_anti")


def quality_stage(spark, docs, sf_dir):
    """Documents that the base rules or the distance to their language reject go."""
    return _without(docs, quality.quality_rules(docs).where("not kept"))


def line_stage(spark, docs, sf_dir):
    """Lines close to an earlier line go; so do documents that lose all their words with them."""
    cleaned = lines.without_lines(docs.select(*COLUMNS))
    lost = (F.col("line_dedup.n_removed") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    changed = F.when(F.col("line_dedup.n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.where(~lost).withColumn("n_chars", changed).select(*COLUMNS)


def near_duplicate_stage(spark, docs, sf_dir):
    """Of each group of documents at similarity 0.8 on five-word shingles, the one of the smallest doc_id stays."""
    return _without(docs, neardup.near_duplicates(docs, k=5).where("not kept"))


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold a benchmark item, or a paraphrase of one with its answer, go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.matches(docs, items))


def mixing_stage(spark, docs, sf_dir):
    """The documents that the mix takes, with their number of copies."""
    taken = mixing.mix(docs.select(*COLUMNS), carry=["text", "lang", "source", "n_chars"]).where("taken > 0")
    return taken.select(*COLUMNS, "size", "taken", "copies")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

# line distance, similarity and the filling of budgets cannot be stated together in SQL; see tests/llm/test_pipeline.py
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stored(docs, "pipeline")
    return docs
