"""Queries of benchmark decontamination and the quality classifier."""

from . import decontaminate, perplexity
from .registry import query, table


@query("op3_decontamination")
def op3(spark, folder):
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_kneser_ney_quality")
def op7(spark, folder):
    return perplexity.quality_by_perplexity(table(spark, folder, "documents"), table(spark, folder, "labels"))
