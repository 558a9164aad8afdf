"""Two-axis ranking of variants: structural change and regulatory score, kept apart until both exist."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered

HIGH = 0.75


def midrank(df: DataFrame, value: str, name: str, keys=()) -> DataFrame:
    """(below + half of equal) / present, to four places; absent stays absent; a single present value ranks 1."""
    ranks = ordered.value_ranks(df, value, keys)
    share = F.when(F.col("total") < 2, F.lit(1.0)).otherwise(F.round((F.col("below") + F.col("n") / 2) / F.col("total"), 4))
    return df.join(ranks.select(*keys, value, share.alias(name)), [*keys, value], "left")


def percentile_rank(df: DataFrame, value: str, name: str, keys=()) -> DataFrame:
    """Average-tie rank over count."""
    ranks = ordered.value_ranks(df, value, keys).select(*keys, value, (ordered.average_rank() / F.col("total")).alias(name))
    return df.join(ranks, [*keys, value], "left")


def quadrants(df: DataFrame, keys=(), structural_threshold=None, regulatory_threshold=None) -> DataFrame:
    """Quadrant, combined rank and reason of rows with `magnitude`, `motif_state` and `reg` (|score|).

    A lost motif is structurally highest without inventing a number; a row with
    one axis missing is unclassified, not low.
    """
    df = midrank(midrank(df, "magnitude", "structural_rank", keys), "reg", "regulatory_rank", keys)
    lost = F.coalesce(F.col("motif_state") == "motif_lost", F.lit(False))
    df = df.withColumn("structural_rank", F.when(lost, F.lit(1.0)).otherwise(F.col("structural_rank")))
    both = (F.col("magnitude").isNotNull() | lost) & F.col("reg").isNotNull()
    high = lambda value, rank, bound: (F.col(value) >= bound) if bound is not None else (F.coalesce(F.col(rank), F.lit(0.0)) >= HIGH)
    s_hi = lost | F.coalesce(high("magnitude", "structural_rank", structural_threshold), F.lit(False))
    r_hi = high("reg", "regulatory_rank", regulatory_threshold)
    quadrant = (F.when(~both, "unclassified").when(s_hi & r_hi, "both").when(s_hi, "structural_only")
                .when(r_hi, "regulatory_only").otherwise("neither"))
    reason = (F.when(~both, F.when(F.col("magnitude").isNull(), "no_structural_delta").otherwise("no_regulatory_record"))
              .when(lost, "motif_lost"))
    combined = F.when(both, F.round(F.least(F.coalesce("structural_rank", F.lit(0.0)), F.coalesce("regulatory_rank", F.lit(0.0))), 4))
    return df.withColumns({"quadrant": quadrant, "quadrant_reason": reason, "combined_rank": combined})
