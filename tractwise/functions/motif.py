"""Tract-loop motif grammar as regular expressions and the column expressions built on them.

A left-to-right scan that skips overlapping hits is exactly what plain regular
expression matching does, so counting and listing hits need no position loop.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tract_pattern(base: str, tract: str = "{3}", max_loop: int = 7, min_loop: int = 1, letter: str = "[ACGT]") -> str:
    t, loop = f"{base}{tract}", f"{letter}{{{min_loop},{max_loop}}}"
    return t + (loop + t) * 3


# exact-length tracts, the grammar of single sequences
PATTERN = {"G4": tract_pattern("G", max_loop=7), "iM": tract_pattern("C", max_loop=12)}
# tracts of three or more, the grammar of genome scans
GENOME_PATTERN = {"G4": tract_pattern("G", "{3,}", 7), "iM": tract_pattern("C", "{3,}", 12)}
BASE = {"G4": "G", "iM": "C"}


def motif_count(s, kind: str) -> Column:
    """Non-overlapping hits on the given strand."""
    return F.regexp_count(s, F.lit(PATTERN[kind])).cast("bigint")


def has_motif(s, kind: str) -> Column:
    s = F.col(s) if isinstance(s, str) else s
    return s.rlike(PATTERN[kind])


def hits(s, pattern: str, overlapping: bool = False) -> Column:
    """array<struct<start, text>> of hits, 0-based, left to right.

    Splitting at the (zero-width) hits gives the distances between them; one
    sentinel character keeps a hit at position 0 apart from no hit.
    """
    s = F.col(s) if isinstance(s, str) else s
    cut = f"(?={pattern})" if overlapping else pattern
    texts = F.regexp_extract_all(s, F.lit(f"(?=({pattern}))" if overlapping else f"({pattern})"), 1)
    # one walk over (distance, hit) pairs: neither expression is repeated per hit
    pairs = F.arrays_zip(F.split(F.concat(F.lit("#"), s), cut).alias("gap"), texts.alias("text"))
    none = F.array().cast("array<struct<start:bigint,text:string>>")

    def step(acc, p):
        start = acc["pos"] + F.length(p["gap"])
        after = start if overlapping else start + F.coalesce(F.length(p["text"]), F.lit(0))
        return F.struct(after.cast("bigint").alias("pos"),
                        F.concat(acc["hits"], F.array(F.struct(start.cast("bigint").alias("start"), p["text"].alias("text")))).alias("hits"))

    first = F.struct(F.lit(-1).cast("bigint").alias("pos"), none.alias("hits"))
    return F.filter(F.aggregate(pairs, first, step)["hits"], lambda h: h["text"].isNotNull())


def with_tract_parts(df: DataFrame, s: str, base: str, min_tract: int = 3, max_loop: int = 12) -> DataFrame:
    """Append _r (runs), _g (gaps; _g[i] precedes _r[i]) and _at, the first admissible four-run window.

    _at is null below four runs and 0 when no window has all three loops within the bound.
    """
    pattern = f"{base}{{{min_tract},}}"
    df = df.withColumns({"_r": F.regexp_extract_all(s, F.lit(f"({pattern})"), 1), "_g": F.split(s, pattern)})
    fits = lambda i, d: F.length(F.get("_g", i + d)).between(1, max_loop)
    first = F.get(F.filter(F.sequence(F.lit(0), F.greatest(F.size("_r") - 4, F.lit(0))),
                           lambda i: fits(i, 1) & fits(i, 2) & fits(i, 3)), F.lit(0))
    return df.withColumn("_at", F.when(F.size("_r") >= 4, F.coalesce(first, F.lit(0))))
