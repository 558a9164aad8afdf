"""Mixing sources to target weights by fitting each source's word budget with whole documents.

A source is first taken in proportion from every document length; what is left of its budget is filled largest length
first down to a window, and the window by bounded-knapsack dynamic programming over the counts of lengths. Which
documents of a length are taken is decided by a seeded hash. Only (source, length) counts reach the fitting, one row
per distinct length, and a group is cut by hash buckets, so no task ever orders a whole source.

Defined results. Null text or no words: size 0, never taken. Null source: a source of its own, last. Null doc_id and
repeated rows: rows of their own; equal rows may get different counts, whose sum is fixed. Empty table: no rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5      # words of the mix over words of all documents
CAP = 2          # most copies of a document, and of a source's words
SEED = 17
WINDOW = 16_384  # words of a budget that dynamic programming fits; more is filled before


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """Append target to (source, source_size): shares by weight, cut at cap x size, the excess dealt again by weight.

    Weights follow the order of source names, null last. Only the level of the dealing, one number, is held outside.
    """
    ordered = sources.orderBy(F.asc_nulls_last("source"))
    ranked = ordered.rdd.zipWithIndex().map(lambda x: (x[0]["source"], x[0]["source_size"], x[1]))
    ranked = stored(sources.sparkSession.createDataFrame(ranked, "source string, source_size long, rank long"), "sources")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int"))
    ranked = ranked.withColumn("weight", weight)
    most = F.lit(float(cap)) * F.col("source_size")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, found = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > most
        held, free, n = ranked.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if n == found or not free:
            break
        level, found = (total - (held or 0.0)) / free, n
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), most)).drop("rank", "weight")


def fit(lengths, counts, budget: int, window: int = WINDOW):
    """How many documents of each length (ascending, positive) to take so that their words come closest to budget.

    Documents taken in proportion go back into the budget until it holds `window` words, so that sums of whole
    documents on either side of it are in reach; of two equally near ones the smaller is taken.
    """
    lengths, counts = [int(x) for x in lengths], [int(x) for x in counts]
    total = sum(n * c for n, c in zip(lengths, counts))
    budget = min(int(budget), total)
    take = [c * budget // total if total else 0 for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take))
    for i in reversed(range(len(lengths))):
        more = min(counts[i] - take[i], max(0, left - window) // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    share = window // max(1, len(lengths))
    for part in (share, window):  # first a little of every length, then whatever there is
        for i in range(len(lengths)):
            back = min(take[i], max(1, part // lengths[i]), -(-max(0, window - left) // lengths[i]))
            take[i] -= back
            left += back * lengths[i]
    top = left + (lengths[-1] if lengths else 0)
    parts = []  # (words, index, copies): counts as powers of two
    for i, n in enumerate(lengths):
        free, k = min(counts[i] - take[i], top // n), 1
        while free > 0:
            k = min(k, free)
            parts.append((n * k, i, k))
            free, k = free - k, 2 * k
    first = np.full(top + 1, -1, dtype=np.int32)  # part with which a sum is first reached
    reached = np.zeros(top + 1, dtype=bool)
    reached[0] = True
    for p, (w, _, _) in enumerate(parts):
        if w > top:
            continue
        new = reached[:top + 1 - w] & ~reached[w:]
        first[w:][new] = p
        reached[w:] |= new
        if reached[left]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.abs(sums - left).argmin()])
    while at > 0:
        w, i, k = parts[first[at]]
        take[i] += k
        at -= w
    return take


def plan(counts: DataFrame, goals: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, size, base, extra: copies of every document of that length, and how many get one more."""
    def of_source(frame):
        frame = frame[frame["size"] > 0].sort_values("size")
        base = int(frame["target"].iloc[0] // frame["source_size"].iloc[0]) if len(frame) else 0
        left = int(round(frame["target"].iloc[0])) - base * int(frame["source_size"].iloc[0]) if len(frame) else 0
        extra = fit(frame["size"], frame["n"], max(0, left), window)
        return pd.DataFrame({"key": frame["key"], "size": frame["size"], "n": frame["n"], "base": base, "extra": extra})

    joined = counts.join(small(goals), "key")
    return joined.groupBy("key").applyInPandas(of_source, "key string, size long, n long, base long, extra long")


def mix(docs: DataFrame, carry=(), weights=WEIGHTS, share=SHARE, cap=CAP, seed: int = SEED, window: int = WINDOW) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, copies counted), copies, source, and the carried columns."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    carry = [c for c in carry if c != "source"]
    held = F.struct(*[F.col(c) for c in carry]).alias("carried") if carry else F.lit(None).cast("boolean").alias("carried")
    sized = docs.select("doc_id", "source", held, F.size(words(F.col("text"))).cast("long").alias("size"))
    sized = sized.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id")).withColumn("key", key)
    if not carry:
        sized = stored(sized, "sizes")
    counts = stored(sized.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = stored(targets(sources, weights, share, cap).withColumn("key", key).drop("source"), "targets")
    chosen = stored(plan(counts.drop("source"), goals, window), "taken-lengths")

    # a hash bucket per group holds the last document taken; below it all are taken, within it the first few
    bucket = F.shiftrightunsigned("draw", 52)
    partly = chosen.where((F.col("extra") > 0) & (F.col("extra") < F.col("n")))
    filled = sized.select("key", "size", bucket.alias("bucket")).join(partly.select("key", "size", "extra"), ["key", "size"])
    filled = filled.groupBy("key", "size", "extra", "bucket").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("key", "size").orderBy("bucket")  # at most 4,096 rows
    last = filled.withColumn("upto", F.sum("m").over(before)).where(
        (F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("m") < F.col("extra"))).select(
        "key", "size", F.col("bucket").alias("last"), (F.col("extra") - F.col("upto") + F.col("m")).alias("few"))
    cuts = stored(chosen.join(last, ["key", "size"], "left"), "cuts")

    rows = sized.withColumn("bucket", bucket).join(small(cuts), ["key", "size"], "left").join(small(goals), "key", "left")
    inside = F.col("bucket") == F.col("last")
    whole = rows.where(~F.coalesce(inside, F.lit(False))).withColumn(
        "more", F.when(F.col("bucket") < F.col("last"), 1).when(F.col("last").isNull() & (F.col("extra") > 0), 1).otherwise(0))
    cut = rows.where(inside).withColumn("more", (F.row_number().over(
        Window.partitionBy("key", "size", "bucket").orderBy("draw", "doc_id")) <= F.col("few")).cast("int"))
    out = whole.unionByName(cut).withColumn("copies", F.coalesce(F.col("base") + F.col("more"), F.lit(0)).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source",
                      *[F.col("carried")[c].alias(c) for c in carry])
