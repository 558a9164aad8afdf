"""Audit of filters that are applied in a row: what each removes, repeats and costs, in every order of the filters.

One pass over the texts gives each document its failures as a bit mask. Identical texts share their failures, so they
are counted per (text, part, labels) before they leave a task, and the only document of a group that is no copy is
told from the smallest id. What remains are counts per part and mask, reshaped to a tensor with one axis of length two
per filter; a step of an order picks "passes", "fails" or "all" along each axis, and one `einsum` gives every step.

Defined results: a null text is an empty one; a null id is neither a copy nor has copies, and no label; an id with
several label rows is good (toxic) if one of them says so; repeated rows of one id count each and are no copies of one
another; an empty table gives no part and so no row; extra columns are not read. A hot text is one row per task, part
and label when it is exchanged.
"""

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import words

OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3  # words, percent of words, percent of code points
LETTERS = "ABCDE"


def failures(text):
    """Bits 1, 2, 4, 8 of the failures A to D of a text that is not null; E needs the whole table."""
    size = F.char_length(text)

    def bits(found):
        n = F.size(found)
        return (F.when(n < MIN_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(found)) < MIN_DISTINCT * n, 2).otherwise(0)
                + F.when(100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS * size, 4).otherwise(0)
                + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0))

    return F.transform(F.array(words(text)), bits)[0]


def masks(docs: DataFrame, labels: DataFrame, id="doc_id", text="text", part="lang") -> DataFrame:
    """part, mask (failing filters, A is bit 1 and E bit 16), good, toxic, n: documents counted."""
    whole = F.coalesce(F.col("text_"), F.lit(""))
    rows = docs.select(docs[id].cast("long").alias("id"), docs[text].cast("string").alias("text_"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"))
    rows = rows.select("id", "part", failures(whole).alias("bits"), F.unhex(F.sha2(whole, 256)).alias("hash"))
    said = labels.groupBy(labels[id].cast("long").alias("of")).agg(
        F.max(F.coalesce(labels.quality == 1, F.lit(False))).alias("good"), F.max(F.coalesce(labels.toxic == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(said, rows.id == said.of, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    same = ["hash", "bits", "part", "good", "toxic"]
    per_id = rows.groupBy("id", *same).agg(F.count(F.lit(1)).alias("n"))
    groups = per_id.groupBy(*same).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"))
    first = F.min("least.id").over(Window.partitionBy("hash"))
    groups = groups.withColumn("unique", F.col("without_id") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0))
    both = F.explode(F.array(F.struct(F.col("bits").alias("mask"), F.col("unique").alias("n")),
                             F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - F.col("unique")).alias("n"))))
    return groups.select("part", "good", "toxic", both.alias("x")).groupBy("part", "x.mask", "good", "toxic").agg(F.sum("x.n").alias("n"))


def contracted(tensors):
    """(parts, 3, 2, 2, 2, 2, 2) counts of all, good and toxic documents to the seven counts of each order and step."""
    orders = list(permutations(range(5)))
    picks = {"all": np.ones(2, dtype=np.int64), "pass": np.array([1, 0]), "fail": np.array([0, 1])}
    steps = [(o, k) for o in orders for k in range(5)]

    def chosen(rule):
        """Along each axis the pick of every step."""
        return [np.stack([picks[rule(o, k, axis)] for o, k in steps]) for axis in range(5)]

    def count(tensor, rule):
        return np.einsum("pabcde,sa,sb,sc,sd,se->ps", tensor, *chosen(rule), optimize="optimal")

    every, good, toxic = (tensors[:, i] for i in range(3))
    goes = lambda o, k, axis: "fail" if o[k] == axis else "pass" if axis in o[:k] else "all"
    removed = count(every, goes)
    fails = count(every, lambda o, k, axis: "fail" if o[k] == axis else "all")
    letter = np.array([o[k] for o, k in steps])
    of_letter = letter[:, None] == np.arange(5)
    return steps, [count(every, lambda o, k, axis: "pass" if axis in o[:k + 1] else "all"), removed, fails - removed,
                   count(every, lambda o, k, axis: "fail" if o[k] == axis else "pass"),
                   count(good, goes), count(toxic, goes), (removed @ of_letter)[:, letter]]


def audit(docs: DataFrame, labels: DataFrame, id="doc_id", text="text", part="lang") -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    slot = lambda c: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda m: F.coalesce(F.element_at(c, m), F.lit(0)))
    per_mask = masks(docs, labels, id, text, part).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    packed = per_mask.groupBy("part").agg(*[  # at most 32 masks a part
        F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in ("n", "good", "toxic")])
    packed = packed.select("part", *[slot(F.col(c)).alias(c) for c in ("n", "good", "toxic")])

    def work(frames):
        for frame in frames:
            if not len(frame):
                continue
            # mask bit 1 is the fastest axis, so axes come out as E, D, C, B, A
            tensors = np.stack([np.stack(frame[c].to_numpy()) for c in ("n", "good", "toxic")], axis=1).astype(np.int64)
            tensors = tensors.reshape(len(frame), 3, 2, 2, 2, 2, 2).transpose(0, 1, 6, 5, 4, 3, 2)
            steps, counts = contracted(tensors)
            m = len(steps)
            yield pd.DataFrame({
                "part": np.repeat(frame["part"].to_numpy(), m),
                "filter_order": ["".join(LETTERS[i] for i in o) for o, _ in steps] * len(frame),
                "step": np.tile(np.array([k + 1 for _, k in steps], dtype=np.int32), len(frame)),
                **{name: value.reshape(-1) for name, value in zip(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), counts)}})

    return packed.mapInPandas(work, OUT)
