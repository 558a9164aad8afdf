"""Column expressions over nucleotide strings. All but the window means stay inside the JVM."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")


def clean(s) -> Column:
    """Upper case, U to T, anything else than ACGT to N; the length is kept."""
    return F.regexp_replace(F.translate(F.upper(s), "U", "T"), "[^ACGT]", "N")


def revcomp(s) -> Column:
    return F.reverse(F.translate(s, "ACGTUacgtuNn", "TGCAAtgcaaNn"))


def seq_hash(s) -> Column:
    return F.substring(F.sha1(clean(s)), 1, 16)


def count_of(s, text: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    s = F.col(s) if isinstance(s, str) else s
    return ((F.length(s) - F.length(F.replace(s, F.lit(text), F.lit("")))) / len(text)).cast("bigint")


def kmer_count(s, kmer: str) -> Column:
    """Overlapping occurrences; a k-mer that can overlap itself needs a look-ahead."""
    overlaps = any(kmer[:i] == kmer[-i:] for i in range(1, len(kmer)))
    if overlaps:
        return F.regexp_count(s, F.lit(f"(?={kmer})")).cast("bigint")
    return count_of(s, kmer)


def gc(s) -> Column:
    return (count_of(s, "G") + count_of(s, "C")) / F.greatest(F.length(s), F.lit(1))


def g_rich_orientation(s) -> Column:
    """The strand with at least as many G as C, tie to the given strand."""
    return F.when(count_of(s, "G") >= count_of(s, "C"), s).otherwise(revcomp(s))


def runs(s) -> Column:
    """Maximal stretches of G, of C, and of anything else, in order."""
    return F.regexp_extract_all(s, F.lit("(G+|C+|[^GC]+)"), 1)


def _run_value(r) -> Column:
    n = F.least(F.length(r), F.lit(4))
    first = F.substring(r, 1, 1)
    return F.when(first == "G", n).when(first == "C", -n).otherwise(F.lit(0))


def hunter_scores(s) -> Column:
    """Per-base run score: +min(run, 4) inside G runs, the negative inside C runs, else 0."""
    return F.flatten(F.transform(runs(s), lambda r: F.array_repeat(_run_value(r), F.length(r))))


def hunter_sum(s) -> Column:
    return F.aggregate(runs(s), F.lit(0).cast("bigint"),
                       lambda acc, r: acc + (_run_value(r) * F.length(r)).cast("bigint"))


def hunter_mean(s) -> Column:
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(hunter_sum(s) / F.length(s))


def window_means(texts, window: int = 25):
    """Means of every stretch of `window` run scores of each text of an Arrow array, see with_window_means.

    All texts lie in one buffer: runs are found once, and a window's sum is the difference of two running sums.
    """
    given = texts.to_pylist()
    length = np.array([len(x) if x is not None else 0 for x in given], dtype=np.int64)
    end = length.cumsum()
    code = np.frombuffer("".join(x for x in given if x is not None).encode("utf-32-le"), dtype=np.uint32)
    sign = (code == ord("G")).astype(np.int64) - (code == ord("C"))
    starts = np.zeros(len(code) + 1, dtype=bool)
    starts[1:-1] = sign[1:] != sign[:-1]
    starts[0], starts[end] = True, True                      # no run goes on in the next text
    at = np.flatnonzero(starts)
    run = np.repeat(np.diff(at), np.diff(at))
    total = np.r_[0, (sign * np.minimum(run, 4)).cumsum()]
    width = np.minimum(window, length)
    count = np.where(length > 0, length - width + 1, np.array([x is not None for x in given], dtype=np.int64))
    offsets = np.r_[0, count.cumsum()]
    first = np.arange(offsets[-1]) - np.repeat(offsets[:-1], count) + np.repeat(end - length, count)
    wide = np.repeat(width, count)
    means = (total[first + wide] - total[first]) / np.maximum(wide, 1)
    missing = pa.array([x is None for x in given], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(means), mask=missing)


def with_window_means(df: DataFrame, s: str, name: str, window: int = 25) -> DataFrame:
    """Append the means of every stretch of `window` scores; a shorter sequence gives its own mean."""
    def means(texts: pa.Array) -> pa.Array:
        return window_means(texts, window)
    return df.withColumn(name, F.arrow_udf(means, "array<double>")(F.col(s)))


def entropy(s) -> Column:
    total = F.lit(0.0)
    for b in BASES:
        p = count_of(s, b) / F.length(s)
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))
    return total


def kmers(s, k: int) -> Column:
    """Every k-mer in order; an empty array for a sequence shorter than k."""
    s = F.col(s) if isinstance(s, str) else s
    return F.when(F.length(s) < k, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substr(s, i, F.lit(k))))


def dna_key(s) -> Column:
    """Molecule-erased key: spaces dropped, U to T; null unless pure ACGT."""
    t = F.translate(F.upper(F.regexp_replace(s, r"\s+", "")), "U", "T")
    return F.when(t.rlike("^[ACGT]+$"), t)


def rna_key(s) -> Column:
    """Strict RNA key: spaces dropped; null unless pure ACGU."""
    t = F.upper(F.regexp_replace(s, r"\s+", ""))
    return F.when(t.rlike("^[ACGU]+$"), t)


def scaffold(pool_id, pool_class):
    """(group key, basis) of a pool identifier, by ordered rules; no rule leaves it UNASSIGNED."""
    # fixed values: the identifier forms of the pool
    mutant = "^stG4_Pool_ns_([A-Za-z0-9]+)_(1mut|AAAmut)_[0-9]+$"
    parent = "^stG4_Pool_ns_([A-Za-z0-9]+)$"
    synthetic = (pool_class == "stG4") | pool_id.startswith("stG4_Pool_GLV")
    control = pool_class.isin("neg_AAA", "neg_ns", "pUG") | pool_id.rlike("^stG4_Pool_(neg_AAA|neg_ns|pUG)")
    key = (F.when(pool_id.rlike(mutant), F.concat(F.lit("parent:"), F.regexp_extract(pool_id, mutant, 1)))
           .when(pool_id.rlike(parent), F.concat(F.lit("parent:"), F.regexp_extract(pool_id, parent, 1)))
           .when(synthetic, F.concat(F.lit("synthetic:"), pool_id))
           .when(control, F.concat(F.lit("control:"), pool_class, F.lit(":"), pool_id))
           .otherwise("UNASSIGNED"))
    basis = (F.when(pool_id.rlike(mutant), F.concat(F.lit("mutant_of_parent ("), F.regexp_extract(pool_id, mutant, 2),
                                                    F.lit(")")))
             .when(pool_id.rlike(parent), "parent_wildtype")
             .when(synthetic, "synthetic_combinatorial_no_parent")
             .when(control, F.concat(F.lit("control_"), pool_class)).otherwise("no rule matched"))
    return key, basis
