"""Overlap between sequence sets: exact keys, containment, near matches, nearest neighbours."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import condition, seq
from ..session import cut_lineage
from . import ordered, splits


BITS, MARKS = 27, 3       # log2 of the bits of a filter over needles (16 MB, whatever their number) and how many a needle sets
MANY, SLICE = 100_000, 64  # needles from which on one text in SLICE is searched first, to settle the frequent ones
PIECE = 1 << 16           # letters that are hashed together
_BASE = 0x9E3779B97F4A7C15


def _stretches(text, lengths):
    """Per length the 64-bit polynomial hashes of all stretches of a text, by place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(len(codes), _BASE, dtype=np.uint64))
        down = np.cumprod(np.r_[np.uint64(1), np.full(len(codes), pow(_BASE, -1, 1 << 64), dtype=np.uint64)])
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(codes * up, dtype=np.uint64)])
        for n in lengths:
            at = len(total) - n
            yield n, (total[n:] - total[:max(at, 0)]) * down[:max(at, 0)]


def _mark(h, i):
    """The i-th of the bits that a hash sets: the leading bits of its product with an odd number."""
    with np.errstate(over="ignore"):
        return ((h ^ (h >> np.uint64(29))) * np.uint64(pow(_BASE, 2 * i + 3, 1 << 64))) >> np.uint64(64 - BITS)


def _filter(needles: DataFrame, needle: str):
    """(bits of all needles, their lengths), both of bounded size."""
    def marks(batches):
        for batch in batches:
            h = np.array([next(_stretches(x, [len(x)]))[1][0] for x in batch[needle]], dtype=np.uint64)
            yield pd.DataFrame({"bit": np.unique(np.concatenate([_mark(h, i) for i in range(MARKS)])).astype(np.int64)})

    at = needles.mapInPandas(marks, "bit long").groupBy(F.floor(F.col("bit") / 32768).cast("int").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    bits = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for r in at.collect():  # 4,096 rows of 4 kB
        bits[4096 * r["bucket"]:4096 * (r["bucket"] + 1)] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return bits, sorted(r["n"] for r in needles.select(F.length(needle).alias("n")).distinct().collect())  # up to the longest needle


def _search(needles: DataFrame, needle: str, texts: DataFrame) -> DataFrame:
    """Those needles that stand in a text. Only stretches that pass the filter leave their task; equality decides."""
    bits, lengths = _filter(needles, needle)
    if not lengths:
        return needles
    held, most = needles.sparkSession.sparkContext.broadcast(bits), PIECE

    def candidates(batches):
        bits = held.value

        def marked(h, i):
            bit = _mark(h, i)
            return (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1

        def found(pieces):
            text, ends = "".join(pieces), np.repeat(np.cumsum([len(x) for x in pieces]), [len(x) for x in pieces])
            out = set()
            for n, h in _stretches(text, [n for n in lengths if n <= len(text)]):
                at = np.flatnonzero(marked(h, 0))
                if n:
                    at = at[at + n <= ends[at]]
                for i in range(1, MARKS):
                    at = at[marked(h[at], i)]
                out.update(text[i:i + n] for i in at.tolist())
            return pd.DataFrame({needle: sorted(out)}, dtype=object)

        for batch in batches:
            pieces, size = [], 0
            for x in batch["_t"].unique():
                for start in range(0, max(len(x), 1), most):
                    pieces.append(x[start:start + most + lengths[-1]])
                    size += len(pieces[-1])
                    if size >= most:
                        yield found(pieces)
                        pieces, size = [], 0
            if pieces:
                yield found(pieces)

    parts = texts.mapInPandas(candidates, f"`{needle}` string").distinct()
    # neither side is bounded, so neither is broadcast
    return parts.join(needles.hint("merge"), needle, "left_semi")


def contained(needles: DataFrame, needle: str, hay: DataFrame, hay_text: str) -> DataFrame:
    """Distinct needles occurring inside some haystack text.

    Stretches of a length some needle has are looked up in a filter of fixed size inside the task that reads the text;
    the few that pass are matched by equality. Of many needles, those met in the first share of the texts are settled
    there, and the rest of the texts is searched for the others.
    """
    wanted = cut_lineage(needles.select(needle).where(F.col(needle).isNotNull()).distinct())
    texts = hay.select(F.col(hay_text).alias("_t")).where("_t IS NOT NULL")
    if wanted.count() <= MANY:
        return _search(wanted, needle, texts)
    early = F.pmod(F.xxhash64("_t"), F.lit(SLICE)) == 0
    met = cut_lineage(_search(wanted, needle, texts.where(early)))
    left = cut_lineage(wanted.join(met.hint("merge"), needle, "left_anti"))
    return met.unionByName(_search(left, needle, texts.where(~early)))


FEW = 64  # sequences that share a half and are compared with each other inside one row


def hamming_one(df: DataFrame, keys, s: str, values) -> DataFrame:
    """Pairs of sequences differing in exactly one base within a buffer, replicates averaged first.

    Such a pair is equal in one half and differs in the other, so a sequence travels twice, once under each half. Those
    few that share a half are compared in place; where many do, they meet under the other half with one position
    blanked, which at most one sequence per letter can share, whatever the table's size.
    """
    mean = df.where(F.col(s).isNotNull()).groupBy(*keys, s).agg(*[F.avg(v).alias(v) for v in values])
    n, cut = F.length(s), F.floor(F.length(s) / 2).cast("int")
    halves = F.array(*[F.struct(F.lit(side).alias("side"), n.alias("n"), F.substr(s, F.lit(1) + start, length).alias("same"))
                       for side, start, length in ((0, F.lit(0), cut), (1, cut, n - cut))])
    shared = [*keys, "_h.side", "_h.n", "_h.same"]
    met = mean.withColumn("_h", F.explode(halves)).withColumn("_c", F.count("*").over(Window.partitionBy(*shared)))
    row = F.struct(s, *values)

    def paired(groups, close):
        pairs = F.flatten(F.transform("_g", lambda a, i: F.transform(
            F.filter(F.slice("_g", i + 2, F.size("_g")), lambda b: close(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        return groups.select(*keys, F.explode(pairs).alias("p"))

    few = met.where(F.col("_c").between(2, FEW)).groupBy(*shared).agg(F.array_sort(F.collect_list(row)).alias("_g"))
    pairs = paired(few, lambda a, b: F.levenshtein(a[s], b[s], 1) == 1)  # of equal length: one substitution
    first, last = F.when(F.col("_h.side") == 0, cut + 1).otherwise(1), F.when(F.col("_h.side") == 0, n).otherwise(cut)
    blank = met.where(F.col("_c") > FEW).where(last >= first).select(*keys, s, *values, F.explode(F.sequence(first, last)).alias("_at"))
    blank = blank.withColumn("_pattern", F.overlay(F.col(s), F.lit("*"), F.col("_at"), F.lit(1)))
    many = blank.groupBy(*keys, "_at", "_pattern").agg(F.array_sort(F.collect_list(row)).alias("_g")).where(F.size("_g") > 1)
    pairs = pairs.unionByName(paired(many, lambda a, b: F.lit(True)))
    a, b = F.col(f"p.a.{s}"), F.col(f"p.b.{s}")
    pos = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), True) - 1
    return pairs.select(*keys, pos.cast("int").alias("pos"), a.alias("first"), b.alias("second"),
                        *[F.col(f"p.a.{v}").alias(f"{v}_first") for v in values], *[F.col(f"p.b.{v}").alias(f"{v}_second") for v in values])


def cation_pairs(df: DataFrame, least=5.0, share=0.15, ph=0.3) -> DataFrame:
    """K-only against Na-only measurements of one sequence at comparable strength and pH.

    Repeats of one value are counted before the join: a row is a distinct
    combination and n_pairs the number of measurement pairs it stands for.
    """
    counted = df.groupBy("sequence", "k", "na", "ph", "tm").agg(F.count("*").alias("n"))
    k = counted.where("na = 0 AND k > 0").select("sequence", "k", F.col("ph").alias("ph_k"), F.col("tm").alias("tm_k"), F.col("n").alias("_nk"))
    na = counted.where("k = 0 AND na > 0").select("sequence", "na", F.col("ph").alias("ph_na"), F.col("tm").alias("tm_na"), F.col("n").alias("_nn"))
    near = (F.abs(F.col("k") - F.col("na")) <= F.greatest(F.lit(least), share * F.greatest("k", "na"))) & (F.abs(F.col("ph_k") - F.col("ph_na")) <= ph)
    return k.join(na, "sequence").where(near).select(
        "sequence", "k", "na", ((F.col("ph_k") + F.col("ph_na")) / 2).alias("ph"), "tm_k", "tm_na", (F.col("_nk") * F.col("_nn")).alias("n_pairs"))


QUERY_BLOCK, ROW_BLOCK = 1_000, 50_000  # queries and rows that meet in one task


def _six(x):
    """Rounded to six places, halves away from zero, as SQL rounds."""
    return np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5) / 1e6


def neighbours(queries: DataFrame, table: DataFrame, n: int = 5, k: int = 3, weight: float = 0.35, shortlist: int | None = None) -> DataFrame:
    """The n rows nearest to each query in sequence and buffer: query_id, row_id, similarity, joint, place.

    Cosine of k-mer counts, lowered by buffer distance, ranks every row; with a shortlist only the rows most similar in
    sequence are ranked. Rows and queries are dealt in blocks and every pair of blocks is one task, so neither the plan
    nor a task grows with the number of queries. Inside, the joint score never exceeds the similarity: the joint score
    of the n most similar rows bounds from below what another row must reach in similarity to be looked at at all.
    """
    # block numbers are of one type on both sides: a group is placed by a hash that depends on it
    row_blocks = max(1, -(-table.count() // ROW_BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    fields = list(condition.STEP)
    left = table.select("row_id", seq.clean("sequence").alias("s"), *[F.col(f).cast("double").alias(f) for f in fields],
                        F.pmod(F.xxhash64("row_id"), F.lit(row_blocks)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("j"))
    right = queries.select("query_id", seq.clean("q_sequence").alias("s"), *[F.col(f).cast("double").alias(f) for f in fields],
                           F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("i"))
    keep = shortlist or n
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (table, "row_id"))}
    out = f"query_id {kinds['query_id']}, row_id {kinds['row_id']}, similarity double, distance double"

    def compare(rows, asked):
        found = []
        if len(rows) and len(asked):
            m, q = (splits.kmer_counts(list(x["s"]), k).astype(np.float64) for x in (rows, asked))
            norm = np.sqrt(np.outer((q * q).sum(axis=1), (m * m).sum(axis=1)))
            with np.errstate(invalid="ignore"):
                similarity = _six(np.nan_to_num(q @ m.T / norm))
            z, zq = (x[fields].to_numpy() for x in (rows, asked))
            step, ids = np.array([condition.STEP[f] for f in fields]), rows["row_id"].to_numpy()

            def distance(at, query):
                return np.sqrt((((z[at] - zq[query]) / step) ** 2).sum(axis=1))

            def joint(at, query, d):
                return _six(similarity[query, at] - weight * d / (1 + d))

            for query in range(len(asked)):
                own = similarity[query]
                top = np.argpartition(-own, min(keep, len(own)) - 1)[:keep]
                if shortlist is None:
                    least = np.sort(joint(top, query, distance(top, query)))[0] if len(top) == keep else -np.inf
                    at = np.flatnonzero(own >= least)
                    d = distance(at, query)
                    rank = np.lexsort((ids[at], -joint(at, query, d)))[:keep]
                else:
                    at = np.flatnonzero(own >= own[top].min())
                    d = distance(at, query)
                    rank = np.lexsort((ids[at], -own[at]))[:keep]
                found.append(pd.DataFrame({"query_id": asked["query_id"].iloc[query], "row_id": ids[at][rank], "similarity": own[at][rank], "distance": d[rank]}))
        return pd.concat(found) if found else pd.DataFrame(columns=["query_id", "row_id", "similarity", "distance"])

    best = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(compare, out)
    if shortlist is not None:
        near = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "row_id")  # shortlist rows a block
        best = best.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= shortlist).drop("_r")
    best = best.withColumn("joint", F.round(F.col("similarity") - weight * F.col("distance") / (1 + F.col("distance")), 6)).drop("distance")
    last = Window.partitionBy("query_id").orderBy(F.desc("joint"), "row_id")  # n rows a block
    return best.withColumn("place", F.row_number().over(last)).where(F.col("place") <= n)


VIOLATIONS = ["allele_mismatch", "outside_window", "duplicate_keys", "mixed_scorers", "count_mismatch"]


def export_violations(rows: DataFrame, genome: DataFrame, piece_len: int, declared: DataFrame) -> DataFrame:
    """Per chromosome how often a score export breaks its contract: chrom, n_rows and a count for each of VIOLATIONS.

    rows: chrom, pos, ref, alt, scorer; genome: chrom, piece, s; declared: chrom and the number of rows its header names.
    """
    keys = rows.groupBy("chrom", "pos", "ref", "alt").agg(F.count("*").alias("n")).withColumn("piece", F.floor((F.col("pos") - 1) / piece_len))
    x = keys.join(genome, ["chrom", "piece"], "left").withColumn("base", F.substr("s", (1 + (F.col("pos") - 1) % piece_len).cast("int"), F.lit(1)))
    per_key = x.groupBy("chrom").agg(F.count_if(F.col("base") != F.col("ref")).alias("allele_mismatch"), F.count_if(F.col("base").isNull()).alias("outside_window"),
                                     F.count_if(F.col("n") > 1).alias("duplicate_keys"))
    whole = rows.groupBy("chrom").agg(F.count("*").alias("n_rows"), (F.countDistinct("scorer") - 1).alias("mixed_scorers"))
    j = whole.join(per_key, "chrom").join(declared, "chrom", "left")
    return j.select("chrom", "n_rows", "allele_mismatch", "outside_window", "duplicate_keys", "mixed_scorers",
                    F.abs(F.coalesce("declared", F.lit(0)) - F.col("n_rows")).alias("count_mismatch"))
