"""Importance resampling towards a target distribution over hashed n-gram buckets.

Texts are cut by Arrow kernels (`ascii_lower`, `split_pattern_regex`, `list_flatten`, `dictionary_encode`); n-grams are
runs of shifted dictionary indices, each distinct one is spelled and hashed (CRC-32) once per batch. A first pass counts
buckets per task, a second takes the gain of each bucket and sums it per document. Only bucket counts, at most
`buckets` rows, reach the driver. Draws use Gumbel noise from a hash of the id, so reruns agree; ranks come from a
histogram of the whole-number scores (their range is bounded) and an order inside each score.

Defined results: a null, empty or mark-only text has no features, weight 0, and is drawn only if `min_words` is 0;
repeated rows are documents of their own; a null id draws with the noise of the text `<seed>:`; ties go to the smaller
id, null first; of equal ids to the larger number of features; an empty table gives an empty one; extra columns are not read.
"""

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import texts_of
from .common import small, stored, text_batches

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = 4 << 20  # bytes of text cut at once
SCORES = 1_000_000  # a gain is within 1000 ln of the greatest count, noise within 25,000: far fewer distinct scores


def _slices(column, limit=PIECE):
    """Row ranges of about `limit` bytes; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, low = np.cumsum(size), 0
    while low < len(size):
        before = total[low] - size[low]
        high = max(low + 1, int(np.searchsorted(total, before + limit, "right")))
        yield low, high
        low = high


def features(column, n, buckets):
    """Words per text, features per text, and the bucket of every feature, texts in order and gram lengths within."""
    data, offsets = texts_of(column)  # laid anew from offset 0: ascii_lower misreads arrays that begin further on
    texts = pa.LargeStringArray.from_buffers(
        len(column), pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(data[offsets[0]:offsets[-1]]))
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    word = pc.list_flatten(lists)
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(word), 0)
    word, owner = word.filter(full), owner[full.to_numpy(zero_copy_only=False)]
    coded = pc.dictionary_encode(word)
    spelled = [w.encode("utf-8") for w in coded.dictionary.to_pylist()]
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = np.bincount(owner, minlength=len(lists))
    owners, found = [], []
    for k in range(1, n + 1):
        m = max(len(index) - k + 1, 0)
        inside = owner[:m] == owner[k - 1:k - 1 + m]
        gram = np.stack([index[j:j + m][inside] for j in range(k)])
        if k == 1:
            crc = np.array([crc32(w) for w in spelled], dtype=np.int64)
            bucket = crc[gram[0]] if len(spelled) else gram[0]
        else:  # distinct runs only are spelled
            distinct, place = np.unique(gram, axis=1, return_inverse=True)
            crc = np.array([crc32(b" ".join(spelled[i] for i in g)) for g in distinct.T.tolist()], dtype=np.int64)
            bucket = crc[place.ravel()] if distinct.shape[1] else np.zeros(0, dtype=np.int64)
        owners.append(owner[:m][inside])
        found.append(bucket % buckets)
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    return words, np.bincount(owners, minlength=len(lists)), found[order]


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """bucket, count over all texts (one string column); each task sends one row per bucket it met."""
    text_batches(texts.sparkSession)

    def work(batches):
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for low, high in _slices(batch.column(0)):
                held += np.bincount(features(batch.column(0).slice(low, high - low), n, buckets)[2], minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["bucket", "count"])

    return texts.mapInArrow(work, "bucket int, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(raw: DataFrame, target: DataFrame, buckets: int):
    """floor(1000 ln) of the smoothed share of each bucket in the target over that in the raw texts; `buckets` numbers."""
    spark = raw.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(
        raw.withColumnRenamed("count", "s"), "bucket", "left").join(target.withColumnRenamed("count", "t"), "bucket", "left")
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    rows = both.collect()  # `buckets` rows, whatever the input
    total_s, total_t = sum(r.s for r in rows), sum(r.t for r in rows)
    ratio = ((F.col("t") + 1) * F.lit(total_s + buckets)) / ((F.col("s") + 1) * F.lit(total_t + buckets))
    frame = spark.createDataFrame([tuple(r) for r in rows], "bucket int, s double, t double")
    out = np.zeros(buckets, dtype=np.int64)
    for r in frame.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():
        out[r.bucket] = r.gain
    return out


def weights(docs: DataFrame, gain, n: int, id="doc_id", text="text") -> DataFrame:
    """id, n_words, n_features, weight (floored mean gain) per row."""
    spark, buckets = docs.sparkSession, len(gain)
    text_batches(spark)
    held = spark.sparkContext.broadcast(gain)
    kind = docs.select(id).schema[0].dataType.simpleString()

    def work(batches):
        gain = held.value
        for batch in batches:
            for low, high in _slices(batch.column(1)):
                words, size, bucket = features(batch.column(1).slice(low, high - low), n, buckets)
                value, total = np.take(gain, bucket), np.zeros(len(size), dtype=np.int64)
                full = np.flatnonzero(size)
                if len(full):
                    total[full] = np.add.reduceat(value, (np.cumsum(size) - size)[full])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low), pa.array(words.astype(np.int64)), pa.array(size.astype(np.int64)),
                    pa.array(total // np.maximum(size, 1))], names=["id", "n_words", "n_features", "weight"])

    return docs.select(docs[id].alias("id"), docs[text].cast("string").alias("text")).mapInArrow(
        work, f"id {kind}, n_words long, n_features long, weight long").withColumnRenamed("id", id)


def drawn(scored: DataFrame, share, id="doc_id") -> DataFrame:
    """Append rank: 1, 2, ... for the floor(share percent) best scores among the rows that may be drawn, else null.

    scored: id, score, may_draw and others. Rows above a score are counted by a histogram of scores; only rows of
    equal score are ordered among themselves, and only those that reach the last score drawn.
    """
    scored = stored(scored, "scored")
    counts = scored.where("may_draw").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "scores")
    total = int(counts.agg(F.sum("n")).first()[0] or 0)
    wanted = total * share // 100
    # the histogram has as many rows as there are distinct scores, within SCORES, and is summed in blocks of scores
    block = F.floor(F.col("score") / 256)
    blocks = counts.groupBy(block.alias("block")).agg(F.sum("n").alias("m"))
    blocks = blocks.select("block", F.coalesce(F.sum("m").over(
        Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("over_block"))
    inside = Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    above = counts.withColumn("block", block).join(F.broadcast(blocks), "block").select(
        F.col("score").alias("score_"), (F.col("over_block") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("above")).where(F.col("above") < wanted)
    above = small(stored(above, "above"), SCORES)
    taken = scored.where("may_draw").join(above, F.col("score") == F.col("score_")).drop("score_")
    order = Window.partitionBy("score").orderBy(F.asc_nulls_first(id), F.desc("n_features"), F.desc("weight"))
    place = F.col("above") + F.row_number().over(order)
    taken = taken.withColumn("rank", F.when(place <= wanted, place).cast("long")).drop("above")
    rest = scored.join(above, F.col("may_draw") & (F.col("score") == F.col("score_")), "left_anti").withColumn("rank", F.lit(None).cast("long"))
    return taken.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, n=2, buckets=10_000, share=10, seed=2024, min_words=20, id="doc_id", text="text") -> DataFrame:
    """Every row of docs as id, n_features, weight, score, rank. target: table with a text column of the wanted kind.

    share: whole percent of the rows of at least min_words words that are drawn.
    """
    gain = gains(bucket_counts(docs.select(docs[text].cast("string")), n, buckets),
                 bucket_counts(target.select(target[text].cast("string")), n, buckets), buckets)
    scored = weights(docs, gain, n, id, text)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = scored.withColumn("score", F.col("weight") + noise).withColumn("may_draw", F.col("n_words") >= min_words)
    return drawn(scored, share, id).select(id, "n_features", "weight", "score", "rank")
