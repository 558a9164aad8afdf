"""Line dedup by a segment-partition edit join: of each class of lines within EDITS of another, the first stays.

A line of n code points is cut into EDITS + 1 segments. A line within EDITS edits of it holds one of those segments
unchanged, at a place that the lengths of both and the segment's number narrow down: for EDITS = 2 a line has 12
probes (length, segment, substring), among them its own segments. Lines that share a probe are candidates; a parity
sketch of their letter pairs, of which an edit turns at most 4 bits, drops nearly all others; what is left is verified
by banded bit-parallel edit distance. Classes are connected components of the links.

Equal lines are one text. In a bucket every line is first compared with one hub; only buckets that then hold several
components are compared further, across components. Probes travel packed per bucket, and only those that two texts
share become rows.

Defined results. Null or empty text: one empty line. Lines without a word are never removed. Lines below MIN_CHARS code
points only match equal lines. Null doc_id: before all others. Repeated rows: the same places, none a later copy of the
other. Empty table: no rows. Other columns are carried, whatever their names.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import small, stored, text_batches
from .components import components, paired
from .packs import OUT_SQL, gather, packed, rows

EDITS = 2
MIN_CHARS = 32
BLOCK = 1 << 18
IDS_BOUND = 500_000  # ids of 8 bytes that may be broadcast
_WORD = str.maketrans("", "", " \t\n\x0b\f\r")


def probes(edits: int = EDITS):
    """(length difference, segment, shift) of every substring a line has to be looked up by."""
    out = []
    for gap in range(edits + 1):
        for i in range(1, edits + 2):
            low = max(-(i - 1), gap - (edits + 1 - i))
            high = min(i - 1, gap + (edits + 1 - i))
            out += [(gap, i - 1, shift) for shift in range(low, high + 1)]
    return out


def keys_of(texts, edits: int = EDITS):
    """Probe keys (one row per text) and parity sketches; every text holds at least edits + 1 code points."""
    keys, sketches, i = [], [], 0
    plan = probes(edits)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    while i < len(texts):
        j, total = i + 1, sizes[i]
        while j < len(texts) and total + sizes[j] <= BLOCK:
            total += sizes[j]
            j += 1
        piece = np.frombuffer("".join(texts[i:j]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = sizes[i:j]
        base = np.cumsum(n) - n
        up, down = (arrays._UP, arrays._DOWN) if len(piece) <= arrays.BLOCK else (
            arrays._powers(arrays._P, len(piece)), arrays._powers(arrays._INV, len(piece)))
        value = piece.astype(np.uint64)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((value + np.uint64(1)) * up[:len(piece)], out=sums[1:])
        key = np.zeros((j - i, len(plan)), dtype=np.uint64)
        for c, (gap, segment, shift) in enumerate(plan):
            length = n - gap
            short = length // (edits + 1)
            longer = length - short * (edits + 1)           # the last segments hold one code point more
            size = short + (segment >= edits + 1 - longer)
            start = segment * short + np.maximum(0, segment - (edits + 1 - longer)) + shift
            good = (start >= 0) & (start + size <= n) & (length > edits)
            a = base + np.where(good, start, 0)
            b = a + np.where(good, size, 0)
            own = arrays.mixed((sums[b] - sums[a]) * down[np.minimum(a, len(down) - 1)] + length.astype(np.uint64) * np.uint64(8 * 0x51ED27F5) + np.uint64(segment))
            key[:, c] = np.where(good, own, 0)
        keys.append(key)
        pair = arrays.mixed(value[:-1] * np.uint64(1 << 32) + value[1:]) >> np.uint64(58)
        bit = np.zeros(len(piece), dtype=np.uint64)
        bit[:-1] = np.uint64(1) << pair
        bit[base[1:] - 1] = 0                               # no pair across texts
        sketches.append(np.bitwise_xor.reduceat(bit, base))
        i = j
    if not keys:
        return np.zeros((0, len(plan)), dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(keys), np.concatenate(sketches)


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most k.

    State j holds, as bits of one small number, the diagonals of the band reachable with j edits; a step takes one
    character of b: equal characters keep a diagonal, an edit moves to state j + 1 on the same or a neighbouring one.
    """
    if abs(len(a) - len(b)) > k:
        return False
    low, top = 0, min(len(a), len(b))
    while low < top and a[low] == b[low]:
        low += 1
    high = 0
    while high < top - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low:len(a) - high], b[low:len(b) - high]
    width = (1 << (2 * k + 1)) - 1
    places = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (i + k)
    states = [1 << k]
    for _ in range(k):
        states.append((states[-1] | states[-1] << 1) & width)
    for i, c in enumerate(b):
        same = places.get(c, 0) >> i & width
        following = [states[0] & same]
        for j in range(1, k + 1):
            following.append((states[j] & same | states[j - 1] | states[j - 1] >> 1 | following[-1] << 1) & width)
        states = following
        if not states[k]:
            return False
    end = len(a) - len(b) + k
    return bool(states[k] >> end & 1)


def _scan(docs, edits, min_chars, buckets):
    """Occurrences of lines (id, d, th, no, n, sketch) and, packed per bucket, the probes of each batch's lines."""
    def run(batches):
        for batch in batches:
            for low, high, _, _ in arrays.chunks(batch, 2):
                d, th, texts = (batch.column(c).slice(low, high - low).to_pylist() for c in range(3))
                ids, at_d, at_th, at_no, size, first = [], [], [], [], [], {}
                for i, text in enumerate(texts):
                    for no, line in enumerate(text.split("\n")):
                        if line.translate(_WORD) if line[:1] in " \t\x0b\f\r" else line:
                            key = xxhash.xxh64_intdigest(line.encode(), 42)
                            ids.append(key)
                            at_d.append(d[i])
                            at_th.append(th[i])
                            at_no.append(no)
                            size.append(len(line))
                            first.setdefault(key, line)
                own = [(k, t) for k, t in first.items() if len(t) >= min_chars]
                key, sketch = keys_of([t for _, t in own], edits)
                near = np.array([k for k, _ in own], dtype=np.uint64)
                shown = dict(zip(near.tolist(), sketch.view(np.int64).tolist()))
                yield rows(len(ids), bucket=np.arange(len(ids)) % buckets, id=np.array(ids, dtype=np.uint64).view(np.int64),
                             d=at_d, th=at_th, no=at_no, n=size, sketch=[shown.get(k) for k in ids])
                yield packed(key, near.view(np.int64), buckets, key != 0)
    return docs.mapInArrow(run, OUT_SQL)


def _verified(pairs, texts, edits):
    def run(batches):
        held, own = None, ""
        for batch in batches:
            out_a, out_b = [], []
            for a, salt, b, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if b is None:
                    held, own = (a, salt), text
                elif held == (a, salt) and within(own, text, edits):
                    out_a.append(a)
                    out_b.append(b)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
    return paired(pairs, texts).mapInArrow(run, "a long, b long")


def _texts(docs, ids):
    """id, text of the wanted lines; ids are broadcast only within a counted bound."""
    ids = small(stored(ids.distinct(), "line-ids"), IDS_BOUND)
    lines = docs.select(F.explode(F.split("text", "\n")).alias("text"))
    return lines.withColumn("id", F.xxhash64("text")).join(ids, "id").dropDuplicates(["id"])


def removed_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """d, th, gone: numbers of the lines that go, per text (docs: d, th, text)."""
    if min_chars <= 2 * edits:
        raise ValueError("min_chars must leave every segment of a compared line at least one code point")
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scanned = _scan(docs.select("d", "th", "text"), edits, min_chars, buckets)
    scanned = stored(scanned.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, OUT_SQL).drop("bucket", "pack"), "lines")
    places = scanned.where(F.col("key").isNull()).drop("key")
    lines = stored(places.groupBy("id").agg(
        F.min(F.struct("d", "no")).alias("first"), F.count(F.lit(1)).alias("m"), F.first("n").alias("n"),
        F.first("sketch", ignorenulls=True).alias("sketch")), "distinct-lines")

    about = lines.select("id", "n", "sketch")
    members = stored(scanned.where(F.col("key").isNotNull()).select("key", "id").join(about, "id"), "probes")
    hubs = members.groupBy("key").agg(F.min(F.struct("id", "n", "sketch")).alias("hub"))

    def near(n, m, s, t):
        return (F.abs(n - m) <= edits) & (F.bit_count(s.bitwiseXOR(t)) <= 4 * edits)
    met = stored(members.join(hubs, "key").where(
        (F.col("id") != F.col("hub.id")) & near(F.col("n"), F.col("hub.n"), F.col("sketch"), F.col("hub.sketch"))).select(
        F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct(), "hub-pairs")
    ids = met.select(F.col("a").alias("id")).unionByName(met.select(F.col("b").alias("id")))
    links = stored(_verified(met, _texts(docs, ids), edits), "line-links")
    groups = components(links).withColumnRenamed("node", "id")

    open_ = members.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = open_.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    open_ = stored(open_.join(mixed, "key"), "open-buckets")
    a, b = open_.alias("a"), open_.alias("b")
    more = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.component") < F.col("b.component")) &
                  near(F.col("a.n"), F.col("b.n"), F.col("a.sketch"), F.col("b.sketch")))
    more = more.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
    more = stored(more.join(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "cross-pairs")
    ids = more.select(F.col("a").alias("id")).unionByName(more.select(F.col("b").alias("id")))
    links = links.unionByName(_verified(more, _texts(docs, ids), edits))
    groups = stored(components(links).withColumnRenamed("node", "id"), "line-classes")

    least = groups.join(lines.select("id", "first"), "id").groupBy("component").agg(F.min("first").alias("stays"))
    classes = groups.join(least, "component").select("id", "stays")
    repeated = lines.join(classes, "id", "left").where("m > 1 or stays is not null").select(
        "id", F.coalesce("stays", "first").alias("stays"))
    gone = places.join(repeated, "id").where((F.col("d") != F.col("stays.d")) | (F.col("no") != F.col("stays.no")))
    return gone.groupBy("d", "th").agg(F.collect_set("no").alias("gone"))


def without_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with `text` freed of removed lines, and n_lines and n_removed in a struct column `line_dedup`."""
    text_batches(docs.sparkSession)
    names = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.coalesce("text", F.lit("")).alias("text"),
        F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("rest")).withColumn("th", F.hash("text"))
    gone = removed_lines(names, edits, min_chars)
    joined = names.join(stored(gone, "removed-lines"), ["d", "th"], "left")
    lines = F.split("text", "\n")
    number = F.size(lines).cast("long").alias("n_lines")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(_without(lines, F.col("gone")), "\n"))
    kept = joined.select("rest", kept.alias("text"), F.struct(
        number, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")).alias("line_dedup"))
    return kept.select(*[F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns], "line_dedup")


def _without(lines, gone):
    """The lines whose number is not in `gone`, by a set difference of numbers, so that no list is searched per line."""
    numbers = F.sequence(F.lit(0).cast("long"), F.size(lines).cast("long") - 1)
    return F.transform(F.array_except(numbers, gone), lambda i: F.get(lines, i.cast("int")))
