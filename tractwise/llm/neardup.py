"""MinHash near-duplicates through a multi-index Hamming join over b-bit signatures.

Signature: POSITIONS b-bit minima of the document's shingle set. Chunks of CHUNK positions; two signatures that differ
in at most MAX_DIFFER positions differ, by the pigeonhole principle, in at most MAX_DIFFER // chunks positions of some
chunk. Those allowed errors are enumerated: every way to leave that many positions of a chunk out is one key. So
documents within the distance share a key. A pair over the Jaccard threshold exceeds the distance with a probability
of about 1e-6 (24 positions, 15 differing, similarity 0.8); every link is confirmed on the full sets.

No group is expanded into its pairs: documents of equal sets are one class; in a bucket every class is compared with
one hub first; only buckets that then still hold several components are compared further, across components, and there
only pairs whose unshared shingles leave room for a link, again with hubs before pair by pair.

Defined results. Null or empty text: an empty set, linked with nothing. Fewer words than a shingle: one shingle. Null
doc_id: cannot name a component, so it is linked with nothing and its component_id is null. Repeated rows: one class.
Empty table: no rows. Only doc_id and text are read.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import small, stored, text_batches
from .components import components, paired
from .packs import OUT_SQL, dealt, gather, packed, streamed

SHINGLE = 4
PERCENT = 80
POSITIONS = 24
CHUNK = 3
BITS = 32
MAX_DIFFER = 15
HUBS = 4
ROUNDS = 2   # in which members outside the largest component of a bucket meet another hub
IDS_BOUND = 200_000  # (id, doc_id) rows that may be broadcast


def _seeds(n):
    x = np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = arrays.mixed(x)
    return x[:n], x[n:] | np.uint64(1)


def fingerprints(docs: DataFrame, k: int = SHINGLE, positions: int = POSITIONS, bits: int = BITS) -> DataFrame:
    """doc_id, n (set size), set_id (fingerprint of the set), sig (minima, array of b-bit numbers; null for an empty set)."""
    xors, odds = _seeds(positions)

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in arrays.chunks(batch, 1):
                hashes, bounds, _ = arrays.words_of(data, offsets, lower=True)
                value, at = arrays.shingle_sets(hashes, bounds, k)
                size = np.diff(at)
                full = np.flatnonzero(size)
                set_id = arrays.per_text(np.add, arrays.mixed(value), at, 0)
                set_id = arrays.mixed(set_id ^ arrays.per_text(np.bitwise_xor, arrays.mixed(value + np.uint64(7)), at, 0))
                sig = np.empty((len(full), positions), dtype=np.int64)
                for i in range(positions):
                    drawn = (value ^ xors[i]) * odds[i]
                    drawn ^= drawn >> np.uint64(29)
                    drawn *= odds[i]
                    sig[:, i] = (np.minimum.reduceat(drawn, at[:-1][full]) >> np.uint64(64 - bits)).astype(np.int64) if len(full) else 0
                lists = [None] * len(size)
                for row, i in enumerate(full):
                    lists[i] = sig[row]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low), pa.array(size, pa.int64()),
                    pa.array(set_id.view(np.int64), pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "set_id", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, set_id long, sig array<long>")


def keys_of(sigs, chunk: int = CHUNK, max_differ: int = MAX_DIFFER):
    """Bucket keys of signatures (rows): per chunk, one for each way to leave the allowed number of positions out."""
    positions = sigs.shape[1]
    chunks = [range(i, min(i + chunk, positions)) for i in range(0, positions, chunk)]
    errors = max_differ // len(chunks)
    out = []
    for places in chunks:
        for kept in combinations(places, max(1, len(places) - errors)):
            key = np.full(len(sigs), kept[0] + 1, dtype=np.uint64)
            for p in kept:
                key = arrays.mixed(key * np.uint64(arrays._P) + sigs[:, p].astype(np.uint64) + np.uint64(p))
            out.append(key)
    return np.stack(out, axis=1)


def _buckets(classes: DataFrame) -> DataFrame:
    """key, id: the bucket keys that two classes or more share. Keys travel packed; only shared ones become rows."""
    buckets = 4 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches):
        for batch in batches:
            ids = np.array(batch.column(0))
            if len(ids):
                yield packed(keys_of(np.stack(batch.column(1).to_numpy(zero_copy_only=False))), ids, buckets)

    found = classes.select("set_id", "sig").mapInArrow(pack, OUT_SQL).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return found.mapInArrow(gather, OUT_SQL).select("key", "id")


HELD = np.dtype([("key", "<u8"), ("owner", "<i8"), ("id", "<i8")])


def unshared(texts: DataFrame, k: int) -> DataFrame:
    """id, u: how many of a text's shingles are held by no text of another owner (texts: id, owner, text)."""
    buckets = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def runs(held):
        """First entry of each key, and whether its entries have several owners."""
        first = np.ones(len(held), dtype=bool)
        first[1:] = held["key"][1:] != held["key"][:-1]
        at = np.flatnonzero(first)
        if not len(at):
            return at, np.zeros(0, dtype=bool), at
        several = np.minimum.reduceat(held["owner"], at) != np.maximum.reduceat(held["owner"], at)
        return at, several, np.cumsum(first) - 1

    def pack(batches):
        for batch in batches:
            ids, owners, parts = np.array(batch.column(0)), np.array(batch.column(1)), []
            for low, high, data, offsets in arrays.chunks(batch, 2):
                hashes, bounds, _ = arrays.words_of(data, offsets, lower=True)
                value, at = arrays.shingle_sets(hashes, bounds, k)
                part = np.empty(len(value), dtype=HELD)
                part["key"] = value
                part["owner"], part["id"] = (np.repeat(x[low:high], np.diff(at)) for x in (owners, ids))
                parts.append(part)
            if parts:
                held = np.concatenate(parts)
                held = held[np.lexsort((held["owner"], held["key"]))]
                at, several, group = runs(held)
                # a shingle of several owners is sent for its least and its greatest: enough to show that it is shared
                ends = np.append(at[1:], len(held)) - 1
                keep = ~several[group]
                keep[at] = keep[ends] = True
                yield dealt(held[keep], buckets)

    def count(batches):
        def of(held):
            _, several, group = runs(held)
            found, n = np.unique(held["id"][~several[group]] if len(held) else held["id"], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["id", "u"])
        yield from streamed(batches, of, kind=HELD)

    sent = texts.select("id", "owner", "text").mapInArrow(pack, OUT_SQL).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(count, "id long, u long").groupBy("id").agg(F.sum("u").alias("u"))


def with_room(members: DataFrame, sizes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Members (key, id, component) with n and c, the shingles that an owner's other texts cannot account for left out.

    A link of x and y of different owners needs c shingles in common with 100 c >= percent (n_x + n_y - c), c being the
    smaller of theirs; members that cannot reach it with any partner go, and buckets that hold one component go.
    """
    bounds = sizes.join(unshared(texts, k), "id", "left").withColumn("c", F.col("n") - F.coalesce("u", F.lit(0))).drop("u")
    bounds = stored(bounds.where(100 * F.col("c") >= percent * F.col("n")), "bounds")
    return stored(in_open_buckets(members.join(bounds, "id")), "live-buckets")


def _room(a, b, percent, owned):
    """Condition that two members are of different components and that their shared shingles leave room for a link."""
    most = F.least(a["c"], b["c"])
    room = (a["component"] != b["component"]) & (100 * most >= percent * (a["n"] + b["n"] - most))
    return room & (a["owner"] != b["owner"]) if owned else room


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def across(live: DataFrame, links: DataFrame, tried: DataFrame, confirm, percent: int, rounds: int = ROUNDS):
    """Further links between members (key, id, component, n, c, perhaps owner) of open buckets.

    In each round the members outside a bucket's largest component meet one member of it, another one per bucket and
    round. What then is still apart is compared pair by pair.
    """
    owned = "owner" in live.columns
    about = [c for c in live.columns if c != "key"]
    for r in range(rounds):
        if live.isEmpty():
            return links
        of_component = live.groupBy("key", "component").agg(
            F.count(F.lit(1)).alias("m"), F.min(F.struct(F.xxhash64(F.lit(r), "key", "id").alias("draw"), *about)).alias("one"))
        hubs = of_component.groupBy("key").agg(F.max(F.struct("m", "one")).alias("h")).select("key", "h.one")
        met = live.join(hubs, "key").where(_room({c: F.col(c) for c in about}, {c: F.col("one")[c] for c in about}, percent, owned))
        met = met.select(*_ordered(F.col("id"), F.col("one.id"))).distinct().join(tried, ["a", "b"], "left_anti")
        met = stored(met, "hub-pairs")
        tried = tried.unionByName(met)
        more = stored(confirm(met), "links")
        if more.isEmpty():
            continue
        links = links.unionByName(more)
        groups = stored(components(links).withColumnRenamed("node", "id"), "components")
        live = live.drop("component").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
        live = stored(in_open_buckets(live), "live-buckets")
    a, b = live.alias("a"), live.alias("b")
    sides = [{c: F.col(f"{x}.{c}") for c in about} for x in "ab"]
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.component") < F.col("b.component")) & _room(*sides, percent, owned))
    met = met.select(*_ordered(F.col("a.id"), F.col("b.id"))).distinct().join(tried, ["a", "b"], "left_anti")
    met = stored(met, "cross-pairs")
    return links if met.isEmpty() else stored(links.unionByName(confirm(met)), "all-links")


def _distance(a, b):
    """Positions in which two signatures differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def confirmed(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of set ids whose full sets are similar enough.

    A task holds two sets at a time, however many pairs an a has. texts: id, text.
    """
    def run(batches):
        held, own = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            out_a, out_b = [], []
            for low, high, data, offsets in arrays.chunks(batch, 3):
                hashes, bounds, _ = arrays.words_of(data, offsets, lower=True)
                value, at = arrays.shingle_sets(hashes, bounds, k)
                a, salt, b = (batch.column(i).slice(low, high - low).to_pylist() for i in range(3))
                for i in range(high - low):
                    here = value[at[i]:at[i + 1]]
                    if b[i] is None:
                        held, own = (a[i], salt[i]), here.copy()
                    elif held == (a[i], salt[i]):
                        common = np.isin(here, own, assume_unique=True, kind="sort").sum()
                        if 100 * int(common) >= percent * (len(own) + len(here) - int(common)):
                            out_a.append(a[i])
                            out_b.append(b[i])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return paired(pairs, texts).mapInArrow(run, "a long, b long")


def _close(pairs, about, percent):
    """Pairs whose set sizes and signatures allow a link."""
    def side(x):
        return about.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) &
                      (_distance(F.col("sig_a"), F.col("sig_b")) <= MAX_DIFFER)).select("a", "b")


def _ids(pairs):
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))


def in_open_buckets(members):
    """Members of the buckets that hold several components."""
    several = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return members.join(several.select("key"), "key")


def _texts(docs, classes, ids):
    """id, text of the wanted classes, each from its first document."""
    wanted = classes.select(F.col("set_id").alias("id"), F.col("first").alias("doc_id")).join(ids.distinct(), "id")
    return docs.join(small(stored(wanted, "wanted"), IDS_BOUND), "doc_id").select("id", "text").dropDuplicates(["id"])


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = stored(fingerprints(docs, k), "fingerprints")
    usable = prints.where(F.col("sig").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(usable.groupBy("set_id").agg(
        F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")

    about = classes.select(F.col("set_id").alias("id"), "n", "sig")
    members = stored(_buckets(classes), "buckets")

    # hubs are drawn anew in each of HUBS parts of the keys, so that a large group meets several of its members
    part = F.pmod("key", F.lit(HUBS))
    hubs = members.groupBy("key").agg(F.min(F.struct(F.xxhash64(part, "id"), "id")).alias("hub"))
    met = members.join(hubs, "key").where(F.col("id") != F.col("hub.id")).select(
        F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()
    met = stored(_close(met, about, percent), "hub-pairs")
    links = stored(confirmed(met, _texts(docs, classes, _ids(met)), k, percent), "links")
    groups = stored(components(links).withColumnRenamed("node", "id"), "components")

    # buckets that still hold several components: compare across components, but only classes whose shingles that no
    # other such class holds leave room for a link
    open_ = members.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = stored(in_open_buckets(open_), "open-buckets")
    texts = stored(_texts(docs, classes, open_.select("id")), "texts")
    live = with_room(open_, about.select("id", "n"), texts.withColumn("owner", F.col("id")), k, percent)
    links = across(live, links, met, lambda pairs: confirmed(pairs, texts, k, percent), percent)
    groups = stored(components(links).withColumnRenamed("node", "set_id"), "components")

    ends = classes.select("set_id", "first").join(groups, "set_id", "left")
    ends = ends.withColumn("component", F.coalesce("component", "set_id"))
    least = ends.groupBy("component").agg(F.min("first").alias("component_id"))
    named = ends.join(least, "component").select("set_id", "component_id")
    linked = F.col("sig").isNotNull() & F.col("doc_id").isNotNull()
    out = prints.withColumn("has", linked).join(named, "set_id", "left")
    component = F.when(F.col("has"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
