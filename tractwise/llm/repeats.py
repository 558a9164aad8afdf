"""Removal of repeated byte strings: a place is dropped when its longest previous factor reaches the given length.

Only whether that factor reaches LENGTH bytes matters, so suffixes are compared by their first LENGTH bytes: in an order
that puts equal strings side by side, the earlier match of a place is the smallest position of its run, and all places
but that one have a previous factor long enough. The order is by hash and is never built over all places at once:

1. Every LENGTH-byte window is assigned to its smallest K-byte gram (leftmost on ties). Equal windows have equal grams,
   so matches lie within the buckets of equal grams. Consecutive windows of one gram are a run, about 39 bytes apart.
2. Runs of equal gram and equal bytes repeat as a whole: all but the first go. First within a batch of texts, so that a
   string of a third of all texts reaches the exchange once per batch; then per bucket.
3. Where a gram has runs of different bytes, their windows are compared one by one, from the bytes of the runs. Grams
   with very many such runs are dealt by window instead of by gram.

Defined results. Null or empty text: no bytes, nothing removed, digest of nothing. Null doc_id: before all others.
Rows of equal doc_id: places of equal start are the same place, so a repeated row is not a later copy of itself. Texts
shorter than LENGTH: kept. Empty table: no rows. Only doc_id and text are read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import stored, text_batches

LENGTH = 100
GRAM = 24
HOT = 1_024          # differing runs of one gram beyond which its windows are dealt singly
BLOCK = 1 << 18
_POS = np.uint64((1 << 20) - 1)
RUN = np.dtype([("h", "<u8"), ("ctx", "<u8"), ("doc", "<i4"), ("start", "<i4"), ("n", "<i2")])
CONTEXT = np.dtype([("doc", "<i4"), ("start", "<i4"), ("n", "<i2"), ("at", "<i8")])
WINDOW = np.dtype([("w", "<u8"), ("doc", "<i4"), ("start", "<i4")])
DOC = np.dtype([("d", "<i8"), ("th", "<i4")])
_ADD = np.uint64(0x632BE59BD9B4E019)


def _sums(piece):
    """Prefix sums of a piece's polynomial hash."""
    value = piece.astype(np.uint64)
    value += np.uint64(1)
    value *= arrays._UP[:len(piece)]
    total = np.zeros(len(piece) + 1, dtype=np.uint64)
    np.cumsum(value, out=total[1:])
    return total


def _span(total, a, b):
    return (total[b] - total[a]) * arrays._DOWN[a]


def _lowest(v, width):
    """Smallest value of every window of `width` entries."""
    step = 1
    while 2 * step <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    rest = width - step
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def runs_of(data, offsets, length=LENGTH, gram=GRAM):
    """Runs of all texts: gram hash, hash of the run's bytes, text number, first window, number of windows."""
    out, low, high = [], int(offsets[0]), int(offsets[-1])
    while high - low >= length:
        end = min(low + BLOCK + length - 1, high)
        piece = data[low:end]
        total = _sums(piece)
        places = np.arange(len(piece) - gram + 1)
        h = arrays.mixed(_span(total, places, places + gram))
        lowest = _lowest((h & ~_POS) | places.astype(np.uint64), length - gram + 1)
        anchor = (lowest & _POS).astype(np.int64)
        starts = np.arange(len(anchor))
        doc = np.searchsorted(offsets, starts + low, "right") - 1
        good = starts + low + length <= offsets[doc + 1]
        begin = good.copy()
        begin[1:] &= (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~good[:-1]
        last = good.copy()
        last[:-1] &= (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~good[1:]
        a, b = np.flatnonzero(begin), np.flatnonzero(last)
        run = np.empty(len(a), dtype=RUN)
        run["h"] = h[anchor[a]]
        run["n"] = b - a + 1
        where = (anchor[a] - a).astype(np.uint64) * np.uint64(1 << 20) + run["n"].astype(np.uint64)
        run["ctx"] = arrays.mixed(_span(total, a, b + length) + where * _ADD)
        run["doc"] = doc[a]
        run["start"] = a + low - offsets[doc[a]]
        out.append(run)
        low += len(anchor)
    return np.concatenate(out) if out else np.zeros(0, dtype=RUN)


def _ranked(d, start):
    """A number per row that orders (d, start) and is equal for equal pairs."""
    order = np.lexsort((start, d))
    new = np.ones(len(d), dtype=np.int64)
    new[1:] = (d[order][1:] != d[order][:-1]) | (start[order][1:] != start[order][:-1])
    rank = np.empty(len(d), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _later(keys, d, start):
    """Which rows have an earlier (d, start) among the rows of equal keys."""
    n = len(d)
    if not n:
        return np.zeros(0, dtype=bool)
    rank = _ranked(d, start)
    order = np.lexsort((rank, *reversed(keys)))
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    least = rank[order][np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    out = np.empty(n, dtype=bool)
    out[order] = rank[order] != least
    return out


def _merged(doc, start, n):
    """Join window ranges of a text that touch."""
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order].astype(np.int64), n[order].astype(np.int64)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.add.reduceat(n, at) if len(at) else n


OUT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("d", pa.int64()), ("th", pa.int32()), ("h", pa.int64()),
                 ("start", pa.int64()), ("n", pa.int64()), ("docs", pa.binary()), ("rows", pa.binary()), ("bytes", pa.binary())])
OUT_SQL = "kind int, bucket int, d long, th int, h long, start long, n long, docs binary, rows binary, bytes binary"
DONE, RUNS, MIXED, MANY, CONTEXTS, WINDOWS = range(6)


def _rows(kind, m, **columns):
    """m output rows of a kind; columns that are not given are null."""
    columns["kind"] = np.full(m, kind, dtype=np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(m, f.type) for f in OUT], schema=OUT)


def _gone(doc, start, n, docs):
    doc, start, n = _merged(doc, start, n)
    return _rows(DONE, len(doc), bucket=(doc % 1024).astype(np.int32), d=docs["d"][doc], th=docs["th"][doc], start=start, n=n)


def _dealt(kind, rows, hashes, docs, buckets, payload=None):
    """Rows packed per bucket, each pack with the documents it names."""
    bucket = (arrays.mixed(hashes) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out = {"bucket": [], "docs": [], "rows": [], "bytes": []}
    for i in range(buckets):
        part = rows[order[edges[i]:edges[i + 1]]]
        if len(part):
            used, local = np.unique(part["doc"], return_inverse=True)
            part["doc"] = local
            extra = b""
            if payload is not None:
                extra = b"".join(payload[a] for a in part["at"])
            out["bucket"].append(i)
            out["docs"].append(docs[used].tobytes())
            out["rows"].append(part.tobytes())
            out["bytes"].append(extra)
    return _rows(kind, len(out["bucket"]), **out)


def _unpacked(batches, kind_of):
    """All packs of a bucket at once, with text numbers over one list of documents."""
    docs, rows, extra, n = [], [], [], 0
    for d, r, e in batches:
        d = np.frombuffer(d, dtype=DOC)
        r = np.frombuffer(r, dtype=kind_of).copy()
        r["doc"] += n
        n += len(d)
        docs.append(d)
        rows.append(r)
        extra.append(e)
    return (np.concatenate(docs) if docs else np.zeros(0, dtype=DOC),
            np.concatenate(rows) if rows else np.zeros(0, dtype=kind_of), extra)


def _per_bucket(batches, work):
    """Stream sorted rows: rows of kind DONE pass, the packs of each bucket go to `work`."""
    bucket, packs = None, []
    for batch in batches:
        kinds = np.array(batch.column(0))
        done = kinds == DONE
        if done.any():
            yield batch.filter(pa.array(done))
        for i in np.flatnonzero(~done):
            here = batch.column(1)[int(i)].as_py()
            if here != bucket and packs:
                yield from work(packs)
                packs = []
            bucket = here
            packs.append((int(kinds[i]), *(batch.column(c)[int(i)].as_py() for c in (7, 8, 9))))
    if packs:
        yield from work(packs)


def _windows(total, starts, length):
    return arrays.mixed(_span(total, starts, starts + length))


def removed_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, buckets: int | None = None) -> DataFrame:
    """d, th, start, n: ranges of window starts to remove, per text (docs: d, th, text)."""
    if buckets is None:
        buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def find(batches):
        for batch in batches:
            names = np.empty(batch.num_rows, dtype=DOC)
            names["d"], names["th"] = np.array(batch.column(0)), np.array(batch.column(1))
            parts = []
            for low, high, data, offsets in arrays.chunks(batch, 2):
                part = runs_of(data, offsets, length, gram)
                part["doc"] += low
                parts.append(part)
            run = np.concatenate(parts) if parts else np.zeros(0, dtype=RUN)
            later = _later([run["h"], run["ctx"]], names["d"][run["doc"]], run["start"])
            yield _gone(run["doc"][later], run["start"][later], run["n"][later], names)
            yield _dealt(RUNS, run[~later], run["h"][~later], names, buckets)

    def settle(batches):
        def work(packs):
            names, run, _ = _unpacked([p[1:] for p in packs], RUN)
            later = _later([run["h"], run["ctx"]], names["d"][run["doc"]], run["start"])
            if later.any():
                yield _gone(run["doc"][later], run["start"][later], run["n"][later], names)
            run = run[~later]
            order = np.lexsort((run["ctx"], run["h"]))
            run = run[order]
            new = np.ones(len(run), dtype=bool)
            new[1:] = run["h"][1:] != run["h"][:-1]
            group = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            distinct = new.copy()
            distinct[1:] |= run["ctx"][1:] != run["ctx"][:-1]
            kinds = np.add.reduceat(distinct.astype(np.int64), at)[group] if len(at) else np.zeros(0, dtype=np.int64)
            open_ = kinds > 1
            part, many = run[open_], kinds[open_] > HOT
            if len(part):
                out = _rows(MIXED, len(part), d=names["d"][part["doc"]], th=names["th"][part["doc"]],
                            h=part["h"].view(np.int64), start=part["start"], n=part["n"])
                yield out.set_column(0, OUT[0], pa.array(np.where(many, MANY, MIXED).astype(np.int32)))
        yield from _per_bucket(batches, work)

    found = docs.mapInArrow(find, OUT_SQL).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    verdicts = stored(found.mapInArrow(settle, OUT_SQL).select("kind", "d", "th", "h", "start", "n"), "runs")

    def expand(batches):
        for batch in batches:
            m = batch.num_rows
            names = np.empty(m, dtype=DOC)
            names["d"], names["th"] = np.array(batch.column(0)), np.array(batch.column(1))
            data, offsets = arrays.texts_of(batch.column(2))
            kept, texts, seen = [], [], []
            for i, todo in enumerate(batch.column(3)):
                text = data[offsets[i]:offsets[i + 1]]
                for run in todo.as_py():
                    a, n = run["start"], run["n"]
                    piece = text[a:a + n + length - 1]
                    if run["kind"] == MIXED:
                        kept.append((i, a, n, len(texts), run["h"]))
                        texts.append(piece.tobytes())
                    else:
                        w = np.empty(n, dtype=WINDOW)
                        w["w"] = _windows(_sums(piece), np.arange(n), length)
                        w["doc"], w["start"] = i, np.arange(a, a + n)
                        seen.append(w)
            if kept:
                kept = np.array(kept, dtype=[*((k, CONTEXT[k]) for k in CONTEXT.names), ("h", "<i8")])
                rows = np.empty(len(kept), dtype=CONTEXT)
                for k in CONTEXT.names:
                    rows[k] = kept[k]
                yield _dealt(CONTEXTS, rows, kept["h"].view(np.uint64), names, buckets, texts)
            if seen:
                w = np.concatenate(seen)
                later = _later([w["w"]], names["d"][w["doc"]], w["start"])
                yield _gone(w["doc"][later], w["start"][later], np.ones(later.sum(), dtype=np.int64), names)
                yield _dealt(WINDOWS, w[~later], w["w"][~later], names, buckets)

    def compare(batches):
        def work(packs):
            names, row, extra = _unpacked([p[1:] for p in packs if p[0] == CONTEXTS], CONTEXT)
            own, w, _ = _unpacked([p[1:] for p in packs if p[0] == WINDOWS], WINDOW)
            w["doc"] += len(names)
            names = np.concatenate([names, own])
            data = np.frombuffer(b"".join(extra), dtype=np.uint8)
            size = row["n"].astype(np.int64) + length - 1
            first = np.cumsum(size) - size
            parts, i = [w], 0
            while i < len(row):  # contexts lie end to end; hash as many as fit a block
                j = max(i + 1, int(np.searchsorted(first, first[i] + BLOCK, "right")) - 1)
                total = _sums(data[first[i]:first[j - 1] + size[j - 1]])
                n = row["n"][i:j].astype(np.int64)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                part = np.empty(len(inner), dtype=WINDOW)
                part["w"] = _windows(total, np.repeat(first[i:j] - first[i], n) + inner, length)
                part["doc"] = np.repeat(row["doc"][i:j], n)
                part["start"] = np.repeat(row["start"][i:j], n) + inner
                parts.append(part)
                i = j
            w = np.concatenate(parts)
            later = _later([w["w"]], names["d"][w["doc"]], w["start"])
            if later.any():
                yield _gone(w["doc"][later], w["start"][later], np.ones(later.sum(), dtype=np.int64), names)
        yield from _per_bucket(batches, work)

    todo = verdicts.where(F.col("kind") != DONE).groupBy("d", "th").agg(F.collect_list(F.struct("kind", "h", "start", "n")).alias("todo"))
    opened = docs.join(todo, ["d", "th"]).select("d", "th", "text", "todo").mapInArrow(expand, OUT_SQL)
    compared = opened.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(compare, OUT_SQL)
    done = verdicts.where(F.col("kind") == DONE)
    return done.select("d", "th", "start", "n").unionByName(compared.select("d", "th", "start", "n"))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, spans: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row; with spans also kept (bytes) and the removed spans."""
    text_batches(docs.sparkSession)
    names = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.hash("text").alias("th"), "text")
    ranges = removed_ranges(names.select("d", "th", "text"), length, gram).groupBy("d", "th").agg(
        F.collect_list("start").alias("starts"), F.collect_list(F.col("start") + F.col("n") + F.lit(length - 1)).alias("ends"))
    joined = names.select("d", "th", "text").join(ranges, ["d", "th"], "left").select("d", "text", "starts", "ends")

    def cut(batches):
        for batch in batches:
            data, offsets = arrays.texts_of(batch.column(1))
            sizes, removed, counts, digests, texts, places = [], [], [], [], [], []
            for i in range(batch.num_rows):
                text = data[offsets[i]:offsets[i + 1]].tobytes()
                a, b = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                gone = []
                for x, y in sorted(zip(a or [], b or [])):
                    if gone and x <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], y)
                    else:
                        gone.append([x, y])
                kept, at = [], 0
                for x, y in gone:
                    kept.append(text[at:x])
                    at = y
                kept = b"".join([*kept, text[at:]])
                sizes.append(len(text))
                removed.append(len(text) - len(kept))
                counts.append(len(gone))
                digests.append(hashlib.sha256(kept).hexdigest())
                if spans:
                    texts.append(kept)
                    places.append([{"start": x, "end": y} for x, y in gone])
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()),
                       pa.array(digests, pa.string())]
            if spans:
                columns += [pa.array(texts, pa.binary()), pa.array(places, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, names=shown[:len(columns)])

    shown = ["d", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"]
    schema = "d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (
        ", kept binary, removed array<struct<start:long,end:long>>" if spans else "")
    out = joined.mapInArrow(cut, schema)
    return out.withColumn("d", F.when(F.col("d") != -(1 << 63), F.col("d"))).withColumnRenamed("d", "doc_id")
