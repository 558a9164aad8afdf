"""(key, id) pairs that travel packed, many to a row, and are met bucket by bucket inside tasks.

A pair costs 16 bytes in the exchange and never becomes a row unless it is needed. Rows without a pack pass through.
"""

import numpy as np
import pyarrow as pa

OUT = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("d", pa.int64()), ("th", pa.int32()), ("no", pa.int64()),
                 ("n", pa.int64()), ("sketch", pa.int64()), ("key", pa.int64()), ("pack", pa.binary())])
OUT_SQL = "bucket int, id long, d long, th int, no long, n long, sketch long, key long, pack binary"
PAIR = np.dtype([("key", "<u8"), ("id", "<i8")])
OWNED = np.dtype([("key", "<u8"), ("id", "<i8"), ("doc", "<u4")])  # doc: hash of a document that holds the id


def rows(m, **columns):
    """m rows; columns that are not given are null."""
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(m, f.type) for f in OUT], schema=OUT)


def packed(keys, ids, buckets, wanted=None):
    """One pack per bucket of the pairs of each id with each of its keys (a row of `keys`)."""
    flat = keys.ravel()
    pair = np.empty(len(flat), dtype=PAIR)
    pair["key"], pair["id"] = flat, np.repeat(ids, keys.shape[1])
    return dealt(pair if wanted is None else pair[wanted.ravel()], buckets)


def dealt(records, buckets):
    """One pack per bucket of records with a field `key`."""
    bucket = (records["key"] % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    records = records[order]
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = [b for b in range(buckets) if edge[b] < edge[b + 1]]
    return rows(len(full), bucket=np.array(full, dtype=np.int32), pack=[records[edge[b]:edge[b + 1]].tobytes() for b in full])


def streamed(batches, work, passed=None, kind=PAIR):
    """work(distinct records, sorted by key) of each bucket; rows without a pack go to `passed`."""
    bucket, here = None, []
    for batch in batches:
        valid = np.array(batch.column(8).is_valid())
        if passed is not None and not valid.all():
            yield passed(batch.filter(pa.array(~valid)))
        for i in np.flatnonzero(valid):
            b = batch.column(0)[int(i)].as_py()
            if b != bucket and here:
                yield work(np.unique(np.frombuffer(b"".join(here), dtype=kind)))
                here = []
            bucket = b
            here.append(batch.column(8)[int(i)].as_py())
    if here:
        yield work(np.unique(np.frombuffer(b"".join(here), dtype=kind)))


def gather(batches):
    """Pass rows without a pack; of the pairs, make rows (key, id) of those whose key another id shares."""
    def shared(pair):
        same = np.zeros(len(pair) + 1, dtype=bool)
        same[1:-1] = pair["key"][1:] == pair["key"][:-1]
        pair = pair[same[1:] | same[:-1]]
        return rows(len(pair), id=pair["id"], key=pair["key"].view(np.int64))
    yield from streamed(batches, shared, lambda batch: batch)


def gather_owned(batches):
    """As gather, for records that name a document: keys are shared only where two ids first stand in different ones."""
    def shared(held):
        if not len(held):
            return rows(0)
        first = np.ones(len(held), dtype=bool)                      # of each key and id; doc is sorted within
        first[1:] = (held["key"][1:] != held["key"][:-1]) | (held["id"][1:] != held["id"][:-1])
        pair = held[first]
        new = np.ones(len(pair), dtype=bool)
        new[1:] = pair["key"][1:] != pair["key"][:-1]
        at = np.flatnonzero(new)
        several = np.minimum.reduceat(pair["doc"], at) != np.maximum.reduceat(pair["doc"], at)
        pair = pair[several[np.cumsum(new) - 1]]
        return rows(len(pair), id=pair["id"], key=pair["key"].view(np.int64))
    yield from streamed(batches, shared, lambda batch: batch, OWNED)
