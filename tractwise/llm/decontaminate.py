"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over hashed words, weighted by document frequencies of the whole corpus; words of more than
STOP_SHARE of its documents (and STOP_LEAST) weigh nothing. A randomised
SVD of the benchmark's passages (range finder with power steps; partial products are summed over tasks) gives the latent
space; windows of the documents are folded into it. A window whose cosine with an item reaches MIN_COSINE is a
candidate. The basis has at most RANK dimensions and holds some passages poorly where there are more; so is a window
that holds MIN_SHARE of a passage's full weight, found exactly through postings of the passages' rarest words. A
candidate is confirmed where the longest common subsequence of words covers STRONG of the item, or covers
WEAK of it and the item's answer (an `answer` column, else its last sentence) stands in the window's neighbourhood word
for word. Windows that hold too little of the benchmark's vocabulary for any item to reach the cosine's share are
passed over by the latent search, which loses no candidate.

The benchmark is the query set: it is held in blocks of BLOCK_ITEMS, each against all documents.

Defined results. Null or empty document text: no window. Null or wordless item: never matched. Null doc_id or item_id:
carried as they are. Repeated rows: each for itself. Empty tables: no rows. Only doc_id and text (item_id, text,
answer) are read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import stored, text_batches

DIMS = 1 << 16
RANK = 256
OVERSAMPLE = 8
POWER_STEPS = 2
WINDOW, STRIDE = 64, 32
MIN_COSINE = 0.35
MIN_SHARE = 0.35        # of an item's weight that a window has to hold
STRONG, WEAK = 0.75, 0.5
PREFIX = 0.85            # of an item's weight, in its rarest words, through which windows are met exactly
CELLS = 1 << 22          # of windows by passages that are summed at once
SEED = 11
STOP_SHARE, STOP_LEAST = 0.1, 100  # words of more documents than both weigh nothing
BLOCK_ITEMS = 20_000
_STOP = np.frombuffer(b".?!\n", dtype=np.uint8)


def _tokens(data, offsets):
    return arrays.words_of(data, offsets, lower=True, parts=arrays.MARKS)


def document_frequencies(docs: DataFrame):
    """Number of documents, and of documents that hold each hashed word, over the whole table; DIMS numbers."""
    def count(batches):
        held, n = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, data, offsets in arrays.chunks(batch, 0):
                hashes, bounds, _ = _tokens(data, offsets)
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                once = np.unique(owner * DIMS + (hashes % np.uint64(DIMS)).astype(np.int64))
                held += np.bincount(once % DIMS, minlength=DIMS)
        dims = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(dims, DIMS), pa.int32()), pa.array(np.append(held[dims], n), pa.int64())], names=["dim", "n"])
    rows = docs.select("text").mapInArrow(count, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros(DIMS + 1, dtype=np.int64)
    held[rows["dim"]] = rows["n"]
    return int(held[DIMS]), held[:DIMS]


def item_vectors(items: DataFrame):
    """Per passage of an item: item number, hashed words; long items give several passages. One row per passage."""
    def cut(batches):
        for batch in batches:
            data, offsets = arrays.texts_of(batch.column(1))
            hashes, bounds, _ = _tokens(data, offsets)
            no, dims = [], []
            for i in range(batch.num_rows):
                own = hashes[bounds[i]:bounds[i + 1]]
                for a in range(0, max(1, len(own) - WINDOW + STRIDE), STRIDE):
                    if len(own):
                        no.append(batch.column(0)[i].as_py())
                        dims.append(np.unique(own[a:a + WINDOW] % np.uint64(DIMS)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(dims, pa.list_(pa.int64()))], names=["no", "dims"])
    return items.select("no", "text").mapInArrow(cut, "no long, dims array<long>")


def latent_basis(vectors: DataFrame, idf, rank=RANK):
    """Dimensions in use, and for each its row of the basis: top right singular vectors of the passages' matrix.

    Products A'(A Q) are summed over tasks in a tree; what is held outside has DIMS x (rank + OVERSAMPLE) numbers at most.
    """
    used = np.array(sorted(r[0] for r in vectors.select(F.explode("dims")).distinct().collect()), dtype=np.int64)
    place = np.full(DIMS, -1, dtype=np.int64)
    place[used] = np.arange(len(used))
    width = min(rank + OVERSAMPLE, max(1, len(used)))
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((len(used), width)))[0]
    context = vectors.sparkSession.sparkContext
    held = vectors.select("dims").rdd.map(lambda r: r[0])
    for step in range(POWER_STEPS + 1):
        shared = context.broadcast(q)

        def product(rows, shared=shared):
            total = np.zeros_like(shared.value)
            for dims in rows:
                at = place[np.array(dims)]
                w = idf[np.array(dims)]
                total[at] += np.outer(w, w @ shared.value[at])
            yield total
        y = held.mapPartitions(product).treeReduce(np.add)
        if step < POWER_STEPS:
            q = np.linalg.qr(y)[0]
    values, turn = np.linalg.eigh(q.T @ y)
    order = np.argsort(-values)[:rank]
    return used, (q @ turn[:, order]).astype(np.float32)


def common_words(item, text, masks=None):
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    if masks is None:
        masks = word_masks(item)
    full = (1 << len(item)) - 1
    v = full
    for word in text:
        m = masks.get(word)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def word_masks(item):
    masks = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


def _holds(text, part):
    """Whether `part` stands in `text` as one run of words."""
    n = len(part)
    return n > 0 and any(text[i:i + n] == part for i, word in enumerate(text) if word == part[0])


def _block(rows):
    """By item number: its words, their masks, and its answer's words."""
    out = {}
    for no, text, answer in rows:
        def words(t):
            raw = np.frombuffer((t or "").encode(), dtype=np.uint8)
            return raw, *_tokens(raw, np.array([0, len(raw)]))
        raw, hashes, _, spans = words(text)
        own = hashes.tolist()
        if answer is not None:
            tail = words(answer)[1].tolist()
        else:
            stops = np.flatnonzero(np.isin(raw, _STOP))
            stops = stops[stops < (spans[-1, 1] if len(spans) else 0)]
            tail = hashes[spans[:, 0] > stops[-1]].tolist() if len(stops) else []
            tail = tail if len(tail) >= 3 else own[-5:]
        out[no] = (own, word_masks(own), tail)
    return out


def matches(docs: DataFrame, items: DataFrame, min_cosine=MIN_COSINE, strong=STRONG, weak=WEAK) -> DataFrame:
    """One row per contaminated (document, item): doc_id, item_id, cosine, lcs_words, item_words, answer_found."""
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    if "answer" not in items.columns:
        items = items.withColumn("answer", F.lit(None).cast("string"))
    items = items.select("item_id", "text", "answer")
    numbered = stored(spark.createDataFrame(
        items.rdd.zipWithIndex().map(lambda x: (x[1], *x[0])), "no long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)), "items")
    n, held = document_frequencies(docs)
    idf = np.log((n + 1) / (held + 1)) + 0.05
    vectors = stored(item_vectors(numbered), "item-passages")
    # a passage of nothing but stop words keeps their weights
    bare = np.where(held > max(STOP_SHARE * n, STOP_LEAST), 0.0, idf)
    for r in vectors.where(F.size("dims") > 0).toLocalIterator():
        if not bare[r["dims"]].any():
            bare[r["dims"]] = idf[r["dims"]]
    full, idf = idf, bare
    count = numbered.count()
    found = None
    if count and vectors.limit(1).count():
        used, basis = latent_basis(vectors, idf, min(RANK, vectors.count()))
        for low in range(0, count, BLOCK_ITEMS):
            inside = (F.col("no") >= low) & (F.col("no") < low + BLOCK_ITEMS)
            block = _block(numbered.where(inside).select("no", "text", "answer").toLocalIterator())
            passages = vectors.where(inside).toPandas()
            if len(passages):
                part = _search(docs, block, passages, idf, full, used, basis, min_cosine, strong, weak)
                found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "doc_id long, no long, cosine double, lcs_words long, item_words long, answer_found boolean")
    return found.join(numbered.select("no", "item_id"), "no").select(
        "doc_id", "item_id", "cosine", "lcs_words", "item_words", "answer_found")


def _search(docs, block, passages, idf, full, used, basis, min_cosine, strong, weak):
    place = np.full(DIMS, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    latent = np.stack([idf[d].astype(np.float32) @ basis[place[d]] for d in passages["dims"]])
    norm = np.linalg.norm(latent, axis=1)
    latent = latent / np.maximum(norm, 1e-9)[:, None]
    owner = passages["no"].to_numpy()
    least = MIN_SHARE ** 2 * min((idf[d] ** 2).sum() for d in passages["dims"])
    weight = np.where(place >= 0, idf, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast((block, place, basis, latent.T.copy(), owner, weight, _postings(passages["dims"], full)))

    def run(batches):
        block, place, basis, latent, owner, weight, postings = shared.value
        for batch in batches:
            out = {k: [] for k in ("doc", "no", "cosine", "lcs", "m", "answer")}
            for first, last, data, offsets in arrays.chunks(batch, 1):
                hashes, bounds, _ = _tokens(data, offsets)
                dims = (hashes % np.uint64(DIMS)).astype(np.int64)
                mass = np.concatenate([[0.0], np.cumsum(weight[dims] ** 2)])
                size = np.diff(bounds)
                blocks = -(-size // STRIDE)
                number = np.where(size > 0, np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1), 0)
                doc = np.repeat(np.arange(len(size)), number)
                inner = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                start = bounds[:-1][doc] + STRIDE * inner
                end = np.minimum(start + WINDOW, bounds[1:][doc])
                rich = np.flatnonzero(mass[end] - mass[start] >= least)
                # a window is the sum of the blocks it holds, and a block is folded once
                own = np.repeat(np.arange(len(size)), blocks)
                low = bounds[:-1][own] + STRIDE * (np.arange(len(own)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
                first_block = (np.cumsum(blocks) - blocks)[doc] + inner
                best = {}
                for i in range(0, len(rich), 8_192):
                    part = rich[i:i + 8_192]
                    for w, p, c in _candidates(first_block[part], end[part], low, np.minimum(low + STRIDE, bounds[1:][own]), dims,
                                               place, basis, latent, weight, min_cosine):
                        key = (int(doc[part[w]]), int(owner[p]))
                        seen = best.setdefault(key, {})
                        seen[int(part[w])] = max(seen.get(int(part[w]), (-1.0, 0)), (float(c), int(p)))
                for w, p in _held(first_block, own, low, np.minimum(low + STRIDE, bounds[1:][own]), dims, postings, latent.shape[1]):
                    best.setdefault((int(doc[w]), int(owner[p])), {}).setdefault(int(w), (None, int(p)))
                for (i, no), windows in best.items():
                    item, masks, answer = block[no]
                    top, lcs, answered = 0.0, 0, False
                    for w, (c, p) in windows.items():
                        a, b = max(bounds[i], start[w] - len(item) // 2), min(bounds[i + 1], end[w] + len(item) // 2)
                        text = hashes[a:b].tolist()
                        got = common_words(item, text, masks)
                        if c is None:
                            c = 0.0 if got < weak * len(item) else _cosine(dims[start[w]:end[w]], place, basis, latent[:, p], weight)
                        top, lcs = max(top, c), max(lcs, got)
                        answered = answered or weak * len(item) <= got and _holds(text, answer)
                    if lcs >= strong * len(item) or lcs >= weak * len(item) and answered:
                        for k, v in zip(out, (first + i, no, top, lcs, len(item), answered)):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(out["doc"], pa.int64())), pa.array(out["no"], pa.int64()), pa.array(out["cosine"], pa.float64()),
                pa.array(out["lcs"], pa.int64()), pa.array(out["m"], pa.int64()), pa.array(out["answer"], pa.bool_())],
                names=["doc_id", "no", "cosine", "lcs_words", "item_words", "answer_found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, no long, cosine double, lcs_words long, item_words long, answer_found boolean")


def _postings(passages, idf):
    """For each hashed word, the range of its postings; per posting its passage and share of the passage's weight; and per
    passage the share that a window has to hold in the posted words if it holds MIN_SHARE of the whole weight."""
    dims, owner, share, need = [], [], [], []
    for p, d in enumerate(passages):
        d = np.asarray(d)
        w = idf[d] ** 2 / (idf[d] ** 2).sum()
        order = np.argsort(-w, kind="stable")
        n = int(np.searchsorted(np.cumsum(w[order]), PREFIX)) + 1
        dims.append(d[order[:n]])
        share.append(w[order[:n]])
        owner.append(np.full(len(dims[-1]), p))
        need.append(MIN_SHARE - w[order[n:]].sum() - 1e-5)
    dims, owner, share = (np.concatenate(x) for x in (dims, owner, share))
    order = np.argsort(dims, kind="stable")
    edges = np.searchsorted(dims[order], np.arange(DIMS + 1))
    return edges, owner[order], share[order], np.array(need)


def _held(first_block, own, low, high, dims, postings, count):
    """(window, passage) of the windows that hold enough of a passage's posted words."""
    edges, owner, share, need = postings
    step = max(1, CELLS // max(1, count))
    for i in range(0, len(first_block), step):
        at = first_block[i:i + step]
        a, b = int(at[0]), min(int(at[-1]) + 2, len(low))
        d = dims[low[a]:high[b - 1]]
        of = np.repeat(np.arange(b - a), high[a:b] - low[a:b])
        size = edges[d + 1] - edges[d]
        ends = np.cumsum(size)
        post = np.repeat(edges[d] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
        sums = np.bincount(np.repeat(of, size) * count + owner[post], weights=share[post], minlength=(b - a) * count).reshape(b - a, count)
        after = np.minimum(at + 1, len(low) - 1)
        two = (after > at) & (own[after] == own[at])
        total = sums[at - a] + np.where(two[:, None], sums[np.minimum(after - a, b - a - 1)], 0.0)
        for w, p in zip(*np.nonzero(total >= need)):
            yield i + int(w), int(p)


def _cosine(dims, place, basis, passage, weight):
    d = dims[weight[dims] > 0]
    window = (basis[place[d]] * weight[d][:, None]).sum(axis=0)
    return float(window @ passage / max(np.linalg.norm(window), 1e-9))


def _candidates(block, end, low, high, dims, place, basis, latent, weight, min_cosine):
    """(window, passage, cosine) of the windows that come near a passage in the latent space.

    A window is its first block and the next one, if that begins before the window's end.
    """
    count = WINDOW // STRIDE
    held = block[:, None] + np.arange(count)
    inside = (held < len(low)) & (low[np.minimum(held, len(low) - 1)] < end[:, None])
    needed, at = np.unique(np.where(inside, held, block[:, None]), return_inverse=True)
    size = high[needed] - low[needed]
    token = np.repeat(low[needed] - np.cumsum(size) + size, size) + np.arange(size.sum())
    d = dims[token]
    known = weight[d] > 0
    d, owner = d[known], np.repeat(np.arange(len(needed)), size)[known]
    if not len(d):
        return
    full = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    folded = np.zeros((len(needed), basis.shape[1]), dtype=np.float32)
    folded[owner[full]] = np.add.reduceat(basis[place[d]] * weight[d].astype(np.float32)[:, None], full, axis=0)
    window = (folded[at.reshape(inside.shape)] * inside[:, :, None]).sum(axis=1)
    window /= np.maximum(np.linalg.norm(window, axis=1), 1e-9)[:, None]
    cosine = window @ latent
    for w, p in zip(*np.nonzero(cosine >= min_cosine)):
        yield w, p, cosine[w, p]
