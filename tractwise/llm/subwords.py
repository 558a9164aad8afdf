"""SentencePiece BPE with byte fallback: encoding by vectorised merge rounds, and decoding.

No piece of such a vocabulary holds a space mark after another character, so a text falls apart before every space
that follows something else, and the parts ("words": a run of spaces and what follows) never share a merge. Each Arrow
batch encodes its distinct words once, all together: flat arrays hold the symbols of every word, a round finds the best
pair rank of each word (a segmented minimum), merges its leftmost occurrences that do not overlap, and compacts the
arrays; words without a pair leave. Several occurrences merge in one round only where that equals merging one by one:
a piece that begins or ends another piece of the same or a better rank stops the round for its word.

Defined results: a null text is an empty one and gives only the begin and end ids; every row gives one row, repeated
rows and null ids included; an empty table gives an empty one; only the named columns are read, so others may have any
name. Texts longer than `BLOCK` bytes are encoded block by block, cut between words; a single longer word is held whole.
The space mark U+2581 in a text is a space, as in the library, and decodes to one. Ties of rank go to the left.
"""

import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrays import texts_of
from .common import text_batches

BLOCK = 4 << 20
MARK = "▁"
NONE = np.iinfo(np.int32).max
LONG_WORD = 1_024  # symbols from which a word whose merges go one by one is merged by a queue instead of rounds


class Vocabulary:
    """Lookup arrays made from a model file: first symbols, pairs, ranks, and the bytes of every id."""

    def __init__(self, model: bytes):
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) for i in range(n)]
        if sum(map(lib.is_byte, range(n))) != 256 or any(map(lib.is_unused, range(n))):
            raise ValueError("the model must have byte pieces and no unused pieces")
        if any(MARK in p.lstrip(MARK) for p, s in zip(pieces, special) if not s):
            raise ValueError("a piece has a space mark inside")
        self.begin, self.end, self.n = lib.bos_id(), lib.eos_id(), n
        self.byte = np.zeros(256, dtype=np.int32)
        for i in range(n):
            if lib.is_byte(i):
                self.byte[int(pieces[i][3:5], 16)] = i
        ids = {p: i for i, (p, s) in enumerate(zip(pieces, special)) if not s}
        ranked = sorted({lib.get_score(i) for i in ids.values()}, reverse=True)
        place = {s: r for r, s in enumerate(ranked)}
        rank = {p: place[lib.get_score(i)] for p, i in ids.items()}
        symbol = dict(ids)  # single characters that only occur inside longer pieces get numbers from n on
        for p in ids:
            for c in p:
                symbol.setdefault(c, n + len(symbol) - len(ids))
        self.width = n + len(symbol) - len(ids) + 1  # the last number: characters of no piece
        self.first = np.full(0x110000, self.width - 1, dtype=np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                self.first[ord(p)] = i
        self.first[0x20] = self.first[ord(MARK)]
        pairs, self.stops = [], np.zeros(self.width, dtype=bool)
        for p, i in ids.items():
            for k in range(1, len(p)):
                left, right = p[:k], p[k:]
                if left in symbol and right in symbol:
                    pairs.append((symbol[left] * self.width + symbol[right], rank[p], i))
                for part in (left, right):
                    if len(part) > 1 and part in rank and rank[p] <= rank[part]:
                        self.stops[ids[part]] = True
        self.keys, self.ranks, self.merged = (np.array(x, dtype=t) for x, t in zip(zip(*pairs), (np.int64, np.int32, np.int32)))
        self.bits = int(np.ceil(np.log2(4 * len(pairs) + 4)))  # an open table, filled to a quarter at most
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        left = np.arange(len(pairs), dtype=np.int32)
        at = self._slot(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several for one slot the last stays
            placed = self.slots[at] == left
            left, at = left[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)
        shown = [b"" if lib.is_control(i) else bytes([int(p[3:5], 16)]) if lib.is_byte(i) else
                 " ⁇ ".encode() if lib.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.shown = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.shown_length = np.array([len(b) for b in shown], dtype=np.int64)
        self.shown_start = np.cumsum(self.shown_length) - self.shown_length
        self.spaced = np.array([not s and p.startswith(MARK) for p, s in zip(pieces, special)])

    def _slot(self, keys):
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, left, right):
        """Rank and piece of each pair of symbols; NONE where no piece joins them."""
        key = left.astype(np.int64) * self.width + right
        at = self._slot(key)
        entry = self.slots[at]
        rank, piece = np.full(len(key), NONE, dtype=np.int32), np.zeros(len(key), dtype=np.int32)
        hit = np.flatnonzero(entry >= 0)
        while len(hit):
            e = entry[hit]
            right_one = self.keys[e] == key[hit]
            found = hit[right_one]
            rank[found], piece[found] = self.ranks[e[right_one]], self.merged[e[right_one]]
            hit = hit[~right_one]
            at[hit] = (at[hit] + 1) & (len(self.slots) - 1)
            entry[hit] = self.slots[at[hit]]
            hit = hit[entry[hit] >= 0]
        return rank, piece


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def queued(vocab, symbols, characters):
    """Merge one word by a queue of pairs, best rank first and leftmost among equals; for long words only."""
    n = len(symbols)
    symbols, before, after = symbols.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
    keys = {int(k): (int(r), int(m)) for k, r, m in zip(vocab.keys, vocab.ranks, vocab.merged)}

    def pair(i):
        j = after[i]
        return keys.get(symbols[i] * vocab.width + symbols[j]) if j < n else None

    queue = [(p[0], i, symbols[i], symbols[after[i]], p[1]) for i in range(n - 1) if (p := pair(i))]
    heapify(queue)
    while queue:
        _, i, left, right, piece = heappop(queue)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        symbols[i], symbols[j], after[i] = piece, -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and (p := pair(k)):
                heappush(queue, (p[0], k, symbols[k], symbols[after[k]], p[1]))
    kept = np.array([i for i in range(n) if symbols[i] >= 0])
    return np.array(symbols, dtype=np.int32)[kept], characters[kept]


def merged_words(vocab, words):
    """Ids of each word of a binary array of UTF-8 words: flat ids and the bounds of every word."""
    count = len(words)
    data, offsets = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8), np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + count + 1]
    data = data[offsets[0]:offsets[-1]]
    character = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.int32)
    starts = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of every character
    word = (np.searchsorted(offsets - offsets[0], starts, "right") - 1).astype(np.int32)
    symbol = vocab.first[character]
    done = []
    rank, piece = np.full(len(symbol), NONE, dtype=np.int32), np.zeros(len(symbol), dtype=np.int32)
    if len(symbol) > 1:
        rank[:-1], piece[:-1] = vocab.pairs(symbol[:-1], symbol[1:])
        rank[:-1][word[:-1] != word[1:]] = NONE
    while len(symbol):
        new = np.ones(len(word), dtype=bool)
        new[1:] = word[1:] != word[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(word)))
        best = np.repeat(np.minimum.reduceat(rank, start), size)
        open_ = best != NONE
        if not open_.all():
            done.append((word[~open_], symbol[~open_], character[~open_]))
            symbol, character, word, rank, piece, best, new = (x[open_] for x in (symbol, character, word, rank, piece, best, new))
            if not len(symbol):
                break
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(word)))
        wanted = rank == best
        at = np.flatnonzero(wanted)
        # of pairs that follow one another, every second merges, from the left
        head = np.ones(len(at), dtype=bool)
        head[1:] = at[1:] != at[:-1] + 1
        at = at[(at - at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]) % 2 == 0]
        stop = vocab.stops[piece[at]]
        if stop.any():
            passed = np.cumsum(stop) - stop  # stopping merges before this one, over all words
            of = word[at]
            first = np.ones(len(at), dtype=bool)
            first[1:] = of[1:] != of[:-1]
            at = at[passed == passed[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]]
            long = size[np.searchsorted(word[start], of[stop])] > LONG_WORD
            if long.any():
                out = np.zeros(len(word), dtype=bool)
                for w in np.unique(of[stop][long]):
                    low, high = np.searchsorted(word, [w, w + 1])
                    s, c = queued(vocab, symbol[low:high], character[low:high])
                    done.append((np.full(len(s), w, dtype=np.int32), s, c))
                    out[low:high] = True
                at = at[~out[at]]
                shift = np.cumsum(out)
                symbol, character, word, rank, piece = (x[~out] for x in (symbol, character, word, rank, piece))
                at -= shift[at]
        symbol[at] = piece[at]
        keep = np.ones(len(word), dtype=bool)
        keep[at + 1] = False
        touched = np.cumsum(keep)[at] - 1
        symbol, character, word, rank, piece = (x[keep] for x in (symbol, character, word, rank, piece))
        changed = np.zeros(len(word), dtype=bool)
        changed[touched] = changed[np.maximum(touched - 1, 0)] = True
        touched = np.flatnonzero(changed)
        last = touched == len(word) - 1
        rank[touched[last]] = NONE
        touched = touched[~last]
        rank[touched], piece[touched] = vocab.pairs(symbol[touched], symbol[touched + 1])
        rank[touched[word[touched] != word[touched + 1]]] = NONE
    if not done:
        return np.zeros(0, dtype=np.int32), np.zeros(count + 1, dtype=np.int64)
    word, symbol, character = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(word, kind="stable")
    word, symbol, character = word[order], symbol[order], character[order]
    unknown = symbol >= vocab.n
    if unknown.any():  # such characters become their bytes
        length = np.ones(len(symbol), dtype=np.int64)
        spelled = np.frombuffer("".join(map(chr, character[unknown])).encode("utf-8"), dtype=np.uint8)
        begins = np.flatnonzero((spelled & 0xC0) != 0x80)
        length[unknown] = np.diff(np.append(begins, len(spelled)))
        fill = np.repeat(unknown, length)
        word, symbol = np.repeat(word, length), np.repeat(symbol, length)
        symbol[fill] = vocab.byte[spelled]
    return symbol, np.searchsorted(word, np.arange(count + 1))


def blocks(column, limit=BLOCK):
    """(row, bytes, whether the row begins, whether it ends) lists of a column, about `limit` bytes at a time."""
    data, offsets = texts_of(pc.replace_substring(column.cast(pa.large_string()), MARK, " "))
    parts, held = [], 0
    for row in range(len(offsets) - 1):
        low, high, begins = int(offsets[row]), int(offsets[row + 1]), True
        while high - low > limit:  # cut where a space follows something else
            window, cut = low + limit, high
            while window < high:
                piece = data[window - 1:min(window + limit, high)]
                found = np.flatnonzero((piece[1:] == 32) & (piece[:-1] != 32))
                if len(found):
                    cut = window + int(found[0])
                    break
                window += limit
            if cut == high:
                break
            yield [*parts, (row, data[low:cut], begins, False)]
            parts, held, low, begins = [], 0, cut, False
        parts.append((row, data[low:high], begins, True))
        held += high - low
        if held >= limit:
            yield parts
            parts, held = [], 0
    if parts:
        yield parts


def encoded(vocab, parts):
    """Flat ids of the parts of `blocks` and the bounds of each, begin and end ids and the leading space included."""
    pieces = []
    for _, text, begins, _ in parts:
        if begins and len(text):
            pieces.append(np.array([32], dtype=np.uint8))
        pieces.append(text)
    data = np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.uint8)
    ends = np.cumsum([len(text) + (begins and len(text) > 0) for _, text, begins, _ in parts])
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
    cut[0] = cut[len(data)] = True
    cut[ends] = True
    at = np.flatnonzero(cut)
    words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
    ids, bounds = merged_words(vocab, words.dictionary)
    distinct = len(words.dictionary)
    ids = np.concatenate([ids, np.array([vocab.begin, vocab.end], dtype=np.int32)])  # the marks are two more words
    bounds = np.concatenate([bounds, [len(ids) - 1, len(ids)]])
    index = words.indices.to_numpy()
    stands = np.searchsorted(at[:-1], np.concatenate([[0], ends]))  # the first word of every part
    seq = []
    for k, (_, _, begins, finishes) in enumerate(parts):
        low, high = stands[k], stands[k + 1]
        seq += [[distinct]] * begins + [index[low:high]] + [[distinct + 1]] * finishes
    seq = np.concatenate(seq).astype(np.int64)
    sizes = np.array([stands[k + 1] - stands[k] + b + f for k, (_, _, b, f) in enumerate(parts)])
    length = np.diff(bounds)[seq]
    total = np.cumsum(length)
    flat = ids[np.repeat(bounds[:-1][seq] - (total - length), length) + np.arange(int(total[-1]) if len(total) else 0)]
    edge = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(sizes)])]
    return flat, edge


def _each(error):
    return "�" * (error.end - error.start), error.end


def decoded(vocab, flat, edge, fresh):
    """The text of each run of ids. fresh: whether a run begins its text, where one leading space is dropped."""
    import codecs
    codecs.register_error("each-byte", _each)
    length = vocab.shown_length[flat]
    total = np.cumsum(length)
    size = int(total[-1]) if len(total) else 0
    shown = vocab.shown[np.repeat(vocab.shown_start[flat] - (total - length), length) + np.arange(size)]
    at = np.concatenate([[0], total])[edge]
    for k in range(len(edge) - 1):
        low = int(at[k])
        if fresh[k]:
            run = flat[edge[k]:edge[k + 1]]
            seen = run[vocab.shown_length[run[:64]].nonzero()[0][:1]] if len(run) <= 64 or vocab.shown_length[run[:64]].any() else run[vocab.shown_length[run].nonzero()[0][:1]]
            low += bool(len(seen)) and bool(vocab.spaced[seen[0]])
        raw = shown[low:int(at[k + 1])].tobytes()
        yield raw.decode("utf-8", "each-byte")


def _table(model):
    with open(model, "rb") as file:
        return file.read()


def encode(docs, model, id="doc_id", text="text"):
    """One row per document: id, ids (array of int), with begin and end ids. model: path of the model file."""
    spark, schema = docs.sparkSession, docs.select(id).schema
    text_batches(spark)
    held = spark.sparkContext.broadcast(_table(model))

    def work(batches):
        vocab = vocabulary(held.value)
        for batch in batches:
            ids = [[] for _ in range(batch.num_rows)]
            for parts in blocks(batch.column(1)):
                flat, edge = encoded(vocab, parts)
                for k, part in enumerate(parts):
                    ids[part[0]].append(flat[edge[k]:edge[k + 1]])
            sizes = np.cumsum([0, *(sum(map(len, x)) for x in ids)]).astype(np.int32)
            flat = np.concatenate([y for x in ids for y in x]) if batch.num_rows else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, pa.int32()))], names=[id, "ids"])

    return docs.select(id, docs[text].cast("string").alias("text_")).mapInArrow(work, f"`{id}` {schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded_docs, model, id="doc_id", ids="ids"):
    """One row per document: id, text. Unknown bytes become U+FFFD, one for each byte; null ids give an empty text."""
    spark, schema = encoded_docs.sparkSession, encoded_docs.select(id).schema
    held = spark.sparkContext.broadcast(_table(model))

    def work(batches):
        vocab = vocabulary(held.value)
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            edge = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = decoded(vocab, flat, edge, np.ones(batch.num_rows, dtype=bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(texts), pa.string())], names=[id, "text"])

    return encoded_docs.select(id, encoded_docs[ids].cast("array<int>").alias("ids_")).mapInArrow(work, f"`{id}` {schema[0].dataType.simpleString()}, text string")


def digests(docs, model, id="doc_id", text="text"):
    """One row per document: id, n_tokens, SHA-256 of its ids (little-endian 32 bits) and of their decoded text."""
    spark, schema = docs.sparkSession, docs.select(id).schema
    text_batches(spark)
    held = spark.sparkContext.broadcast(_table(model))

    def work(batches):
        vocab = vocabulary(held.value)
        for batch in batches:
            n = batch.num_rows
            of_ids, of_text, tokens = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)], np.zeros(n, dtype=np.int64)
            for parts in blocks(batch.column(1)):
                flat, edge = encoded(vocab, parts)
                raw = memoryview(flat.astype("<u4")).cast("B")
                texts = decoded(vocab, flat, edge, [part[2] for part in parts])
                for k, (part, shown) in enumerate(zip(parts, texts)):
                    of_ids[part[0]].update(raw[4 * int(edge[k]):4 * int(edge[k + 1])])
                    of_text[part[0]].update(shown.encode("utf-8"))
                    tokens[part[0]] += edge[k + 1] - edge[k]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(tokens), pa.array([h.hexdigest() for h in of_ids], pa.string()),
                pa.array([h.hexdigest() for h in of_text], pa.string())], names=[id, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id, docs[text].cast("string").alias("text_")).mapInArrow(
        work, f"`{id}` {schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
