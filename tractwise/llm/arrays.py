"""Words of whole texts as arrays of 64-bit hashes, computed for many texts at once inside a task."""

import numpy as np

BLOCK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
MARKS = _SPACE.copy()  # spaces and ASCII punctuation
MARKS[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base, n):
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_P, BLOCK), _powers(_INV, BLOCK)


def mixed(x):
    """Spread every input bit over the 64 bits of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column):
    """A string column of an Arrow batch as its bytes and offsets; null is empty."""
    import pyarrow as pa
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def words_of(data, offsets, lower=False, parts=_SPACE):
    """Hash of every word, for each text the number of its first word (one entry more than texts), and byte spans.

    parts: for each byte, whether it stands between words.
    """
    found, at = [], []
    low, high = int(offsets[0]), int(offsets[-1])
    while low < high:
        end = min(low + BLOCK, high)
        if end < high:  # cut before a word, unless one word fills the block
            space = np.flatnonzero(parts[data[low:end]])
            starts = offsets[(offsets > low) & (offsets <= end)]
            cut = max(int(space[-1]) + 1 + low if len(space) else 0, int(starts[-1]) if len(starts) else 0)
            if cut <= low:
                end = _word_end(data, end, int(offsets[np.searchsorted(offsets, end, "left")]), parts)
            else:
                end = cut
        piece = data[low:end]
        inside = ~parts[piece]
        edge = offsets[(offsets > low) & (offsets < end)] - low
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[edge] = inside[edge]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[edge - 1] = inside[edge - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = (_UP, _DOWN) if len(piece) <= BLOCK else (_powers(_P, len(piece)), _powers(_INV, len(piece)))
        value = (_LOWER[piece] if lower else piece).astype(np.uint64)
        value += np.uint64(1)
        value *= up[:len(piece)]
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(value, out=total[1:])
        found.append(mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)))
        at.append(np.stack([a + low, b + low], axis=1))
        low = end
    hashes = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
    places = np.concatenate(at) if at else np.zeros((0, 2), dtype=np.int64)
    return hashes, np.searchsorted(places[:, 0], offsets), places


def _word_end(data, at, limit, parts):
    while at < limit:
        space = np.flatnonzero(parts[data[at:min(at + BLOCK, limit)]])
        if len(space):
            return at + int(space[0])
        at = min(at + BLOCK, limit)
    return limit


def shingle_sets(hashes, bounds, k):
    """Distinct k-word shingles per text, sorted: values and bounds. A shorter text is one shingle of all its words."""
    n = len(bounds) - 1
    count = np.diff(bounds)
    runs = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    owner = np.repeat(np.arange(n), runs)
    ends = np.cumsum(runs)
    start = bounds[:-1][owner] + np.arange(len(owner)) - (ends - runs)[owner]
    length = np.minimum(count, k)[owner]
    value = np.zeros(len(owner), dtype=np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, dtype=np.uint64)])
    for j in range(k):
        part = padded[start + j]
        part[length <= j] = np.uint64(j + 1)
        value = mixed(value * np.uint64(_P) + part)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(n + 1))


def per_text(function, values, bounds, empty):
    """function.reduceat over each text's values; `empty` where it has none."""
    n = len(bounds) - 1
    out = np.full(n, empty, dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = function.reduceat(values, bounds[:-1][full])
    return out


def chunks(batch, column, limit=4 << 20):
    """Row ranges of a batch whose texts hold about `limit` bytes; a longer text stands alone."""
    data, offsets = texts_of(batch.column(column))
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data, offsets[low:high + 1]
        low = high
