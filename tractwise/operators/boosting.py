"""Boosted trees, fitted and evaluated inside a task on numpy arrays.

Trees have one depth and are kept as flat arrays, so that evaluating them is a few gathers per level. `fit` holds its rows
in memory; `Stored` keeps them in files of the task and reads them block by block, so any number of rows can be fitted.
"""

import io
import os

import numpy as np

BINS = 32


def _cuts(x):
    """BINS - 1 ascending cut values per column, and the number of cuts below every value."""
    cuts = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).astype(np.float32)
    binned = np.empty(x.shape, dtype=np.int64)
    for j in range(x.shape[1]):
        binned[:, j] = np.searchsorted(cuts[:, j], x[:, j], "left")
    return cuts, binned


def _gradient(score, y, task):
    if task == "regression":
        return score - y[:, None], np.ones_like(score)
    if task == "binary":
        p = 1 / (1 + np.exp(-score))
        return p - y[:, None], np.maximum(p * (1 - p), 1e-6)
    p = posterior(score, task)
    return p - (y[:, None] == np.arange(score.shape[1])), np.maximum(2 * p * (1 - p), 1e-6)


def posterior(score, task):
    """Answers from summed leaves: the value, P(1), or one probability per class."""
    if task == "regression":
        return score
    if task == "binary":
        return 1 / (1 + np.exp(-score))
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _best(left_g, left_h, penalty, least):
    """Place of the best split of every node among columns and bins, and whether it gains anything."""
    all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g ** 2 / (left_h + penalty) + right_g ** 2 / (right_h + penalty) - all_g ** 2 / (all_h + penalty)
    gain[(left_h < least) | (right_h < least)] = 0
    gain = gain.reshape(len(gain), -1)
    best = gain.argmax(axis=1)
    return best, gain[np.arange(len(gain)), best] > 1e-9


def _base(total, counts, n, task):
    """Score before the first tree: the mean, the log-odds, or the log-shares of the classes."""
    if task == "regression":
        return np.array([total / n])
    if task == "binary":
        share = np.clip(total / n, 1e-3, 1 - 1e-3)
        return np.array([np.log(share / (1 - share))])
    return np.log(np.maximum(counts, 0.5) / n)


def _tree(binned, g, h, rows, columns, depth, penalty, least):
    """(feature, bin) of every inner node, level by level, and the leaf of every row; bin BINS sends all rows left."""
    feature, cut = np.zeros(2 ** depth - 1, dtype=np.int64), np.full(2 ** depth - 1, BINS, dtype=np.int64)
    node, width = np.zeros(len(binned), dtype=np.int64), len(columns)
    inside, gs, hs = binned[np.ix_(rows, columns)], np.repeat(g[rows], width), np.repeat(h[rows], width)
    for level in range(depth):
        nodes = 2 ** level
        key = ((node[rows][:, None] * width + np.arange(width)) * BINS + inside).ravel()
        left_g = np.bincount(key, gs, nodes * width * BINS).reshape(nodes, width, BINS).cumsum(axis=2)
        left_h = np.bincount(key, hs, nodes * width * BINS).reshape(nodes, width, BINS).cumsum(axis=2)
        best, good = _best(left_g, left_h, penalty, least)
        at = nodes - 1 + np.arange(nodes)
        feature[at], cut[at] = columns[best // BINS], np.where(good, best % BINS, BINS)
        here = nodes - 1 + node
        node = 2 * node + (binned[np.arange(len(binned)), feature[here]] > cut[here])
    return feature, cut, node


def fit(x, y, task, n_classes, seed, rounds=40, rate=0.15, depth=4, rows=0.85, columns=0.7, penalty=2.0, least=2.0):
    """A boosted ensemble of `rounds` trees per output as a dict of arrays."""
    rng = np.random.default_rng(seed)
    outputs = n_classes if task == "multiclass" else 1
    cuts, binned = _cuts(x)
    y = y.astype(np.float64)
    base = _base(y.sum(), np.bincount(y.astype(int), minlength=outputs) if task == "multiclass" else None, len(y), task)
    score = np.tile(base, (len(y), 1))
    features, thresholds, leaves = [], [], []
    high = np.concatenate([cuts, np.full((1, cuts.shape[1]), np.inf, dtype=np.float32)])
    for _ in range(rounds):
        g, h = _gradient(score, y, task)
        taken = np.flatnonzero(rng.random(len(y)) < rows)
        taken = taken if len(taken) else np.arange(len(y))
        drawn = np.sort(rng.permutation(x.shape[1])[:max(1, int(columns * x.shape[1]))])
        for c in range(outputs):
            feature, cut, node = _tree(binned, g[:, c], h[:, c], taken, drawn, depth, penalty, least)
            total_g = np.bincount(node[taken], g[taken, c], 2 ** depth)
            total_h = np.bincount(node[taken], h[taken, c], 2 ** depth)
            leaf = -rate * total_g / (total_h + penalty)
            score[:, c] += leaf[node]
            features.append(feature)
            thresholds.append(high[np.minimum(cut, BINS - 1), feature])
            leaves.append(leaf)
    return {"base": base, "feature": np.array(features, dtype=np.int16), "threshold": np.array(thresholds, dtype=np.float32),
            "leaf": np.array(leaves, dtype=np.float32)}


class Stored:
    """Rows of one fit in files below a folder: a code per row and feature, block by block, and what is known of each row.

    A code is the place of a value among the cut points of all fits together, so every fit finds its own bins from it. What
    is held in memory is one block, the histograms of one tree level and the trees.
    """

    def __init__(self, folder: str, width: int):
        self.folder, self.width, self.blocks, self.n = folder, width, [], 0
        self._files = {c: open(os.path.join(folder, c), "wb") for c in ("codes", "label", "fold")}

    def add(self, codes, label, fold):
        """Append rows: codes (rows x features, uint8), labels and folds."""
        self._files["codes"].write(np.ascontiguousarray(codes.T).tobytes())
        self._files["label"].write(np.asarray(label, dtype=np.float64).tobytes())
        self._files["fold"].write(np.asarray(fold, dtype=np.int32).tobytes())
        self.blocks.append((self.n, self.n + len(codes)))
        self.n += len(codes)

    def close(self):
        for f in self._files.values():
            f.close()
        self._codes, self.label, self.fold = (np.asarray(np.memmap(os.path.join(self.folder, c), dtype=kind, mode="r"))
                                              for c, kind in (("codes", np.uint8), ("label", np.float64), ("fold", np.int32)))

    def array(self, name, shape, dtype):
        """An array of one entry per row, zero at first, that replaces the last one of its name."""
        return np.asarray(np.memmap(os.path.join(self.folder, name), dtype=dtype, mode="w+", shape=shape))

    def _block(self, store, low, high):
        return store[low * self.width:high * self.width].reshape(self.width, high - low)

    def _binned(self, bins):
        out = self.array("binned", (self.n * self.width,), np.uint8)
        for low, high in self.blocks:
            codes, to = self._block(self._codes, low, high), self._block(out, low, high)
            for j in range(self.width):
                to[j] = bins[j][codes[j]]
        return out

    def fit(self, cuts, bins, left_out, task, n_classes, seed, rounds=40, rate=0.15, depth=4, rows=0.85, columns=0.7, penalty=2.0, least=2.0):
        """The model `fit` makes of all rows but those of one fold, and scores of every row.

        cuts: BINS - 1 ascending values per feature; bins: per feature the bin of every code. Only the smaller of two
        sister nodes is counted, the other is what is left of their parent.
        """
        rng = np.random.default_rng(seed)
        outputs = n_classes if task == "multiclass" else 1
        binned = self._binned(bins)
        total, counts, n = 0.0, np.zeros(max(outputs, 1)), 0
        for low, high in self.blocks:
            y = self.label[low:high][self.fold[low:high] != left_out]
            total, n = total + y.sum(), n + len(y)
            if task == "multiclass":
                counts += np.bincount(y.astype(int), minlength=outputs)
        base = _base(total, counts, n, task)
        score = self.array("score", (self.n, outputs), np.float64)
        for low, high in self.blocks:
            score[low:high] = base
        taken = self.array("taken", (self.n,), bool)
        node = self.array("node", (outputs, self.n), np.uint8)
        features, thresholds, leaves = [], [], []
        high_cuts = np.concatenate([cuts.T, np.full((1, self.width), np.inf, dtype=np.float32)])
        for _ in range(rounds):
            some = False
            for low, high in self.blocks:
                inside = self.fold[low:high] != left_out
                inside[inside] = rng.random(int(inside.sum())) < rows
                taken[low:high], some = inside, some or bool(inside.any())
            if not some:
                for low, high in self.blocks:
                    taken[low:high] = self.fold[low:high] != left_out
            drawn = np.sort(rng.permutation(self.width)[:max(1, int(columns * self.width))])
            grown = []
            for c in range(outputs):
                node[c] = 0
                feature, cut = np.zeros(2 ** depth - 1, dtype=np.int64), np.full(2 ** depth - 1, BINS, dtype=np.int64)
                parent, share = None, None
                for level in range(depth):
                    parent = self._histograms(binned, score, taken, node[c], c, task, drawn, level, parent, share)
                    best, good = _best(parent[0].cumsum(axis=2), parent[1].cumsum(axis=2), penalty, least)
                    at = 2 ** level - 1 + np.arange(2 ** level)
                    feature[at], cut[at] = drawn[best // BINS], np.where(good, best % BINS, BINS)
                    share = np.zeros(2 ** (level + 1), dtype=np.int64)
                    for low, high in self.blocks:
                        before = node[c, low:high]
                        here = 2 ** level - 1 + before.astype(np.int64)
                        right = self._block(binned, low, high)[feature[here], np.arange(high - low)] > cut[here]
                        node[c, low:high] = 2 * before + right
                        share += np.bincount(node[c, low:high][taken[low:high]], minlength=len(share))
                total_g, total_h = np.zeros(2 ** depth), np.zeros(2 ** depth)
                for low, high in self.blocks:
                    on = taken[low:high]
                    g, h = _gradient(score[low:high], self.label[low:high], task)
                    at = node[c, low:high][on]
                    total_g += np.bincount(at, g[on, c], 2 ** depth)
                    total_h += np.bincount(at, h[on, c], 2 ** depth)
                leaf = -rate * total_g / (total_h + penalty)
                grown.append(leaf)
                features.append(feature)
                thresholds.append(high_cuts[np.minimum(cut, BINS - 1), feature])
                leaves.append(leaf)
            for low, high in self.blocks:      # gradients of all outputs are those of the round's beginning
                score[low:high] += np.stack([leaf[node[c, low:high]] for c, leaf in enumerate(grown)], axis=1)
        return {"base": base, "feature": np.array(features, dtype=np.int16), "threshold": np.array(thresholds, dtype=np.float32),
                "leaf": np.array(leaves, dtype=np.float32)}, score

    def _histograms(self, binned, score, taken, node, c, task, drawn, level, parent, share):
        """Sums of gradient and curvature per node, drawn column and bin."""
        nodes = max(1, 2 ** level // 2)
        if level:                               # per parent the sister with fewer rows
            small = 2 * np.arange(nodes) + (share[1::2] < share[::2])
            wanted = np.zeros(2 * nodes, dtype=bool)
            wanted[small] = True
        sums = np.zeros((2, len(drawn), nodes * BINS))
        for low, high in self.blocks:
            on = taken[low:high] & wanted[node[low:high]] if level else taken[low:high]
            on = np.flatnonzero(on)
            g, h = _gradient(score[low:high][on], self.label[low:high][on], task)
            g, h = np.ascontiguousarray(g[:, c]), np.ascontiguousarray(h[:, c])
            at = (node[low:high][on] // 2).astype(np.intp) * BINS if level else np.zeros(len(on), dtype=np.intp)
            block = self._block(binned, low, high)
            for i, j in enumerate(drawn):
                key = at + block[j].take(on)
                sums[0, i] += np.bincount(key, g, nodes * BINS)
                sums[1, i] += np.bincount(key, minlength=nodes * BINS) if task == "regression" else np.bincount(key, h, nodes * BINS)
        sums = sums.reshape(2, len(drawn), nodes, BINS).transpose(0, 2, 1, 3)
        if not level:
            return np.ascontiguousarray(sums)
        both = np.empty((2, 2 * nodes, len(drawn), BINS))
        both[:, small], both[:, small ^ 1] = sums, parent - sums
        return both


def evaluate(model, x, task, block=2_048, together=8):
    """One row of answers per row of x.

    A few trees at a time are compared with a block of rows as whole columns; the leaf is selected from the lowest level up.
    """
    feature, threshold, leaf, outputs = model["feature"].astype(np.int64), model["threshold"], model["leaf"], len(model["base"])
    depth = int(np.log2(leaf.shape[1]))
    out = np.empty((len(x), outputs))
    for low in range(0, len(x), block):
        part = np.ascontiguousarray(x[low:low + block].T)
        value = np.empty((part.shape[1], len(feature)), dtype=leaf.dtype)
        for first in range(0, len(feature), together):
            trees = slice(first, first + together)
            right = part[feature[trees]] > threshold[trees][:, :, None]
            at = right[:, 2 ** (depth - 1) - 1:].view(np.uint8)
            for level in range(depth - 2, -1, -1):
                at = np.where(right[:, 2 ** level - 1:2 ** (level + 1) - 1], at[:, 1::2] + np.uint8(2 ** (depth - 1 - level)), at[:, ::2])
            value[:, trees] = np.take_along_axis(leaf[trees], at[:, 0].astype(np.intp), axis=1).T
        out[low:low + block] = value.reshape(len(value), -1, outputs).sum(axis=1) + model["base"]
    return posterior(out, task)


def packed(model):
    held = io.BytesIO()
    np.savez(held, **model)
    return held.getvalue()


def unpacked(data):
    with np.load(io.BytesIO(data)) as held:
        return {k: held[k] for k in held.files}
