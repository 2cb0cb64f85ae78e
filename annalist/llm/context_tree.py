"""Context-tree weighting over bytes, counted once and then used as a fixed model.

A text is the sequence of its bytes after lower-casing A-Z, ended by a zero
byte; before its first byte stand zero bytes.  Each byte is eight binary
decisions, and each decision has a context tree over the preceding 0 to DEPTH
bytes.  A tree node holds a Krichevsky-Trofimov estimate of its decisions, and
a node's probability weights its own estimate and its children's product by
one half each.  Since both depend on counts alone, training is counting.

Grams are DEPTH context bytes and the byte that follows, in one 64-bit integer
(earliest byte highest).
"""

from __future__ import annotations

import math

import numpy as np

from annalist.llm.textnum import LOWER, mix64

U = np.uint64
DEPTH = 5
SPLIT = 3  # the trees are weighed in groups of so many context bytes; what is above is Top's
LN2 = math.log(2)


def grams(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(grams of all documents of a chunk, each document's range of them): one per byte and one for the end."""
    n_docs = len(offsets) - 1
    sizes = np.diff(offsets)
    step = sizes + depth + 1  # pads before, end after
    first = np.concatenate([[0], np.cumsum(step)])
    laid = np.zeros(int(first[-1]), dtype=np.uint8)
    at = np.arange(len(data)) + np.repeat(first[:-1] + depth - offsets[:-1], sizes)
    laid[at] = LOWER[data]
    if not n_docs:
        return np.empty(0, np.uint64), first
    wide = laid.astype(np.uint64)
    n = len(laid) - depth
    out = np.zeros(n, dtype=np.uint64)
    for i in range(depth + 1):
        out = out << U(8) | wide[i : i + n]
    keep = np.ones(n + depth, dtype=bool)
    for i in range(depth):  # grams that would start in one document and end in the next
        keep[first[1:] - 1 - i] = False
    ranges = np.concatenate([[0], np.cumsum(sizes + 1)])
    return out[keep[:n]], ranges


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5, by Stirling's series after eight steps up."""
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    y = x + 8
    small = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    with np.errstate(divide="ignore"):
        return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + small - np.log(shift)


def log_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    big = np.maximum(np.maximum(a, b), 1) > 1e30
    assert not big.any()
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - math.log(math.pi)


def _nodes(context: np.ndarray, byte: np.ndarray, level: int) -> np.ndarray:
    """Key of the decision on bit ``level`` of ``byte`` in ``context``."""
    return context << U(8) | (U(1 << level) | byte >> U(8 - level))


class Group:
    """The trees' part at depths ``split`` and more, from all grams of some contexts of that many bytes, and their training counts."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, depth: int = DEPTH, split: int = SPLIT):
        byte = gram & U(255)
        seen = count > 0
        self.gram, self.depth = gram, depth
        weight = count[seen].astype(float)
        context = [(gram >> U(8)) & U((1 << 8 * d) - 1) for d in range(depth + 1)]
        self.p = np.empty((len(gram), 8))  # probability of the right decision, these depths mixed
        tops = []
        for level in range(8):
            bit = (byte >> U(7 - level)) & U(1)
            one = bit[seen].astype(float)
            below_log = below_key = None
            stack = []
            for d in range(depth, split - 1, -1):
                key, inverse = np.unique(_nodes(context[d][seen], byte[seen], level), return_inverse=True)
                ones = np.bincount(inverse, weights=weight * one, minlength=len(key))
                zeros = np.bincount(inverse, weights=weight * (1 - one), minlength=len(key))
                own = log_estimate(zeros, ones)
                if d == depth:
                    log_eta, log_w = np.full(len(key), np.inf), own
                else:
                    parent = np.searchsorted(key, self._up(below_key, d))
                    children = np.bincount(parent, weights=below_log, minlength=len(key))
                    log_eta = own - children
                    log_w = np.logaddexp(own, children) - LN2
                stack.append((d, key, zeros, ones, log_eta))
                below_key, below_log = key, log_w
            tops.append((self._up(below_key, split - 1), zeros, ones, below_log))
            p = np.full(len(gram), 0.5)
            for d, key, zeros, ones, log_eta in stack:
                at, known = _find(key, _nodes(context[d], byte, level))
                right = np.where(bit == 1, ones[at], zeros[at]) if len(key) else 0.0
                estimate = (right + 0.5) / (zeros[at] + ones[at] + 1) if len(key) else 0.5
                share = _share(log_eta[at]) if len(key) else 0.5
                p = np.where(known, share * estimate + (1 - share) * p, 0.5)
            self.p[:, level] = p
        self.top_node, self.top_zeros, self.top_ones, self.top_log = (np.concatenate(x) for x in zip(*tops, strict=True))

    @staticmethod
    def _up(key: np.ndarray, d: int) -> np.ndarray:
        """Keys at depth d of nodes one byte deeper: the oldest context byte goes."""
        return ((key >> U(8)) & U((1 << 8 * d) - 1)) << U(8) | key & U(255)


def _share(log_eta: np.ndarray) -> np.ndarray:
    """Weight of a node's own estimate against its children."""
    return 1 / (1 + np.exp(np.clip(-log_eta, -700, 700)))


def _find(key: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    return at, key[at] == wanted


class Top:
    """Depths 0 to ``split`` - 1 of the trees: 256**d * 255 decisions at depth d, at most."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray, split: int = SPLIT):
        """``node``: distinct keys at depth ``split`` - 1; ``children``: the sum of log probabilities of the nodes below."""
        order = np.argsort(node)
        key, children = node[order], children[order]
        zeros, ones = zeros[order].astype(float), ones[order].astype(float)
        self.levels = []  # (depth, keys, zeros, ones, log_eta), deepest first
        for d in range(split - 1, -1, -1):
            own = log_estimate(zeros, ones)
            self.levels.append((d, key, zeros, ones, own - children))
            if d:
                log_w = np.logaddexp(own, children) - LN2
                key, inverse = np.unique(Group._up(key, d - 1), return_inverse=True)
                zeros, ones, children = (np.bincount(inverse, weights=x, minlength=len(key)) for x in (zeros, ones, log_w))

    def finish(self, gram: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's byte, from the probabilities mixed for the deeper nodes."""
        byte = gram & U(255)
        total = np.zeros(len(gram))
        for level in range(8):
            bit = (byte >> U(7 - level)) & U(1)
            mixed = p[:, level].astype(float)
            for d, key, zeros, ones, log_eta in self.levels:
                at, known = _find(key, _nodes((gram >> U(8)) & U((1 << 8 * d) - 1), byte, level))
                if not len(key):
                    mixed = np.full(len(gram), 0.5)
                    continue
                estimate = (np.where(bit == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
                share = _share(log_eta[at])
                mixed = np.where(known, share * estimate + (1 - share) * mixed, 0.5)
            total += np.log10(mixed)
        return total


class Table:
    """Values of 64-bit keys by open addressing, for many look-ups at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(keys) - 1).bit_length()) if len(keys) else 16
        self.mask = U(size - 1)
        self.key = np.zeros(size, dtype=np.uint64)
        self.value = np.zeros(size, dtype=np.float32)
        used = np.zeros(size, dtype=bool)
        left = np.arange(len(keys))
        slot = (mix64(keys) & self.mask).astype(np.int64)
        while len(left):
            free = ~used[slot[left]]
            candidates = left[free]
            _, winner = np.unique(slot[candidates], return_index=True)
            placed = candidates[winner]
            used[slot[placed]] = True
            self.key[slot[placed]], self.value[slot[placed]] = keys[placed], values[placed]
            done = np.zeros(len(keys), dtype=bool)
            done[placed] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & int(self.mask)
        self.used = used

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values; 0 for a key not in the table."""
        slot = (mix64(keys) & self.mask).astype(np.int64)
        hit = (self.key[slot] == keys) & self.used[slot]
        out = np.where(hit, self.value[slot], np.float32(0))
        left = np.flatnonzero(~hit & self.used[slot])
        while len(left):
            slot[left] = (slot[left] + 1) & int(self.mask)
            at = slot[left]
            found = (self.key[at] == keys[left]) & self.used[at]
            out[left[found]] = self.value[at[found]]
            left = left[~found & self.used[at]]
        return out
