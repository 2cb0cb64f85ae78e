"""A small bidirectional gated recurrent network with attention pooling, in numpy.

Input of a step: a word's embedding (known words only) beside the sum, by the
root of their number, of the embeddings of its runs of four characters, marks of
its ends among them.  Both directions' states are pooled by attention into one
vector per window, and that into one logit.  Words and runs find their embeddings
by hash in tables of fixed size, so the model does not grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from annalist.llm.textnum import ALNUM_SEP, LOWER, Words, mix64, text_chunks

U = np.uint64
WINDOW, STRIDE = 32, 16
DIM, HIDDEN = 8, 8
GRAMS = 1 << 15
WORDS = 1 << 18
RESCORED = 3  # epochs between two choices of the largest windows
PART = 1024
INPUTS = 1 << 14  # distinct words whose input vectors are in memory at once
BAG_CHUNK = 1 << 19  # bytes of training texts that are taken apart at once
EPOCHS, STEPS = 8, 400  # of training, at least


def word_rows(hashes: np.ndarray) -> np.ndarray:
    """Rows of the word table."""
    return (hashes % U(WORDS)).astype(np.int64)


class Tokens:
    """Words of a chunk as numbers of distinct words, with each distinct word's character runs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(LOWER[data], offsets, ALNUM_SEP)
        self.first = words.first
        self.hash, where, self.word = np.unique(words.hashes(), return_index=True, return_inverse=True)
        start, end = words.start[where], words.end[where]
        # bytes of each distinct word, between two boundary marks
        size = end - start
        lo = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(start - lo[:-1], size) + np.arange(lo[-1])
        body = LOWER[data][at].astype(np.uint64)
        ends = lo[1:][size > 0] - 1
        before = np.concatenate([[U(1)], body[:-1]])
        before[lo[:-1][size > 0]] = U(1)
        after = np.concatenate([body[1:], [U(2)]])
        after[ends] = U(2)
        later = np.concatenate([after[1:], [U(2)]])
        later[ends] = U(2)
        gram = before << U(24) | body << U(16) | after << U(8) | later
        self.gram = (mix64(gram) % U(GRAMS)).astype(np.int64)
        self.gram_cuts = lo

    def windows(self, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, words (-1: padding), number of windows per document)."""
        n = np.diff(self.first)
        count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // stride) + 1), 0)
        doc = np.repeat(np.arange(len(n)), count)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        at = (self.first[:-1][doc] + number * stride)[:, None] + np.arange(WINDOW)
        inside = at < self.first[1:][doc][:, None]
        grid = np.where(inside, self.word[np.minimum(at, max(len(self.word) - 1, 0))], -1) if len(doc) else at
        return doc, grid.astype(np.int32), count


class Bag:
    """Windows of labelled documents over one vocabulary of distinct words, which is all that training keeps of them.

    All windows of a document are kept, or with ``most`` that many of a longer
    one, drawn from its whole text by a hash.  Texts are taken as they come and
    not kept; the bag is the same in whatever order.
    """

    def __init__(self, rows: Iterable[tuple[np.ndarray, np.ndarray, pa.Array]], most: int | None = None):
        """``rows``: parts of (ids, labels, texts), each id once."""
        sizes, runs, grids, owners, known = [], [], [], [], {}
        seen, number_of = np.empty(0, np.uint64), np.empty(0, np.int32)  # sorted hashes; their words' numbers, by appearance
        for ids, labels, text in rows:
            known.update(zip(ids.tolist(), labels.tolist(), strict=True))
            for lo, hi, data, offsets in text_chunks(text, BAG_CHUNK):
                t = Tokens(data, offsets)
                doc, grid, count = t.windows(WINDOW)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                owner = ids[lo:hi].astype(np.int64)[doc]
                drawn = np.arange(len(doc))
                if most is not None:
                    place = np.lexsort((mix64(owner.view(np.uint64) * U(0x9E3779B97F4A7C15) + number.astype(np.uint64)), doc))
                    drawn = np.sort(place[number < most])
                used = np.unique(grid[drawn])
                used = used[used >= 0]
                hashes = t.hash[used]
                at = np.searchsorted(seen, hashes)
                new = np.ones(len(used), dtype=bool)
                new[at < len(seen)] = seen[at[at < len(seen)]] != hashes[at < len(seen)]
                fresh = used[new]
                number_of = np.insert(number_of, at[new], len(seen) + np.arange(len(fresh), dtype=np.int32))
                seen = np.insert(seen, at[new], hashes[new])
                size = np.diff(t.gram_cuts)[fresh]
                sizes.append(size)
                runs.append(t.gram[np.repeat(t.gram_cuts[fresh] - np.cumsum(size) + size, size) + np.arange(size.sum())].astype(np.int32))
                numbers = np.full(len(t.hash) + 1, -1, dtype=np.int32)  # the last one pads
                numbers[used] = number_of[np.searchsorted(seen, hashes)]
                grids.append(numbers[grid[drawn]])
                owners.append(owner[drawn])
        self.hash = seen
        size, run = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (sizes, runs))
        del sizes, runs
        cuts = np.cumsum(size) - size
        kept = size[number_of]
        self.gram_cuts = np.concatenate([[0], np.cumsum(kept)])
        self.gram = np.empty(int(kept.sum()), dtype=np.int32)
        for lo in range(0, len(seen), INPUTS):
            part = kept[lo : lo + INPUTS]
            start, end = self.gram_cuts[lo], self.gram_cuts[lo + len(part)]
            self.gram[start:end] = run[np.repeat(cuts[number_of[lo : lo + INPUTS]] - self.gram_cuts[lo : lo + len(part)], part) + np.arange(start, end)]
        del run
        where = np.full(len(seen) + 1, -1, dtype=np.int32)  # a number's place among the hashes; the last one pads
        where[number_of] = np.arange(len(seen), dtype=np.int32)
        owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        order = np.argsort(owner, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.grid, lo = np.empty((len(order), WINDOW), np.int32), 0
        grids.reverse()
        while grids:  # each is freed as it is placed
            grid = grids.pop()
            self.grid[place[lo : lo + len(grid)]] = where[grid]
            lo += len(grid)
        every = np.array(sorted(known), dtype=np.int64)
        self.y = np.array([known[i] for i in every.tolist()], dtype=np.float32)
        self.doc = np.searchsorted(every, owner[order])

    def documents_of(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the word table, and how many documents hold a word of each."""
        held = np.zeros(WORDS, dtype=np.int64)
        row = word_rows(self.hash)
        lo = 0
        while lo < len(self.doc):  # a few thousand windows at a time, of whole documents
            hi = int(np.searchsorted(self.doc, self.doc[min(lo + PART, len(self.doc)) - 1], side="right"))
            grid, doc = self.grid[lo:hi], self.doc[lo:hi]
            real = grid >= 0
            key = np.unique(np.repeat(doc, real.sum(axis=1)) * WORDS + row[grid[real]])
            held += np.bincount(key % WORDS, minlength=WORDS)
            lo = hi
        rows = np.flatnonzero(held)
        return rows, held[rows]


def _tanh_sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted rows of the word table that are known; the first of p["words"] is for all others
    p: dict[str, np.ndarray]
    threshold: float = 0.0
    sharpness: float = 1.0

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of p["words"]."""
        row = word_rows(hashes)
        at = np.searchsorted(self.vocabulary, row)
        known = at < len(self.vocabulary)
        known[known] = self.vocabulary[at[known]] == row[known]
        return np.where(known, at + 1, 0)

    def inputs(self, t: Tokens, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Input vectors of the distinct words, or of those from lo to hi."""
        hashes, cuts = t.hash[lo:hi], t.gram_cuts[lo : None if hi is None else hi + 1]
        word = self.p["words"][self.rows(hashes)]
        sums = np.zeros((len(hashes), DIM), dtype=np.float32)
        if len(hashes):
            sums[:] = np.add.reduceat(self.p["chars"][t.gram[cuts[0] : cuts[-1]]], cuts[:-1] - cuts[0], axis=0)
        size = np.sqrt(np.maximum(np.diff(cuts), 1))[:, None]
        return np.concatenate([word, sums / size], axis=1).astype(np.float32)

    def logits(self, t: Tokens, grid: np.ndarray) -> np.ndarray:
        """Logit of each window."""
        n = len(t.hash)
        fore, back = (np.empty((n + 1, 3 * HIDDEN), np.float32) for _ in "fb")
        fore[n], back[n] = self.p["bf"], self.p["bb"]  # the last row pads
        for lo in range(0, n, INPUTS):
            part, x = slice(lo, min(lo + INPUTS, n)), self.inputs(t, lo, min(lo + INPUTS, n))
            fore[part], back[part] = x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]
        out = np.empty(len(grid), dtype=np.float32)
        for lo in range(0, len(grid), PART):
            out[lo : lo + PART] = self._part(fore, back, grid[lo : lo + PART])
        return out

    def _part(self, fore: np.ndarray, back: np.ndarray, grid: np.ndarray) -> np.ndarray:
        n = len(grid)
        grid = np.ascontiguousarray(grid.T, dtype=np.intp)
        real = grid >= 0
        states = np.empty((WINDOW, 2 * HIDDEN, n), dtype=np.float32)  # windows last: long runs for every operation
        for table, u, part, steps in (
            (fore, self.p["uf"].T, slice(0, HIDDEN), range(WINDOW)),
            (back, self.p["ub"].T, slice(HIDDEN, 2 * HIDDEN), range(WINDOW - 1, -1, -1)),
        ):
            h = np.zeros((HIDDEN, n), dtype=np.float32)
            for step in steps:
                a, b = np.ascontiguousarray(np.take(table, grid[step], axis=0).T), u @ h
                gates = _tanh_sigmoid(a[: 2 * HIDDEN] + b[: 2 * HIDDEN])
                z = gates[:HIDDEN]
                new = np.tanh(a[2 * HIDDEN :] + gates[HIDDEN:] * b[2 * HIDDEN :])
                new += z * (h - new)
                h = new if real[step].all() else np.where(real[step], new, h)
                states[step, part] = h
        score = self.p["attv"] @ np.tanh(self.p["att"].T @ states)
        score = np.where(real, score, -np.inf)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,thn->hn", weight, states)
        return self.p["out"] @ pooled + self.p["bias"]

    def document_logits(self, t: Tokens) -> np.ndarray:
        """Largest logit of each document's windows; -inf for a document without words."""
        doc, grid, count = t.windows()
        best = np.full(len(count), -np.inf)
        if len(doc):
            np.maximum.at(best, doc, self.logits(t, grid))
        return best

    def probability(self, logit: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-np.clip(self.sharpness * (logit - self.threshold), -60, 60)))


def _gradients(m: Model, x: np.ndarray, real: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weighted log loss for inputs x (step, window, dim); and those of x."""
    p, n = m.p, len(y)
    steps = x.shape[0]
    states = np.empty((steps, n, 2 * HIDDEN), dtype=np.float32)
    saved = []
    for name, part, order in (
        ("f", slice(0, HIDDEN), range(steps)),
        ("b", slice(HIDDEN, 2 * HIDDEN), range(steps - 1, -1, -1)),
    ):
        a_all = x @ p["w" + name] + p["b" + name]
        h, kept = np.zeros((n, HIDDEN), np.float32), {}
        for s in order:
            b = h @ p["u" + name]
            gates = _tanh_sigmoid(a_all[s, :, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(a_all[s, :, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
            kept[s] = (h, z, r, new, b[:, 2 * HIDDEN :])
            h = np.where(real[s][:, None], new + z * (h - new), h)
            states[s, :, part] = h
        saved.append((name, part, order, kept))
    inner = np.tanh(states @ p["att"])
    score = np.where(real, inner @ p["attv"], -np.inf)
    alpha = np.exp(score - score.max(axis=0))
    alpha /= alpha.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", alpha, states)
    logit = pooled @ p["out"] + p["bias"]
    d = ((1 / (1 + np.exp(-logit)) - y) * weight / n).astype(np.float32)
    g = {"out": pooled.T @ d, "bias": d.sum()}
    d_pooled = d[:, None] * p["out"]
    d_states = alpha[:, :, None] * d_pooled
    d_alpha = np.einsum("nh,tnh->tn", d_pooled, states)
    d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
    g["attv"] = np.einsum("tn,tna->a", d_score, inner)
    d_inner = d_score[:, :, None] * p["attv"] * (1 - inner**2)
    g["att"] = np.einsum("tnh,tna->ha", states, d_inner)
    d_states = d_states + d_inner @ p["att"].T
    d_x = np.zeros_like(x)
    for name, part, order, kept in saved:
        u = p["u" + name]
        g_u, d_a = np.zeros_like(u), np.zeros((steps, n, 3 * HIDDEN), np.float32)
        d_h = np.zeros((n, HIDDEN), np.float32)
        for s in reversed(list(order)):
            h, z, r, new, hn = kept[s]
            total = d_h + d_states[s, :, part]
            live = real[s][:, None]
            d_new = total * live
            d_z = d_new * (h - new) * z * (1 - z)
            d_n = d_new * (1 - z) * (1 - new**2)
            d_r = d_n * hn * r * (1 - r)
            d_a[s] = np.concatenate([d_z, d_r, d_n], axis=1)
            d_b = np.concatenate([d_z, d_r, d_n * r], axis=1)
            g_u += h.T @ d_b
            d_h = np.where(live, total * z, total) + d_b @ u.T
        g["u" + name] = g_u
        g["w" + name] = np.einsum("tnd,tng->dg", x, d_a)
        g["b" + name] = d_a.sum(axis=(0, 1))
        d_x += d_a @ p["w" + name].T
    return g, d_x


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v, dtype=np.float32) for k, v in p.items()}
        self.v = {k: np.zeros_like(v, dtype=np.float32) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, d in g.items():
            self.m[k] = self.m[k] * np.float32(0.9) + np.float32(0.1) * d
            self.v[k] = self.v[k] * np.float32(0.999) + np.float32(0.001) * d * d
            size = np.sqrt(self.v[k] * np.float32(1 / (1 - 0.999**self.t))) + np.float32(1e-8)
            self.p[k] = (self.p[k] - np.float32(self.rate / (1 - 0.9**self.t)) * self.m[k] / size).astype(np.float32)


def start(vocabulary: np.ndarray, seed: int = 3) -> Model:
    """All weights and embeddings at random, over the known rows of the word table."""
    rng = np.random.default_rng(seed)

    def random(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {
        "words": random(len(vocabulary) + 1, DIM, scale=0.1),
        "chars": random(GRAMS, DIM, scale=0.1),
        "att": random(2 * HIDDEN, HIDDEN, scale=0.3),
        "attv": random(HIDDEN, scale=0.3),
        "out": random(2 * HIDDEN, scale=0.3),
        "bias": np.float32(0),
    }
    for d in "fb":
        p |= {"w" + d: random(2 * DIM, 3 * HIDDEN, scale=0.4), "u" + d: random(HIDDEN, 3 * HIDDEN, scale=0.2)}
        p["b" + d] = np.zeros(3 * HIDDEN, np.float32)
    return Model(vocabulary, p)


def schedule(docs: int, epochs: int = EPOCHS, steps: int = STEPS) -> tuple[int, int]:
    """(documents a batch, epochs) over ``docs`` documents: few get smaller batches and more epochs, ``steps`` steps at least."""
    batch = min(256, max(32, docs // 8))
    return batch, max(epochs, -(-steps * batch // (2 * max(docs, 1))))


def learn(model: Model, bag: Bag, epochs: range, batch: int, seed: int = 3, frozen: tuple[str, ...] = ()) -> None:
    """Go ``epochs`` times through the documents of ``bag``, all of whose windows count.

    A document's logit is its largest window's, so after two epochs over random
    windows all windows are scored again and again, and each document's largest
    one is learned from, beside a random one of the documents labelled 0.
    """
    if not len(bag.doc):
        return
    rng = np.random.default_rng([seed, epochs.start])
    adam = _Adam(model.p, 0.01)
    lookup = model.rows(bag.hash)
    held, first, count = np.unique(bag.doc, return_index=True, return_counts=True)
    zero = bag.y[held] == 0
    top = None
    for epoch in epochs:
        if epoch >= 2 and (top is None or epoch % RESCORED == 0):
            top = np.lexsort((-model.logits(bag, bag.grid), bag.doc))[first]
        drawn = lambda: first + (rng.random(len(held)) * count).astype(int)
        one, other = drawn() if top is None else top, drawn()
        if top is not None:
            other = other[zero]
        chosen = np.concatenate([one, other])
        weight = np.concatenate([np.ones(len(one)), np.full(len(other), 0.5)]).astype(np.float32)
        order = rng.permutation(len(chosen))
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            _learn(model, adam, bag, chosen[part], bag.y[bag.doc[chosen[part]]], weight[part], lookup, frozen)


def rounds(epochs: int, blocks: int) -> list[range]:
    """Epochs between two meetings of the blocks: after the first two, and then before each scoring of all windows."""
    cuts = [0, *(e for e in range(2, epochs) if e == 2 or e % RESCORED == 0), epochs] if blocks > 1 else [0, epochs]
    return [range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def train(
    rows: Iterable[tuple[np.ndarray, np.ndarray, pa.Array]],
    prior: float,
    most: int | None = None,
    epochs: int = EPOCHS,
    steps: int = STEPS,
    seed: int = 3,
    frozen: tuple[str, ...] = (),
) -> Model | None:
    """Fit on ``rows``, parts of (ids, labels, texts), as one block in memory; a threshold of its own included.

    A word is known if two training documents hold it (or one in its row of the
    table).  ``prior`` is the share of documents labelled 1 to expect, for the
    threshold.  ``frozen`` names weights to be left as they started (to see what
    each part contributes).  None without words of both classes.
    """
    bag = Bag(rows, most)
    y = bag.y
    if not len(bag.doc) or not 0 < y[bag.doc].sum() < len(bag.doc):
        return None
    row, held = bag.documents_of()
    model = start(row[held >= 2], seed)
    batch, epochs = schedule(len(y), epochs, steps)
    learn(model, bag, range(epochs), batch, seed, frozen)
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, bag.doc, model.logits(bag, bag.grid))
    _calibrate(model, best, y, prior)
    return model


class Block:
    """A copy of the weights that a bag's documents touch, to learn in and to tell the changes of.

    Changes are rows of DIM numbers: of the word table, then the character table,
    then all other weights in a row.
    """

    def __init__(self, model: Model, bag: Bag):
        self.bag, self.whole = bag, model
        self.words = np.unique(np.append(model.rows(bag.hash), 0))
        self.chars = np.unique(bag.gram)
        p = {k: np.array(v, dtype=np.float32) for k, v in model.p.items() if k != "words"}
        self.model = Model(model.vocabulary[self.words[1:] - 1], p | {"words": model.p["words"][self.words]})

    def changes(self) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, changes)."""
        old, new, n = self.whole.p, self.model.p, len(self.whole.p["words"])
        rest = _rest(new) - _rest(old)
        rows = [self.words, n + self.chars, n + GRAMS + np.arange(len(rest))]
        return np.concatenate(rows), np.concatenate(
            [new["words"] - old["words"][self.words], (new["chars"] - old["chars"])[self.chars], rest]
        )


def _rest(p: dict[str, np.ndarray]) -> np.ndarray:
    flat = np.concatenate([np.ravel(p[k]) for k in sorted(p) if k not in ("words", "chars")])
    return np.append(flat, np.zeros(-len(flat) % DIM, np.float32)).reshape(-1, DIM)


def changed(model: Model, rows: np.ndarray, changes: np.ndarray) -> Model:
    """``model`` with ``changes`` (as ``Block.changes`` numbers them; each row once) added."""
    n, rest = len(model.p["words"]), _rest(model.p)
    table = np.concatenate([model.p["words"], model.p["chars"], rest])
    table[rows] += changes
    p, at, flat = {"words": table[:n], "chars": table[n : n + GRAMS]}, 0, table[n + GRAMS :].ravel()
    for k in sorted(model.p):
        if k not in p:
            shape = np.shape(model.p[k])
            size = int(np.prod(shape, dtype=int))
            p[k] = flat[at : at + size].reshape(shape).astype(np.float32)
            at += size
    return Model(model.vocabulary, p, model.threshold, model.sharpness)


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` that go to each of ``n`` rows."""
    width = values.shape[1]
    place = (at[:, None] * width + np.arange(width)).ravel()
    return np.bincount(place, values.ravel(), n * width).astype(np.float32).reshape(n, width)


def _learn(model: Model, adam: _Adam, bag: Bag, chosen, y, weight, lookup, frozen) -> None:
    grid = bag.grid[chosen]
    used, inverse = np.unique(grid, return_inverse=True)
    if used[0] < 0:
        used = used[1:]
        inverse = inverse.reshape(grid.shape) - 1
    else:
        inverse = inverse.reshape(grid.shape)
    size = np.diff(bag.gram_cuts)[used]
    cuts = np.cumsum(size) - size
    runs = bag.gram[np.repeat(bag.gram_cuts[used] - cuts, size) + np.arange(size.sum())]
    p, rows = model.p, lookup[used]
    scale = np.sqrt(np.maximum(size, 1)).astype(np.float32)[:, None]
    chars = np.add.reduceat(p["chars"][runs], cuts, axis=0) / scale
    x_rows = np.concatenate([p["words"][rows], chars], axis=1)
    x_rows = np.concatenate([x_rows, np.zeros((1, 2 * DIM), np.float32)]).astype(np.float32)
    real = (grid >= 0).T
    g, d_x = _gradients(model, np.take(x_rows, inverse.T, axis=0), real, y, weight)
    flat = _summed(inverse.T[real], d_x[real], len(used))
    g["words"] = _summed(rows, flat[:, :DIM], len(p["words"]))
    g["chars"] = _summed(runs, np.repeat(flat[:, DIM:] / scale, size, axis=0), len(p["chars"]))
    adam.step({k: v for k, v in g.items() if k not in frozen})


def _calibrate(model: Model, logit: np.ndarray, y: np.ndarray, prior: float) -> None:
    """Threshold of the fewest expected errors, documents weighted to the prior; midway between its neighbours."""
    finite = np.isfinite(logit)
    score, label = logit[finite], y[finite] > 0.5
    order = np.argsort(score, kind="stable")
    score, label = score[order], label[order]
    ones, zeros = max(label.sum(), 1), max((~label).sum(), 1)
    missed = np.concatenate([[0], np.cumsum(label)]) / ones * prior
    alarms = (zeros - np.concatenate([[0], np.cumsum(~label)])) / zeros * (1 - prior)
    errors = missed + alarms
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    cut = int(best[len(best) // 2])
    edge = np.concatenate([[score[0] - 1], score, [score[-1] + 1]])
    model.threshold = float((edge[cut] + edge[cut + 1]) / 2)
    model.sharpness = 1.0
