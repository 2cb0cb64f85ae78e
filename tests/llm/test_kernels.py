"""The numpy kernels against plain Python."""

import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from annalist.llm import context_tree as ct
from annalist.llm import gru
from annalist.llm.packing import assign, encoder
from annalist.llm.superminhash import signatures
from annalist.llm.textnum import ALNUM_SEP, LOWER, SPACE_SEP, Words, inside, mix64, text_chunks, window_hashes

TEXTS = ["", " ", "one", " Ünïcode  word\tand\nlines ", "a b c d e f", "x" * 5000, "ABC abc\x0bq\x0cz", None, "a b c d e f"]


def words_of(texts, sep=SPACE_SEP, limit=64):
    out, hashes = [], []
    for _, _, data, offsets in text_chunks(pa.array(texts), limit):
        w = Words(LOWER[data], offsets, sep)
        h = w.hashes()
        for d in range(len(offsets) - 1):
            span = range(w.first[d], w.first[d + 1])
            out.append([LOWER[data][w.start[i] : w.end[i]].tobytes().decode() for i in span])
            hashes.append([int(h[i]) for i in span])
    return out, hashes


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_words_match_the_patterns():
    assert words_of(TEXTS)[0] == [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in TEXTS]
    assert words_of(TEXTS, ALNUM_SEP)[0] == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) for t in TEXTS]


def test_hashes_do_not_depend_on_the_place():
    words, hashes = words_of(TEXTS)
    words_2, hashes_2 = words_of(["pad pad"] + TEXTS, limit=1 << 20)
    flat = {}
    for ws, hs in zip(words + words_2, hashes + hashes_2, strict=True):
        for w, h in zip(ws, hs, strict=True):
            assert flat.setdefault(w, h) == h
    assert len(set(flat.values())) == len(flat)


def test_window_hashes():
    h = mix64(np.arange(1, 40, dtype=np.uint64) % np.uint64(7))
    w = window_hashes(h, 5)
    for i in range(len(w)):
        for j in range(len(w)):
            assert (w[i] == w[j]) == (h[i : i + 5] == h[j : j + 5]).all()
    assert inside(np.array([0, 3, 9]), 3).tolist() == [True, False, False, True, True, True, True]


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(20):
            both = rng.integers(1, 2**63, 200, dtype=np.uint64)
            n = int(200 * share)
            rest = (200 - n) // 2
            a, b = both[: n + rest], np.concatenate([both[:n], both[n + rest :]])
            sig = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 252)
            errors.append((sig[0] == sig[1]).mean() - n / len(both[: n + 2 * rest]))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_superminhash_is_a_function_of_the_set():
    rng = np.random.default_rng(1)
    sets = [rng.integers(1, 2**63, n, dtype=np.uint64) for n in (1, 2, 7, 300, 3000)]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    together = signatures(np.concatenate(sets), first)
    for i, s in enumerate(sets):
        alone = signatures(rng.permutation(s), np.array([0, len(s)]))
        assert (alone[0] == together[i]).all()
        # every slot is filled, and each element fills each slot at most once
        assert (together[i] < np.uint64(1) << np.uint64(62)).all()


def test_packing_fills_every_sequence():
    rng = random.Random(2)
    for _ in range(50):
        lengths = np.array([rng.choice([1, 3, 50, 700, 1024, 1025, 5000]) for _ in range(rng.randint(1, 80))])
        doc, start, length, sequence, offset = assign(lengths)
        spans = {}
        for d, s, n in sorted(zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)):
            assert s == spans.get(d, 0) and n > 0
            spans[d] = s + n
        assert spans == dict(enumerate(lengths.tolist()))
        used = {}
        for q, o, n in sorted(zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True)):
            assert o == used.get(q, 0)
            used[q] = o + n
        assert all(n <= 1024 and n & (n - 1) == 0 for n in used.values())


def test_packing_balances_cost():
    rng = np.random.default_rng(4)
    lengths = rng.integers(10, 900, 800)
    doc, start, length, sequence, _ = assign(lengths)
    cost = np.bincount(sequence, weights=length + length.astype(float) ** 2 / 512)
    full = np.bincount(sequence, weights=length) == 1024
    first_fit = []  # in the order given
    for n in lengths:
        for bin_ in first_fit:
            if sum(bin_) + n <= 1024:
                bin_.append(n)
                break
        else:
            first_fit.append([n])
    plain = np.array([sum(n + n * n / 512 for n in b) for b in first_fit])
    assert cost[full].std() / cost[full].mean() < plain.std() / plain.mean()


def test_both_tokenizers_agree():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    exact, ours = Tokenizer.from_file(path), encoder(path)
    for text in ["", "Hello, world!  twice\n\n x", "élan vital 12'll", "日本語 текст", "a<|endoftext|>b", " x\x1cy", "it's  9% "]:
        assert ours(text) == exact.encode(text, add_special_tokens=False).ids


class Sequential:
    """Context-tree weighting one decision at a time, as the definition has it."""

    def __init__(self, depth):
        self.depth, self.counts = depth, {}

    def learn(self, text):
        padded = bytes(self.depth) + text + b"\0"
        for i in range(self.depth, len(padded)):
            for level in range(8):
                bit = padded[i] >> (7 - level) & 1
                node = (1 << level) | padded[i] >> (8 - level)
                for d in range(self.depth + 1):
                    self.counts.setdefault((padded[i - d : i], node), [0, 0])[bit] += 1

    def log_estimate(self, a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_weighted(self, context, node):
        if (context, node) not in self.counts:
            return 0.0
        own = self.log_estimate(*self.counts[context, node])
        if len(context) == self.depth:
            return own
        below = sum(self.log_weighted(bytes([c]) + context, node) for c in range(256) if (bytes([c]) + context, node) in self.counts)
        return np.logaddexp(own, below) - math.log(2)

    def log10_text(self, text):
        """By the ratio of weighted probabilities with and without the decision."""
        total, padded = 0.0, bytes(self.depth) + text + b"\0"
        for i in range(self.depth, len(padded)):
            for level in range(8):
                bit = padded[i] >> (7 - level) & 1
                node = (1 << level) | padded[i] >> (8 - level)
                before = self.log_weighted(b"", node)
                keys = [(padded[i - d : i], node) for d in range(self.depth + 1)]
                for k in keys:
                    self.counts.setdefault(k, [0, 0])[bit] += 1
                total += self.log_weighted(b"", node) - before
                for k in keys:
                    self.counts[k][bit] -= 1
                    if self.counts[k] == [0, 0]:
                        del self.counts[k]
        return total / math.log(10)


@pytest.mark.parametrize("split", [1, 2, 3])
def test_context_trees_match_the_sequential_definition(split):
    training = [b"abracadabra", b"abcabcabd", b"", b"zz"]
    wanted = [b"abra", b"", b"xyz", b"abc\xc3\xa9"]
    slow = Sequential(3)
    for t in training:
        slow.learn(t)

    def grams(texts):
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        return ct.grams(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), 3)

    seen, n = np.unique(grams(training)[0], return_counts=True)
    asked, cuts = grams(wanted)
    every = np.union1d(seen, asked)
    count = np.zeros(len(every), dtype=np.int64)
    count[np.searchsorted(every, seen)] = n
    suffix = every >> np.uint64(8) & np.uint64((1 << 8 * split) - 1)
    groups = [ct.Group(every[suffix == s], count[suffix == s], 3, split) for s in np.unique(suffix)]
    nodes = {}
    for g in groups:
        for k, z, o, w in zip(g.top_node.tolist(), g.top_zeros, g.top_ones, g.top_log, strict=True):
            nodes[k] = nodes.get(k, np.zeros(3)) + [z, o, w]
    rows = np.array([nodes[k] for k in nodes])
    top = ct.Top(np.array(list(nodes), dtype=np.uint64), rows[:, 0], rows[:, 1], rows[:, 2], split)
    values = np.zeros(len(every))
    for g in groups:
        values[np.searchsorted(every, g.gram)] = top.finish(g.gram, g.p)
    score = values[np.searchsorted(every, asked)]
    for i, text in enumerate(wanted):
        assert score[cuts[i] : cuts[i + 1]].sum() == pytest.approx(slow.log10_text(text), abs=1e-6)


def test_table():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    table = ct.Table(keys, np.arange(len(keys), dtype=np.float32) + 1)
    assert (table.get(keys) == np.arange(len(keys)) + 1).all()
    assert (table.get(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == 0).all()
    assert ct.Table(keys[:0], np.empty(0, np.float32)).get(keys[:3]).tolist() == [0, 0, 0]


def trained(texts, labels, **options):
    rows = [(np.arange(len(texts)), np.array(labels), pa.array(texts, pa.large_string()))]
    return gru.train(rows, prior=0.3, **{"epochs": 1, "steps": 1} | options)


def tokens(texts):
    (_, _, data, offsets), = text_chunks(pa.array(texts, pa.large_string()))
    return gru.Tokens(data, offsets)


def test_document_logits_are_the_largest_of_all_windows():
    rng = np.random.default_rng(8)
    pick = lambda n: " ".join(rng.choice(["moron", "Nice", "word", "über", "a1", "day"], n))
    texts = [pick(n) for n in (1, 5, 31, 32, 33, 48, 49, 200, 700)] + ["", " ,;! "]
    model, t = trained(texts, [1, 0] * 5 + [0]), tokens(texts)
    model.p = {k: v.astype(np.float64) if hasattr(v, "astype") else v for k, v in model.p.items()}
    x = np.concatenate([model.inputs(t), np.zeros((1, 2 * gru.DIM), np.float32)]).astype(np.float64)
    got = model.document_logits(t)
    for d, text in enumerate(texts):
        words = t.word[t.first[d] : t.first[d + 1]]
        assert len(words) == len(re.findall("[0-9a-z\x80-\U0010FFFF]+", text.lower()))
        logits = []
        for start in range(0, max(len(words), 1), gru.STRIDE):  # each window for itself, no batch
            window = words[start : start + gru.WINDOW]
            if len(window):
                one = x[window][:, None, :]
                logits.append(float(model_logit(model, one, np.ones((len(window), 1), bool))[0]))
            if start + gru.WINDOW >= len(words):
                break
        assert got[d] == (pytest.approx(max(logits), abs=1e-4) if logits else -np.inf)


def test_training_does_not_depend_on_the_order_of_rows():
    texts = [f"word{i % 7} thing{i % 3} " * (5 + 80 * (i % 4)) for i in range(12)]
    labels = [i % 3 == 0 for i in range(12)]
    parts = [(np.array([i]), np.array([labels[i]]), pa.array([texts[i]], pa.large_string())) for i in range(12)]
    one = gru.train(parts, prior=0.3, most=4, epochs=2, steps=2)
    other = gru.train(parts[::-1], prior=0.3, most=4, epochs=2, steps=2)
    assert (one.vocabulary == other.vocabulary).all() and one.threshold == other.threshold
    assert all(np.array_equal(one.p[k], other.p[k]) for k in one.p)
    bag = gru.Bag(parts, 4)
    assert np.bincount(bag.doc).max() == 4 and len(bag.y) == 12


def test_bag_keeps_every_window_of_long_texts():
    text = " ".join(f"w{i}" for i in range(32 * 300))
    bag = gru.Bag([(np.array([4, 7]), np.array([1, 0]), pa.array([text, "short one"], pa.large_string()))])
    assert np.bincount(bag.doc).tolist() == [300, 1] and len(np.unique(bag.grid[:300])) == 32 * 300


def test_bag_needs_little_more_than_its_windows():
    """Texts that share their words: while a bag is made, memory does not hold a word's runs for every chunk."""
    words = [f"{i}sharedword" for i in range(40_000)]
    rng = np.random.default_rng(3)
    rows = [(np.array([i]), np.array([i % 2]), pa.array([" ".join(words[j] for j in rng.permutation(40_000))], pa.large_string())) for i in range(40)]
    gru.Bag(rows[:2])  # tables of powers
    tracemalloc.start()
    try:
        bag = gru.Bag(rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(bag.hash) == 40_000 and np.bincount(bag.doc).tolist() == [1250] * 40
    assert peak < 2 * bag.grid.nbytes + (64 << 20)  # one chunk taken apart among it


def test_changes_of_a_block_give_its_weights():
    texts = [f"word{i % 7} thing{i % 3} other{i % 2} " * 9 for i in range(12)]
    rows = [(np.arange(12), np.arange(12) % 3 == 0, pa.array(texts, pa.large_string()))]
    bag = gru.Bag(rows)
    row, held = bag.documents_of()
    model = gru.start(np.union1d(row[held >= 2], [5, 77]))
    block = gru.Block(model, bag)
    gru.learn(block.model, bag, range(4), 8)
    whole = gru.changed(model, *block.changes())
    assert whole.logits(bag, bag.grid) == pytest.approx(block.model.logits(bag, bag.grid), abs=1e-4)
    assert abs(whole.logits(bag, bag.grid) - model.logits(bag, bag.grid)).max() > 0.01
    untouched = np.searchsorted(model.vocabulary, [5, 77]) + 1
    assert np.array_equal(whole.p["words"][untouched], model.p["words"][untouched])


def test_inputs_of_a_range_are_those_of_all():
    texts = [f"word{i % 7} thing{i % 3} über{i} " * 9 for i in range(12)]
    model, t = trained(texts, [1, 0] * 6), tokens(texts)
    whole, n = model.inputs(t), len(t.hash)
    assert np.array_equal(np.concatenate([model.inputs(t, lo, min(lo + 4, n)) for lo in range(0, n, 4)]), whole)
    assert whole.shape == (n, 2 * gru.DIM) and model.inputs(tokens([""])).shape == (0, 2 * gru.DIM)


def test_scoring_holds_few_input_vectors_at_once():
    """Beside the two tables of the distinct words, what is needed does not grow with their number."""
    bag = gru.Bag([(np.array([1]), np.array([1]), pa.array([" ".join(f"{i}distinctword" for i in range(150_000))], pa.large_string()))])
    model, tables = gru.start(np.empty(0, np.int64)), 2 * 3 * gru.HIDDEN * 4 * len(bag.hash)
    tracemalloc.start()
    try:
        model.logits(bag, bag.grid[:10])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(bag.hash) == 150_000 and peak < tables + (24 << 20)


def test_network_gradients():
    texts = ["you are a moron today", "nice words here and there", "word " * 50]
    model, t = trained(texts * 3, [1, 0, 0] * 3), tokens(texts)
    doc, grid, _ = t.windows()
    x = np.concatenate([model.inputs(t), np.zeros((1, 2 * gru.DIM), np.float32)])[grid.T].astype(np.float64)
    real, y, weight = (grid >= 0).T, np.array([1.0] + [0.0] * (len(doc) - 1)), np.ones(len(doc))
    model.p = {k: v.astype(np.float64) if hasattr(v, "astype") else v for k, v in model.p.items()}

    def loss():
        logit = model_logit(model, x, real)
        return np.mean(weight * (np.logaddexp(0, logit) - y * logit))

    g, _ = gru._gradients(model, x, real, y, weight)
    rng = np.random.default_rng(0)
    for name in ("wf", "ub", "att", "attv", "out", "bf"):
        at = tuple(rng.integers(0, s) for s in model.p[name].shape)
        old, step = model.p[name][at], 1e-3
        model.p[name][at] = old + step
        up = loss()
        model.p[name][at] = old - step
        down = loss()
        model.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * step), abs=3e-4)


def model_logit(m, x, real):
    states = np.zeros((len(x), x.shape[1], 2 * gru.HIDDEN))
    for name, part, order in (("f", slice(0, gru.HIDDEN), range(len(x))), ("b", slice(gru.HIDDEN, None), range(len(x) - 1, -1, -1))):
        h = np.zeros((x.shape[1], gru.HIDDEN))
        for s in order:
            a, b = x[s] @ m.p["w" + name] + m.p["b" + name], h @ m.p["u" + name]
            n = gru.HIDDEN
            z, r = 1 / (1 + np.exp(-(a[:, :n] + b[:, :n]))), 1 / (1 + np.exp(-(a[:, n : 2 * n] + b[:, n : 2 * n])))
            new = np.tanh(a[:, 2 * n :] + r * b[:, 2 * n :])
            h = np.where(real[s][:, None], (1 - z) * new + z * h, h)
            states[s][:, part] = h
    score = np.where(real, np.tanh(states @ m.p["att"]) @ m.p["attv"], -np.inf)
    alpha = np.exp(score - score.max(axis=0))
    alpha /= alpha.sum(axis=0)
    return np.einsum("tn,tnh->nh", alpha, states) @ m.p["out"] + m.p["bias"]
