"""The Spark operators against brute force on small rows: nulls, empties, ties, repeats, clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annalist.llm import common, exact_dedup, license_scan, line_dedup, lm_score, mixing, near_dedup, nearest, packing, substring_dedup, toxicity
from annalist.llm.components import components
from annalist.llm.gru import Bag, Tokens

DOCS = "doc_id long, text string, lang string, source string"
ODD = [  # null id, null text, empty, blanks, a repeated row, a long word
    (None, "null id text", "en", "src1"), (900, None, None, None), (901, "", "en", "src1"), (902, " \n\t ", "en", "src2"),
    (903, "again and again", "de", "src3"), (903, "again and again", "de", "src3"), (904, "x" * 30_000, "en", "src1"),
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def frame(spark, rows, clash=()):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for c in clash:
        df = df.withColumn(c, F.lit("clash"))
    return df


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(i, prose(rng, rng.choice([3, 20, 120])), "en" if i % 3 else "fr", f"src{i % 7}") for i in range(60)]
    for i in range(12):  # exact copies, in other case, and near copies
        out.append((100 + i, out[i][1].upper() if i % 2 else out[i][1], "en", "src0"))
    base = prose(rng, 150).split()
    for i in range(30):
        copy = list(base)
        for _ in range(i % 10):
            copy[rng.randrange(150)] = f"z{rng.randrange(9999)}"
        out.append((200 + i, " ".join(copy), "en", "src0"))
    return out + ODD


def collected(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key] or 0))


# 5


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_dedup(spark, rows, bits):
    got = collected(exact_dedup.exact_dedup(frame(spark, rows, ["keep_id", "norm", "salt"]), digest_bits=bits))
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(lower(text), []).append(i)
    assert len(got) == len(rows)
    want = Counter()
    for text, members in groups.items():
        keep = max((m for m in members if m is not None), default=None)
        for m in members:
            want[m, keep, len(members), m == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


def test_exact_dedup_stage(spark, rows):
    docs = frame(spark, rows, ["digest"])
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    texts = Counter(lower(r.text) for r in kept.collect() if r.doc_id is not None and r.doc_id != 903)
    assert set(texts.values()) == {1}
    assert {lower(t) for _, t, *_ in rows} == {lower(r.text) for r in kept.collect()}


def kept_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_exact_dedup_stage_goes_by_row(spark):
    """Ids that repeat with two texts, rows that repeat, null ids: every text stays once."""
    rows = [(1, "x"), (1, "y"), (5, "X"), (5, "X"), (9, "y"), (9, "only here"), (None, "x"), (None, "z"), (None, "z"), (7, None), (8, "")]
    docs = frame(spark, [(i, t, "en", "s") for i, t in rows])
    want = [(5, "X"), (9, "y"), (9, "only here"), (None, "z"), (8, "")]
    assert kept_rows(exact_dedup.drop_exact_copies(docs)) == sorted(want, key=str)
    assert kept_rows(exact_dedup.drop_exact_copies(docs.filter("doc_id > 1"))) == sorted(want[:3] + want[4:], key=str)


def test_near_dedup_stage_goes_by_row(spark):
    rng = random.Random(3)
    x, y, z = (prose(rng, 100) for _ in range(3))
    near = lambda text, i: " ".join([*text.split()[:-1], f"last{i}"])
    rows = [(1, x), (1, y), (5, x), (5, z), (7, near(x, 7)), (8, near(y, 8)), (None, x), (None, x), (6, None), (6, "")]
    docs = frame(spark, [(i, t, "en", "s") for i, t in rows])
    got = near_dedup.drop_near_copies(docs)
    assert kept_rows(got) == sorted([(1, x), (1, y), (5, z), (None, x), (None, x), (6, None), (6, "")], key=str)
    assert got.columns == docs.columns


# 1


def shingles(text, k=5):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_truth(rows, percent):
    ids = sorted({i for i, *_ in rows if i is not None})
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup(spark, rows, percent):
    got = collected(near_dedup.near_dedup(frame(spark, rows, ["component_id", "fp", "keys"]), percent))
    want = near_truth(rows, percent)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_dedup_large_group(spark):
    """A bucket far above the size that is paired fully."""
    rng = random.Random(5)
    base = prose(rng, 160).split()
    rows = []
    for i in range(220):
        copy = list(base)
        for _ in range(rng.randrange(14)):
            copy[rng.randrange(160)] = f"q{rng.randrange(99999)}"
        rows.append((i, " ".join(copy), "en", "src0"))
    got = {r["doc_id"]: r["component_id"] for r in collected(near_dedup.near_dedup(frame(spark, rows), 85))}
    assert got == {i: c for i, (_, c) in near_truth(rows, 85).items()}


def test_near_dedup_original_amid_its_copies(spark):
    """600 copies that resemble the original (0.88) but not each other (0.77); the original's id lies in the middle."""
    rng = random.Random(6)
    base = prose(rng, 160, 10**6).split()
    rows = []
    for i in range(601):
        copy = list(base)
        if i != 300:
            for at in (rng.randrange(5, 75), rng.randrange(85, 155)):
                copy[at] = f"q{i}x{at}"
        rows.append((i, " ".join(copy), "en", "src0"))
    got = {r["doc_id"]: r["component_id"] for r in collected(near_dedup.near_dedup(frame(spark, rows), 85))}
    assert got == {i: c for i, (_, c) in near_truth(rows, 85).items()} == dict.fromkeys(range(601), 0)


@pytest.mark.parametrize("block", [4, 256])
def test_near_dedup_blocks_compare_all_groups(spark, rows, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    some = {i: t for i, t, *_ in rows if i is not None and i != 903 and words(t)}
    texts = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    sets = texts.mapInArrow(*near_dedup._sets(5))
    want = {i: c for i, (_, c) in near_truth(list(some.items()), 80).items()}
    root = {i: 200 if want[i] == 200 and i < 220 else i for i in some}  # a group that is known already
    families = spark.createDataFrame([(i, root[i], 0) for i in some], "rep long, root long, family long")
    links = near_dedup._within(families, sets, 80).collect()
    known = [(i, root[i]) for i in some if root[i] != i] + [(r.u, r.v) for r in links]
    found = {r.node: r.root for r in components(spark.createDataFrame(known, "u long, v long")).collect()}
    assert {i: found.get(i, i) for i in some} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (105, 101), (105, 200), (7, 7)]
    edges = spark.createDataFrame(chain, "u long, v long").repartition(4)
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 105: 100, 200: 100}


# 10


def substring_truth(rows, window):
    first = {}
    for i, text, *_ in rows:
        w = words(text)
        if i is not None and text is not None:
            for s in range(len(w) - window + 1):
                k = tuple(w[s : s + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, text, *_ in rows:
        w = words(text)
        gone = set()
        if i is not None:
            for s in range(len(w) - window + 1):
                if first.get(tuple(w[s : s + window]), i) < i:
                    gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return Counter(out)


@pytest.mark.parametrize("window,anchor", [(50, 8), (6, 2)])
def test_substring_dedup(spark, rows, window, anchor):
    rng = random.Random(3)
    passage = prose(rng, 70)
    more = [(300 + i, f"{prose(rng, 9)} {passage}\n{prose(rng, 30 * i)} {passage} {passage}", "en", "src0") for i in range(5)]
    more += [(5000, "\t" + passage + " ", "en", "src1"), (None, passage, "en", "src1")]
    got = substring_dedup.substring_dedup(frame(spark, rows + more, ["own", "shared"]), window, anchor).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == substring_truth(rows + more, window)
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in itertools.pairwise(r.removed))


# 2


def test_line_dedup(spark):
    def log(i):
        return f"Job {i} of user u{i}@x.org ended with code {i % 3}"

    rng = random.Random(8)
    said = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    rows = [(i, f"{said(12)}\n{log(i)}\n\nShare this page now with friend number {said(1)}", "en", "s") for i in range(8)]
    rows += [(50, None, "en", "s"), (51, "", "en", "s"), (None, log(1), "en", "s"), (52, "\n\n", "en", "s")]
    rows += [(53, log(3), "en", "s"), (53, log(4) + "\nother text", "en", "s")]
    got = line_dedup.line_dedup(frame(spark, rows, ["dropped", "leaf"])).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_lines): r for r in got}
    assert by[0, 4].dropped == []  # the smallest document keeps the first of each template
    for i in range(1, 8):
        assert by[i, 4].dropped == [1, 3] and by[i, 4].kept_text == rows[i][1].split("\n")[0] + "\n"
    assert by[50, 1].kept_text == "" and by[51, 1].kept_text == "" and by[52, 3].kept_text == "\n\n"
    assert by[None, 1].kept_text == log(1)
    assert by[53, 1].n_dropped == 1 and by[53, 2].kept_text == "other text"


def test_line_dedup_leaves_different_lines(spark):
    rng = random.Random(1)
    said = [" ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(14)) for _ in range(6)]
    rows = [(i, f"the same start but {said[i]}", "en", "s") for i in range(6)]
    got = line_dedup.line_dedup(frame(spark, rows)).collect()
    assert all(r.n_dropped == 0 for r in got)


def letters(rng, n, size=3, alphabet="abcdefgh"):
    """Words without digits."""
    return " ".join("".join(rng.choice(alphabet) for _ in range(size)) for _ in range(n))


def template_truth(rows, min_docs=3):
    """{(row, line)} that go, by plain Python: ``rows`` are (doc_id, text)."""
    lines = []  # (doc, at, row, masked tokens)
    for row, (doc, text) in enumerate(rows):
        for at, line in enumerate(text.split("\n")):
            tokens = tuple("<*>" if re.search("[0-9@]|://", w) else w for w in words(line))
            if any(t != "<*>" for t in tokens):
                lines.append((doc, at, row, tokens))
    docs = {}  # of each form
    for doc, _, _, tokens in lines:
        docs.setdefault(tokens, set()).add(doc)
    branch = lambda t: (len(t), t[:3])
    support, forms = Counter(), Counter()
    for t, who in docs.items():
        for p in range(3, len(t)):
            if t[p] != "<*>":
                support[branch(t), p, t[p]] += len(who)
                forms[branch(t), p, t[p]] += 1
    leaf = {}
    for t in docs:
        shared = [(-support[branch(t), p, t[p]], p) for p in range(3, len(t)) if forms[branch(t), p, t[p]] > 1 and support[branch(t), p, t[p]] >= min_docs]
        leaf[t] = (branch(t), tuple((p, t[p]) for _, p in sorted(shared)[:2])) if shared else None
    template = {}
    for t in docs:
        if leaf[t]:
            mates = [u for u in docs if leaf[u] == leaf[t]]
            agree = free = 0
            for p in range(3, len(t)):
                votes = Counter()
                for u in mates:
                    votes[u[p]] += len(docs[u])
                top = max(votes, key=lambda w: (votes[w], w))
                free += t[p] != "<*>"
                agree += t[p] != "<*>" and t[p] == top and 2 * votes[top] >= sum(votes.values())
            template[t] = leaf[t] if 100 * agree >= 60 * free else t
        else:
            template[t] = t
    groups = {}
    for doc, at, row, t in lines:
        groups.setdefault(template[t], []).append((doc, at, row))
    gone = set()
    for members in groups.values():
        if len({doc for doc, *_ in members}) >= min_docs:
            gone |= {(row, at) for doc, at, row in members if (doc, at) != min(members)[:2]}
    return gone


def dropped_lines(spark, rows):
    got = line_dedup.line_dedup(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert len(got) == len(rows)
    row_of = {i: r for r, (i, _) in enumerate(rows)}
    return {(row_of[r.doc_id], at) for r in got for at in r.dropped}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(21)
    pick = lambda *w: rng.choice(w)
    makers = [
        lambda: f"The cat sat {pick('on', 'under', 'beside')} {pick('a', 'my', 'your')} {pick('mat', 'chair', 'dog')}",
        lambda: f"User {pick('ann', 'bob', 'cy')} has logged in from {pick('home', 'work', 'abroad', 'afar')} today",
        lambda: f"User {pick('ann', 'bob', 'cy')} has removed group {pick('red', 'blue', 'green')} from list",
        lambda: f"Read more about {pick('war', 'peace', 'love', '17', 'a@b')}",
        lambda: f"{rng.randrange(9)} of {pick('5', 'five')} {pick('x', '1')}",
        lambda: f"start of the {letters(rng, 3, 1)} end {prose(rng, 1, 3)}",
        lambda: "short",
        lambda: letters(rng, 5, 1, 'ab'),
        lambda: " ",
    ]
    rows = [(i, "\n".join(pick(*makers)() for _ in range(rng.randrange(1, 6)))) for i in range(90)]
    assert dropped_lines(spark, rows) == template_truth(rows) != set()


def test_line_dedup_keeps_short_lines_that_differ(spark):
    """Lines of few words agree in their leading ones by construction; only the words after those count."""
    rows = [(i, t) for i, t in enumerate(["The cat sat on a mat", "The cat sat under my chair", "The cat sat beside your dog"])]
    rows += [(10 + i, f"Thor the haan {w}.") for i, w in enumerate(["eaesing", "for", "eron", "ash"])]
    rows += [(20 + i, f"2024-01-0{i} 12:0{i}") for i in range(5)]  # no word at all
    assert dropped_lines(spark, rows) == set()


def test_line_dedup_finds_several_templates_of_one_branch(spark):
    """Two templates and many unrelated lines, all of one number of tokens and the same first three."""
    rng = random.Random(2)
    rows = [(i, f"On this day {letters(rng, 1, 9)} was born in the city") for i in range(6)]
    rows += [(10 + i, f"On this day {letters(rng, 1, 9)} did lose at the polls") for i in range(6)]
    rows += [(100 + i, f"On this day {letters(rng, 6, 9)}") for i in range(80)]
    assert dropped_lines(spark, rows) == {(r, 0) for r in [*range(1, 6), *range(7, 12)]}


# 3


def test_mixing(spark, rows):
    docs = frame(spark, rows, ["copies", "weight", "budget"])
    got = mixing.mix(docs, share=0.6, epochs=2).collect()
    assert len(got) == len(rows)
    tokens = {(r.doc_id, r.n_tokens) for r in got}
    assert {(i, len(words(t))) for i, t, *_ in rows} == tokens
    total = sum(r.n_tokens for r in got)
    taken = sum(r.n_tokens * r.copies for r in got)
    leaves = len({(r.domain, r.lang, r.source) for r in got})
    longest = max(r.n_tokens for r in got)
    assert 0.6 * total - leaves * (longest + 1) <= taken <= 0.6 * total
    assert all(0 <= r.copies <= 2 for r in got)
    again = mixing.mix(docs.repartition(7), share=0.6, epochs=2).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_budgets_move_shortages_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("web", "en", "a", 10), ("web", "en", "b", 1000), ("books", "en", "c", 1000)], "domain string, lang string, source string, tokens long"
    )
    weights = {"domain": {"web": 0.5, "books": 0.5}, "lang": {"en": 1.0}, "source": {"a": 0.5, "b": 0.5}}
    got = {r.source: r.budget for r in mixing.budgets(leaves, weights, 400.0, 1).collect()}
    assert got == pytest.approx({"a": 10, "b": 190, "c": 200})
    got = {r.source: r.budget for r in mixing.budgets(leaves, weights, 2010.0, 1).collect()}
    assert got == pytest.approx({"a": 10, "b": 1000, "c": 1000})
    small = leaves.filter("source <> 'b'")
    got = {r.source: r.budget for r in mixing.budgets(small, weights, 400.0, 1).collect()}
    assert got == pytest.approx({"a": 10, "c": 390})


def test_mixed_documents_keep_their_columns(spark, rows):
    docs = frame(spark, [r for r in rows if r[0] is not None], ["domain"])
    out = mixing.mixed_documents(docs, share=0.5, epochs=1)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()


def test_mixed_documents_take_each_row_by_its_own_copies(spark):
    """Null ids, and ids that repeat with texts of other lengths, beside plain ones."""
    rng = random.Random(13)
    rows = [(i if i < 60 else None if i < 90 else 1000 + i // 2, prose(rng, 5 + i), "en", f"src{i % 2}") for i in range(120)]
    docs = frame(spark, rows)
    for share, epochs in ((0.5, 1), (1.3, 2)):
        want = Counter()
        for r in mixing.mix(docs, share=share, epochs=epochs).collect():
            want[r.doc_id, r.n_tokens] += r.copies
        got = Counter((r.doc_id, len(words(r.text))) for r in mixing.mixed_documents(docs, share=share, epochs=epochs).collect())
        assert got == +want
        assert sum(n for (i, _), n in got.items() if i is None) > 0


# 4


@pytest.mark.parametrize("dim", [3, 64])
def test_nearest(spark, dim):
    rng = np.random.default_rng(dim)
    vectors = [(int(i), [float(x) for x in rng.standard_normal(dim)], 0) for i in range(1200)]
    vectors += [(2000 + i, vectors[7][1], 0) for i in range(40)]  # ties
    bad = [(3000, None, 0), (3100, [0.0] * dim, 0), (3200, [float("nan")] + [1.0] * (dim - 1), 0), (3300, [None] + [1.0] * (dim - 1), 0)]
    bad += [(3400, [float("inf")] * dim, 0), (3500, [1.0], 0), (3600, [], 0), (None, [1.0] * dim, 0)]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>, code int").repartition(4)
    index = nearest.build_index(df)
    assert index.count() == len(vectors)
    for block in (10_000, 5):
        got = nearest.search(index, index.filter("vec_id % 100 = 0"), 10, block=block).collect()
        found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got}
        data = np.array([v for _, v, _ in vectors])
        ids = np.array([i for i, *_ in vectors])
        right = wanted = 0
        for q in ids[ids % 100 == 0]:
            d = np.sqrt(((data - data[ids == q]) ** 2).sum(axis=1))
            order = [int(i) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
            for rank, i in enumerate(order, 1):
                wanted += 1
                right += found[int(q), rank][0] == ids[i] and found[int(q), rank][1] == pytest.approx(d[i], rel=1e-12)
        assert right >= 0.99 * wanted and len(found) == wanted


@pytest.mark.parametrize("huge", [0, 3, 9])
def test_nearest_with_vectors_out_of_range(spark, huge):
    """Squares that overflow or vanish: exact distances, by rational arithmetic, and no query without its neighbours."""
    rng = random.Random(huge)
    vectors = [(i, [rng.uniform(0, 2), rng.uniform(1, 3)]) for i in range(12)] + [(100, [1e200, 2.0]), (101, [1e200, 3.0])]
    vectors += [(200 + i, [rng.uniform(-1.7, 1.7) * 10.0 ** (308 - 40 * (i % 3)), 1.0]) for i in range(huge)]
    vectors += [(300, [1e-200, 1e-200]), (301, [3e-200, 1e-200]), (302, [5e-324, 0.0])]
    index = nearest.build_index(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    got = {}
    for r in nearest.search(index, index, 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    exact = {i: [Fraction(x) for x in v] for i, v in vectors}
    for q, v in exact.items():
        squares = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), i) for i, w in exact.items() if i != q)
        near = sorted(got[q])
        assert [rank for rank, *_ in near] == [1, 2, 3]
        for (square, _), (_, i, score) in zip(squares, near, strict=False):
            mine = sum((a - b) ** 2 for a, b in zip(v, exact[i], strict=True))
            assert abs(mine - square) <= square * Fraction(1, 10**12)  # a neighbour as near as the right one
            root = Fraction(math.isqrt(int(mine * 10**1400))) / 10**700
            assert score == (pytest.approx(float(root), rel=1e-12) if root < Fraction(1.79e308) else math.inf)


def test_nearest_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    index = nearest.build_index(empty)
    assert nearest.search(index, index, 10).collect() == []


# 6


def test_packing(spark, rows):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(frame(spark, rows, ["ids", "length"]), path, shard_tokens=3000)
    table = got.withColumn("crc", F.crc32("ids")).collect()
    for r in table:
        assert r.crc == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
    whole = {}
    for i, text, *_ in rows:
        whole.setdefault(i, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])
    pieces = {}
    for r in table:
        pieces.setdefault((r.doc_id, r.start), []).append(np.frombuffer(bytes(r.ids), "<u4").tolist())
    for i, versions in whole.items():
        ids, copies = versions[0], len(versions)
        at, out = 0, []
        while at < len(ids):
            part = pieces[i, at]
            out += part[0]
            at += len(part[0])
        assert out == ids if copies == 1 else out[: len(ids)] == ids
    used = Counter()
    for r in table:
        used[r.sequence_id] += r.length
    assert all(n <= 1024 and n & (n - 1) == 0 for n in used.values())  # no padding at all


# 7


@pytest.mark.parametrize("entries,hot", [(10**7, 10**6), (300, 3)])
def test_lm_scores(spark, rows, entries, hot):
    docs = frame(spark, rows, ["score", "count", "learn"])
    got = lm_score.lm_score(docs, depth=3, table_entries=entries, hot_words=hot).collect()
    assert len(got) == len(rows)
    training = Counter()
    for i, text, *_ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            training.update([*words(lower(text)), None])
    n, v = sum(training.values()), len(training)
    want = {}
    for i, text, *_ in rows:
        tokens = [*words(lower(text)), None]
        base = sum(math.log10((training[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        want[i] = (len(tokens), sum(training[t] > 0 for t in tokens), base)
    for r in got:
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and r.train_tokens == n
        assert r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-9)
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.score < 0
    if entries > 1000:
        test_lm_scores.whole = {r.doc_id: r.score for r in got}
    else:  # in shards, the same
        for r in got:
            assert r.score == pytest.approx(test_lm_scores.whole[r.doc_id], rel=1e-5)


def test_lm_prefers_what_it_learned(spark):
    rng = random.Random(1)
    noise = lambda: "".join(rng.choice("qxzjk") for _ in range(200))
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    rows = [(i, prose(rng, 60, 50), "en", "s") for i in range(80)] + [(i, noise(), "en", "s") for i in range(1000, 1100) if held(i)]
    got = [r for r in lm_score.lm_score(frame(spark, rows)).collect() if r.held_out]
    known, unseen = [r.bits_per_byte for r in got if r.doc_id < 1000], [r.bits_per_byte for r in got if r.doc_id >= 1000]
    assert known and unseen and max(known) + 1 < min(unseen)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / len(texts[r.doc_id]), rel=1e-9)


# 8


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["moron", "idiot", "scum"]
    rows, labels = [], []
    for i in range(300):
        w = prose(rng, rng.choice([10, 80, 300])).split()
        toxic = i % 5 == 0
        for _ in range(4 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(toxic)))
    labels += [(7, 1, None), (None, 1, 1), (99_999, 1, 1)]
    docs = frame(spark, rows + ODD, ["score", "toxic"])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows) + len(ODD)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id in (900, 901, 902):
            assert r.score == 0
    none = toxicity.toxicity(docs, marks.filter("toxic = 0")).collect()
    assert all(r.score == 0 for r in none)


def test_toxicity_learns_from_every_labelled_text(spark):
    """No text beyond some number or place is left out: words of the last ones by the id's hash and of a long text's end are known."""
    ids = spark.range(4500).filter(~toxicity.held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id")
    ids = [r.id for r in ids.collect()]
    rare = {ids[-4]: "quagmirish", ids[-3]: "quagmirish", ids[-2]: "endwordly", ids[-1]: "endwordly"}
    rows, labels = [], []
    for k, i in enumerate(ids):
        long = " ".join(f"w{j % 50}" for j in range(9_000)) + " " if rare.get(i) == "endwordly" else ""
        rows.append((i, long + ("you moron " if k % 2 else "kind day ") + rare.get(i, ""), "en", "s"))
        labels.append((i, k % 2))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), toxicity.labelled(marks), block_bytes=50_000)
    t = Tokens(np.frombuffer(b"quagmirish endwordly moron unheard", np.uint8), np.array([0, 34]))
    assert (model.rows(t.hash)[t.word] > 0).tolist() == [True, True, True, False]
    texts = [b"you moron", b"kind day"]
    t = Tokens(np.frombuffer(b"".join(texts), np.uint8), np.array([0, 9, 17]))
    bad, good = model.document_logits(t)
    assert bad > good + 2


def test_toxicity_blocks_travel_in_small_pieces():
    texts = [[" ".join(f"w{i}x{j}" for j in range(3000)) for i in range(k, 6 * k, k)] for k in (1, 7)]
    parts = [pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([1, 0] * 2 + [0]), pa.array(t)], ["doc_id", "toxic", "text"]) for t in texts]
    rows = [pa.Table.from_batches(toxicity._bags(iter([p]))) for p in parts]
    for r in rows:
        assert r.num_rows > 10 and max(len(c) for c in r["piece"].to_pylist()) <= toxicity.PIECE_BYTES
        assert (sum(r["n"].to_pylist()), sum(r["ones"].to_pylist()), r["number"].to_pylist().count(0)) == (5, 2, 1)
    both = pa.concat_tables(rows).select(["number", "pieces", "piece"])
    for size in (1, 7, 10_000):  # batches end anywhere
        bags = list(toxicity._each_bag(iter(both.combine_chunks().to_batches(size))))
        for bag, p in zip(bags, parts, strict=True):
            whole = Bag([(p.column(0).to_numpy(), p.column(1).to_numpy(), p.column(2))])
            assert all(np.array_equal(getattr(bag, k), v) for k, v in vars(whole).items())
    for torn in (both.slice(1), both.slice(0, both.num_rows - 1), pa.concat_tables([both.slice(0, 3), both.slice(4)])):
        with pytest.raises(ValueError, match="piece"):
            list(toxicity._each_bag(iter(torn.to_batches())))
    assert list(toxicity._bags(iter([parts[0].slice(0, 0)]))) == []


def test_toxicity_threshold(spark):
    rng = random.Random(6)
    for n, spread in ((1, 1), (2, 1), (60, 1), (60, 8), (300, 3)):
        rows = [(round(rng.gauss(spread * y, 1), 1), y) for y in (int(rng.random() < 0.3) for _ in range(n))]
        got = toxicity.threshold(spark.createDataFrame(rows, "logit double, toxic int").repartition(3))
        errors = lambda cut: sum((x >= cut) != y for x, y in rows)
        values = sorted({x for x, _ in rows})
        cuts = [values[0] - 0.5, *((a + b) / 2 for a, b in itertools.pairwise(values)), values[-1] + 0.5]
        assert errors(got) == min(map(errors, cuts)), (n, spread)
        assert min(abs(got - c) for c in cuts) < 1e-9


def test_toxicity_stage_goes_by_row(spark):
    bad, good = "you utter moron and scum", "a kind word for the day"
    rows = [(i, bad if i % 2 else good, "en", "s") for i in range(60)]
    rows += [(100, bad, "en", "s"), (100, good, "en", "s"), (None, bad, "en", "s"), (None, good, "en", "s"), (101, None, "en", "s")]
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    docs = frame(spark, rows, ["predicted"])
    got = toxicity.drop_toxic(docs, marks)
    assert got.columns == docs.columns
    assert Counter(r.text for r in got.collect()) == Counter({good: 32, None: 1})
    assert got.filter("doc_id IS NULL OR doc_id = 100").count() == 2


# 9


def test_license_scan(spark):
    rng = random.Random(2)
    mit = dict((len(t), t) for _, t in license_scan.TEMPLATES if t.startswith("Permission is hereby"))[max(len(t) for _, t in license_scan.TEMPLATES if t.startswith("Permission is hereby"))]
    edited = mit.replace("free of charge,", "without any charge whatsoever,").replace("and/or", "or")
    cases = [
        (1, prose(rng, 50), "", "", 0), (2, f"{prose(rng, 9)} {mit} {prose(rng, 9)}", "", "mit", 0), (3, edited, "", "mit", 0),
        (4, "Released under the MIT License. And the mit-license!", "mit", "mit", 2),
        (5, "licensed under the GNU General Public License, version 3", "gpl", "gpl,gpl-3.0", 1),
        (6, "Licensed under the GNU Lesser General Public License, version 3.", "gpl", "gpl,lgpl-3.0", 0),
        (7, None, "", "", 0), (8, "", "", "", 0), (9, "mit", "", "", 0), (10, "the apache license is mentioned", "apache", "apache", 1),
        (11, "Licensed under CC BY-NC 4.0.", "", "cc-by-nc-4.0", 0),
    ]
    rows = [(i, t, "en", "s") for i, t, *_ in cases] + [(None, "mit license", "en", "s"), (4, cases[3][1], "en", "s")]
    got = license_scan.license_scan(frame(spark, rows, ["label", "spans"])).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text, base, labels, n in cases:
        r = by[i]
        if i == 6:
            base, labels, n = "gpl", "gpl,lgpl-3.0", 1
        assert (r.n_words, r.labels) == (len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))), labels)
        assert (r.base_labels, r.n_base) == (base, n)
        assert (r.score > 0) == bool(labels)
    assert by[4].first_word == 3 and by[4].last_word == 7 and by[1].first_word is None
    assert by[2].spans[0].start == 9 and by[2].spans[0].score == 1.0
    assert by[None].base_labels == "mit" and by[None].score == 0.5


# all of them over nothing, and the pipeline


def test_empty_tables(spark):
    public = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        exact_dedup.exact_dedup(docs), near_dedup.near_dedup(docs), substring_dedup.substring_dedup(docs), line_dedup.line_dedup(docs),
        mixing.mix(docs), packing.pack(docs, public.path("byte_bpe_50k.json")), lm_score.lm_score(docs),
        toxicity.toxicity(docs, labels), license_scan.license_scan(docs),
    ):
        assert out.collect() == []


def test_drop_ids(spark):
    docs = frame(spark, [(1, "a", "", ""), (2, "b", "", ""), (None, "c", "", "")])
    assert {r.text for r in common.drop_ids(docs, spark.createDataFrame([(2,)], "doc_id long")).collect()} == {"a", "c"}
