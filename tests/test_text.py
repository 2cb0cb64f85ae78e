"""Text expressions, keys, vectors and stemming."""

import sqlite3
import uuid

import pytest
from pyspark.sql import functions as F

from annalist.functions import fuzzy, ids
from annalist.functions import text as X
from annalist.functions import vectors as V
from annalist.functions.stemming import stem


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expression.alias("x")).head()[0]


@pytest.mark.parametrize(
    "raw,clean",
    [
        ("a <!-- gone --> b", "a  b"), ("- [ ] First\n- [X] Last", "First\nLast"), ("A\n\n\n\n\nB", "A\n\nB"),
        ("", ""), (None, ""), (" \r\n x\ry <!-- a\nb --> ", "x\ny"),
    ],
)
def test_clean_markdown(spark, raw, clean):
    assert one(spark, X.clean_markdown(F.col("t")), t=raw) == clean


def test_clean_html(spark):
    assert one(spark, X.clean_html(F.col("t")), t="<p>a <b>c</b></p>\n\n\n\n<i>d</i>") == "a  c  \n\n d"
    assert one(spark, X.clean_html(F.col("t")), t=None) == ""


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb\n\n", "\n", "x\n\ny"])
def test_lines(spark, text):
    assert one(spark, X.lines(F.col("t")), t=text) == text.splitlines()


def test_subject_and_body(spark):
    m = "fix: handle auth edge case \nskipped\nThis fixes the JWT expiry bug.\n\nMore\n"
    assert one(spark, X.subject(F.col("t")), t=m) == "fix: handle auth edge case"
    assert one(spark, X.message_body(F.col("t")), t=m) == "This fixes the JWT expiry bug.\n\nMore"
    assert one(spark, X.message_body(F.col("t")), t="only") == "" and one(spark, X.subject(F.col("t")), t="") == ""


def test_references(spark):
    assert one(spark, X.references(F.col("a"), F.col("b")), a="Add (#17) #1", b="2 Fixes #17.") == [17, 1]
    assert one(spark, X.references(F.col("a"), F.col("b")), a=None, b=None) == []


@pytest.mark.parametrize(
    "text,iso", [("2023-01-15T10:00:00+02:00", "2023-01-15T08:00:00Z"), ("2023-01-15T10:00:00Z", "2023-01-15T10:00:00Z"), ("2023-02-01T12:00:00", "2023-02-01T12:00:00Z"), ("nonsense", None), ("", None), (None, None)]
)
def test_times(spark, text, iso):
    assert one(spark, X.iso(X.parse_time(F.col("t"))), t=text) == iso


@pytest.mark.parametrize("n,size", [(0, 100), (1, 100), (100, 100), (2048, 2048), (5000, 2048), (151, 100)])
def test_split_by_chars(spark, n, size):
    text = "".join(chr(97 + i % 26) for i in range(n))
    want, at = [], 0
    while at < n:
        want.append(text[at : at + size])
        at += size - 50
    got = one(spark, X.split_by_chars(F.col("t"), size), t=text)
    assert got == want
    assert "".join(p[: size - 50] for p in got) == text


def test_headings(spark):
    assert one(spark, X.heading_version(F.col("t")), t="## v2.0.0 — 2023-06-01") == "v2.0.0"
    assert one(spark, X.heading_version(F.col("t")), t="## Unreleased stuff") == "Unreleased"
    for text in ("## 1.0 (2022/06/01)", "## 1.0 June 1 2022", "## 1.0 on June 1, 2022"):
        assert str(one(spark, X.heading_date(F.col("t")), t=text)) == "2022-06-01 00:00:00"
    assert one(spark, X.heading_date(F.col("t")), t="## 1.0") is None


def test_keys(spark):
    assert one(spark, ids.uuid5(F.col("t")), t="chunk-1") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "chunk-1"))
    for text in ("https://github.com/o/n.git", "git@github.com:o/n", "o/n/", "github.com/o/n"):
        assert one(spark, ids.repo_slug(F.col("t")), t=text) == "o/n"


def test_cosine(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    a, z = row.select(V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("z"))).head()
    assert a == pytest.approx(0.5**0.5) and z == 0


def test_stems_equal_sqlite():
    words = """caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed
    failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli
    vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative
    formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement
    adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll
    running runs migrations authentication tokens limiter yes by sky embedded databases""".split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, instance)")
    for i, w in enumerate(words):
        db.execute("insert into t(rowid, x) values (?, ?)", (i, w))
    known = dict(db.execute("select doc, term from v"))
    assert {w: stem(w) for w in words} == {w: known[i] for i, w in enumerate(words)}


def test_fuzzy():
    assert fuzzy.token_sort_ratio("auth service", "service auth") == 100
    assert fuzzy.token_sort_ratio("abc", "abd") == pytest.approx(200 * 2 / 6)
    assert fuzzy.token_sort_ratio("", "") == 100 and fuzzy.token_sort_ratio("a", "") == 0
