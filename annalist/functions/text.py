"""Text expressions: cleaning, lines, tokens, references, dates.  All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = "\r\n|[\n\r]"
TOKEN_CHARS = 4
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this "
    "to was will with"
).split()


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A[ \t\n\r\x0b\f]+|[ \t\n\r\x0b\f]+\z", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"[^ \t\n\r\x0b\f]"), F.lit(True))


def normalise(text: Column) -> Column:
    """Line feeds only, at most one empty line in a row, no white space around."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    return strip(F.regexp_replace(unix, "\n{3,}", "\n\n"))


def clean_markdown(text: Column) -> Column:
    """Without comments and check-box marks; null becomes empty."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "(?s)<!--.*?-->", "")
    return normalise(F.regexp_replace(bare, r"- \[[ xX]\] ", ""))


def clean_html(html: Column) -> Column:
    """Tags become spaces; null becomes empty."""
    return normalise(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "))


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no line, and an empty text has none."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\r\n|[\n\r])\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END))


def subject(message: Column) -> Column:
    return F.coalesce(strip(F.get(lines(message), 0)), F.lit(""))


def message_body(message: Column) -> Column:
    """The lines after the second."""
    rows = lines(message)
    return strip(F.array_join(F.slice(rows, 3, F.greatest(F.size(rows), F.lit(1))), "\n"))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / TOKEN_CHARS).cast("int")


def references(*texts: Column) -> Column:
    """Distinct numbers written as #n, each text for itself."""
    found = [F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"#(\d{1,18})"), 1) for t in texts]
    return F.array_distinct(F.transform(F.concat(*found), lambda n: n.cast("long")))


def years(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b((?:19|20)[0-9]{2})\b"), 1)


def quoted(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit('"([^"]+)"'), 1)


def parse_time(text: Column) -> Column:
    """ISO time (Z or an offset; UTC if neither); null where it is none."""
    return F.try_to_timestamp(F.when(is_blank(text), None).otherwise(strip(text)))


def iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ssXXX")


def search_tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and _ (of two characters or more) that are no stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def fulltext_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, diacritics of Latin letters folded."""
    marked = "àáâãäåāăąçćĉċčďđèéêëēĕėęěĝğġģĥħìíîïĩīĭįıĵķĺļľŀłñńņňòóôõöøōŏőŕŗřśŝşšţťŧùúûüũūŭůűųŵýÿŷźżž"
    plain = "aaaaaaaaacccccddeeeeeeeeegggghhiiiiiiiiijklllllnnnnooooooooorrrsssstttuuuuuuuuuuwyyyzzz"
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), marked, plain)
    return F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}]+)"), 1)


def without_punctuation(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_\s]", " ")


def split_by_chars(text: Column, size: Column | int, overlap: int = 50) -> Column:
    """Pieces of ``size`` characters starting every ``size - overlap``, as long as a start lies in the text."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(0), F.length(text) - 1, (size - overlap).cast("int"))
    pieces = F.transform(starts, lambda i: F.substring(text, i + 1, size))
    return F.when(F.length(text) > 0, pieces).otherwise(F.array().cast("array<string>"))


HEADING_DATE = r"([0-9]{4}([-/])[0-9]{2}\2[0-9]{2}|\w+ [0-9]{1,2},? [0-9]{4})"


def heading_version(heading: Column) -> Column:
    found = F.regexp_extract(heading, r"v?[0-9]+[.][0-9]+[.0-9]*", 0)
    word = F.regexp_extract(F.regexp_replace(heading, r"\A[# ]+|[# ]+\z", ""), r"\S+", 0)
    return F.when(found != "", found).otherwise(word)


def heading_date(heading: Column) -> Column:
    raw = F.replace(F.regexp_extract(heading, HEADING_DATE, 1), F.lit("/"), F.lit("-"))
    return F.coalesce(
        *[F.try_to_timestamp(raw, F.lit(p)) for p in ("yyyy-MM-dd", "MMMM d yyyy", "MMMM d, yyyy")]
    )
