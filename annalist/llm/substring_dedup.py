"""Removal of word windows that an earlier document already holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import id_and_text, materialise
from annalist.llm.textnum import IDENTITY, SPACE_SEP, Words, inside, text_chunks, window_hashes

WINDOW = 50
ANCHOR = 8
U = np.uint64


def _sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values (van Herk)."""
    m = len(values)
    pad = -m % n
    blocks = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, n)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: m - n + 1], ahead[n - 1 : m])


class _Windows:
    """Windows of a chunk: first word, Rabin-Karp hash, anchor (smallest hash of the short grams inside)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, anchor: int):
        self.words = Words(data, offsets, SPACE_SEP)
        hashes = self.words.hashes()
        self.at = np.flatnonzero(inside(self.words.first, window))
        if len(self.at):
            self.hash = window_hashes(hashes, window)[self.at].view(np.int64)
            grams = window_hashes(hashes, anchor)
            self.anchor = _sliding_min(grams, window - anchor + 1)[self.at].view(np.int64)
        else:
            self.hash = self.anchor = np.empty(0, np.int64)
        self.doc = self.words.doc[self.at]
        self.bounds = np.searchsorted(self.doc, np.arange(len(offsets)))


def _anchors(window: int, anchor: int):
    """Documents to (anchor, doc_id), each once per document."""
    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            for lo, _, data, offsets in text_chunks(batch.column(1)):
                w = _Windows(data, offsets, window, anchor)
                if not len(w.at):
                    continue
                turn = np.ones(len(w.at), dtype=bool)
                turn[1:] = (w.anchor[1:] != w.anchor[:-1]) | (w.doc[1:] != w.doc[:-1])
                a, d = w.anchor[turn], w.doc[turn]
                order = np.lexsort((a, d))
                a, d = a[order], d[order]
                keep = np.ones(len(a), dtype=bool)
                keep[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(ids[lo + d[keep]])], schema=schema)

    return run, "anchor long, doc_id long"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a list column whose nulls are empty lists."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), values


def _candidates(window: int, anchor: int):
    """Documents with their shared anchors to (hash, doc_id) of the windows on those, each once per document."""
    schema = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            cuts, shared = _lists(batch.column(2))
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                if cuts[hi] == cuts[lo]:
                    continue
                w = _Windows(data, offsets, window, anchor)
                hashes, owners = [], []
                for d in range(hi - lo):
                    mine = shared[cuts[lo + d] : cuts[lo + d + 1]]
                    if len(mine):
                        part = slice(w.bounds[d], w.bounds[d + 1])
                        h = np.unique(w.hash[part][np.isin(w.anchor[part], mine)])
                        hashes.append(h)
                        owners.append(np.full(len(h), ids[lo + d], dtype=np.int64))
                if hashes:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(hashes)), pa.array(np.concatenate(owners))], schema=schema
                    )

    return run, "hash long, doc_id long"


def _removal(window: int, anchor: int):
    """Documents with shared anchors and own windows to removal intervals and the kept text."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("n_removed", pa.int64()),
            ("removed", pa.list_(span)),
            ("kept_text", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared_cuts, shared = _lists(batch.column(2))
            own_cuts, own = _lists(batch.column(3))
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                w = _Windows(data, offsets, window, anchor)
                n = len(w.words.start)
                edge = np.zeros(n + 1, dtype=np.int64)
                for d in range(hi - lo):
                    mine = shared[shared_cuts[lo + d] : shared_cuts[lo + d + 1]]
                    if len(mine):
                        part = slice(w.bounds[d], w.bounds[d + 1])
                        gone = np.isin(w.anchor[part], mine)
                        gone &= ~np.isin(w.hash[part], own[own_cuts[lo + d] : own_cuts[lo + d + 1]])
                        at = w.at[part][gone]
                        edge[at] += 1
                        edge[at + window] -= 1
                covered = np.cumsum(edge[:n]) > 0
                first = w.words.first
                yield _kept(batch.column(0).slice(lo, hi - lo), data, offsets, w.words, covered, first, schema)

    return run, (
        "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"
    )


def _kept(ids, data, offsets, words, covered, first, schema) -> pa.RecordBatch:
    n_docs = len(offsets) - 1
    before = np.concatenate([[0], np.cumsum(covered)])
    n_removed = before[first[1:]] - before[first[:-1]]
    # maximal intervals of covered words, in words of their document
    turn = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    turn_first = np.zeros(len(covered) + 1, dtype=bool)
    turn_first[first[:-1]] = True
    joined = covered & np.concatenate([[False], covered[:-1]]) if len(covered) else covered
    split = joined & turn_first[: len(covered)]  # covered on both sides of a document's start
    starts = np.flatnonzero((turn[:-1] == 1) | split)
    ends = np.flatnonzero((turn[1:] == -1) | np.concatenate([split[1:], [False]])) + 1 if len(covered) else starts
    base = first[:-1][words.doc[starts]] if len(starts) else starts
    spans = pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], names=["start", "end"])
    removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, first).astype(np.int32)), spans)
    # kept words and the byte after each but the document's last
    keep = np.flatnonzero(~covered)
    doc = words.doc[keep]
    last = np.ones(len(keep), dtype=bool)
    last[:-1] = doc[1:] != doc[:-1]
    edge = np.zeros(len(data) + 2, dtype=np.int8)
    edge[words.start[keep]] += 1
    inner = keep[~last]
    stop = words.end[keep] + ~last
    edge[stop] -= 1
    taken = np.cumsum(edge[: len(data)], dtype=np.int8) > 0
    out = data.copy()
    out[words.end[inner]] = 0x20
    cuts = np.concatenate([[0], np.cumsum(taken)])[offsets].astype(np.int32)
    text = pa.StringArray.from_buffers(n_docs, pa.py_buffer(cuts.tobytes()), pa.py_buffer(out[taken].tobytes()))
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), pa.array(np.diff(first)), pa.array(n_removed), removed, text], schema=schema
    )


def substring_dedup(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, removed (word intervals), kept_text.

    A word goes if some window of ``window`` consecutive words that covers it
    also starts in a document of smaller id.  Windows are hashed by Rabin-Karp
    and owned by the smallest id that holds them; a window not owned is removed,
    and removed windows merge into maximal intervals.

    Most windows occur once, and to move them all would cost several times the
    input.  So windows are first represented by their anchor, the smallest hash
    of the short grams inside: equal windows have equal anchors, about one word
    in twenty starts a new one, and only windows whose anchor occurs in two
    documents are counted.  No group is ever gathered: counting is a combining
    aggregate, and a document is told only what concerns its own windows.

    Null text has no words; a text shorter than a window is kept whole; a row
    with a null id is kept whole and removes nothing; rows that repeat an id are
    one document; an empty table gives no rows; other columns are ignored.
    Hashes have 64 bits: N windows meet a false match with a chance of N*N/2**65.
    """
    rows = id_and_text(docs, id_col, text_col)
    known = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    run, schema = _anchors(window, anchor)
    anchors = materialise(known.mapInArrow(run, schema), "anchors")
    # written, so that the join's sides come by shuffles of their own and a hot anchor can be split
    shared = materialise(
        anchors.groupBy("anchor")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        .filter("lo < hi")
        .select("anchor"),
        "shared_anchors",
    )
    by_doc = anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared"))
    run, schema = _candidates(window, anchor)
    owners = known.join(by_doc, "doc_id").select("doc_id", "text", "shared").mapInArrow(run, schema)
    own = (
        owners.groupBy("hash")
        .agg(F.min("doc_id").alias("doc_id"))
        .groupBy("doc_id")
        .agg(F.collect_list("hash").alias("own"))
    )
    run, schema = _removal(window, anchor)
    judged = known.join(by_doc, "doc_id", "left").join(own, "doc_id", "left").select("doc_id", "text", "shared", "own")
    none = F.lit(None).cast("array<long>")
    whole = rows.filter("doc_id IS NULL OR text IS NULL").select("doc_id", "text", none.alias("shared"), none.alias("own"))
    return judged.mapInArrow(run, schema).unionByName(whole.mapInArrow(run, schema))


def digest(result: DataFrame) -> DataFrame:
    """The result with the kept text's digest in place of the texts."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def oracle_sql(window: int = WINDOW) -> str:
    return f"""
    WITH d AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                   lambda x: x <> '') AS words FROM documents
    ), w AS (
        SELECT doc_id, i, array_to_string(words[i:i + {window - 1}], ' ') AS win
        FROM d, LATERAL (SELECT unnest(range(1, len(words) - {window} + 2)) AS i)
    ), gone AS (
        SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS f FROM w) WHERE f < doc_id
    ), words AS (
        SELECT doc_id, i, words[i] AS word FROM d, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i)
    ), last AS (
        SELECT w.doc_id, w.i, word, g.i AS mark,
               max(g.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS latest
        FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i
    ), judged AS (SELECT doc_id, i, word, coalesce(i - latest < {window}, false) AS removed FROM last)
    SELECT d.doc_id, len(any_value(d.words)) AS n_words, count(*) FILTER (WHERE removed) AS n_removed,
           sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT removed), '')) AS kept_sha256
    FROM d LEFT JOIN judged j ON j.doc_id = d.doc_id GROUP BY d.doc_id
    """
