"""Cost-balanced packing of tokenised documents into training sequences."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQUENCE = 1024
SHARD_TOKENS = 1 << 21
END_ID = 0
LINEAR, QUADRATIC = 1.0, 1.0 / 512

#: Characters on which the two libraries' pre-tokenisers surely agree: ASCII, Latin letters, common punctuation.
_ODD = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ſ‐-‧€]|<\\|")

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """Text to ids of the byte-level BPE file at ``path``, kept for the worker's life.

    The ids are those of ``tokenizers``.  Beside ``x.json`` lies ``x.tiktoken``,
    the same vocabulary as ranks: texts of plain characters take that faster
    implementation, all others (and all, if the file is missing) ``tokenizers``.
    """
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        exact: list = []  # loaded when first needed

        def slow(text: str) -> list[int]:
            if not exact:
                from tokenizers import Tokenizer

                exact.append(Tokenizer.from_file(path))
            return exact[0].encode(text, add_special_tokens=False).ids

        encode = slow
        ranks = re.sub(r"\.json$", ".tiktoken", path)
        if ranks != path and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            ).encode_ordinary

            def encode(text: str) -> list[int]:
                return slow(text) if _ODD.search(text) else fast(text)

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def cost(n: np.ndarray) -> np.ndarray:
    """Estimated cost of a piece: linear layers, plus attention within the piece."""
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, ...]:
    """Pieces (document, start, length, sequence, offset) that pack ``lengths`` without padding.

    A document's full windows of ``capacity`` become sequences of their own.
    The rests share as many full sequences as their sum fills, and a last few
    whose sizes are the powers of two of what is over, so none needs padding.
    Rests go by descending cost to the lowest-cost sequence with room for the
    whole rest; those that found none are cut along the remaining room, largest
    room first.
    """
    full = lengths // capacity
    n_full = int(full.sum())
    which = np.repeat(np.arange(len(lengths)), full)
    number = np.arange(n_full) - np.repeat(np.cumsum(full) - full, full)
    parts = [
        np.stack([which, number * capacity, np.full(n_full, capacity), np.arange(n_full), np.zeros(n_full, np.int64)])
    ]
    rest = lengths - full * capacity
    total = int(rest.sum())
    tail = total % capacity
    sizes = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if tail >> b & 1]
    size = np.array(sizes, dtype=np.int64)
    room, load = size.copy(), np.zeros(len(size))
    pieces: list[tuple[int, int, int, int, int]] = []
    over: list[int] = []
    order = np.argsort(-rest, kind="stable")
    costs = cost(rest.astype(float))
    for doc in order[: int((rest > 0).sum())].tolist():
        n = int(rest[doc])
        best = int(np.argmin(np.where(room >= n, load, np.inf)))
        if room[best] < n:
            over.append(doc)
            continue
        pieces.append((doc, int(full[doc]) * capacity, n, n_full + best, int(size[best] - room[best])))
        room[best] -= n
        load[best] += costs[doc]
    gaps = [int(i) for i in np.argsort(room, kind="stable") if room[i]]
    for doc in over:
        start, left = int(full[doc]) * capacity, int(rest[doc])
        while left:
            at = gaps[-1]
            n = min(left, int(room[at]))
            pieces.append((doc, start, n, n_full + at, int(size[at] - room[at])))
            room[at] -= n
            start, left = start + n, left - n
            if not room[at]:
                gaps.pop()
    parts.append(np.array(pieces, dtype=np.int64).reshape(-1, 5).T)
    return tuple(np.concatenate(parts, axis=1))


def _packer(path: str, capacity: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path)
        task = TaskContext.get()
        next_id = (task.partitionId() if task else 0) << 40
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_id
            doc, start, length, sequence, offset = assign(np.array([len(x) for x in ids], dtype=np.int64), capacity)
            body = [ids[d][s : s + n].tobytes() for d, s, n in zip(doc, start, length, strict=True)]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([docs[d] for d in doc], pa.int64()),
                    pa.array(start),
                    pa.array(length),
                    pa.array(body, pa.binary()),
                    pa.array([len(ids[d]) for d in doc], pa.int64()),
                    pa.array(sequence + next_id),
                    pa.array(offset),
                ],
                schema=_ARROW,
            )
            next_id += int(sequence.max()) + 1
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = encode(text or "")
                tokens.append(END_ID)
                docs.append(doc)
                ids.append(np.array(tokens, dtype="<u4"))
                held += len(tokens)
                if held >= shard_tokens:
                    yield flush()
                    ids, docs, held = [], [], 0
        if ids:
            yield flush()

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = SEQUENCE,
    shard_tokens: int = SHARD_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document: where it stands, and its ids (little-endian unsigned 32-bit).

    Documents are tokenised and packed where they are read, in shards of about
    ``shard_tokens`` tokens: one pass, no shuffle, bounded memory, and every
    sequence comes from one task, so a retried task replaces whole sequences.
    Sequence ids are unique (task number, then a counter) but not consecutive.

    Null text counts as empty (one piece, the end id); null and repeated ids
    are carried as they are; a text of any length is cut at will; an empty
    table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_packer(tokenizer, capacity, shard_tokens), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
