"""Language-model scores of whole texts, by context-tree weighting and by word counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import materialise
from annalist.llm.context_tree import DEPTH, SPLIT, Group, Table, Top, grams
from annalist.llm.textnum import LOWER, SPACE_SEP, Words, mix64, text_chunks

U = np.uint64
END = np.int64(-6148914691236517206)  # stands for the end among the word hashes
TABLE_ENTRIES = 8_000_000  # of the model sent to the executors at a time (200 MB as a table)
HOT_WORDS = 200_000
HOLD = 2_000_000  # counts a task holds before it merges them
CHUNK = 1 << 20  # bytes of text at a time: a gram takes some 60 bytes on the way
WEIGHED_AT_ONCE = 1 << 16  # grams, and the rest of the last one's group


def held_out(doc_id, folds: int = 10):
    return F.crc32(doc_id.cast("string")) % folds == 0


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    keys.clear(), counts.clear()
    order = np.argsort(key)
    key = key[order]
    count = count[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _count(depth: int):
    """Documents to partial counts (kind, key, count): 0, gram, occurrences in training texts (0 if none there);
    1, word hash, occurrences in training texts."""
    schema = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        totals: tuple[list, list] = ([], [])
        size = [0, 0]

        def shrink(kind: int) -> None:
            if held[kind]:
                key, count = _merge(held[kind], totals[kind])
                held[kind].append(key)
                totals[kind].append(count)
                size[kind] = len(key)

        def emit(kind: int) -> Iterator[pa.RecordBatch]:
            shrink(kind)
            if held[kind]:
                key, count = held[kind][0], totals[kind][0]
                for lo in range(0, len(key), 1 << 18):
                    part = slice(lo, lo + (1 << 18))
                    n = len(key[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, kind, np.int8)), pa.array(key[part].view(np.int64)), pa.array(count[part])],
                        schema=schema,
                    )
            held[kind].clear()
            totals[kind].clear()
            size[kind] = 0

        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, offsets in text_chunks(batch.column(0), CHUNK):
                gram, cuts = grams(data, offsets, depth)
                mine = np.repeat(learn[lo:hi], np.diff(cuts))
                for part, weight in ((gram[mine], 1), (gram[~mine], 0)):
                    key, n = np.unique(part, return_counts=True)
                    held[0].append(key)
                    totals[0].append(n * weight)
                    size[0] += len(key)
                words = Words(LOWER[data], offsets, SPACE_SEP)
                h = words.hashes()[learn[lo:hi][words.doc]]
                ends = np.full(1, END, np.int64).view(np.uint64)
                key, n = np.unique(h, return_counts=True)
                held[1].append(np.concatenate([key, ends]))
                totals[1].append(np.concatenate([n, [int(learn[lo:hi].sum())]]))
                size[1] += len(key)
                for kind in (0, 1):
                    if size[kind] > HOLD:
                        shrink(kind)
                        if size[kind] > HOLD // 2:  # mostly distinct: let the shuffle combine them
                            yield from emit(kind)
        for kind in (0, 1):
            yield from emit(kind)

    return run, "kind byte, key long, count long"


def _suffix(key, split: int):
    return F.shiftright(key, 8).bitwiseAND((1 << 8 * split) - 1)


def _weigh(depth: int, split: int):
    schema = pa.schema(
        [
            ("gram", pa.int64()),
            ("p", pa.binary()),
            ("node", pa.int64()),
            ("zeros", pa.float64()),
            ("ones", pa.float64()),
            ("log_w", pa.float64()),
        ]
    )

    def weigh(gram: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        g = Group(gram, count, depth, split)
        n, m = len(gram), len(g.top_node)
        body = np.ascontiguousarray(g.p.astype("<f4")).view("V32").reshape(-1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(gram.view(np.int64)),
                pa.array(body.tolist(), pa.binary()),
                pa.nulls(n, pa.int64()),
                *(pa.nulls(n, pa.float64()) for _ in range(3)),
            ],
            schema=schema,
        )
        top = [pa.array(g.top_node.view(np.int64)), pa.array(g.top_zeros), pa.array(g.top_ones), pa.array(g.top_log)]
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), *top], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their contexts' last bytes; whole groups of those are weighed, many small ones at once."""
        grams, counts, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            grams.append(batch.column(0).to_numpy().view(np.uint64))
            counts.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held < WEIGHED_AT_ONCE:
                continue
            gram, count = np.concatenate(grams), np.concatenate(counts)
            suffix = (gram >> U(8)) & U((1 << 8 * split) - 1)
            cut = int(np.flatnonzero(suffix != suffix[-1])[-1]) + 1 if (suffix != suffix[-1]).any() else 0
            if cut:
                yield from weigh(gram[:cut], count[:cut])
            grams, counts, held = [gram[cut:]], [count[cut:]], len(gram) - cut
        if held:
            yield from weigh(np.concatenate(grams), np.concatenate(counts))

    return run, "gram long, p binary, node long, zeros double, ones double, log_w double"


def _finish(top):
    """``top``: a broadcast Top."""
    schema = pa.schema([("gram", pa.int64()), ("log10_p", pa.float32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gram = batch.column(0).to_numpy().view(np.uint64)
                p = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<f4").reshape(-1, 8)
                value = top.value.finish(gram, p).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], schema=schema)

    return run, "gram long, log10_p float"


def _shard(suffix: np.ndarray, shards: int) -> np.ndarray:
    return mix64(suffix) % U(shards)


def _score(table, hot, depth: int, shard: int, shards: int, last: bool):
    """Adds to ``score`` what the table's shard says; the last shard also counts words."""
    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string()), ("score", pa.float64())]
    if last:
        del fields[2]
        fields += [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("row", pa.int64())]
        fields += [("n_bytes", pa.int64()), ("rare", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 40
        model = table.value
        hot_key, hot_count = hot.value
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(2), CHUNK):
                gram, cuts = grams(data, offsets, depth)
                value = model.get(gram).astype(float)
                if shards > 1:
                    value[_shard(gram >> U(8) & U(0xFFFF), shards) != U(shard)] = 0
                total = np.concatenate([[0.0], np.cumsum(value)])
                part = batch.slice(lo, hi - lo)
                score = part.column(3).to_numpy(zero_copy_only=False) + np.diff(total[cuts])
                out = [part.column(0), part.column(1)]
                if not last:
                    yield pa.RecordBatch.from_arrays([*out, part.column(2), pa.array(score)], schema=schema)
                    continue
                n = hi - lo
                words = Words(LOWER[data], offsets, SPACE_SEP)
                key, inverse = np.unique(words.hashes().view(np.int64), return_inverse=True)
                at = np.minimum(np.searchsorted(hot_key, key), len(hot_key) - 1)
                known = hot_key[at] == key
                log = np.where(known, np.log10(hot_count[at] + 0.1), 0.0)
                end_at = int(np.searchsorted(hot_key, END))
                ends = hot_count[end_at]
                n_known = np.bincount(words.doc, weights=known[inverse], minlength=n).astype(np.int64) + int(ends > 0)
                logs = np.bincount(words.doc, weights=log[inverse], minlength=n) + math.log10(ends + 0.1)
                rare = ~known[inverse]
                rare_cuts = np.concatenate([[0], np.cumsum(rare)])[words.first].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *out,
                        pa.array(score),
                        pa.array(np.diff(words.first) + 1),
                        pa.array(n_known),
                        pa.array(logs),
                        pa.array(np.arange(row, row + n)),
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(rare_cuts), pa.array(key[inverse[rare]])),
                    ],
                    schema=schema,
                )
                row += n

    kinds = "doc_id long, held_out boolean, score double"
    if last:
        return run, f"{kinds}, n_tokens long, n_known long, logs double, row long, n_bytes long, rare array<long>"
    return run, "doc_id long, held_out boolean, text string, score double"


def lm_score(
    docs: DataFrame,
    depth: int = DEPTH,
    table_entries: int = TABLE_ENTRIES,
    hot_words: int = HOT_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the documents whose crc32(doc_id as text) mod 10 is not 0, over
    texts with A-Z lower-cased.  ``score`` is the context trees' log10
    probability of the text's bytes and its end; ``bits_per_byte`` the same as a
    code length, by the text's bytes (an empty text counts as one byte).  ``base_score`` is the sum over words and the end of
    log10((c + 0.1) / (N + 0.1 * (V + 1))).

    Counting: every gram of context and byte in any text, with its training
    count, and every training word; combined in each task, then by shuffle.
    The trees are weighed in groups of one three-byte context, and the decisions
    above those on the driver: as many as there are different (two-byte context,
    start of a byte), some 50 thousand for prose of one alphabet and 16.8 million
    if every pair of bytes is followed by every other.  That gives the log
    probability of every gram that occurs anywhere.  These go to the executors as a table of
    at most ``table_entries``; a larger model is cut into shards by two-byte
    context, each scored over all texts in turn.  Word counts: the most frequent,
    ``hot_words`` at most, likewise; every other word is joined.

    Null text counts as empty and scores its end alone; a row with a null id is
    scored and learned from, with a null held_out; rows that repeat an id are
    scored each for itself; an empty table gives no rows; without training rows
    every estimate is that of no counts; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    run, schema = _count(depth)
    counts = materialise(
        rows.select("text", (~F.coalesce("held_out", F.lit(False))).alias("learn"))
        .mapInArrow(run, schema)
        .groupBy("kind", "key")
        .agg(F.sum("count").alias("count")),
        "lm_counts",
    )
    gram_counts = counts.filter("kind = 0")
    words = counts.filter("kind = 1 AND count > 0").select("key", "count")

    split = min(SPLIT, depth)
    run, schema = _weigh(depth, split)
    weighed = materialise(
        gram_counts.select("key", "count", _suffix(F.col("key"), split).alias("suffix"))
        .repartition("suffix")
        .sortWithinPartitions("suffix")
        .select("key", "count")
        .mapInArrow(run, schema),
        "lm_nodes",
    )
    tops = (
        weighed.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_w").alias("log_w"))
        .toArrow()
    )
    top = Top(
        tops.column("node").to_numpy().view(np.uint64),
        *(tops.column(c).to_numpy() for c in ("zeros", "ones", "log_w")),
        split,
    )
    run, schema = _finish(spark.sparkContext.broadcast(top))
    model = materialise(weighed.filter("gram IS NOT NULL").select("gram", "p").mapInArrow(run, schema), "lm_model")
    entries = model.count()
    shards = max(1, math.ceil(1.2 * entries / table_entries)) if entries > table_entries else 1

    hot = spark.sparkContext.broadcast(_hot_words(words, hot_words))
    scored = rows.withColumn("score", F.lit(0.0))
    for shard in range(shards):
        part = model.toArrow() if shards == 1 else _of_shard(model, shard, shards).toArrow()
        table = Table(part.column(0).to_numpy().view(np.uint64), part.column(1).to_numpy())
        last = shard == shards - 1
        run, schema = _score(spark.sparkContext.broadcast(table), hot, depth, shard, shards, last)
        scored = materialise(scored.mapInArrow(run, schema), "lm_scored")
        del part, table

    n, v = words.agg(F.sum("count"), F.count("key")).head()
    n, v = int(n or 0), int(v)
    rare = (
        scored.select("row", F.explode("rare").alias("key"))
        .groupBy("row", "key")
        .agg(F.count(F.lit(1)).alias("tf"))
        .join(words, "key", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("count") > 0, F.col("tf")).otherwise(F.lit(0))).alias("more_known"),
            F.sum(F.col("tf") * F.log10(F.coalesce("count", F.lit(0)) + F.lit(0.1))).alias("more_logs"),
        )
    )
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (
            F.col("logs")
            + F.coalesce("more_logs", F.lit(0.0))
            - F.col("n_tokens") * F.lit(math.log10(n + 0.1 * (v + 1)))
        ).alias("base_score"),
        "score",
        (F.col("score") * (-math.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def _of_shard(model: DataFrame, shard: int, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column(0).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(_shard(gram >> U(8) & U(0xFFFF), shards) == U(shard)))

    return model.mapInArrow(run, "gram long, log10_p float")


def _hot_words(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of the words at least as frequent as the lowest power of two that ``most`` allow; and the end."""
    by_size = {
        r["size"]: r["n"]
        for r in words.groupBy(F.floor(F.log2("count")).cast("int").alias("size")).agg(F.count("key").alias("n")).collect()
    }
    total, least = 0, None
    for size in sorted(by_size, reverse=True):
        total += by_size[size]
        if total > most:
            break
        least = size
    end = words.filter(F.col("key") == int(END))
    kept = end if least is None else words.filter(F.col("count") >= float(2**least)).unionByName(end)
    found = kept.distinct().toArrow()
    key = np.append(found.column(0).to_numpy(), END)
    count = np.append(found.column(1).to_numpy(), 0)
    key, first = np.unique(key, return_index=True)
    return key, count[first].astype(float)
