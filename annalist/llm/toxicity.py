"""Toxicity scores of whole texts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm import gru
from annalist.llm.common import BROADCAST_ROWS, give_back, keep_rows, materialise
from annalist.llm.gru import DIM, Bag, Block, Model, Tokens
from annalist.llm.textnum import text_chunks

BLOCK_BYTES = 24 << 20  # of training texts that one task learns from at a time
PIECE_BYTES = 4 << 10  # of a cell: Spark's readers hold 4,096 rows at once
ROW_GROUP_BYTES = 1 << 30  # more than a block's pieces take, so that one task reads them all
CHANGE_ROWS = 20_000  # of an Arrow batch of changes
ONE = 1 << 24  # changes of weights are summed as integers of this fraction, in any order the same


def held_out(doc_id, folds: int = 5):
    return F.crc32(doc_id.cast("string")) % folds == 0


BAGS = {"number": pa.int64(), "pieces": pa.int64(), "piece": pa.binary(), "n": pa.int64(), "ones": pa.int64()}


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's (doc_id, toxic, text) as one pickled Bag, cut into pieces; its counts stand with the first."""
    numbers = lambda column: column.to_numpy(zero_copy_only=False)
    bag = Bag((numbers(b.column(0)), numbers(b.column(1)), b.column(2)) for b in batches)
    if not len(bag.doc):
        return
    with_words = bag.y[np.unique(bag.doc)]
    whole = memoryview(pickle.dumps(bag))
    del bag
    pieces = -(-len(whole) // PIECE_BYTES)
    for lo in range(0, pieces, 1000):
        number = np.arange(lo, min(lo + 1000, pieces))
        cells = [whole[i * PIECE_BYTES : (i + 1) * PIECE_BYTES] for i in number.tolist()]
        first = (number == 0).astype(np.int64)
        columns = [number, np.full(len(number), pieces), cells, first * len(with_words), first * int(with_words.sum())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, BAGS.values(), strict=True)], list(BAGS))
    del whole, cells, columns
    give_back()


def _each_bag(batches: Iterator[pa.RecordBatch]) -> Iterator[Bag]:
    """Bags of (number, pieces, piece), whose rows follow each other."""
    whole, expected = bytearray(), 0
    for batch in batches:
        for number, pieces, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if number != expected:
                raise ValueError(f"piece {number} of a block where {expected} was due")
            whole += cell.as_buffer()
            expected = (number + 1) % pieces
            if not expected:
                yield _loaded(whole)
                give_back()
    if expected:
        raise ValueError(f"a block ends before piece {expected}")


def _loaded(whole: bytearray) -> Bag:
    bag = pickle.loads(whole)
    whole.clear()
    return bag


def _rows_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bag in _each_bag(batches):
        rows, held = bag.documents_of()
        del bag
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(held, pa.int64())], ["place", "n"])


CHANGE = [f"d{i}" for i in range(DIM)]


def _learned(model, epochs: range, batch_size: int):
    """What each bag changes in ``model``, a broadcast Model, weighted by its documents."""
    schema = pa.schema([("place", pa.int64()), ("n", pa.int64()), *((d, pa.int64()) for d in CHANGE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bag in _each_bag(batches):
            block = Block(model.value, bag)
            gru.learn(block.model, bag, epochs, batch_size)
            place, change = block.changes()
            n = len(np.unique(bag.doc))
            del bag, block
            for lo in range(0, len(place), CHANGE_ROWS):
                part = slice(lo, lo + CHANGE_ROWS)
                whole = np.rint(change[part].astype(np.float64) * ONE).astype(np.int64) * n
                columns = [place[part], np.full(len(whole), n), *whole.T]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run, ", ".join(f"{f.name} long" for f in schema)


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) outside the held-out fold."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return known.agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))


def fit(docs: DataFrame, known: DataFrame, block_bytes: int = BLOCK_BYTES) -> Model | None:
    """A model from all windows of all texts that ``known`` (doc_id, toxic) labels; None without words of both classes.

    The texts are dealt by a hash of their ids into blocks of about
    ``block_bytes``, the same wherever the rows lie, and kept as windows of word
    numbers, in rows of ``PIECE_BYTES``, so that the JVM never holds a block.  In
    each round a task learns from a block, beginning with the same weights; the
    changes are averaged over the blocks that touched a weight, by their
    documents.  Of an id with several texts, the one with the smallest hash
    counts.  The driver gets the averaged weights alone, which the tables' sizes
    bound.
    """
    spark = docs.sparkSession
    small = known.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") > 0)
    texts = texts.join(F.broadcast(known) if small else known, "doc_id").select("doc_id", "toxic", "text")
    sizes = texts.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n"))
    size = sizes.agg(F.sum("bytes").alias("bytes"), F.max("n").alias("most")).first()
    if not size["bytes"]:
        return None
    if size["most"] > 1:
        texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    blocks = -(-size["bytes"] // block_bytes)
    dealt = texts.repartitionById(blocks, F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    cut = dealt.mapInArrow(_bags, "number long, pieces long, piece binary, n long, ones long")
    bags = materialise(cut, "bags", **{"parquet.block.size": str(ROW_GROUP_BYTES), "maxRecordsPerFile": "0"})
    found = bags.agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.count_if(F.col("number") == 0).alias("blocks")).first()
    if not found["ones"] or found["ones"] == found["n"]:
        return None
    bags = bags.select("number", "pieces", "piece")
    held = bags.mapInArrow(_rows_held, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    vocabulary = held.filter("n >= 2").select(F.col("place").cast("int").alias("place")).toArrow()["place"].to_numpy()
    model = gru.start(np.sort(vocabulary).astype(np.int64))
    batch_size, epochs = gru.schedule(-(-found["n"] // found["blocks"]))
    for part in gru.rounds(epochs, found["blocks"]):
        sent = spark.sparkContext.broadcast(model)
        run, schema = _learned(sent, part, batch_size)
        mean = [(F.sum(d) / F.sum("n") / ONE).cast("float").alias(d) for d in CHANGE]
        change = bags.mapInArrow(run, schema).groupBy(F.col("place").cast("int").alias("place")).agg(*mean).toArrow()
        model = gru.changed(model, change["place"].to_numpy(), np.column_stack([change[d].to_numpy() for d in CHANGE]))
        sent.destroy()
    return model


def threshold(logits: DataFrame) -> float:
    """The threshold of the fewest errors over all rows of ``logits`` (logit, toxic); of several the one in the widest gap.

    Exact: logits are sorted into ranges, whose totals (one row a range) shift the running sums inside.
    """
    one = F.sum("toxic").alias("ones")
    values = logits.groupBy("logit").agg(one, (F.count(F.lit(1)) - F.sum("toxic")).alias("zeros"))
    values = materialise(values.repartitionByRange("logit").withColumn("part", F.spark_partition_id()), "logits_by_range")
    parts = values.groupBy("part").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.max("logit").alias("last"))
    totals, below, above, last, shifts = parts.orderBy("part").collect(), 0, 0, None, []
    above = sum(t["zeros"] for t in totals)
    for t in totals:
        shifts.append((t["part"], below, above, last))
        below, above, last = below + t["ones"], above - t["zeros"], t["last"]
    kinds = pa.schema([("part", pa.int32()), ("below", pa.int64()), ("above", pa.int64()), ("last", pa.float64())])
    columns = [pa.array(c, t) for c, t in zip(zip(*shifts, strict=True), kinds.types, strict=True)]
    shift = logits.sparkSession.createDataFrame(pa.Table.from_arrays(columns, schema=kinds))  # from Arrow: no Python on the executors
    order = Window.partitionBy("part").orderBy("logit")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    missed = F.col("below") + F.coalesce(F.sum("ones").over(before), F.lit(0))
    alarms = F.col("above") - F.coalesce(F.sum("zeros").over(before), F.lit(0))
    lower = F.coalesce(F.lag("logit").over(order), "last", F.col("logit") - 1)
    cuts = values.join(F.broadcast(shift), "part").select((missed + alarms).alias("errors"), lower.alias("lower"), "logit")
    best = cuts.agg(F.min(F.struct("errors", (F.col("lower") - F.col("logit")).alias("gap"), "logit", "lower")).alias("b")).first()["b"]
    if below < best["errors"]:  # all are judged 0
        return last + 0.5
    return (best["lower"] + best["logit"]) / 2


def _score(model):
    """``model``: a broadcast Model or None."""
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("logit", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Model | None = model.value
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                logit = np.full(hi - lo, -np.inf) if net is None else net.document_logits(Tokens(data, offsets))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(logit)], schema=schema)
        give_back()

    return run, "doc_id long, version long, logit double"


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic (0 or 1; the larger
    where an id repeats; null labels are not used).  The score is that of the
    most suspicious of all overlapping windows of 32 words, one every 16 words,
    over the whole text.  Only the text enters it.  Words, weights and threshold
    are learned from all labelled texts outside the held-out fold.

    Null and empty texts, and texts without a word, score 0; so do all where no
    model can be learned (no labels of one class).  Rows with a null id are
    scored, with a null held_out; rows that repeat an id are scored each for
    itself; an empty table gives no rows; other columns are ignored.
    """
    return judged(docs, labels).drop("version")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of ``toxicity``, with ``version``, a hash of each row's text.

    Logits are written first: the threshold is that of the fewest errors over those of all training texts.
    """
    known = materialise(labelled(labels), "labelled")
    model = fit(docs, known)
    run, schema = _score(docs.sparkSession.sparkContext.broadcast(model))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    rows = materialise(rows.mapInArrow(run, schema), "logits")
    cut = 0.0
    if model is not None:
        some = rows.filter(F.col("logit") > float("-inf")).join(known, "doc_id").groupBy("doc_id", "toxic")
        cut = threshold(some.agg(F.min_by("logit", "version").alias("logit")))
    score = F.when(F.col("logit") > float("-inf"), 1 / (1 + F.exp(F.least(F.greatest(F.lit(cut) - F.col("logit"), F.lit(-60.0)), F.lit(60.0)))))
    return rows.select(
        "doc_id",
        "version",
        held_out(F.col("doc_id")).alias("held_out"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored 0.5 or more, each by its own text; columns unchanged."""
    rows = judged(docs, labels).select("doc_id", "version", (F.col("predicted") == 0).alias("kept"))
    return keep_rows(docs, rows, F.xxhash64("text"), once=False)
