"""Nearest neighbours over randomly rotated one-bit codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import materialise

QUERY_BLOCK = 8192  # queries sent to the executors at a time
CHUNK = 2048
QUERY_CHUNK = 512
CODE_BITS = 256  # at least; a vector of fewer dimensions is padded, which makes its estimates as much finer
BOUND = 4.0  # of the error, in its standard deviations: a neighbour is passed over with a chance below 1e-4


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """Random orthonormal columns: what a rotation of the padded space does to the ``dim`` dimensions in use."""
    bits = max(dim, CODE_BITS)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, center: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated residual, the residual's length, and <code, direction> (the correction).

    Residuals are brought to components of at most 1 before they are squared or turned.
    """
    with np.errstate(all="ignore"):  # what leaves the range of doubles here gets a length that is no number
        return _encode(vectors - center, rotate)


def _encode(residual: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    largest = np.maximum(np.abs(residual).max(axis=1, initial=0), np.finfo(float).tiny)
    unit = residual / largest[:, None]
    length = np.sqrt((unit * unit).sum(axis=1))
    turned = unit @ rotate.T
    bits = turned > 0
    aligned = np.abs(turned).sum(axis=1) / math.sqrt(rotate.shape[0])
    correction = np.where(length > 0, aligned / np.where(length > 0, length, 1), 1.0)
    return np.packbits(bits, axis=1), length * largest, correction


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    v = F.col("embedding")
    ok = (
        F.col("vec_id").isNotNull()
        & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    return vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")
    ).filter(ok)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _indexer(center: np.ndarray, scale: float, seed: int):
    schema = pa.schema(
        [
            ("vec_id", pa.int64()),
            ("embedding", pa.list_(pa.float64())),
            ("code", pa.binary()),
            ("length", pa.float64()),
            ("correction", pa.float64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotate = rotation(len(center), seed)
        for batch in batches:
            if batch.num_rows:
                code, length, correction = encode(_matrix(batch.column(1), len(center)) * scale, center, rotate)
                body = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), body, pa.array(length), pa.array(correction)], schema=schema
                )

    return run, "vec_id long, embedding array<double>, code binary, length double, correction double"


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 5) -> DataFrame:
    """(vec_id, embedding, code, length, correction) for every vector that takes part.

    Vectors are scaled by a power of two, so that the median of their largest
    components is near 1; the centre is the mean of those within 1,024 times
    that median, so a few huge ones do not move it.  Vectors that are null, zero,
    or hold null or non-finite components take no part, nor do rows with a null
    id and vectors whose dimension is not the most frequent one (ties: the
    larger), which have no distance to the others.
    """
    rows = usable(vectors, id_col, vector_col)
    spark = rows.sparkSession
    dims = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).head(1)
    if not dims:
        empty = "vec_id long, embedding array<double>, code binary, length double, correction double"
        return spark.createDataFrame([], empty)
    dim = dims[0]["dim"]
    rows = rows.filter(F.size("embedding") == dim)
    size = F.array_max(F.transform("embedding", F.abs))
    median = rows.select(F.percentile_approx(size, 0.5)).head()[0]
    scale = 2.0 ** -max(min(math.frexp(median)[1], 1000), -1000)
    near = rows.filter(size * F.lit(scale) <= 1024.0)
    mean = near.select(*[F.avg(F.col("embedding")[i] * F.lit(scale)).alias(f"m{i}") for i in range(dim)]).head()
    center = np.array([float(x) for x in mean])
    run, schema = _indexer(center, scale, seed)
    return materialise(rows.mapInArrow(run, schema), "codes").withMetadata(
        "code", {"center": center.tolist(), "scale": scale, "seed": seed}
    )


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, squares added in the order of the components.

    Where a sum of squares leaves the range of normal doubles it is taken again with the differences scaled.
    """

    def length(step: np.ndarray) -> np.ndarray:
        total = np.zeros(len(step))
        for i in range(step.shape[1]):
            total += step[:, i] * step[:, i]
        return np.sqrt(total)

    with np.errstate(over="ignore", under="ignore"):
        step = a - b
        out = length(step)
        odd = np.flatnonzero(~((out > 1e-145) & (out < np.inf)))
        if len(odd):
            # two vectors at either end of the range differ by more than it holds: halve them, but not to nothing
            tiny = np.abs(step[odd]).max(axis=1, initial=0) < 1e-140
            part = np.where(tiny[:, None], step[odd], a[odd] / 2 - b[odd] / 2)
            largest = np.abs(part).max(axis=1, initial=0)
            scale = np.exp2(np.floor(np.log2(largest, where=largest > 0, out=np.zeros(len(odd)))))
            out[odd] = length(part / scale[:, None]) * scale * np.where(tiny, 1.0, 2.0)
    return out


NO_ID = np.iinfo(np.int64).max


class _Best:
    """The k nearest so far of each query."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.distance = np.full((n, k), np.inf)
        self.vec = np.full((n, k), NO_ID)

    def add(self, query: np.ndarray, vec: np.ndarray, distance: np.ndarray) -> None:
        touched, inverse = np.unique(query, return_inverse=True)
        q = np.concatenate([inverse, np.repeat(np.arange(len(touched)), self.k)])
        d = np.concatenate([distance, self.distance[touched].ravel()])
        v = np.concatenate([vec, self.vec[touched].ravel()])
        order = np.lexsort((v, d, q))
        q, d, v = q[order], d[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.distance[touched[q[keep]], rank[keep]] = d[keep]
        self.vec[touched[q[keep]], rank[keep]] = v[keep]


def _search(query_ids: np.ndarray, queries: np.ndarray, meta: dict, k: int, bound: float):
    center, unit, seed = np.array(meta["center"]), meta["scale"], meta["seed"]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = len(center)
        residual = queries * unit - center
        largest = np.maximum(np.abs(residual).max(axis=1, initial=0), np.finfo(float).tiny)[:, None]
        q_length = np.sqrt(((residual / largest) ** 2).sum(axis=1)) * largest[:, 0]
        rotate = rotation(dim, seed)
        bits = len(rotate)
        turned = (residual / largest @ rotate.T).astype(np.float32)
        best = _Best(len(queries), k)
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                vectors = _matrix(part.column(1), dim)
                code = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
                sign = np.unpackbits(code, axis=1)[:, :bits].astype(np.float32) * 2 - 1
                length = part.column(3).to_numpy(zero_copy_only=False)
                correction = part.column(4).to_numpy(zero_copy_only=False)
                with np.errstate(all="ignore"):  # what leaves the range of doubles has no bound and is reranked
                    factor = length / (correction * math.sqrt(bits))
                    spread = np.sqrt(np.maximum(1 - correction**2, 0)) / correction * length / math.sqrt(max(bits - 1, 1))
                    squares = length**2
                for q0 in range(0, len(queries), QUERY_CHUNK):
                    q1 = min(q0 + QUERY_CHUNK, len(queries))
                    with np.errstate(all="ignore"):
                        inner = (turned[q0:q1] @ sign.T).astype(np.float64) * largest[q0:q1] * factor
                        slack = bound * q_length[q0:q1, None] * spread
                        # lower bound of the squared distance, less what single precision may cost
                        both = squares + q_length[q0:q1, None] ** 2
                        low = both * (1 - 1e-5) - 2 * (inner + slack)
                    low[~np.isfinite(low)] = -np.inf
                    left = ids[None, :] != query_ids[q0:q1, None]
                    low[~left] = np.inf
                    empty = best.vec[q0:q1, -1] == NO_ID
                    if empty.any() and len(ids) > 4 * k:  # no k neighbours yet: take the likeliest first
                        fresh = np.flatnonzero(empty)
                        first = np.argpartition(low[fresh], 2 * k, axis=1)[:, : 2 * k]
                        rows, cols = np.repeat(fresh, 2 * k), first.ravel()
                        real = left[rows, cols]
                        rows, cols = rows[real], cols[real]
                        best.add(q0 + rows, ids[cols], distances(queries[q0 + rows], vectors[cols]))
                        left[rows, cols] = False
                    with np.errstate(all="ignore"):
                        limit = (best.distance[q0:q1, -1] * unit) ** 2
                    limit = np.where(limit > 1e-290, limit * (1 + 1e-9), 1e-290)
                    rows, cols = np.nonzero(left & (low <= limit[:, None]))
                    for at in range(0, len(rows), 1 << 11):
                        r, c = rows[at : at + (1 << 11)], cols[at : at + (1 << 11)]
                        best.add(q0 + r, ids[c], distances(queries[q0 + r], vectors[c]))
        real = best.vec != NO_ID
        which = np.nonzero(real)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[which]), pa.array(best.vec[real]), pa.array(best.distance[real])], schema=schema
        )

    return run, "query_id long, vec_id long, score double"


def search(index: DataFrame, queries: DataFrame, k: int = 10, bound: float = BOUND, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``index`` nearest to each query, its own id excluded.

    ``queries`` are rows of the same index.  From the packed bits comes an
    estimate of each inner product and, with the correction, a bound of its
    error; a vector is reranked by its exact distance unless the lower bound of
    its distance exceeds the distance of the k-th neighbour so far.  Ties go to
    the smaller id.  Queries are sent in blocks of about ``block``, each to all
    rows (so the cost grows with queries times rows); every task keeps k rows a
    query, whatever it reads.  Vectors whose estimate leaves the range of doubles
    are reranked without one; a distance beyond that range is infinite.
    """
    meta = index.schema["code"].metadata
    if not meta:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(meta["center"])
    n = queries.count()
    blocks = max(1, math.ceil(n / block))
    mine = queries.select("vec_id", "embedding").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    found = []
    for b in range(blocks):
        held = mine.filter(F.col("block") == b).select("vec_id", "embedding").toArrow()
        if held.num_rows:
            ids = held.column(0).to_numpy()
            run, schema = _search(ids, _matrix(held.column(1), dim), meta, k, bound)
            part = index.mapInArrow(run, schema)
            found.append(materialise(part, "neighbours") if blocks > 1 else part)
    if not found:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    near = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        reduce(DataFrame.unionByName, found)
        .withColumn("rank", F.row_number().over(near))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def oracle_sql(k: int = 10, every: int = 100) -> str:
    return f"""
    WITH e AS (
        SELECT vec_id, embedding::double[] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
               sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
        FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0
    )
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::int AS rank, vec_id, score
    FROM pairs QUALIFY rank <= {k}
    """
