"""Embeddings through a pluggable function, and their cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import ids
from annalist.functions import vectors as V

DIM = 768
BATCH = 32
CODE_TYPES = ("diff", "code")

Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dim: int = DIM) -> Embedder:
    """Deterministic offline embedder: signed word counts hashed to ``dim`` and scaled to length 1."""
    import re
    import zlib

    word = re.compile(r"\w+")

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in enumerate(texts):
            for w in word.findall(text.lower()):
                h = zlib.crc32(w.encode())
                out[row, h % dim] += 1 if h >> 16 & 1 else -1
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(length > 0, length, 1)).tolist()

    return embed


def embed_texts(rows: DataFrame, embedder: Embedder, text: str = "text", dim: int = DIM, batch: int = BATCH) -> DataFrame:
    """``rows`` plus vector, in batches; a blank text has a zero vector, a text that fails twice a null one."""
    fields = rows.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", vector array<float>"

    def vectors(texts: list[str]) -> list:
        out: list = []
        for lo in range(0, len(texts), batch):
            part = texts[lo : lo + batch]
            try:
                out += embedder(part)
            except Exception:  # a bad text must not cost its batch
                for one in part:
                    try:
                        out += embedder([one])
                    except Exception:
                        out.append(None)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text].fillna("").str.strip()
            got = pd.Series([[0.0] * dim] * len(pdf), index=pdf.index, dtype=object)
            full = texts[texts != ""]
            for i, v in zip(full.index, vectors(full.tolist()), strict=True):
                got[i] = v
            yield pdf[fields].assign(vector=got)

    return rows.mapInPandas(run, schema)


def cached_embeddings(rows: DataFrame, cache: DataFrame, embedder: Embedder, model: str, text: str = "text", dim: int = DIM):
    """(rows plus vector, new cache rows): every distinct text not in the cache is embedded once; failures are not cached."""
    keyed = rows.withColumn("cache_key", ids.cache_key(model, F.coalesce(F.col(text), F.lit(""))))
    misses = cache_misses(keyed, cache)
    fresh = embed_texts(misses.select("cache_key", F.col(text).alias("text")), embedder, "text", dim).select("cache_key", "vector")
    fresh = fresh.filter("vector IS NOT NULL")
    known = cache.select("cache_key", "vector").unionByName(fresh)
    return keyed.join(known, "cache_key", "left"), fresh


def cache_misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])


def dual_vectors(chunks: DataFrame, vector: str = "vector", dim: int = DIM) -> DataFrame:
    """semantic_vector for all chunks, code_vector for code and diffs (zeros for the others)."""
    code = F.when(F.col("doc_type").isin(*CODE_TYPES), F.col(vector))
    return chunks.withColumns({"semantic_vector": F.col(vector), "code_vector": F.coalesce(code, V.zeros(dim))}).drop(vector)


def vector_points(chunks: DataFrame, dim: int = DIM) -> DataFrame:
    """Rows of the vector table: a point id, both vectors (a missing one zero), no row where both are missing."""
    known = chunks.filter("semantic_vector IS NOT NULL OR code_vector IS NOT NULL")
    return known.withColumns(
        {
            "point_id": ids.uuid5(F.col("chunk_id")),
            "semantic_vector": F.coalesce("semantic_vector", V.zeros(dim)),
            "code_vector": F.coalesce("code_vector", V.zeros(dim)),
        }
    ).dropDuplicates(["chunk_id"])


def count_code_vectors(points: DataFrame) -> DataFrame:
    return points.agg(F.count_if(V.is_nonzero(F.col("code_vector"))).alias("n_code"), F.count(F.lit(1)).alias("n"))


