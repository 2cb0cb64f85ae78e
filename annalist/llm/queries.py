"""Queries opN_<name> over the training-data tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from annalist.llm import exact_dedup as _exact
from annalist.llm import license_scan as _license
from annalist.llm import line_dedup as _line
from annalist.llm import lm_score as _lm
from annalist.llm import mixing as _mixing
from annalist.llm import near_dedup as _near
from annalist.llm import nearest as _nearest
from annalist.llm import packing as _packing
from annalist.llm import substring_dedup as _substring
from annalist.llm import toxicity as _toxicity
from annalist.llm.common import documents, tune


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return _near.near_dedup(documents(spark, sf_dir), percent=85)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line.digest(_line.line_dedup(documents(spark, sf_dir)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(documents(spark, sf_dir))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    index = _nearest.build_index(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return _nearest.search(index, index.filter("vec_id % 100 = 0"), k=10)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return _packing.digest(_packing.pack(documents(spark, sf_dir), tokenizer_path()))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return _lm.lm_score(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return _toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return _license.digest(_license.license_scan(documents(spark, sf_dir)))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return _substring.digest(_substring.substring_dedup(documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_mixing": op3_mixing,
        "op4_nearest": op4_nearest,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_packing": op6_packing,
        "op7_lm_score": op7_lm_score,
        "op8_toxicity": op8_toxicity,
        "op9_license_scan": op9_license_scan,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_dedup": _near.oracle_sql(),
        "op2_line_dedup": _line.oracle_sql(),
        "op3_mixing": _mixing.oracle_sql(),
        "op4_nearest": _nearest.oracle_sql(),
        "op5_exact_dedup": _exact.oracle_sql(),
        "op9_license_scan": _license.oracle_sql(),
        "op10_substring_dedup": _substring.oracle_sql(),
    }
