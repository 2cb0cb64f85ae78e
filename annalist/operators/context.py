"""Rerank, token-budgeted context, evidence, prompts and answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import text as X

BUDGET = 3000
SNIPPET = 200
MEMO_SCHEMA = (
    "decision STRING, date STRING, decision_makers ARRAY<STRING>, context STRING, alternatives ARRAY<STRING>, "
    "rationale STRING, consequences ARRAY<STRING>, evidence ARRAY<STRING>"
)

Scorer = Callable[[pd.Series, pd.Series], pd.Series]
Writer = Callable[[pd.Series], pd.Series]

_ASK = {
    "direct": "You answer questions about the history of a software project from the context alone. Give the answer, the chain of evidence, your confidence and any caveats.",
    "memo": "You write a decision memo from the context alone. Return JSON with the keys decision, date, decision_makers, context, alternatives, rationale, consequences, evidence.",
    "blame": "You describe who owned a module and when, from the context alone, as a timeline in order of time.",
    "risk": "You report the risks of a module from the context alone: hotspots, churn, hints of bugs against features, files that change together.",
}


def rerank(candidates: DataFrame, top_k: int = 12, scorer: Scorer | None = None) -> DataFrame:
    """The best ``top_k`` of each question; without a scorer, the first in the order given.

    Candidates have query_id, rank, chunk_id and, for a scorer, query and text.
    The scorer gets Arrow batches of questions and texts; equal scores keep their order.
    """
    if scorer is None:
        return candidates.filter(F.col("rank") < top_k)
    fields = "query_id", "rank", "chunk_id"
    kinds = dict(candidates.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in fields) + ", score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[list(fields)].assign(score=scorer(rows["query"], rows["text"]).to_numpy(dtype=float))

    scored = candidates.select(*fields, "query", "text").mapInPandas(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return scored.withColumn("rank", (F.row_number().over(order) - 1).cast("int")).filter(F.col("rank") < top_k)


def word_overlap(questions: pd.Series, texts: pd.Series) -> pd.Series:
    """Share of a question's distinct words that stand in a text, in any case: a scorer that needs no model."""
    words = re.compile(r"\w+")
    asked = {q: set(words.findall((q or "").lower())) for q in questions.unique()}
    shares = [len(asked[q] & set(words.findall((t or "").lower()))) / max(len(asked[q]), 1) for q, t in zip(questions, texts, strict=True)]
    return pd.Series(shares, index=questions.index, dtype=float)


def block(doc_type: Column, doc_id: Column, timestamp: Column, author: Column, text: Column) -> Column:
    head = [F.concat(F.lit("["), F.coalesce(c.cast("string"), F.lit("")), F.lit("]")) for c in (doc_type, doc_id, timestamp, author)]
    return F.concat(F.concat_ws(" ", *head), F.lit("\n"), text, F.lit("\n"))


def block_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), X.estimate_tokens(text))


def within_budget(rows: DataFrame, budget: int = BUDGET, order_by: str = "rank") -> DataFrame:
    """Rows (query_id, ``order_by``, block) up to the first that does not fit; every block costs a token at least."""
    upto = Window.partitionBy("query_id").orderBy(order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("tokens", block_tokens(F.col("block")))
        .withColumn("used", F.sum("tokens").over(upto))
        .filter(F.col("used") <= budget)
    )


def assemble(rows: DataFrame, budget: int = BUDGET, order_by: str = "rank") -> DataFrame:
    """(query_id, context, n_chunks, used_tokens)"""
    kept = within_budget(rows, budget, order_by)
    blocks = F.transform(F.sort_array(F.collect_list(F.struct(order_by, "block"))), lambda x: x["block"])
    return kept.groupBy("query_id").agg(
        F.array_join(blocks, "\n---\n").alias("context"), F.count(F.lit(1)).alias("n_chunks"), F.max("used").alias("used_tokens")
    )


def evidence(context: Column) -> Column:
    """type:id of the context's header lines, distinct in order."""
    heads = F.filter(F.split(context, "\n"), lambda x: x.startswith("["))
    parts = F.transform(heads, lambda x: F.regexp_extract_all(x, F.lit(r"\[([^\]]++)[\]]"), 1))
    full = F.filter(parts, lambda p: F.size(p) >= 2)
    return F.array_distinct(F.transform(full, lambda p: F.concat(F.get(p, 0), F.lit(":"), F.get(p, 1))))


def snippet(text: Column) -> Column:
    return F.substring(text, 1, SNIPPET)


def prompt(mode: str, question: Column, context: Column) -> Column:
    subject = "Module" if mode in ("blame", "risk") else "Question"
    return F.concat(F.lit(_ASK[mode] + "\n\nContext:\n"), context, F.lit(f"\n\n{subject}: "), question, F.lit("\n"))


def retrying(writer: Writer, fallback: Writer | None = None, attempts: int = 5, wait: float = 5.0, again: Callable[[Exception], bool] | None = None) -> Writer:
    """A writer that loses no batch to one failure.

    A batch that fails is asked again prompt by prompt.  An error that ``again``
    takes for a passing one (by default: status 429, or a quota) is waited out,
    ``wait`` seconds and twice as long each time, up to ``attempts`` times; then,
    and after any other error, the prompt goes to ``fallback``; where that fails
    too, or is none, the answer is empty.
    """
    import time

    def passing(e: Exception) -> bool:
        return any(x in str(e).lower() for x in ("429", "resource_exhausted", "quota"))

    def one(prompt: str) -> str:
        for attempt in range(attempts):
            try:
                return str(writer(pd.Series([prompt])).iloc[0])
            except Exception as e:
                if not (again or passing)(e) or attempt + 1 == attempts:
                    break
                time.sleep(wait * 2**attempt)
        try:
            return "" if fallback is None else str(fallback(pd.Series([prompt])).iloc[0])
        except Exception:
            return ""

    def write(prompts: pd.Series) -> pd.Series:
        try:
            return writer(prompts)
        except Exception:
            return pd.Series([one(p) for p in prompts], index=prompts.index, dtype=object)

    return write


def cached_scores(candidates: DataFrame, cache: DataFrame, scorer: Scorer) -> tuple[DataFrame, DataFrame]:
    """(candidates plus score, new cache rows): each distinct question and text not in ``cache`` (score_key, score) is scored once."""
    keyed = candidates.withColumn("score_key", F.sha2(F.concat_ws("\x1f", "query", "text"), 256))
    misses = keyed.join(cache.select("score_key"), "score_key", "left_anti").dropDuplicates(["score_key"]).select("score_key", "query", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[["score_key"]].assign(score=scorer(rows["query"], rows["text"]).to_numpy(dtype=float))

    fresh = misses.mapInPandas(run, "score_key string, score double")
    known = cache.select("score_key", "score").unionByName(fresh)
    return keyed.drop("score").join(known, "score_key").drop("score_key"), fresh


def write_answers(prompts: DataFrame, writer: Writer | None = None) -> DataFrame:
    """``prompts`` plus answer; without a writer the answer is empty."""
    if writer is None:
        return prompts.withColumn("answer", F.lit(""))
    fields = [c for c in prompts.columns]
    schema = ", ".join(f"{c} {t}" for c, t in prompts.dtypes) + ", answer string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[fields].assign(answer=writer(rows["prompt"]).to_numpy(dtype=object))

    return prompts.mapInPandas(run, schema)


def memo(answer: Column) -> Column:
    """Decision memo in an answer: the answer itself or its first JSON object; null without the required fields."""
    plain = F.from_json(answer, MEMO_SCHEMA)
    inner = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), MEMO_SCHEMA)

    def good(m: Column) -> Column:
        return m["decision"].isNotNull() & m["context"].isNotNull() & m["rationale"].isNotNull()

    return F.when(good(plain), plain).when(good(inner), inner)
