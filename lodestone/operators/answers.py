"""Asking a language model about hits: prompts, answers, and what to do without a good one.

The model is any function from a prompt to its answer; it runs in the tasks, a call for each prompt.  Nothing here opens a connection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import parsed_answer

Ask = Callable[[str], str]
FAILED = "\u0000failed"
FORM = '{"evaluations": [{"passage_number": 1, "relevance_score": 8, "explanation": "why", "key_concepts": ["one", "two"]}]}'


def prompts(hits: DataFrame, topic: str = "quotations", most: int = 20) -> DataFrame:
    """query_id, doc_ids and prompt: one for each query of ``hits(query_id, doc_id, query, text, rank)``, about its first ``most`` passages in order."""
    first = hits.filter(F.col("rank") <= most).groupBy("query_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text"))).alias("ps"))
    listed = F.array_join(F.transform("ps", lambda p, k: F.concat((k + 1).cast("string"), F.lit(". "), F.coalesce(p["text"], F.lit("")))), "\n")
    text = F.concat_ws("\n", F.concat(F.lit(f'You know {topic} well.  Query: "'), F.coalesce("query", F.lit("")), F.lit('"')), F.lit("Give each passage below a score from 0 to 10 for its relevance to the query, a short explanation and the concepts they share."), listed, F.lit(f"Answer in JSON of this form: {FORM}"))
    return first.select("query_id", F.col("ps.doc_id").alias("doc_ids"), text.alias("prompt"))


def answered(rows: DataFrame, ask: Ask, column: str = "prompt") -> DataFrame:
    """The rows with answer; a call that raises has a mark that no JSON and no line is."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(prompt: str) -> str:
            try:
                return ask(prompt)
            except Exception:  # whatever a model raises, its passages get the score of a failure
                return FAILED

        for b in batches:
            yield b.assign(answer=[one(p) for p in b[column]])

    return rows.mapInPandas(read, f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, answer string")


def scored(hits: DataFrame, ask: Ask, topic: str = "quotations", most: int = 20) -> DataFrame:
    """The hits with llm_score: the model's for the first ``most`` of a query, 6 where its answer is not JSON, 5 where it failed or left a passage out; null for the others."""
    said = answered(prompts(hits, topic, most), ask)
    scores = F.when(F.col("answer") == FAILED, F.transform("doc_ids", lambda d: F.lit(5.0))).otherwise(parsed_answer(F.col("answer"), F.size("doc_ids")))
    each = said.select("query_id", F.explode(F.arrays_zip("doc_ids", scores.alias("scores"))).alias("z")).select("query_id", F.col("z.doc_ids").alias("doc_id"), F.col("z.scores").alias("llm_score"))
    return hits.join(each, ["query_id", "doc_id"], "left")


def confirmed_by(pairs: DataFrame, ask: Ask, threshold: float = 6.0) -> DataFrame:
    """The pairs (query, text) with relevance_score and is_relevant; 5 and false where the model failed or gave no JSON."""
    prompt = F.concat(F.lit('Say how relevant the passage is to the query, from 0 to 10, by words, themes and context, in JSON of the form {"relevance_score": 7.5}.\nQuery: '), F.coalesce("query", F.lit("")), F.lit("\nPassage: "), F.coalesce("text", F.lit("")))
    said = answered(pairs.withColumn("prompt", prompt), ask)
    found = F.from_json("answer", "relevance_score double")
    good = found.isNotNull() & found["relevance_score"].isNotNull()
    return said.withColumns({"relevance_score": F.when(good, found["relevance_score"]).otherwise(5.0), "is_relevant": good & (found["relevance_score"] >= threshold)}).drop("prompt", "answer")


def variations(queries: DataFrame, ask: Ask, n: int = 5) -> DataFrame:
    """query_id, variant: the first ``n`` lines of the model's answer that are not empty and not the query itself; none where it failed."""
    prompt = F.concat(F.lit(f"Write {n} variations of this query, with synonyms, other words and related themes, one in a line and nothing else.\nQuery: "), F.coalesce("query", F.lit("")))
    said = answered(queries.select("query_id", "query", prompt.alias("prompt")), ask).filter(F.col("answer") != FAILED)
    lines = F.transform(F.split("answer", "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    kept = F.slice(F.filter(lines, lambda x: (x != "") & (x != F.col("query"))), 1, n)
    return said.select("query_id", F.explode(kept).alias("variant"))


def by_model_first(hits: DataFrame) -> DataFrame:
    """Hits with a model's score first, by it, then the others by their own score, ranked anew."""
    order: Column = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("llm_score").isNull(), F.desc("llm_score"), F.desc("score"), "doc_id"))
    return hits.withColumn("rank", order)
