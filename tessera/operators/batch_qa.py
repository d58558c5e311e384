"""Batch question answering: retrieve, answer, assemble records.

An answerer takes a question and its passages and gives the answer's text.  An exception becomes the answer
``Error: <message>`` and the message goes to ``error``; the rest goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip
from tessera.operators.answers import records, with_results
from tessera.operators.embedding import Embedder
from tessera.operators.retrieval import relax
from tessera.operators.store import Collection
from tessera.plans.tables import stored

Answerer = Callable[[str, list[str]], str]
NOT_FOUND = "No passage was found."


def first_passage(query: str, passages: list[str]) -> str:
    """The extractive answerer: the best passage as it stands."""
    return passages[0] if passages else NOT_FOUND


def answer(asked: DataFrame, answerer: Answerer = first_passage) -> DataFrame:
    """(category, id, answer, error) for rows with category, id, text and result."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for c, i, q, r in zip(f["category"], f["id"], f["text"], f["result"], strict=True):
                try:
                    rows.append((c, i, answerer(q or "", [x["content"] for x in r]), None))
                except Exception as e:  # one failing question must not end the run
                    rows.append((c, i, f"Error: {e}", str(e)))
            yield pd.DataFrame(rows, columns=["category", "id", "answer", "error"])

    return asked.select("category", "id", "text", "result").mapInPandas(run, "category string, id long, answer string, error string")


def answer_batch(
    questions: DataFrame, collection: Collection, embedder: Embedder, answerer: Answerer = first_passage, limit: int = 5,
    score_threshold: float | None = None, keep_results: bool = True, thresholds: tuple[float, ...] | None = None,
) -> DataFrame:
    """Records (category, q_pos, id, query, result, answer); ``keep_results=False`` leaves every result empty.

    With ``thresholds`` each question takes the passages at the highest of them that gives it any; a question with none at
    the lowest is answered without passages.
    """
    keyed = stored(questions.withColumn("query_id", F.xxhash64("category", "id", "q_pos")))
    hits = collection.retrieve(keyed.select("query_id", "text"), embedder, limit, min(thresholds) if thresholds else score_threshold)
    if thresholds:
        hits = relax(hits, thresholds)
    found = hits.drop("id").join(keyed.select("query_id", "category", "id"), "query_id").select("category", "id", "position", F.col("text").alias("content"))
    found = stored(found)
    asked = with_results(questions, found)
    return records(questions, answer(asked, answerer).drop("error"), found if keep_results else None)


def conversation(messages: DataFrame) -> DataFrame:
    """User turns (conv_id, turn, text) before the first that says ``exit``, which ends a conversation."""
    ends = messages.where(strip(F.col("text")) == "exit").groupBy("conv_id").agg(F.min("turn").alias("_end"))
    return messages.join(ends, "conv_id", "left").where(F.col("_end").isNull() | (F.col("turn") < F.col("_end"))).drop("_end")
