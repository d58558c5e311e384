"""Answers joined to their questions, and the records and lines written from them.

A question without an answer row gets ``UNANSWERED``; an answer that is there but null stays null.  Of several answers to
one question the last counts.  Null keys match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import json_string

UNANSWERED = "未回答"
KEYS = ("category", "id")


def latest(rows: DataFrame, keys: tuple[str, ...] = KEYS, order: str = "answered_at", ties: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each key by ``order``, nulls first; ties go to the largest of ``ties``, nulls last among them.

    An aggregate, so rows are reduced before the shuffle and a hot key needs no sort of its group.
    """
    rest = [c for c in rows.columns if c not in keys and c != order and c not in ties]
    rank = F.struct(F.col(order), *[F.col(c) for c in ties], *[F.col(c) for c in rest])
    best = rows.groupBy(*keys).agg(F.max(rank).alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in rows.columns if c not in keys])


def answered(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Every question with its answer; ``answers`` has one row a key."""
    a = answers.select(*KEYS, F.col("answer").alias("_answer"), F.lit(True).alias("_there"))
    joined = questions.join(a, list(KEYS), "left")
    return joined.withColumn("answer", F.when(F.col("_there"), F.col("_answer")).otherwise(F.lit(UNANSWERED))).drop("_answer", "_there")


def with_results(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Every question with its retrieved passages in order of position, an empty array where there are none."""
    rows = retrieved.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("_result"))
    nothing = F.array().cast("array<struct<position:int,content:string>>")
    return questions.join(rows, list(KEYS), "left").withColumn("result", F.coalesce("_result", nothing)).drop("_result")


def records(questions: DataFrame, answers: DataFrame, retrieved: DataFrame | None = None) -> DataFrame:
    """(category, q_pos, id, query, result, answer); without ``retrieved`` every result is empty."""
    nothing = F.array().cast("array<struct<position:int,content:string>>")
    q = with_results(questions, retrieved) if retrieved is not None else questions.withColumn("result", nothing)
    return answered(q, answers).select("category", "q_pos", "id", F.col("text").alias("query"), "result", "answer")


def result_json(result: Column) -> Column:
    items = F.transform(result, lambda x: F.concat(F.lit('{"position": '), F.coalesce(x["position"].cast("string"), F.lit("null")), F.lit(', "content": '), json_string(x["content"]), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def one_line(query: Column, result: Column, answer: Column) -> Column:
    """A record as one JSON object with a blank after commas and colons."""
    return F.concat(F.lit('{"query": '), json_string(query), F.lit(', "result": '), result_json(result), F.lit(', "answer": '), json_string(answer), F.lit("}"))


def three_lines(query: Column, result: Column, answer: Column) -> Column:
    """A record as three JSON objects."""
    pairs = (("query", json_string(query)), ("result", result_json(result)), ("answer", json_string(answer)))
    return F.array(*[F.concat(F.lit(f'{{"{name}": '), body, F.lit("}")) for name, body in pairs])


def lines(records_: DataFrame, three: bool = False) -> DataFrame:
    """(category, q_pos, part, line): the lines of the answer file, to be written in this order."""
    columns = F.col("query"), F.col("result"), F.col("answer")
    body = three_lines(*columns) if three else F.array(one_line(*columns))
    return records_.select("category", "q_pos", F.posexplode(body).alias("part", "line"))
