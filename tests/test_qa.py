from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import answers as A
from tessera.operators import questions as Q
from tessera.operators import store
from tessera.operators.batch_qa import answer, answer_batch, conversation
from tessera.operators.embedding import hashing_embedder
from tessera.operators.store import Collection


def sheets(spark, *data):
    return spark.createDataFrame([(k, t) for k, t in enumerate(data)], "n int, text string")


def parsed(spark, text):
    return [(r.category, r.cat_pos, r.q_pos, r.id, r.text) for r in Q.parse(sheets(spark, text), key="n").orderBy("cat_pos", "q_pos").collect()]


def test_plain_sheet(spark):
    t = "## A（2 道）\n1. one\n2. two\n   more\n\n## B（9 道）\n7. seven\n"
    assert parsed(spark, t) == [("A", 0, 0, 1, "one"), ("A", 0, 1, 2, "two\n   more"), ("B", 1, 0, 7, "seven")]


def test_traps(spark):
    assert parsed(spark, "### x（3 道）\n1. q\n") == [("x", 0, 0, 1, "q")]
    assert parsed(spark, "## A（1 道）\n1. length\n3.5 km more\n2. two") == [("A", 0, 0, 1, "length"), ("A", 0, 1, 2, "two")]
    assert parsed(spark, "## A（1 道）\n1.\n2. foo") == [("A", 0, 0, 1, "2. foo")]
    assert parsed(spark, "## Intro\ntext\n## A（1 道）\n1. q") == [("Intro\ntext\n## A", 0, 0, 1, "q")]
    assert parsed(spark, "## A（1 道）\n1. old\n## B（1 道）\n1. b\n## A（1 道）\n5. new") == [("A", 0, 0, 5, "new"), ("B", 1, 0, 1, "b")]
    assert parsed(spark, "no header") == parsed(spark, "") == parsed(spark, None) == []


def test_summary_keeps_empty_categories(spark):
    t = "## A（2 道）\n1. one\n## Empty（0 道）\nnothing\n"
    counts = Q.summary(Q.categories(sheets(spark, t)), Q.parse(sheets(spark, t)))
    assert {tuple(r) for r in counts.collect()} == {("A", 1), ("Empty", 0)}
    assert Q.summary_text(counts).first()[0] == "questions: 1\ncategories: 2\n  A: 1\n  Empty: 0"


def questions(spark):
    return spark.createDataFrame([("A", 0, 1, "q1"), ("A", 1, 2, "q2"), ("A", 2, 3, "q3"), ("B", 0, 1, 'say "x"\n')], "category string, q_pos int, id long, text string")


def test_answers(spark):
    rows = [("A", 1, "old", 1), ("A", 1, "new", 2), ("A", 2, None, 1), (None, 3, "lost", 1), ("A", 1, "new", 2)]
    a = A.latest(spark.createDataFrame(rows, "category string, id long, answer string, answered_at long"))
    got = {(r.category, r.id): r.answer for r in A.answered(questions(spark), a).collect()}
    assert got == {("A", 1): "new", ("A", 2): None, ("A", 3): "未回答", ("B", 1): "未回答"}


def test_latest_takes_nulls_first(spark):
    rows = spark.createDataFrame([(1, None, "a"), (1, 5, "b"), (2, None, "c"), (2, None, None)], "k int, at int, v string")
    assert {tuple(r) for r in A.latest(rows, ("k",), "at").collect()} == {(1, 5, "b"), (2, None, "c")}


def test_lines(spark):
    a = spark.createDataFrame([("B", 1, "yes — é")], "category string, id long, answer string")
    r = spark.createDataFrame([("B", 1, 2, "second"), ("B", 1, 1, None)], "category string, id long, position int, content string")
    rec = A.records(questions(spark), a, r)
    got = [x.line for x in A.lines(rec).orderBy("category", "q_pos").collect()]
    want = {"query": 'say "x"\n', "result": [{"position": 1, "content": None}, {"position": 2, "content": "second"}], "answer": "yes — é"}
    assert got[3] == json.dumps(want, ensure_ascii=False) and json.loads(got[0]) == {"query": "q1", "result": [], "answer": "未回答"}
    three = [x.line for x in A.lines(rec, three=True).where("category = 'B'").orderBy("part").collect()]
    assert three == [json.dumps({k: v}, ensure_ascii=False) for k, v in want.items()]


def test_answer_file(spark, tmp_path):
    from tessera.sources.sinks import default_name, write_answers

    rec = A.records(questions(spark), spark.createDataFrame([], "category string, id long, answer string"))
    path = write_answers(rec.coalesce(1), f"file://{tmp_path}/out")
    body = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert path.endswith("out") and body.count("\n\n") == 4 and [json.loads(x)["query"] for x in body.strip().split("\n\n")] == ["q1", "q2", "q3", 'say "x"\n']
    assert default_name().startswith("answers_")


def test_errors_are_kept(spark):
    asked = questions(spark).withColumn("result", F.array().cast("array<struct<position:int,content:string>>"))

    def fails(query, passages):
        if query == "q2":
            raise RuntimeError("broken")
        return query.upper()

    got = {(r.category, r.id): (r.answer, r.error) for r in answer(asked, fails).collect()}
    assert got["A", 2] == ("Error: broken", "broken") and got["A", 1] == ("Q1", None)


def test_planted_fact_is_found(spark):
    chunks = [("d-0", "d", 0, "the relay stands in the hut"), ("d-1", "d", 1, "the secret word of the station is marzipan"), ("d-2", "d", 2, "trains run on rails")]
    rows = spark.createDataFrame(chunks, "id string, doc_id string, chunk_id int, t string").select("id", "doc_id", "chunk_id", F.struct(F.col("t").alias("text")).alias("content"))
    base = Collection(spark, dimensions=256)
    base.add(rows, hashing_embedder(256))
    q = spark.createDataFrame([("A", 0, 1, "what is the secret word?"), ("A", 1, 2, "zzzz")], "category string, q_pos int, id long, text string")
    out = {r.id: r for r in answer_batch(q, base, hashing_embedder(256), limit=2, score_threshold=0.1).collect()}
    assert "marzipan" in out[1].answer and out[2].answer == "No passage was found." and out[2].result == []


def test_collection_generations(spark):
    base = Collection(spark, dimensions=2)
    row = lambda i, t: (i, "d", 0, t, [1.0, 0.0])
    schema = "id string, doc_id string, chunk_id int, text string, vector array<float>"
    assert not base.exists() and base.read().count() == 0
    base.upsert(spark.createDataFrame([row("a", "1"), row("b", "1"), row("b", "2"), row(None, "x")], schema))
    base.upsert(spark.createDataFrame([row("a", "3")], schema))
    want = {("a", "3"), ("b", "2")}
    assert {(r.id, r.text) for r in base.read().collect()} == want
    base.compact()
    assert {(r.id, r.text) for r in base.read().collect()} == want and base.exists() and not base.wants_compaction()
    with pytest.raises(PySparkException, match="2 dimensions"):
        base.upsert(spark.createDataFrame([("a", "d", 0, "t", [1.0])], schema))
    assert {(r.id, r.text) for r in base.read().collect()} == want
    base.delete(spark.createDataFrame([("a",), ("zzz",), (None,)], "id string"))
    assert {(r.id, r.text) for r in base.read().collect()} == {("b", "2")}
    base.upsert(spark.createDataFrame([row("a", "4")], schema), batch=7)
    base.upsert(spark.createDataFrame([row("a", "5")], schema), batch=7)  # the batch is repeated
    assert {(r.id, r.text) for r in base.read().collect()} == {("b", "2"), ("a", "4")}


def test_collection_compacts_itself(spark, monkeypatch):
    monkeypatch.setattr(store, "MAX_GENERATIONS", 3)
    base = Collection(spark, dimensions=2)
    schema = "id string, doc_id string, chunk_id int, text string, vector array<float>"
    for k in range(6):
        base.upsert(spark.createDataFrame([("a", "d", 0, str(k), [1.0, 0.0]), (f"b{k}", "d", 0, str(k), [0.0, 1.0])], schema))
        assert len(base.states.last().generations) <= 3
    assert {(r.id, r.text) for r in base.read().collect()} == {("a", "5"), *((f"b{k}", str(k)) for k in range(6))}
    many = spark.range(3000).selectExpr("cast(id as string) id", "'d' doc_id", "0 chunk_id", "'t' text", "array(1f, 0f) vector")
    base = Collection(spark, dimensions=2)
    base.upsert(many)
    base.delete(many.where("id < 2000").select("id"))
    assert len(base.states.last().generations) == 1 and base.read().count() == 1000


def test_two_writers(spark):
    base = Collection(spark, dimensions=2)
    schema = "id string, doc_id string, chunk_id int, text string, vector array<float>"
    base.upsert(spark.createDataFrame([("a", "d", 0, "1", [1.0, 0.0])], schema))
    old = base.states.last()
    results = []
    for name in ("x", "y"):
        try:
            results.append(base.states.publish(old, [name], 2, None).generations)
        except RuntimeError:
            results.append(None)
    assert base.states.last().generations in results


def test_collection_through_lists(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = e.selectExpr("cast(vec_id as string) id", "'d' doc_id", "0 chunk_id", "concat('t', vec_id) text", "embedding vector")
    asked = e.where("vec_id % 100 = 0").selectExpr("vec_id query_id", "embedding vector")
    base = Collection(spark, dimensions=64)
    base.upsert(rows)
    exact = {(r.query_id, r.id, r.text) for r in base.nearest(asked, 10).collect()}
    base.index_above = 100
    for _ in range(2):  # the second search finds the lists made by the first
        found = {(r.query_id, r.id, r.text) for r in base.nearest(asked, 10).collect()}
        assert len(exact & found) >= 0.9 * len(exact) and all(t == "t" + i for _, i, t in found)


def test_conversation_ends(spark):
    m = spark.createDataFrame([(1, 0, "hi"), (1, 1, " exit\n"), (1, 2, "late"), (2, 0, "exit now")], "conv_id long, turn long, text string")
    assert {tuple(r) for r in conversation(m).collect()} == {(1, 0, "hi"), (2, 0, "exit now")}
