from __future__ import annotations

import pytest

from tessera.operators.chunking import prechunked
from tessera.operators.embedding import hashing_embedder
from tessera.operators.store import Collection
from tessera.sources import files
from tessera.sources.sinks import write_texts
from tessera.streaming.ingest import ingest


def put(folder, name, data):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())


def test_texts_and_quarantine(spark, tmp_path):
    put(tmp_path, "a.txt", "one\r\ntwo\r")
    put(tmp_path, "bad.txt", b"\xff\xfe broken")
    put(tmp_path, "B.TXT", "upper")
    put(tmp_path / "below", "c.txt", "deep")
    good, bad = files.texts(spark, f"file://{tmp_path}")
    assert [r.text for r in good.collect()] == ["one\ntwo\n"]
    assert [r.source_path.endswith("bad.txt") for r in bad.collect()] == [True]
    with pytest.raises(FileNotFoundError):
        files.texts(spark, f"file://{tmp_path}/missing")


def test_load_methods(spark, tmp_path):
    put(tmp_path, "a.txt", "x" * 30 + "--- Document Chunk 1 ---" + "y")
    size = lambda m: files.load(spark, f"file://{tmp_path}", m, 20, 5).count()
    assert (size("chunked"), size("overlap"), size("direct"), size("anything")) == (2, 3, 3, 3)
    put(tmp_path / "empty", "a.md", "x")
    assert files.load(spark, f"file://{tmp_path}/empty").count() == 0


def test_pdf_seam(spark, tmp_path):
    put(tmp_path / "in/deep", "a.PDF", b"p1|p2")
    put(tmp_path / "in", "b.pdf", b"!")

    def extract(content: bytes) -> list[str]:
        if content == b"!":
            raise ValueError("not a document")
        return content.decode().split("|")

    rows = files.extracted_pages(files.pdf_files(spark, f"file://{tmp_path}/in"), extract).collect()
    assert sorted((r.page_no, r.text, r.error) for r in rows if r.text) == [(1, "p1", None), (2, "p2", None)]
    assert [r.error for r in rows if r.error] == ["not a document"]


def test_extracted_files_are_written(spark, tmp_path):
    """From PDFs to page-marked and to chunk-marked texts by file name; a bad file is left out, equal names are kept apart."""
    put(tmp_path / "in", "a.PDF", "one\n\ntwo|three")
    put(tmp_path / "in/deep", "a.pdf", "x" * 12)
    put(tmp_path / "in", "bad.pdf", b"\xff")
    pages = files.extracted_pages(files.pdf_files(spark, f"file://{tmp_path}/in"), lambda b: b.decode().split("|"))
    got = {}
    for kind, texts in (("pages", files.page_text(pages)), ("chunks", files.marked_text(pages, 8))):
        write_texts(texts, f"file://{tmp_path}/{kind}")
        got[kind] = {r.name: r.text for r in spark.read.json(f"file://{tmp_path}/{kind}").collect()}
    assert sorted(got["pages"].values()) == ["\n--- Page 1 ---\none\n\ntwo\n--- Page 2 ---\nthree", "\n--- Page 1 ---\n" + "x" * 12]
    assert set(got["pages"]) == set(got["chunks"]) == {"a.txt", "a-2.txt"}
    back = prechunked(spark.read.json(f"file://{tmp_path}/chunks"))
    assert sorted(r.content.text for r in back.collect()) == sorted(["one", "two", "three", "x" * 8, "x" * 4])


def test_encodings(spark, tmp_path):
    for n, d in (("a", b"plain"), ("b", "é".encode()), ("c", b"\xef\xbb\xbfx"), ("d", b"\xff\xfex\0"), ("f", b"\xe9 latin")):
        put(tmp_path, n, d)
    got = {r.path[-1]: r.encoding for r in files.encodings(files.binary_files(spark, f"file://{tmp_path}", "*")).collect()}
    assert got == {"a": "ascii", "b": "utf-8", "c": "UTF-8-SIG", "d": "UTF-16", "f": None}


def test_wrap(spark):
    df = spark.createDataFrame([(1, "abcdef\n\n　x"), (2, None)], "k int, text string")
    assert [(r.k, r.line) for r in files.wrapped_lines(df, 4).orderBy("k", "line_no").collect()] == [(1, "abcd"), (1, "ef"), (1, ""), (1, " x")]
    wide = files.wrapped_lines(df, 3, lambda s: sum(2 if c > "b" else 1 for c in s)).orderBy("line_no")
    assert [r.line for r in wide.collect()][:4] == ["ab", "c", "d", "e"]


def test_stem_collisions(spark):
    df = spark.createDataFrame([("a/x.pdf",), ("b/x.PDF",), ("y.pdf",)], "path string")
    assert [tuple(r) for r in files.stem_collisions(df).collect()] == [("x", 2)]


def test_stream_is_idempotent(spark, tmp_path):
    put(tmp_path / "in", "a.txt", "hello world " * 10)
    put(tmp_path / "in", "copy.txt", "hello world " * 10)
    base = Collection(spark, dimensions=16)
    go = lambda: ingest(spark, f"file://{tmp_path}/in", base, hashing_embedder(16), f"file://{tmp_path}/state").awaitTermination()
    go()
    assert base.read().count() == 1
    put(tmp_path / "in", "b.txt", "another text")
    go()
    assert base.read().count() == 2


def test_many_small_files_take_few_tasks(spark, tmp_path):
    from tessera.sources import sinks

    bodies = spark.range(300).selectExpr("cast(concat('text ', id, if(id % 7 = 0, '', '\n')) as binary) body").coalesce(2)
    assert sinks.write_files(bodies, f"file://{tmp_path}/in") == 300 == len(list((tmp_path / "in").iterdir()))
    store, context = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)

    def tasks():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(j).numTasks() for j in range(stages.size()))

    before, cost = tasks(), spark.conf.get("spark.sql.files.openCostInBytes")
    base = Collection(spark, dimensions=16, location=f"file://{tmp_path}/base")
    ingest(spark, f"file://{tmp_path}/in", base, hashing_embedder(16), f"file://{tmp_path}/state").awaitTermination()
    assert tasks() - before < 100  # one a file to list them, before
    assert {r.text for r in base.read().collect()} == {f"text {k}" for k in range(300)} and spark.conf.get("spark.sql.files.openCostInBytes") == cost
