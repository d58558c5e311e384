from __future__ import annotations

import hashlib
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import chunking as C


def texts(spark, *data):
    return spark.createDataFrame([(k, t) for k, t in enumerate(data)], "n int, text string")


def bodies(df):
    return [r[0] for r in df.orderBy("n", "chunk_id").select("content.text").collect()]


def fold(units, size, overlap):
    """The packing rule, step by step."""
    done, cur = [], ""
    for u in units:
        if len(cur) + len(u) > size and cur:
            done.append(cur)
            cur = (cur[-overlap:] if overlap else cur) + u
        else:
            cur += u
    if cur:
        done.append(cur)
    return [x.strip() for x in done if x.strip()]


@given(st.text(alphabet="ab \n😀é", max_size=120), st.integers(1, 17), st.integers(0, 16))
@settings(max_examples=300, deadline=None)
def test_closed_form_is_the_fold(t, size, overlap):
    if overlap < size:
        assert C.char_pieces(t, size, overlap) == fold([t[k : k + size] for k in range(0, len(t), size)], size, overlap)


@given(st.text(alphabet="ab \n。", max_size=150), st.integers(2, 20), st.integers(0, 10), st.sampled_from(["paragraph", "sentence"]))
@settings(max_examples=300, deadline=None)
def test_packing_is_the_fold(t, size, overlap, by):
    if overlap < size:
        units = [x.strip() for x in t.split("\n") if x.strip()] if by == "paragraph" else t.split("。")
        assert C.packed_pieces(t, by, size, overlap) == fold(units, size, overlap)


def test_columns_and_python_agree(spark, monkeypatch):
    rng = random.Random(5)
    data = ["".join(rng.choice("abc d\n。😀　") for _ in range(rng.randrange(90))) for _ in range(40)] + ["", None, "x", " \n "]
    for overlap in (0, 3):
        for by in ("char", "sentence", "paragraph"):
            short = C.overlapped(texts(spark, *data), 10, overlap, by, compat=True)
            monkeypatch.setattr(C, "LONG_TEXT", -1)
            long = C.overlapped(texts(spark, *data), 10, overlap, by, compat=True)
            monkeypatch.setattr(C, "LONG_TEXT", 262_144)
            assert bodies(short) == bodies(long)
            one = {"char": lambda t: C.char_pieces(t, 10, overlap)}.get(by, lambda t: C.packed_pieces(t, by, 10, overlap))
            assert bodies(short) == [p for t in data if t for p in one(t)]


def test_prechunked(spark):
    t = "before\n--- Document Chunk 7 ---\n one \n--- Document Chunk 9 ---\n  \n--- Document Chunk 1 ---two--- Document Chunk 2 ---"
    df = C.prechunked(texts(spark, t, "no marker", "", None))
    assert bodies(df) == ["before", "one", "two", "no marker"]
    first = df.where("n = 0").orderBy("chunk_id").collect()
    sha = hashlib.sha256(t.encode()).hexdigest()
    assert [(r.id, r.chunk_id, r.total_chunks) for r in first] == [(f"{sha}-{k}", k, 3) for k in range(3)]


def test_marker_round_trip(spark):
    chunks = C.direct(texts(spark, "abcdefghij" * 3, "xyz"), 7)
    back = C.prechunked(C.marked(chunks.drop("n")).withColumnRenamed("doc_id", "n"))
    assert sorted(bodies(back)) == sorted(bodies(chunks))


def test_astral_characters_are_not_cut(spark):
    assert bodies(C.direct(texts(spark, "a😀b😀"), 2)) == ["a😀", "b😀"]


def test_long_unit_is_kept(spark):
    assert bodies(C.overlapped(texts(spark, "ab\n" + "x" * 50 + "\ncd"), 10, 2, "paragraph")) == ["ab", "ab" + "x" * 50, "xxcd"]


def test_no_overlap_forms(spark):
    assert bodies(C.overlapped(texts(spark, "abcdef"), 2, 0, compat=True)) == ["ab", "abcd", "abcdef"]
    assert bodies(C.overlapped(texts(spark, "abcdef"), 2, 0)) == ["ab", "cd", "ef"]
    assert bodies(C.overlapped(texts(spark, "ab\ncd\nef"), 4, 0, "paragraph")) == ["abcd", "ef"]
    assert bodies(C.overlapped(texts(spark, "ab\ncd\nef"), 4, 0, "paragraph", compat=True)) == ["abcd", "abcdef"]


def test_direct_units(spark):
    t = " one line \n\nanother, longer line\nx"
    assert bodies(C.direct(texts(spark, t, None, ""), 10, "paragraph")) == ["one line", "another, l", "onger line", "x"]
    assert bodies(C.direct(texts(spark, "一。二三。 。四"), 10, "sentence")) == ["一", "二三", "四"]


def test_splitter_is_a_parameter(spark):
    t = 'The lamp failed. "Was it no. 5?" It was! 一。二！ end'
    assert C.rule_sentences(t) == ["The lamp failed.", '"Was it no. 5?"', "It was!", "一。", "二！", " end"]
    assert C.rule_sentences("One here. Two there? no. 3 stays. Four") == ["One here.", "Two there? no. 3 stays.", "Four"] and C.rule_sentences("") == []
    words = lambda x: x.split(" ")
    assert bodies(C.direct(texts(spark, "ab cde f"), 2, "sentence", splitter=words)) == ["ab", "cd", "e", "f"]
    assert bodies(C.overlapped(texts(spark, "ab cde f"), 4, 1, "sentence", splitter=words)) == ["ab", "bcde", "ef"]


def test_packing_takes_linear_time():
    """Doubling a text of many short lines doubles the time, roughly."""
    def seconds(n):
        t = "a short line of text\n" * n
        began = time.perf_counter()
        C.packed_pieces(t, "paragraph", 1024, 200)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(200_000) < 8 * max(seconds(50_000), 0.02)


def test_bad_parameters():
    for bad in ((5, 5, "char"), (5, 6, "char"), (5, -1, "char"), (0, 0, "char"), (5, 1, "word")):
        with pytest.raises(ValueError):
            C.check(*bad)


def test_clashing_columns_and_repeats(spark):
    df = spark.createDataFrame([("mine", 1, "t", "hello"), ("mine", 1, "t", "hello")], "id string, chunk_id int, content string, text string")
    out = C.direct(df, 10)
    assert out.columns == ["id", "doc_id", "chunk_id", "total_chunks", "content"] and out.count() == 2


def test_pages(spark):
    got = C.pages(texts(spark, "lead\n--- Page 1 ---\nA\n--- Page 2 ---\n\n", "--- Page 3 ---x", None, "")).orderBy("n", "page_no")
    assert [(r.n, r.page_no, r.page_text) for r in got.collect()] == [(0, 0, "lead"), (0, 1, "A"), (0, 2, ""), (1, 3, "x")]


def test_page_marked(spark):
    df = spark.createDataFrame([("p", 2, "B"), ("p", 1, None), ("p", 2, "B")], "path string, page_no int, text string")
    assert C.page_marked(df).first().text == "\n--- Page 1 ---\n\n--- Page 2 ---\nB"


def test_empty_table(spark):
    empty = spark.createDataFrame([], "n int, text string")
    assert C.overlapped(empty).count() == C.prechunked(empty).count() == C.direct(empty).count() == 0
