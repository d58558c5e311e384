from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vectors import cosine

SPACES = [chr(c) for c in [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]


def test_strip_takes_all_white_space(spark):
    data = [(f"{s}a{s} b{s}",) for s in SPACES] + [("",), (None,), ("".join(SPACES),), ("​x",)]
    got = [r[0] for r in spark.createDataFrame(data, "t string").select(T.strip(F.col("t"))).collect()]
    assert got == [None if t is None else t.strip() for (t,) in data]


def test_identity_translates_newlines_and_keeps_the_mark(spark):
    data = ["a\r\nb\rc\n", "﻿a", "", "😀\r\n"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in data], "t string").select(T.document_id(F.col("t"))).collect()]
    assert got == [hashlib.sha256(t.replace("\r\n", "\n").replace("\r", "\n").encode()).hexdigest() for t in data]


def test_names(spark):
    data = ["a/b/c.tar.gz", "a/.hidden", "x.TXT", "noext", "d.e/f"]
    df = spark.createDataFrame([(t,) for t in data], "p string").select(T.file_stem(F.col("p")), T.swap_extension(F.col("p"), "txt", "pdf"))
    assert [tuple(r) for r in df.collect()] == [("c.tar", "a/b/c.tar.gz"), (".hidden", "a/.hidden"), ("x", "x.pdf"), ("noext", "noext"), ("f", "d.e/f")]


def test_json_string(spark):
    import json

    data = ['a"b\\c\n\t\r\x01é中😀/', "", "\x1f\b\f"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in data], "t string").select(T.json_string(F.col("t"))).collect()]
    assert got == [json.dumps(t, ensure_ascii=False) for t in data]
    assert spark.sql("select cast(null as string) t").select(T.json_string(F.col("t"))).first()[0] == "null"


def test_cosine(spark):
    df = spark.sql("select array(3f, 4f) a, array(4f, 3f) b, array(0f, 0f) z, cast(null as array<float>) n")
    assert tuple(df.select(cosine(F.col("a"), F.col("b")), cosine(F.col("a"), F.col("z")), cosine(F.col("a"), F.col("n"))).first()) == (0.96, None, None)
