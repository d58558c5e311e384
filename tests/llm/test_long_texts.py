"""Very long texts go through whole."""

from __future__ import annotations

import random

from tessera.llm import leaks, mixing, neardup, scans


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(50_000)}" for _ in range(n)]


def test_near_duplicates(spark):
    w = words(1, 200_000)
    edited = [*w[:1000], "new", *w[1000:150_000], *w[150_010:]]
    df = spark.createDataFrame([("a", " ".join(w)), ("b", " ".join(edited)), ("c", " ".join(words(2, 200_000)))], "id string, text string")
    pairs, members = neardup.near_pairs(df)
    assert members.count() == 3 and [r.jaccard > 0.99 for r in pairs.collect()] == [True]


def test_leaks(spark):
    w = words(3, 300_000)
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(words(4, 50)))], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(w[-20:])), (8, " ".join(w[150_000:150_013]))], "item_id long, text string")
    assert [tuple(r)[:3] for r in leaks.leaks(docs, items).collect()] == [(1, 9, 20)]


def test_scans(spark):
    body = "\n".join(["the driver reported the fault to the con-", "troller of the line"] * 30_000)
    df = spark.createDataFrame([("a", body)], "id string, text string")
    ev = scans.evidence(df, spark.createDataFrame([("controller the driver",)], "text string"), df)
    found = scans.defects(ev)
    assert [(r.defect, r.item) for r in found.collect()] == [("split_word", "controller")]
    assert scans.repaired(df, found, ev).first().text.count("controller") == 30_000


def test_tokens():
    assert mixing.count_tokens(["hello world " * 200_000])[0] > 400_000
