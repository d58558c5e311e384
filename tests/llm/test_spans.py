from __future__ import annotations

import random
from collections import defaultdict

import pytest

from tessera.llm import spans

SCHEMA = "id string, doc_id string, text string, h string, cid int"


def brute(data, span):
    seen = defaultdict(set)
    texts = {}
    for i, d, t in data:
        if i is not None and d is not None and t is not None:
            texts[i] = (d, t)
            for k in range(len(t) - span + 1):
                seen[t[k : k + span]].add(d)
    out = {}
    for i, (d, t) in texts.items():
        end = -1
        n = 0
        for k in range(len(t) - span + 1):
            if len(seen[t[k : k + span]]) > 1:
                n += k + span - max(k, end)
                end = k + span
        if n:
            out[i] = n
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefg éЖ😀\n") for _ in range(n))
    common = [word(rng.randrange(30, 90)) for _ in range(6)]
    data = []
    for k in range(60):
        t = word(rng.randrange(0, 60)) + "".join(rng.choice(common)[rng.randrange(0, 12) :] + word(rng.randrange(0, 9)) for _ in range(rng.randrange(0, 4)))
        data.append((f"i{k}", f"d{k // 2}", t))
    hot = word(70)
    data += [(f"h{k}", f"e{k}", word(5) + hot + word(7)) for k in range(25)]
    data += [("same1", "x", hot), ("same2", "y", hot), ("same2", "y", hot), ("p1", "z", "ab" * 60), ("p2", "w", "ab" * 45)]
    return data + [(None, "d", hot), ("n", None, hot), ("t", "q", None), ("e", "q", "")]


@pytest.mark.parametrize(("seed", "hot", "batches"), [(1, 512, 2), (2, 3, 3), (3, 3, 6)])
def test_against_brute_force(spark, monkeypatch, seed, hot, batches):
    monkeypatch.setattr(spans, "HOT", hot)
    data = corpus(seed)
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], SCHEMA)
    got = {r.id: r.shared_chars for r in spans.shared_spans(df, batches, 20, 40).collect()}
    assert got == brute(data, 40)


def test_index_goes_on_in_its_folder(spark, monkeypatch):
    """Batch after batch, by one index or by a new one that opens the same folder: hashes met in history are told once
    their second document comes, and compaction changes nothing."""
    from tessera.plans.tables import work_dir

    batches = [[(1, 10), (2, 10), (2, 10)], [(1, 10), (3, 11), (3, 12)], [(2, 13), (4, 13)], [(4, 13)], [(4, 14), (5, 1)], [(5, 2), (1, 11)]]
    want = [set(), {3}, {2}, set(), {4}, {5, 1}]
    for reopened in (False, True):
        root = work_dir(spark)
        index = spans.SpanIndex(spark, root)
        sizes = []
        for rows, expected in zip(batches, want, strict=True):
            if reopened:
                index.close()
                index = spans.SpanIndex(spark, root)
            found = index.add(spark.createDataFrame(rows, "h long, did long"))
            assert {r.h for r in found.collect()} == expected
            sizes.append(len(index.runs))
        assert sizes == [1, 2, 3, 1, 2, 3]
        index.close()


def test_windows_that_only_hash_alike(spark, monkeypatch):
    """Windows whose hashes collide are told apart by their characters."""
    import numpy as np

    monkeypatch.setattr(spans.tv, "span_hash", lambda prefix, start, end: np.zeros(len(start), np.uint64))
    h, zero = np.array([7, 7, 7]), np.zeros(3, np.int64)
    row, s, e = spans._covered(h, zero, zero, np.array([1, 2, 3]), ["abcdefgh", "abcdefxy", "zzzzzzzz"], 5)
    assert list(zip(row.tolist(), s.tolist(), e.tolist(), strict=True)) == [(0, 0, 6), (1, 0, 6)]


def test_nothing_shared(spark):
    df = spark.createDataFrame([("a", "d", "x" * 300), ("b", "d", "x" * 300)], "id string, doc_id string, text string")
    assert spans.shared_spans(df).count() == 0
    assert spans.shared_spans(df.where("false")).count() == 0


def test_very_long_text(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghij") for _ in range(900_000))
    df = spark.createDataFrame([("a", "d", long), ("b", "e", "-" * 50 + long[700_000:700_250] + "+" * 50)], "id string, doc_id string, text string")
    assert {(r.id, r.shared_chars, r.n_spans) for r in spans.shared_spans(df).collect()} == {("a", 250, 1), ("b", 250, 1)}
