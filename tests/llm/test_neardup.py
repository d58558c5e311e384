from __future__ import annotations

import random
import re

import pytest

from tessera.llm import neardup as nd


def sets(t, n=3, least=8):
    w = re.findall(r"[^\W_]+", t.lower())
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= least else None


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    data = []
    for k in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 90))]
        data.append((f"b{k}", " ".join(base)))
        for e in range(rng.randrange(0, 5)):
            edited = list(base)
            for _ in range(rng.randrange(0, 7)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            data.append((f"b{k}e{e}", ", ".join(edited).upper() if e % 2 else " ".join(edited)))
    return data + [("copy1", data[0][1]), ("copy2", data[0][1]), ("copy2", data[0][1]), ("none", None), (None, data[0][1]), ("empty", ""), ("few", "one two three")]


def brute(data):
    s = {i: x for i, t in data if i and t is not None and (x := sets(t))}
    ids = sorted(s)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b])}


@pytest.mark.parametrize(("seed", "hot"), [(1, 256), (2, 1)])
def test_against_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(nd, "BLOCK", 2)
    data = corpus(seed)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in data], "id string, text string, cls string, key int")
    pairs, members = nd.near_pairs(df, min_words=8, hot=hot)
    ids = {}
    for r in members.collect():
        ids.setdefault(r.cls, []).append(r.id)
    got = {tuple(sorted((x, y))) for r in pairs.collect() for x in ids[r.a] for y in ids[r.b]}
    got |= {(x, y) for g in ids.values() for x in g for y in g if x < y}
    want = brute(data)
    assert got <= want and len(got) >= 0.98 * len(want)


def test_large_entries(spark, monkeypatch):
    """Entries of more than ``HOT`` classes, with the constants as they are: streamed past, or routed to the blocks first."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    data = []
    for k in range(nd.HOT + 200):
        edited = list(base)
        for place in rng.sample(range(120), rng.randrange(1, 4)):
            edited[place] = f"x{k}y{place}"
        data.append((f"d{k:03d}", " ".join(edited)))
    df = spark.createDataFrame(data, "id string, text string")
    classes = nd.fingerprints(df).select("cls", "fp")
    met = nd.meetings(nd.table_entries(classes), 4)
    assert met.where("b is null").groupBy("key").count().where(f"count > {nd.HOT}").count() > 0
    assert len(nd.large_entries(classes, 1, nd.HOT)) > 0
    want = brute(data)
    for counted in (nd.COUNTED, 1):
        monkeypatch.setattr(nd, "COUNTED", counted)
        pairs, members = nd.near_pairs(df, min_words=8)
        ids = {r.cls: r.id for r in members.collect()}
        got = {tuple(sorted((ids[r.a], ids[r.b]))) for r in pairs.collect()}
        assert got <= want and len(got) >= 0.98 * len(want)


def test_components(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r.cls: r.root for r in nd.components(chain).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100}


def test_empty(spark):
    pairs, members = nd.near_pairs(spark.createDataFrame([], "id string, text string"))
    assert pairs.count() == members.count() == 0
