from __future__ import annotations

import numpy as np
import pytest

from tessera.llm import mixing as m

WORDS = {"en": ["the", "and", "of", "is"], "de": ["der", "und", "ist"]}


def frames(spark):
    docs = [(k, "the relay and the lamp of the line is on " * (k % 5 + 1), " Big-Source", "x") for k in range(300)]
    docs += [(1000 + k, "der Achszähler und der Draht ist neu " * 3, "small_source", "x") for k in range(40)]
    docs += [(2000, None, "small source", "x"), (2001, "", "SMALL_SOURCE", "x"), (2002, "the relay", None, "x"), (None, "the relay and", "big source", "x"), (3, "the lamp", "big_source", "x")]
    weights = [("big_source", 0.7, 3), ("small_source", 0.2, 6), ("tiny_source", 0.1, 9), (None, 0.5, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string"), spark.createDataFrame(weights, "source string, target_share double, max_uses int")


def test_plan_and_selection(spark):
    docs, weights = frames(spark)
    chosen, goal = m.mixture(docs, weights, WORDS)
    assert list(goal["source"][~goal["reachable"]]) == ["tiny_source"]
    rows = chosen.toPandas()
    assert set(rows["source"]) == {"big_source", "small_source"} and (rows["tokens"] > 0).all()
    assert rows.groupby("source")["uses"].max().to_dict()["big_source"] <= 3 and rows["uses"].max() <= 6
    used = (rows["tokens"] * rows["uses"]).groupby(rows["source"]).sum()
    assert used["big_source"] / used.sum() == pytest.approx(0.7 / 0.9, abs=0.03)
    # The reachable sources hold their share of a mixture as large as all documents, to a document.
    lines = goal.set_index("source")
    for name in ("big_source", "small_source"):
        assert abs(used[name] - lines.loc[name, "target_tokens"]) <= rows["tokens"].max()
    assert sorted(map(tuple, m.mixture(docs, weights, WORDS)[0].collect())) == sorted(map(tuple, chosen.collect()))


def test_raking_meets_reachable_margins():
    tokens, cap = np.array([100.0, 50.0, 30.0, 20.0]), np.array([4.0, 4.0, 4.0, 4.0])
    members = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    w = m.rake(tokens, cap, members, [np.array([120.0, 80.0]), np.array([140.0, 60.0])])
    mass = w * tokens
    assert np.allclose([mass[:2].sum(), mass[2:].sum()], [120, 80]) and np.allclose([mass[0] + mass[2], mass[1] + mass[3]], [140, 60])


def test_raking_respects_caps():
    w = m.rake(np.array([10.0, 90.0]), np.array([2.0, 2.0]), [np.array([0, 1]), np.array([0, 0])], [np.array([60.0, 40.0]), np.array([np.nan])])
    assert w[0] == 2.0 and w[1] * 90 == pytest.approx(40)
    one = m.rake(np.array([10.0, 10.0]), np.array([1.0, 9.0]), [np.array([0, 0]), np.array([0, 1])], [np.array([50.0]), np.array([np.nan, np.nan])])
    assert one[0] == 1.0 and one[1] * 10 == pytest.approx(40)


def test_tokens_round_trip():
    assert m.count_tokens(["", "hello world", "联锁"]).tolist()[0] == 0 and (m.count_tokens(["hello world", "联锁"]) > 0).all()


def test_empty(spark):
    docs, weights = frames(spark)
    _, goal = m.plan(m.with_topics(m.measured(docs.where("false"), WORDS)), weights)
    assert len(goal) == 3 and goal["available_tokens"].sum() == 0
    chosen, goal = m.mixture(docs, weights.where("false"), WORDS)
    assert chosen.count() == 0 and len(goal) == 0
