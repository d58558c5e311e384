from __future__ import annotations

import random

import pytest

from tessera.operators.ordinals import batches, positions


def test_batches(spark):
    df = spark.range(1000).repartition(7)
    got = {r.id: r.batch for r in batches(df, 37, "id").collect()}
    assert got == {k: k // 37 for k in range(1000)}
    assert batches(spark.range(0), 5, "id").count() == 0
    with pytest.raises(ValueError):
        batches(df, 0, "id")


def test_positions_in_groups(spark):
    rng = random.Random(1)
    # One group holds most rows, and one key is null.
    data = [(rng.choice(["hot", "hot", "hot", "a", None]), k) for k in range(3000)]
    df = spark.createDataFrame(data, "g string, k int").repartition(5)
    got = {r.k: r.at for r in positions(df, ("k",), "at", ("g",)).collect()}
    seen: dict = {}
    for g, k in data:
        assert got[k] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + 1
    assert len(got) == 3000
