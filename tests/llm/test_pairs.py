from __future__ import annotations

import numpy as np
import pytest

from tessera.llm import pairs
from labelled_pairs import LABELS

Q = "Why did the marker light at Oldham have to be bypassed after the transponder failed?"
A = "The relay at Oldham was tested by the driver, and the reading of 5 mV was noted in the log for the review of the line."
CASES = [
    (1, Q, A, set()),
    (2, Q, None, {"empty"}),
    (3, Q, " \n", {"empty"}),
    (4, Q, "N/A", {"empty"}),
    (5, Q, "Error: request timed out", {"empty"}),
    (6, Q, A + " The second reason is that the", {"truncated"}),
    (7, Q, "1. Reset the relay.\n2. Test the lamp.\n3. The", {"truncated"}),
    (8, Q, "1. Reset the relay at Oldham\n2. Test the lamp at Derby", set()),
    (9, Q, "I'm sorry, but I can't help with that.", {"refusal"}),
    (10, Q, "I am sorry to contradict the premise: the driver cannot release it before the timer ends. " + A, set()),
    (11, Q, Q.upper(), {"copy"}),
    (12, Q, "Q: " + Q, {"copy"}),
    (13, Q, "You asked: " + Q + " " + A, set()),
    (14, Q, "Die Prüferin hat in Oldham die Nummer notiert, weil Wasser in das Gehäuse eingedrungen war.", {"language"}),
    (15, Q, A + " (In Chinese: 事件记录仪; in German: Relais.)", set()),
    (16, "为什么轨道电路需要与无线基站分开供电？", "控制台发生故障后，道口看守员测试了相邻的测速探头，并在值班日志中登记。", set()),
    (17, Q, "879 kilohm", set()),
    (18, Q, "Es tut mir leid, dabei kann ich nicht helfen.", {"refusal", "language"}),
    (19, None, A, set()),
    (20, Q, "x" * 200_000 + ".", set()),
]


def test_cases(spark):
    data = [(i, q, a, "clash", "clash") for i, q, a, _ in CASES for _ in range(30)] + [(None, Q, A, "", "")]
    df = spark.createDataFrame(data, "id long, query string, answer string, defect string, votes string")
    got: dict[int, set[str]] = {}
    for r in pairs.defects(df).collect():
        got.setdefault(r.id, set()).add(r.defect)
        assert pairs.CUTOFFS[r.defect] < r.posterior <= 1
    assert got == {i: d for i, _, _, d in CASES if d}


def test_label_model_finds_the_truth():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.07
    votes, odds = [], np.full(len(truth), np.log(0.07 / 0.93))
    for hit, false in ((0.9, 0.03), (0.8, 0.05), (0.7, 0.02)):
        v = np.where(rng.random(len(truth)) < np.where(truth, hit, false), 1, -1)
        v[rng.random(len(truth)) < 0.2] = 0
        odds += np.where(v > 0, np.log(hit / false), np.where(v < 0, np.log((1 - hit) / (1 - false)), 0))
        votes.append(v)
    text = np.array(["".join("-0+"[x + 1] for x in r) for r in np.array(votes).T])
    patterns, at, counts = np.unique(text, return_inverse=True, return_counts=True)
    p = pairs.label_model(patterns.tolist(), counts)[at]
    best = ((odds > 0) == truth).mean()  # what knowing all rates would give
    assert ((p > 0.5) == truth).mean() > best - 0.005 and p[text == "000"].max(initial=0) < 0.2


@pytest.fixture(scope="module")
def posteriors(spark):
    """Of every defect the record ids at scale 0.01, their posteriors, their majority votes and the truth by hand."""
    cast, patterns = pairs.judged(spark.read.parquet("/root/testdata/sf0.01/qa_records.parquet"))
    rows = cast.toPandas().drop_duplicates(["id", "defect"]).merge(patterns, on=["defect", "votes"])
    return {d: (g["posterior"].to_numpy(), g["majority"].to_numpy(), g["id"].isin(LABELS[d]).to_numpy()) for d, g in rows.groupby("defect")}


@pytest.mark.parametrize("defect", sorted(LABELS))
def test_cutoffs_are_the_best_on_labelled_records(posteriors, defect):
    posterior, _, truth = posteriors[defect]
    best, precision, recall = pairs.choose_cutoff(posterior, truth)
    assert precision >= 0.99 and recall >= 0.99
    assert ((posterior > pairs.CUTOFFS[defect]) == (posterior > best)).all()


def test_label_model_against_the_majority(posteriors):
    """Where the two differ the label model is right."""
    posterior, majority, truth = posteriors["truncated"]
    flagged = posterior > pairs.CUTOFFS["truncated"]
    differ = flagged != majority
    assert differ.sum() > 0 and (flagged == truth)[differ].all()


def test_passages_are_read():
    tail = "the relay near Oldham was examined by the driver and"
    whole = pairs.Record(Q, "A. " + tail, ["Since then " + tail + " the lamp was tested."])
    assert pairs._goes_on(whole) == 1 and pairs._goes_on(pairs.Record(Q, "A. " + tail, [])) == 0
    closed = pairs.Record(Q, A, [A + " And more."])
    assert pairs._goes_on(closed) == -1 and pairs._grounded(pairs.Record(Q, "lens cabinet", ["the lens of a cabinet"])) == -1


def test_no_vote_settles_a_defect_alone():
    """A pattern's posterior is estimated: a vote that is as common among sound records is not believed."""
    p = pairs.label_model(["+00", "+++", "---", "+--"], np.array([5.0, 100.0, 1000.0, 900.0]))
    assert p[3] < 0.05 < p[1]


def test_empty(spark):
    assert pairs.defects(spark.createDataFrame([], "id long, query string, answer string")).count() == 0
