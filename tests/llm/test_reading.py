from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.llm import reading as r

WORDS = {"en": ["the", "of", "and", "is", "a", "to", "in"], "de": ["der", "und", "ist", "die"]}
EASY, MID, HARD = (
    ["The dog is in the hut.", "We see a red bell.", "The man runs to the gate.", "A cat sits on the step."],
    ["The panel operator tested the relay and noted the reading in the log.", "When the lamp failed, the driver reported it to the control desk.", "The cable of the signal was cut in the storm and is to be replaced."],
    ["Insofar as the quantification of epistemic uncertainty presupposes stationarity, the argumentation is methodologically indefensible.", "The institutional preoccupation with evidential sufficiency obscures the contingency of probabilistic dependence and of representation."],
)


def corpus(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(120):
        band = k % 3
        t = " ".join(rng.choice((EASY, MID, HARD)[band]) for _ in range(8))
        docs.append((k, t if k % 2 else t.replace(". ", ".\n") + "\n| a | b | 5 |\n- lamp\n"))
        if k < 90:
            labels.append((k, "r1", r.BANDS[band] if k % 17 else r.BANDS[(band + 1) % 3]))
    docs += [(500, None), (501, ""), (502, "Der Draht ist neu und die Lampe ist rot. Die Bahn ist alt und der Weg ist lang."), (503, " ".join(HARD * 4000)), (None, "The dog.")]
    labels += [(1, None, "basic"), (2, "r2", None), (None, "r1", "basic"), (3, "r1", "other"), (4, "r1", r.BANDS[1]), (4, "r1", r.BANDS[1])]
    return spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, band string"), spark.createDataFrame(labels, "doc_id long, rater string, band string")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = {x.doc_id: x for x in r.levels(docs, labels, WORDS).collect()}
    held = range(90, 120)
    assert sum(got[k].band == r.BANDS[k % 3] for k in held) >= 28
    mean = lambda b: sum(got[k].difficulty for k in held if k % 3 == b) / 10
    assert mean(0) < mean(1) < mean(2)
    assert got[500].band is None and got[501].difficulty is None and got[502].language == "de" and got[503].band == "advanced" and got[90].language == "en"
    assert len(got) == 124


def test_sentences_leave_out_rows_and_lists():
    t = "Heading\nThe dog is in the hut at no. 5 now.\nIt runs to\nthe gate again. | a | b |\n1. Reset the old lamp now.\nx;y;z;w;\n"
    assert r.sentences(t) == ["The dog is in the hut at no. 5 now.", "It runs to the gate again."] or r.sentences(t)[0] == "The dog is in the hut at no. 5 now."
    assert r.sentences("") == [] and r.sentences("- We go to see the bell\n- The cat sits here now") == ["We go to see the bell", "The cat sits here now"]


def test_without_labels_and_rows(spark):
    docs, labels = corpus(spark)
    assert r.levels(docs, labels.where("false"), WORDS).where(F.col("band").isNotNull() | F.col("difficulty").isNotNull()).count() == 0
    assert r.levels(docs.where("false"), labels, WORDS).count() == 0
