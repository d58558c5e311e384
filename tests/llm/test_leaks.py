from __future__ import annotations

import random
import re

from tessera.llm import leaks

DOCS, ITEMS = "doc_id long, text string, item_id string, mask int", "item_id long, text string, key string"


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "clash", 0) for d in docs], DOCS), spark.createDataFrame([(*i, "clash") for i in items], ITEMS)


def longest(a, b):
    best = 0
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0] * (len(b) + 1)
        for k, y in enumerate(b):
            if x == y:
                row[k + 1] = last[k] + 1
                best = max(best, row[k + 1])
        last = row
    return best


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(30))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(12)]
    docs = []
    for k in range(60):
        t = [word() for _ in range(rng.randrange(0, 50))]
        for _ in range(rng.randrange(0, 3)):
            w = rng.choice(items)[1].split()
            n = rng.randrange(9, 22)
            at = rng.randrange(0, len(w) - n)
            t[len(t) // 2 : len(t) // 2] = w[at : at + n]
        docs.append((k, ("; \n" if k % 2 else " ").join(t).upper() if k % 3 else " ".join(t)))
    docs += [(100, None), (101, ""), (None, items[0][1]), (0, docs[0][1])]
    items += [(50, None), (51, "too short"), (None, items[0][1])]
    d, i = frames(spark, docs, items)
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    want = {(a, b): n for a, t in docs if a is not None and t for b, s in items if b is not None and s and (n := longest(words(t), words(s))) >= 14}
    got = {(r.doc_id, r.item_id): r.exact_run for r in leaks.leaks(d, i).where("exact_run > 0").collect()}
    assert got == want and want


def test_a_substituted_word_is_tolerated(spark):
    w = [f"word{k}" for k in range(30)]
    changed = [*w[:13], "other", *w[14:]]
    d, i = frames(spark, [(1, " ".join(["lead", *changed[:24]])), (2, " ".join(f"x{k}" for k in range(40)))], [(7, " ".join(w))])
    got = [tuple(r) for r in leaks.leaks(d, i).collect()]
    assert len(got) == 1 and got[0][:3] == (1, 7, 0) and got[0][3] >= 14


def test_masks_cover_the_window():
    assert all(any(m[k] == "1" for m in leaks.MASKS) for k in range(leaks.RUN)) and all(len(m) == leaks.RUN for m in leaks.MASKS)
    assert all(any(m[k] == "0" for m in leaks.MASKS) for k in range(1, leaks.RUN - 1))


def test_empty(spark):
    d, i = frames(spark, [(1, "a b c")], [(1, " ".join("abcdefghijklmnopqrst"))])
    assert leaks.leaks(d.where("false"), i).count() == leaks.leaks(d, i.where("false")).count() == 0
