from __future__ import annotations

import random
import time
from functools import reduce

import numpy as np
import pytest

from tessera.llm import quality as q

COMMON = ["the", "of", "and", "a", "in", "was", "to", "is", "for", "on"]
PROSE = "The relay in the hut was tested by the driver, and the reading of the panel was noted in the log for the review. " * 3
CASES = {
    "prose": PROSE,
    "capitals": PROSE.upper(),
    "wrapped": PROSE.replace("driver, ", "driver,\n").replace("panel ", "panel\n"),
    "unpunctuated": PROSE.replace(".", "").replace(",", ""),
    "chinese": "按照规定，司机必须先确认信号机的状态，再处理继电器，随后恢复列车正常行车。" * 4,
    "with list": PROSE + "\n- lamp\n- relay\n- fuse",
}
OTHER = {
    "list": ["\n".join(f"- worn relay no. {k}" for k in range(9)), "\n".join(f"{k}.1 Relay tests ........ {k}7" for k in range(1, 9)), "\n".join(f"ABC{c} – Replacement relay" for c in "ABCDEFG"), "\n".join(f"Spare signal lamp, oldham{c}" for c in "abcdefg")],
    "table": ["\n".join(f"| r{k} | Oldham | {k}.5 |" for k in range(9)), "\n".join(f"A{k}\tOldham\t{k}\tok" for k in range(12)), "\n".join(f"Reading: {k}{k} V" for k in range(12)), "\n".join(["Asset", "Value", *(x for k in range(12) for x in (f"no. {k}17", "Oldham", f"{k}.5", "A"))])],
    "junk": ["3f9a" * 60, "menu home12 search top menu home search77 top " * 6, "xkvbq wrtz plmk qwrt zxcv bnmk " * 6, "Ã¢â‚¬â„¢Ã©Ã¼ ï¿½ Ã¤Â¸ " * 12, "\n".join(["W& ~", "|.x", "=.3", "o 1"] * 9)],
}


@pytest.fixture(scope="module")
def kinds(spark):
    data = [(f"prose {n}", t) for n, t in CASES.items()] + [(f"{k} {n}", t) for k, ts in OTHER.items() for n, t in enumerate(ts)]
    data += [("prose empty", ""), ("prose blank", " \n\t"), ("none", None), (None, "x"), ("prose prose", PROSE)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], "id string, text string, kind string, t int")
    return {r.id: r for r in q.statistics(df, COMMON).collect()}


def test_kinds(kinds):
    assert "none" not in kinds and {i: r.kind for i, r in kinds.items()} == {i: i.split()[0] for i in kinds}


def test_counts(kinds):
    r = kinds["prose prose"]
    assert (r.n_chars, r.n_words, r.n_lines) == (len(PROSE), 72, 1) and r.stopped_line_share == 1.0 and 0.3 < r.common_word_share < 0.6
    assert kinds["prose empty"].n_chars == kinds["prose empty"].n_words == 0


@pytest.mark.parametrize("size", [3, 17, 64, 200])
def test_pieces_give_the_whole(size):
    rng = random.Random(size)
    common = q.word_hashes([*COMMON, "iσ"])
    for _ in range(40):
        t = "".join(rng.choice(["the ", "relay", "\n", "a", "  ", "\t", "| ", "12", ";", ",x", ".", "é", "联锁", "- ", "x" * 40, "İ", "ΙΣ ", "İΣ", "THE "]) for _ in range(rng.randrange(1, 90)))
        states = q.piece_states([t[k : k + size] for k in range(0, len(t), size)], common)
        mid = len(states) // 2 or 1
        halves = [reduce(lambda a, b: q.merge_states(a, b, common), x) for x in (states[:mid], states[mid:]) if x]
        assert np.allclose(q.finish_state(reduce(lambda a, b: q.merge_states(a, b, common), halves)), q.text_totals([t], common)[0])


def test_lower_case_is_one_for_one(spark):
    """A letter whose lower case has two characters changes nothing around it, whole or in pieces."""
    t = "The relay of THE hut was in the log.\n" * 40
    df = spark.createDataFrame([("plain", t), ("dotted", t + "İ"), ("inside", "İ " + t[:296] + "İİ " + t[296:])], "id string, text string")
    for piece in (1 << 20, 300, 37):
        counts = {r.id: r.n_common for r in q.statistics(df, COMMON, piece=piece).collect()}
        assert set(counts.values()) == {6 * 40}


def test_long_texts_take_linear_time():
    """Cutting a text costs the same for each of its characters, however long it is."""
    def seconds(n):
        t = "The relay was in the log of a hut.\n" * (n // 35)
        began = time.perf_counter()
        assert sum(1 for k in range(0, len(t), q.PIECE) if t[k : k + q.PIECE]) == -(-len(t) // q.PIECE)
        q.piece_states([t[k : k + q.PIECE] for k in range(0, len(t), q.PIECE)][:: max(1, n // 2_000_000)], q.word_hashes(COMMON))
        return time.perf_counter() - began

    seconds(2_000_000)
    assert seconds(16_000_000) < 4 * max(seconds(2_000_000), 0.2)


def test_huge_documents_go_through_the_tree(spark):
    t = (CASES["wrapped"] + "\n" + OTHER["table"][0] + "\n") * 30
    df = spark.createDataFrame([("a", t), ("a", t), ("b", PROSE)], "id string, text string")
    whole, cut = ({r.id: tuple(r) for r in q.statistics(df, COMMON, piece=p, fan=3).collect()} for p in (1 << 20, 500))
    assert whole == cut and len(whole) == 2


def test_empty(spark):
    assert q.statistics(spark.createDataFrame([], "id string, text string"), COMMON).count() == 0


def test_real_chunks_are_split(spark):
    """Chunks as they are exceed a piece, and splitting them changes nothing."""
    sf = "/root/testdata/sf0.01"
    long = q.chunk_texts(spark, sf).where(f"length(text) > {q.PIECE}")
    words = q.common_words(spark, sf)
    split = sorted(map(tuple, q.statistics(long, words).collect()))
    assert len(split) > 0 and split == sorted(map(tuple, q.statistics(long, words, piece=1 << 20).collect()))
