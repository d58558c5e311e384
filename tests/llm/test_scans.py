from __future__ import annotations

import random

import pytest

from tessera.llm import scans as s

SENTENCES = ["the driver reported that the signal failed again", "because the current returned the panel was locked", "the dispatcher called within the hour to release the route", "a fault-tolerant relay was tested near the barrier", "which engineer was at the machine that day", "the reading of 512 volts was taken over 2048 seconds"]


def wrap(words, rng):
    lines, cur = [], ""
    for w in words:
        if len(cur) + len(w) > 40:
            if len(w) > 5 and rng.random() < 0.6:
                k = rng.randrange(2, len(w) - 2)
                if w[k - 1] != "-" and w[k] != "-":
                    lines.append(cur + w[:k] + rng.choice(["-", "‐", "\xad", "¬", "- "]))
                    cur = w[k:] + " "
                    continue
            lines.append(cur.rstrip())
            cur = ""
        cur += w + " "
    return [*lines, cur.rstrip()]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    chunks, pages, plain = [], [], []
    for k in range(40):
        body = []
        for n in (1, 2):
            words = " ".join(rng.choice(SENTENCES) for _ in range(12)).split()
            words = [*words[:-1], words[-1] + "."]
            body.append((n, "\n".join([f"Oldham Works Bulletin | Issue {k + 3}", f"- {n} -", "", *wrap(words, rng)])))
        chunks.append((f"c{k}", "\n".join(f"--- Page {n} ---\n{t}" for n, t in body)))
        pages += [(f"p{k}", t) for _, t in body]
        plain += [(f"t{k}", ". ".join(SENTENCES * 4))]
    noisy = "--- Page 1 ---\nOldham Works Bulletin | Issuc 9\n- 1O -\n\nthe drivcr rep0rted a fau1t in route\n4l7 and 1O29 of the mach-\n--- Page 2 ---\nOldham Works Bulletin | Issue 8\n- 2 -\n\nine. The fault-\ntolerant relay HLN 2295 was witliin the barner.\n\nNew paragraph."
    chunks += [("noisy", noisy), ("noisy", noisy), ("none", None), ("empty", ""), (None, "x")]
    direct = spark.createDataFrame([(*c, "clash") for c in chunks], "id string, text string, item string").where("id is not null and text is not null").dropDuplicates(["id"])
    texts = spark.createDataFrame([*plain, *chunks], "id string, text string").where("text is not null")
    extra = spark.createDataFrame(pages, "path string, text string")
    ev = s.evidence(direct, texts, extra)
    return direct, ev, s.defects(ev)


def test_defects(world):
    got = {(r.defect, r.item) for r in world[2].where("id = 'noisy'").collect()}
    assert got == {
        ("furniture", "Oldham Works Bulletin | Issuc 9"), ("furniture", "- 1O -"), ("furniture", "Oldham Works Bulletin | Issue 8"), ("furniture", "- 2 -"),
        ("misread", "issue"), ("misread", "10"), ("misread", "driver"), ("misread", "reported"), ("misread", "fault"), ("misread", "417"), ("misread", "1029"), ("misread", "within"), ("misread", "barrier"),
        ("split_word", "machine"), ("split_word", "fault-tolerant"),
    }


def test_whole_words_come_back(world):
    known = {w.strip(".") for x in SENTENCES for w in x.split()}
    items = [r.item for r in world[2].where("defect = 'split_word' and id <> 'noisy'").collect()]
    assert len(items) > 50 and set(items) <= known
    assert world[2].where("defect = 'misread' and id <> 'noisy'").count() == 0
    assert world[2].where("defect = 'furniture' and id <> 'noisy'").count() == 120  # two page numbers and one header a chunk


def test_repair(world):
    got = {r.id: r.text for r in s.repaired(*world[:1], world[2], world[1]).collect()}
    assert got["noisy"] == "the driver reported a fault in route 417 and 1029 of the machine. The fault-tolerant relay HLN 2295 was within the barrier.\n\nNew paragraph."
    assert got["empty"] == "" and "Bulletin" not in got["c0"] and "\n" not in got["c0"].replace("\n\n", "")


def test_anagram_differences_are_edits():
    for wrong, right in s.CONFUSIONS:
        word = f"x{wrong}yz"
        assert f"x{right}yz" in s._replaced(word, ((wrong, right),))
        assert s._value(f"x{right}yz") - s._value(word) == s._value(right) - s._value(wrong)


def test_empty(spark):
    none = spark.createDataFrame([], "id string, text string")
    ev = s.evidence(none, none, none)
    assert s.defects(ev).count() == 0 and s.repaired(none, s.defects(ev), ev).count() == 0


def test_copies_weigh_once(spark):
    """A misread text that is loaded again, copied under other ids and kept as a page is still outnumbered by the right word."""
    plain = [(f"t{k}", f"Report {k}: the driver reported that the signal failed again.") for k in range(12)]
    page = "The drivcr reported that the signal failed again."
    copies = [(f"c{k}", f"--- Page 1 ---\n{page}") for k in range(30)]
    scans = spark.createDataFrame(copies, "id string, text string")
    texts = spark.createDataFrame([*plain, *copies * 3], "id string, text string")
    ev = s.evidence(scans, texts, spark.createDataFrame([(page,)] * 20, "text string"))
    assert [tuple(r) for r in ev.fixes.collect()] == [("drivcr", "driver")]
    assert s.defects(ev).where("defect = 'misread' and item = 'driver'").count() == 30
    assert {r.word: r.n for r in ev.words.where("word in ('driver', 'drivcr')").collect()} == {"driver": 12, "drivcr": 1}


def test_copied_page_is_no_running_line(spark):
    """A line at the edge of one page is no running line because the page has copies."""
    text = "Oldham Works | Issue 3\n\n" + "\n".join(SENTENCES)
    scans = spark.createDataFrame([(f"c{k}", f"--- Page {k} ---\n{text}\n") for k in range(20)], "id string, text string")
    assert s.evidence(scans, scans, spark.createDataFrame([(text,)], "text string")).places.count() == 0


def test_no_length_is_too_long(spark):
    """A word of 45 letters is put together and corrected, a header of 100 characters and 14 words is a running line."""
    rng = random.Random(3)
    long = "betriebsleitzentralenschaltanlagenprotokollen"
    header = "Regional Works Bulletin Of The Northern Lines And Branches | Volume 12 | Section B | Printed At Oldham | No. 7"
    assert len(long) == 45 and len(header) > 100
    filler = lambda: " ".join(rng.choice(SENTENCES) for _ in range(3)) + "."
    pages = [f"{header}\n\n{filler()}\nthe {long} of day {k}\n{filler()}" for k in range(20)]
    wrong = long.replace("anlagen", "aniagen")
    noisy = f"--- Page 1 ---\n{header}\n\n{filler()}\nthe {wrong} and the {long[:30]}-\n{long[30:]} of the day\n{filler()}"
    scans = spark.createDataFrame([*((f"c{k}", f"--- Page 1 ---\n{t}") for k, t in enumerate(pages)), ("noisy", noisy)], "id string, text string")
    ev = s.evidence(scans, scans, spark.createDataFrame([], "text string"))
    got = {(r.defect, r.item) for r in s.defects(ev).where("id = 'noisy'").collect()}
    assert got == {("furniture", header), ("misread", long), ("split_word", long)}


def test_what_no_frequent_form_explains_stays(spark):
    """Codes and words with figures are left alone without evidence, and no token is its own correction."""
    page = "The abc2d unit and the mp3s of covid19x were tested at word7s.\nThe code I45 was read, and B7.\nThe driver came."
    scans = spark.createDataFrame([(f"c{k}", f"--- Page 1 ---\n{page}\nLine {k}") for k in range(20)], "id string, text string")
    found = s.defects(s.evidence(scans, scans, spark.createDataFrame([], "text string"))).where("defect = 'misread'")
    assert found.count() == 0
    ev = s.evidence(scans, scans, spark.createDataFrame([], "text string"))
    assert ev.fixes.where("word = right").count() == 0
