"""Problem 1: noise in text from scanned pages, repaired into continuous paragraphs.

* Running lines: a line at a page's edge whose shape (words, numbers and marks, misread figures folded) stands nearly
  only at page edges over all pages, and more often there than chance would have any of the shapes.
* Words broken over lines or pages: a line ends in a hyphen mark.  Counts over all texts of the closed and of the
  hyphenated form decide whether the hyphen belongs to the word.
* Misread characters: every rare word of the scans is joined, in SQL, with frequent words whose anagram hash differs by
  the difference of one or two known confusions; matches are verified and ranked by the number of confusions and the
  frequency.  Numbers are joined in the same way by their pattern, in which every figure is alike: a rare pattern such as
  figure-l-figure with the frequent one of figures only.  What no frequent form explains is left as it stands.

Null texts and ids take no part, blank pages have no lines, an empty table gives no rows.  Whatever is counted is counted
over distinct pages and texts: rows loaded again, texts copied under other ids and pages that stand in a chunk and in the
table of pages weigh once.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bitmap
from tessera.llm import textvec as tv
from tessera.plans.tables import chunk_texts, stored, table

PAGE = re.compile(r"^\s*-{3}\s*Page\s+\d+\s*-{3}\s*$")
#: The same for Spark, over all lines of a text.
_PAGES = r"(?mdU)^[^\S\n]*-{3}[^\S\n]*Page[^\S\n]+\d+[^\S\n]*-{3}[^\S\n]*$"
#: Lines next to a page's edge that may be running lines.
EDGE_LINES = 3
#: A shape is a running line's if it stands at edges so many times as often as inside pages, and if lines put at random
#: would put any shape at edges only, as often as it was seen, with less than this chance.
EDGE_ODDS, CHANCE = 12, 0.01
#: A frequent word, or pattern of a number, outnumbers its misreadings at least so many times; a word that has figures in
#: it is no word, so there the right one need only be so much more frequent.
OUTNUMBER, OUTNUMBER_MIXED = 8, 2

# Character confusions of optical recognition, as read and as printed.
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("cl", "d"), ("q", "g"), ("li", "h"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("n", "ri"),
    ("ii", "u"), ("d", "cl"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("3", "e"), ("b", "h"), ("h", "b"),
)
FIGURES = {"l": "1", "I": "1", "O": "0", "o": "0"}
LETTERS = ({"0": "o", "1": "l", "5": "s", "6": "b", "8": "b", "9": "g", "3": "e"}, {"0": "o", "1": "i", "5": "s", "6": "b", "8": "b", "9": "g", "3": "e"})

_MARK = re.compile(r"(\S*[^\W_])([-‐‑­¬])[^\S\n]*$")
_HYPHENS = frozenset("-‐‑\xad¬")
_LOWER = re.compile(r"(?:^|\s)[a-kmnp-z]")
_FIGURE = re.compile(r"[\dlIOo]*\d[\dlIOo]*")
_TOKEN = re.compile(r"[^\W_]+")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")


def _break(line: str) -> re.Match | None:
    """The word and the hyphen mark at the end of a line."""
    return _MARK.search(line) if line.rstrip()[-1:] in _HYPHENS else None


def shape(line: str) -> str:
    """Shape of a line: figures as #, words by their case, other marks as they are."""

    def one(m: re.Match) -> str:
        t = m.group()
        if (_FIGURE.fullmatch(t) and not (t[0].isupper() and t[0] not in "IO")) or (len(t) <= 3 and set(t) <= set("lIO")):
            return "#"
        letters = [c for c in t if c.isalpha()]
        if not letters:
            return "#"
        if len(letters) > 1 and all(c.isupper() for c in letters):
            return "XX"
        return "Xx" if letters[0].isupper() else "x"

    return " ".join(_TOKEN.sub(one, line.strip()).split())


def _may_run(s: str) -> bool:
    """Shapes worth counting: few lower-case words, a figure or a capital, and no end of a clause."""
    words = s.split()
    return len(words) > 0 and s[-1] not in ".,;" and ("#" in s or "X" in s) and sum(w == "x" or w.startswith("x") for w in words) <= 1


@dataclass
class Page:
    """Lines of one page; ``place`` is the line's index in the text."""

    lines: list[tuple[int, str]] = field(default_factory=list)

    def edges(self) -> tuple[list[int], list[int]]:
        solid = [k for k, (_, x) in enumerate(self.lines) if x.strip()]
        head = solid[:EDGE_LINES]
        return head, [k for k in solid[-EDGE_LINES:][::-1] if k not in head]


def pages(text: str) -> list[Page]:
    out = [Page()]
    for k, x in enumerate(text.split("\n")):
        if "---" in x and PAGE.match(x):
            out.append(Page())
        else:
            out[-1].lines.append((k, x))
    return [p for p in out if any(x.strip() for _, x in p.lines)]


def distinct_pages(texts: DataFrame) -> DataFrame:
    """(text, scan): every page of the texts once, without white space around it, and whether any scan has it; a text without
    page lines is one page."""
    parts = texts.where("text is not null").select(F.explode(F.split("text", _PAGES)).alias("text"), "scan")
    return parts.select(F.expr(r"btrim(text, ' \n\r\t')").alias("text"), "scan").where("text <> ''").groupBy("text").agg(F.max("scan").alias("scan"))


def _count_shapes(texts: list[str], counts: dict[str | None, list[int]]) -> None:
    """Lines at edges and inside pages by shape; under None all lines that are not blank."""
    for t in texts:
        for p in pages(t):
            head, foot = p.edges()
            edge = {*head, *foot}
            for k, (_, x) in enumerate(p.lines):
                if not x.strip():
                    continue
                counts.setdefault(None, [0, 0])[k not in edge] += 1
                # Two words in lower case already make running text.
                if len(_LOWER.findall(x)) < 2 and _may_run(s := shape(x)):
                    counts.setdefault(s, [0, 0])[k not in edge] += 1


def running_shapes(counts: DataFrame) -> DataFrame:
    """(shape) of running lines over all scanned pages.

    A shape seen k times at edges only would be so by chance with probability share ** k, share being the part of all
    lines that stand at edges; over all shapes that must be less than ``CHANCE``.
    """
    sums = counts.where("kind = 'shape'").select(F.col("key").alias("shape"), F.col("n").alias("edge"), "inner")
    n, edge, inner = sums.agg(F.count("shape"), F.max(F.when(F.col("shape").isNull(), F.col("edge"))), F.max(F.when(F.col("shape").isNull(), F.col("inner")))).first()
    share = (edge or 0) / max((edge or 0) + (inner or 0), 1)
    # Short pages are all edge; a shape must then be seen as often as if half of the lines were.
    least = math.log(max(n, 1) / CHANCE) / math.log(1 / min(max(share, 0.1), 0.5))
    return sums.where(F.col("shape").isNotNull() & (F.col("edge") >= least) & (F.col("edge") >= EDGE_ODDS * F.col("inner"))).select("shape")


def running_places(scans: DataFrame, running: DataFrame) -> DataFrame:
    """(id, places): which lines at the page edges of each text have the shape of a running line."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, t in zip(f["id"], f["text"], strict=True):
                for p in pages(t):
                    for edge in p.edges():
                        for k in edge:
                            place, x = p.lines[k]
                            if len(_LOWER.findall(x)) >= 2 or not _may_run(s := shape(x)):
                                break  # a running line has nothing but running lines between itself and the edge
                            rows.append((i, place, s))
            yield pd.DataFrame(rows, columns=["id", "place", "shape"])

    lines = scans.select("id", "text").mapInPandas(run, "id string, place int, shape string")
    return lines.join(running, "shape").groupBy("id").agg(F.collect_set("place").alias("places"))


@dataclass
class Reading:
    """What a scanned text holds: running lines, broken words and the words of its body in order."""

    furniture: list[str] = field(default_factory=list)
    #: (left, right) of each broken word, as whole strings without outer punctuation.
    broken: list[tuple[str, str]] = field(default_factory=list)
    #: Body lines in order; None between paragraphs; a line that ends in a break is followed by its continuation.
    body: list[str | None] = field(default_factory=list)


def read(text: str, running: set[int]) -> Reading:
    """``running`` has the places of the lines at page edges that have the shape of a running line."""
    out = Reading()
    for p in pages(text):
        drop: set[int] = set()
        for edge in p.edges():
            for k in edge:
                if p.lines[k][0] not in running:
                    break
                drop.add(k)
        out.furniture += [p.lines[k][1].strip() for k in sorted(drop)]
        kept = [x for k, (_, x) in enumerate(p.lines) if k not in drop]
        while kept and not kept[0].strip():
            kept.pop(0)
        while kept and not kept[-1].strip():
            kept.pop()
        # A page ends a paragraph only if its last line is closed.
        if out.body and kept and out.body[-1] is not None and re.search(r"[.!?:。！？]['\"”’)]*\s*$", out.body[-1]):
            out.body.append(None)
        for x in kept:
            if x.strip():
                out.body.append(x)
            elif out.body and out.body[-1] is not None and not _break(out.body[-1]):
                out.body.append(None)
    for a, b in zip(out.body, out.body[1:]):
        if a is None or b is None or not (m := _break(a)):
            continue
        right = b.split(None, 1)[0]
        left, right = _OUTER.sub("", m.group(1)), _OUTER.sub("", right)
        if left and right and right[0].isalnum():
            out.broken.append((left, right))
    return out


def _tokens(r: Reading) -> list[str]:
    """Words of the running lines and of the body, broken words closed up."""
    out = [t for x in r.furniture for t in _TOKEN.findall(x)]
    parts: list[str] = []
    for k, x in enumerate(r.body):
        if x is None:
            parts.append("\n")
        elif k + 1 < len(r.body) and r.body[k + 1] is not None and (m := _break(x)):
            parts.append(x[: m.start(2)])
        else:
            parts.append(x + "\n")
    return out + _TOKEN.findall("".join(p.lstrip() for p in parts))


def _suspect(t: str) -> bool:
    """Tokens that may be misread words: letters, or letters with figures inside, but no letter-figure codes."""
    if len(t) < 2 or (t.isupper() and len(t) <= 3):
        return False
    figures = sum(c.isdigit() for c in t)
    return figures == 0 or (t.lower() != t.upper() and any(c.islower() for c in t) and figures < len(t) - figures + 1) or (len(t) > 4 and figures <= 2 and t[0].isalpha() and t[-1].isalpha())


def pattern(t: str, in_furniture: bool = False) -> str | None:
    """Pattern of a token that is a number, or may be one with misread characters: every figure is a 9, and what may be a
    misread figure stays.  In a running line short tokens without any figure may be numbers too."""
    if not t.isdigit() and not (any(c.isdigit() for c in t) and _FIGURE.fullmatch(t)) and not (in_furniture and len(t) <= 3 and set(t) <= set("lIO") and t not in ("I", "O", "II", "III")):
        return None
    return "".join("9" if c.isdigit() else c for c in t)


def _count_words(texts: list[str], total: Counter[str]) -> None:
    """Words of letters, and pairs of words closed up by a hyphen, as ``a-b``."""
    for part in tv.blocks(texts):
        w = tv.words(texts[part])
        if not len(w.hash):
            continue
        chars = w.cp.tobytes()
        text = lambda a, b: chars[4 * a : 4 * b].decode("utf-32-le", "replace")  # noqa: E731, B023
        figure = (w.cp >= 48) & (w.cp <= 57)
        before = np.concatenate([[0], np.cumsum(figure)])
        _, first, count = np.unique(w.hash, return_index=True, return_counts=True)
        plain = before[w.end[first]] - before[w.start[first]] == 0
        for k, n in zip(first[plain], count[plain], strict=True):
            total[text(w.start[k], w.end[k])] += int(n)
        pair = np.flatnonzero((w.start[1:] == w.end[:-1] + 1) & (w.cp[w.end[:-1]] == 45))
        both = tv.mix(w.hash[pair] * np.uint64(3) + w.hash[pair + 1])
        _, first, count = np.unique(both, return_index=True, return_counts=True)
        at = pair[first]
        plain = before[w.end[at + 1]] - before[w.start[at]] == 0
        for k, n in zip(at[plain], count[plain], strict=True):
            total[text(w.start[k], w.end[k + 1])] += int(n)


def counted(pages_: DataFrame) -> DataFrame:
    """The stored counts (kind, key, n, inner) over distinct pages: of every word, and of every shape of lines in scans, at
    edges as n and inside pages as inner."""
    columns = ["kind", "key", "n", "inner"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()
        shapes: dict[str | None, list[int]] = {}

        def rows() -> pd.DataFrame:
            some = [("word", x, n, 0) for x, n in words.items()] + [("shape", x, a, b) for x, (a, b) in shapes.items()]
            words.clear()
            shapes.clear()
            return pd.DataFrame(some, columns=columns)

        for f in frames:
            _count_words(f["text"].tolist(), words)
            _count_shapes(f["text"][f["scan"]].tolist(), shapes)
            if len(words) + len(shapes) > 200_000:
                yield rows()
        yield rows()

    sums = pages_.mapInPandas(run, "kind string, key string, n long, inner long").groupBy("kind", "key")
    return stored(sums.agg(F.sum("n").alias("n"), F.sum("inner").alias("inner")))


_READ = (
    "id string, furniture array<string>, lefts array<string>, rights array<string>, tokens array<struct<place:string,token:string,pattern:string>>, "
    "patterns array<struct<place:string,pattern:string,n:int>>, words array<string>, counts array<int>"
)
_READ_COLUMNS = ["id", "furniture", "lefts", "rights", "tokens", "patterns", "words", "counts"]


def readings(scans: DataFrame, places: DataFrame) -> DataFrame:
    """One row a scanned text: running lines, halves of broken words, tokens that may be misread numbers, the patterns of
    all numbers with their counts, and the words that may be misread, in lower case, with their counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[tuple] = []
            for i, t, marks in zip(f["id"], f["text"], f["places"], strict=True):
                r = read(t, set() if marks is None else set(marks))
                seen = Counter(_tokens(r))
                shown = Counter(x for y in r.furniture for x in _TOKEN.findall(y))
                tokens, patterns = set(), Counter()
                words: Counter[str] = Counter()
                for place, some in (("text", seen), ("furniture", shown)):
                    for x, n in some.items():
                        if p := pattern(x, place == "furniture"):
                            patterns[place, p] += n
                            if not x.isdigit():
                                tokens.add((place, x, p))
                        elif place == "text" and _suspect(x):
                            words[x.lower()] += n
                broken = set(r.broken)
                numbers = [{"place": a, "pattern": b, "n": n} for (a, b), n in patterns.items()]
                out.append((i, sorted(set(r.furniture)), [a for a, _ in broken], [b for _, b in broken], [{"place": a, "token": x, "pattern": b} for a, x, b in tokens], numbers, list(words), list(words.values())))
            yield pd.DataFrame(out, columns=_READ_COLUMNS)

    return scans.select("id", "text").join(places, "id", "left").mapInPandas(run, _READ)


def one_of_alike(read_: DataFrame, scans: DataFrame) -> DataFrame:
    """Readings of one text of those that are alike."""
    one = scans.groupBy(F.sha2("text", 256).alias("key")).agg(F.min("id").alias("id")).select("id")
    return read_.join(one, "id", "left_semi")


def scan_words(read_: DataFrame) -> DataFrame:
    """(word, n): words of the scanned texts that may be misread."""
    return read_.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))


def scan_numbers(read_: DataFrame) -> DataFrame:
    """(place, pattern, n): patterns of the numbers in the scanned texts, in running lines and altogether."""
    return read_.select(F.explode("patterns").alias("x")).groupBy("x.place", "x.pattern").agg(F.sum("x.n").alias("n"))


def _anagram(word):  # type: ignore[no-untyped-def]
    """Anagram hash: the sum of the characters' fifth powers; equal for anagrams, and additive for replacements."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: a + F.when(c == "", 0).otherwise(F.pow(F.pmod(F.ascii(c), F.lit(1024)), F.lit(5)).cast("long")))


def _value(s: str) -> int:
    return sum(ord(c) ** 5 for c in s)


def _replaced(word: str, changes: tuple[tuple[str, str], ...]) -> set[str]:
    """All words that come of applying each change once, at places that don't overlap."""
    found = {(word, frozenset())}
    for wrong, right in changes:
        nxt = set()
        for w, used in found:
            at = w.find(wrong)
            while at >= 0:
                span = set(range(at, at + len(wrong)))
                if not span & used:
                    shift = len(right) - len(wrong)
                    moved = frozenset(p if p < at else p + shift for p in used) | frozenset(range(at, at + len(right)))
                    nxt.add((w[:at] + right + w[at + len(wrong) :], moved))
                at = w.find(wrong, at + 1)
        found = nxt
    return {w for w, _ in found}


def _exchanged(word: Column, table_: dict[str, str]) -> Column:
    """How the anagram hash changes when every character that the table has is exchanged."""
    change = F.lit(0).cast("long")
    for wrong, right in table_.items():
        change = change + (F.length(word) - F.length(F.replace(word, F.lit(wrong), F.lit("")))) * F.lit(_value(right) - _value(wrong))
    return change


def corrections(suspects: DataFrame, frequent: DataFrame) -> DataFrame:
    """(word, right): rare words with the frequent word they are a misreading of, one each.

    ``suspects`` and ``frequent`` have word and n; the join is on the anagram hash plus the confusion's difference: of one
    confusion, of two, or of all figures in the word at once.
    """
    singles = [((a, b),) for a, b in CONFUSIONS]
    doubles = [(x, y) for k, (x,) in enumerate(singles) for (y,) in singles[k:]]
    changes = [*singles, *doubles]
    table_ = F.array(
        *[F.struct(F.lit(k).alias("k"), F.lit(c[0][0]).alias("w"), F.lit(c[-1][0]).alias("v"), F.lit(sum(_value(b) - _value(a) for a, b in c)).cast("long").alias("d")) for k, c in enumerate(changes)]
    )
    word = F.col("word")
    nothing = F.array().cast("array<struct<k:int,w:string,v:string,d:bigint>>")
    every = F.array(*[F.struct(F.lit(len(changes) + k).alias("k"), F.lit("").alias("w"), F.lit("").alias("v"), _exchanged(word, x).alias("d")) for k, x in enumerate(LETTERS)])
    known = frequent.select(word.alias("right"), F.col("n").alias("right_n"), _anagram(word).alias("h"))
    rare = suspects.join(frequent.select("word", F.col("n").alias("seen")), "word", "left")
    rare = rare.select("word", F.greatest("n", F.coalesce("seen", F.lit(0))).alias("n"), _anagram(word).alias("own"), word.rlike("[0-9]").alias("mixed"))
    one_or_two = F.filter(table_, lambda x: F.contains(word, x["w"]) & F.contains(word, x["v"]))
    tried = rare.select("word", "n", "own", "mixed", F.explode(F.concat(one_or_two, F.when(F.col("mixed"), every).otherwise(nothing))).alias("x"))
    met = tried.select("word", "n", "mixed", F.col("x.k").alias("k"), (F.col("own") + F.col("x.d")).alias("h")).join(known, "h")
    met = met.where((F.col("right_n") >= F.when(F.col("mixed"), OUTNUMBER_MIXED).otherwise(OUTNUMBER) * F.col("n")) & (F.col("word") != F.col("right")))
    tables = [str.maketrans(x) for x in LETTERS]

    @F.pandas_udf("boolean")
    def reads(word: pd.Series, right: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([r in _replaced(w, changes[c]) if c < len(changes) else w.translate(tables[c - len(changes)]) == r for w, r, c in zip(word, right, k, strict=True)], dtype=bool)

    best = Window.partitionBy("word").orderBy("few", F.desc("right_n"), "right")
    sure = met.where(reads("word", "right", "k")).withColumn("few", (F.col("k") >= len(singles)).cast("int"))
    # Two confusions in a short word prove little.
    sure = sure.where((F.col("few") == 0) | (F.length("word") >= 6) | F.col("mixed"))
    ranked = sure.withColumn("rank", F.row_number().over(best)).where("rank = 1")
    return ranked.select("word", "right")


def number_patterns(numbers: DataFrame) -> DataFrame:
    """(place, pattern): rare patterns with misread characters whose anagram hash, all characters exchanged for figures, is
    that of a pattern of figures only that outnumbers them."""
    of = F.col("pattern")
    figures = {wrong: "9" for wrong in FIGURES}
    mixed = numbers.where(~of.rlike("^9+$")).select("place", "pattern", F.col("n"), F.length(of).alias("size"), (_anagram(of) + _exchanged(of, figures)).alias("h"))
    plain = numbers.where(of.rlike("^9+$")).select("place", F.col("n").alias("right_n"), F.length(of).alias("size"), _anagram(of).alias("h"))
    return mixed.join(plain, ["place", "size", "h"]).where(F.col("right_n") >= OUTNUMBER * F.col("n")).select("place", "pattern")


@dataclass
class Evidence:
    """Everything the corpus says about its scans: places of running lines, word counts, corrections, the readings."""

    places: DataFrame
    words: DataFrame
    fixes: DataFrame
    numbers: DataFrame
    readings: DataFrame


def evidence(scans: DataFrame, texts: DataFrame, extra_pages: DataFrame) -> Evidence:
    """``scans`` are the scanned texts, ``texts`` all texts, ``extra_pages`` pages of scans that are not among the texts.  Where
    ``texts`` has a flag ``scan`` it tells the scanned ones, so these need not be read once more."""
    flag = F.coalesce("scan", F.lit(False)) if "scan" in texts.columns else F.lit(False)
    each = [(texts, flag), (extra_pages, F.lit(True)), *([] if "scan" in texts.columns else [(scans, F.lit(True))])]
    pages_ = reduce(DataFrame.unionByName, [d.select("text", scan.alias("scan")) for d, scan in each])
    counts = counted(distinct_pages(pages_))
    words = counts.where("kind = 'word'").select(F.col("key").alias("word"), "n")
    places = stored(running_places(scans, running_shapes(counts)))
    read_ = stored(readings(scans, places))
    alike = one_of_alike(read_, scans)
    return Evidence(places, words, stored(corrections(scan_words(alike), words)), stored(number_patterns(scan_numbers(alike))), read_)


def suspects(ev: Evidence) -> DataFrame:
    """(id, token): words that may be in the corrections, by a bitmap of these."""
    known = bitmap.build(ev.fixes.select(F.crc32(F.col("word").cast("binary")).alias("h")), "h")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[tuple] = []
            for i, words in zip(f["id"], f["words"], strict=True):
                hit = bitmap.contains(known, np.fromiter((zlib.crc32(x.encode()) for x in words), np.int64, len(words)))
                out += [(i, x) for x, h in zip(words, hit, strict=True) if h]
            yield pd.DataFrame(out, columns=["id", "token"])

    return ev.readings.select("id", "words").mapInPandas(run, "id string, token string")


def joined_words(pairs: DataFrame, ev: Evidence) -> DataFrame:
    """(a, b, whole): how the halves of a broken word are put together, by the counts of the closed and of the
    hyphenated form, either as read or corrected."""
    fix = ev.fixes
    fa, fb = fix.select(F.col("word").alias("a"), F.col("right").alias("ra")), fix.select(F.col("word").alias("b"), F.col("right").alias("rb"))
    p = pairs.select("a", "b").distinct().withColumn("shut", F.concat("a", "b"))
    p = p.join(fix.select(F.col("word").alias("shut"), F.col("right").alias("rs")), "shut", "left").join(fa, "a", "left").join(fb, "b", "left")
    p = p.select("a", "b", F.coalesce("rs", "shut").alias("shut"), F.concat(F.coalesce("ra", "a"), F.lit("-"), F.coalesce("rb", "b")).alias("hyphened"))
    count = lambda name: ev.words.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    p = p.join(count("shut"), "shut", "left").join(count("hyphened"), "hyphened", "left")
    keep = F.coalesce("n_hyphened", F.lit(0)) > F.coalesce("n_shut", F.lit(0))
    return p.select("a", "b", F.when(keep, F.col("hyphened")).otherwise(F.col("shut")).alias("whole"))


def defects(ev: Evidence) -> DataFrame:
    """(id, defect, item, token, left, right): token is the misread string, left and right the halves of a broken word."""
    rows, none = ev.readings, F.lit(None).cast("string")
    furniture = rows.select("id", F.lit("furniture").alias("defect"), F.explode("furniture").alias("item"), none.alias("token"), none.alias("left"), none.alias("right"))
    numbers = rows.select("id", F.explode("tokens").alias("x")).select("id", "x.place", "x.token", "x.pattern").join(ev.numbers, ["place", "pattern"])
    right = F.translate("token", "".join(FIGURES), "".join(FIGURES.values()))
    numbers = numbers.select("id", F.lit("misread").alias("defect"), right.alias("item"), "token", none.alias("left"), none.alias("right"))
    words = suspects(ev).join(ev.fixes.select(F.col("word").alias("token"), F.col("right").alias("item")), "token")
    words = words.select("id", F.lit("misread").alias("defect"), "item", "token", none.alias("left"), none.alias("right"))
    broken = rows.select("id", F.explode(F.arrays_zip("lefts", "rights")).alias("x")).select("id", F.col("x.lefts").alias("left"), F.col("x.rights").alias("right"))
    last, first = F.element_at(F.split(F.lower("left"), "[-‐‑]"), -1), F.element_at(F.split(F.lower("right"), "[-‐‑]"), 1)
    broken = broken.withColumn("a", last).withColumn("b", first)
    broken = broken.join(joined_words(broken, ev), ["a", "b"])
    before = F.lower(F.expr("substring(left, 1, length(left) - length(a))"))
    after = F.lower(F.expr("substring(right, length(b) + 1)"))
    broken = broken.select("id", F.lit("split_word").alias("defect"), F.concat(before, "whole", after).alias("item"), none.alias("token"), "left", "right")
    return furniture.unionByName(numbers).unionByName(words).unionByName(broken)


def repaired(scans: DataFrame, found: DataFrame, ev: Evidence) -> DataFrame:
    """(id, text): continuous paragraphs, without running lines, broken words put together, misread characters put right."""
    of = lambda defect, key: F.map_from_entries(F.collect_set(F.when(F.col("defect") == defect, F.struct(key.alias("key"), "item"))))
    marks = found.where("defect <> 'furniture'").groupBy("id").agg(of("misread", F.col("token")).alias("tokens"), of("split_word", F.concat_ws("\n", "left", "right")).alias("wholes"))

    def cased(like: str, word: str) -> str:
        letters = [c for c in like if c.isalpha()]
        if len(letters) > 1 and all(c.isupper() for c in letters):
            return word.upper()
        return word[:1].upper() + word[1:] if letters and letters[0].isupper() else word

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for t, marks, tokens, whole in zip(f["text"], f["places"], f["tokens"], f["wholes"], strict=True):
                tokens, whole = dict(tokens) if tokens is not None else {}, dict(whole) if whole is not None else {}
                r = read(t, set() if marks is None else set(marks))
                paragraphs: list[list[str]] = [[]]
                lines, k = list(r.body), 0
                while k < len(lines):
                    x = lines[k]
                    if x is None:
                        paragraphs.append([])
                    else:
                        while k + 1 < len(lines) and lines[k + 1] is not None and (m := _break(x)):
                            first, _, rest = lines[k + 1].lstrip().partition(" ")
                            left, right = _OUTER.sub("", m.group(1)), _OUTER.sub("", first)
                            item = whole.get(left + "\n" + right)
                            if item is None or not left or not right:
                                break
                            cut = m.start(1) + m.group(1).find(left)
                            x = x[:cut] + cased(left, item) + first[first.find(right) + len(right) :] + (" " + rest if rest else "")
                            k += 1
                        paragraphs[-1].append(x)
                    k += 1

                def fix(m: re.Match, tokens: dict = tokens) -> str:
                    x = m.group()
                    right = tokens.get(x, tokens.get(x.lower()))
                    return x if right is None else right if right.isdigit() else cased(x, right)

                out.append("\n\n".join(_TOKEN.sub(fix, " ".join(" ".join(p).split())) for p in paragraphs if p))
            yield pd.DataFrame({"id": f["id"], "text": out})

    return scans.select("id", "text").join(ev.places, "id", "left").join(marks, "id", "left").mapInPandas(run, "id string, text string")


def _inputs(spark: SparkSession, sf_dir: str, kinds: str) -> tuple[DataFrame, Evidence]:
    texts = chunk_texts(spark, sf_dir)
    pages_ = table(spark, sf_dir, "scan_pages").where("text is not null")
    direct = F.coalesce(F.col("load_method") == "direct", F.lit(False))
    if kinds == "direct":
        texts = texts.withColumn("scan", direct)
    else:
        paths = pages_.where("path is not null").select(F.col("path").alias("source_path"), F.lit(True).alias("known")).distinct()
        texts = texts.join(paths, "source_path", "left").withColumn("scan", direct | F.coalesce("known", F.lit(False)))
    scans = texts.where("scan")
    scans = stored(scans.select("id", "text").dropDuplicates(["id"]))
    return scans, evidence(scans, texts, pages_.select("text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct defects of the chunks loaded directly from scans."""
    scans, ev = _inputs(spark, sf_dir, "direct")
    return defects(ev).select("id", "defect", "item").distinct()


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired text of every chunk of a scanned file."""
    scans, ev = _inputs(spark, sf_dir, "all")
    return repaired(scans, defects(ev), ev)
