"""Problem 2: per-document text statistics that tell prose from lists, tables and junk.

A text is cut into pieces of at most ``PIECE`` characters.  Every piece gives associative partial counts: totals over
its complete lines, and the state of the unfinished lines at its two ends (counts, first and last characters).  Where
two pieces meet, the joined line is counted anew in a narrow strip around the seam, so the merge gives exactly what the
whole text would give.  Pieces are merged by a tree: groups of ``FAN`` neighbours in any task, then the groups of a text.
A text of one piece has no seam, and its ends are finished where it was counted.  Ratios and rules come last.

Null texts give no row, an empty text gives zero counts and kind ``prose``; repeated rows of an id give one row (rows of
one id hold the same text); columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textvec as tv
from tessera.plans.tables import chunk_texts, table

PIECE = 1 << 12
FAN = 64
#: Characters of a line's ends that the line rules and the seams look at.
EDGE = 64
#: A run of so many characters without a space is encoded data rather than words.
LONG = 30
#: A longer line that opens like a list entry is a paragraph.
ITEM = 160
MIN_CHARS = 80
STEMS = 32

# Character classes.
OTHER, VOWEL, CONSONANT, UPPER, DIGIT, SPACE, TAB, NEWLINE, CJK, STOP, PIPE, SEMI, COMMA, BROKEN, CJK_POINT = range(15)
CODES = 16
# After the character counts, a line has these counts, then one per stem bucket.
WORDS, COMMON, ALPHA, GAPS, COMMAS, SEMIS, LONGS = range(CODES, CODES + 7)
WIDTH = CODES + 7 + STEMS
# Line kinds, and what is summed of each.
BLANK, LIST, TABLE, LONG_LINE, SHORT_LINE, BITS = range(6)
SUMS = ("chars", "lines", "words", "common", "digit_lines")
STOPPED = WIDTH + 6 * len(SUMS)
TOTAL = STOPPED + 1

#: Line openings and closings of lists: bullets, enumerators, section numbers; dot leaders; glossary entries.
ENUM = re.compile(r"\s*(?:[-*+•·▪◦‣»–—]\s+\S|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)]\s+\S|\d{1,3}(?:\.\d{1,3})+\.?\s+\S|\[[ xX\d]{1,3}\]\s)")
LEADER = re.compile(r"(?:\.{4,}|(?:\. ){4,}|…{2,}|_{4,})\s*\d{0,4}\s*$")
GLOSS = re.compile(r"\s*[A-Z][A-Z0-9/&-]{1,9}(?:\s*[–—=:]\s+|\s+-\s+|\s{2,}|\t)[A-Za-z]")
LABEL = re.compile(r"\s*[^\W\d_][\w ./-]{1,24}\s?[:=]\s+\S")

_cache: dict[str, np.ndarray] = {}


def _codes() -> np.ndarray:
    if "codes" not in _cache:
        t = np.zeros(0x110000, np.uint8)
        letter = tv.word_table()
        t[letter] = CONSONANT
        for lo, hi in ((0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000), (0x3040, 0x3100), (0xAC00, 0xD7B0)):
            t[lo:hi] = CJK
        for c in range(0x250):
            if chr(c).isupper():
                t[c] = UPPER
        for chars, code in (("aeiouyäöüéèêàâîôûëïœæ", VOWEL), ("0123456789", DIGIT), (" \r\f\v    　", SPACE), ("\t", TAB), ("\n\0", NEWLINE), (".!?。！？…", STOP), ("|¦", PIPE), (";", SEMI), (",", COMMA), ("ÃÂåâ¤¸½¨¿ï�€™œžŸ¢", BROKEN), ("，；：、（）《》", CJK_POINT)):
            t[[ord(c) for c in chars]] = code
        _cache["codes"] = t
    return _cache["codes"]


def word_hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of single words, to be looked up in the hashes of a text; ``d'un`` is two words."""
    return np.unique(tv.words(words).hash) if words else np.zeros(0, np.uint64)


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def line_counts(texts: list[str], common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of every line of the texts, the text of each line, and each line's length.  Counts are sums over places
    that depend on at most ``EDGE`` characters before and after, which is what lets pieces be joined."""
    cp, start = tv.code_points(texts)
    low = tv.lower_table()[cp]
    code = _codes()[cp]
    new = code == NEWLINE
    line = np.cumsum(new) - new
    n = int(new.sum())
    ends = np.flatnonzero(new)
    out = np.zeros((n, WIDTH))
    out[:, :CODES] = np.bincount(line * CODES + code, minlength=n * CODES).reshape(n, CODES)
    out[:, NEWLINE] = 0
    count = lambda where: np.bincount(line[where], minlength=n)
    inside = tv.word_table()[low]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    ws, we = edge[0::2], edge[1::2]
    prefix = tv.prefix_hash(low)
    out[:, WORDS] = count(ws)
    out[:, COMMON] = count(ws[_among(tv.span_hash(prefix, ws, we), common)])
    alpha = ws[code[ws] != DIGIT]
    out[:, ALPHA] = count(alpha)
    stem_end = np.minimum(we[code[ws] != DIGIT], alpha + 4)
    stem = (tv.span_hash(prefix, alpha, stem_end) % np.uint64(STEMS)).astype(np.int64)
    out[:, WIDTH - STEMS :] = np.bincount(line[alpha] * STEMS + stem, minlength=n * STEMS).reshape(n, STEMS)
    blank = (code == SPACE) | (code == TAB) | new
    solid = ~blank
    out[:, GAPS] = count(np.flatnonzero(solid[:-2] & (code[1:-1] == SPACE) & (code[2:] == SPACE))) if len(code) > 2 else 0
    out[:, COMMAS] = count(np.flatnonzero((code[:-1] == COMMA) & solid[1:]))
    out[:, SEMIS] = count(np.flatnonzero((code[:-1] == SEMI) & solid[1:]))
    wide = solid & (code != CJK) & (code != CJK_POINT) & (code != STOP)
    runs = np.cumsum(wide)
    full = np.flatnonzero(runs[LONG - 1 :] - np.concatenate([[0], runs[:-LONG]]) == LONG) + LONG - 1 if len(runs) >= LONG else np.zeros(0, np.int64)
    out[:, LONGS] = count(full)
    owner = np.searchsorted(start, ends, side="right") - 1
    return out, owner, np.diff(ends, prepend=-1) - 1


def line_kinds(v: np.ndarray, head: list[str], tail: list[str], length: np.ndarray) -> np.ndarray:
    """Kind of each line from its counts and its ends."""
    solid = length - v[:, SPACE] - v[:, TAB]
    match = lambda rx, side: np.fromiter((rx(s) is not None for s in side), bool, len(side))
    enum, leader, gloss = match(ENUM.match, head), match(LEADER.search, tail), match(GLOSS.match, head) & (length <= 90)
    label = match(LABEL.match, head) & (length <= 60)
    grid = (v[:, DIGIT] >= 0.7 * solid) & (v[:, WORDS] >= 3)
    # Running text with odd spaces or marks is no row of fields.
    running = (v[:, WORDS] >= 10) & (v[:, COMMON] >= 0.2 * v[:, WORDS])
    loose = (v[:, GAPS] >= 2) | (v[:, SEMIS] >= 2) | ((v[:, COMMAS] >= 2) & (v[:, COMMAS] * 4 >= v[:, WORDS] - 4))
    columns = (v[:, PIPE] >= 2) | (v[:, TAB] >= 2) | (loose & ~running) | grid
    kind = np.where((solid >= 25) & (v[:, WORDS] >= 4) | (v[:, CJK] >= 8), LONG_LINE, SHORT_LINE)
    kind = np.where(solid <= 4, BITS, kind)
    kind = np.where(label, TABLE, kind)
    kind = np.where(gloss, LIST, kind)
    kind = np.where(columns, TABLE, kind)
    kind = np.where(enum & (length <= ITEM) & ~(v[:, PIPE] >= 2) & ~(v[:, TAB] >= 2), LIST, kind)
    kind = np.where(leader, LIST, kind)
    return np.where(solid == 0, BLANK, kind)


def _ends_stopped(tail: list[str]) -> np.ndarray:
    return np.fromiter(((s := t.rstrip()) != "" and s[-1] in ".!?。！？…:;\"”’')" for t in tail), bool, len(tail))


def _line_totals(v: np.ndarray, kind: np.ndarray, stopped: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Vector of totals that a finished line adds to its text."""
    n = len(v)
    out = np.zeros((n, TOTAL))
    out[:, :WIDTH] = v
    at = WIDTH + kind * len(SUMS)
    row = np.arange(n)
    for k, x in enumerate((length - v[:, SPACE] - v[:, TAB], 1, v[:, WORDS], v[:, COMMON], v[:, DIGIT] > 0)):
        out[row, at + k] = x
    out[:, STOPPED] = stopped & (kind != BLANK)
    return out


@dataclass
class Lines:
    """Every line of some texts: counts, length, ends, what it adds to its text when finished, and each text's first and
    last line."""

    v: np.ndarray
    length: np.ndarray
    head: list[str]
    tail: list[str]
    totals: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _lines(texts: list[str], common: np.ndarray) -> Lines:
    v, owner, length = line_counts(texts, common)
    lines = [x for t in texts for x in re.split("[\n\0]", t)]
    head, tail = [x[:EDGE] for x in lines], [x[-EDGE:] for x in lines]
    totals = _line_totals(v, line_kinds(v, head, tail, length), _ends_stopped(tail), length)
    every = np.arange(len(texts))
    return Lines(v, length, head, tail, totals, np.searchsorted(owner, every), np.searchsorted(owner, every, "right") - 1)


def text_totals(texts: list[str], common: np.ndarray) -> np.ndarray:
    """Totals of whole texts, one row each: all lines are finished."""
    if not texts:
        return np.zeros((0, TOTAL))
    x = _lines(texts, common)
    return np.add.reduceat(x.totals, x.first, axis=0)


# State of a piece: totals of its complete lines, then its open lines: the first, and the last if there is another.
# An open line is its counts, its length and its two ends.


def piece_states(texts: list[str], common: np.ndarray) -> list[dict]:
    """States of pieces: the same lines as in ``text_totals``, of which the first and the last stay open."""
    if not texts:
        return []
    x = _lines(texts, common)
    inner = x.totals.copy()
    inner[x.first] = inner[x.last] = 0
    body = np.add.reduceat(inner, x.first, axis=0)
    line = lambda k: {"v": x.v[k], "n": int(x.length[k]), "head": x.head[k], "tail": x.tail[k]}
    return [{"body": b, "open": [line(i)] if i == j else [line(i), line(j)]} for b, i, j in zip(body, x.first, x.last, strict=True)]


def _join_lines(a: dict, b: dict, common: np.ndarray) -> dict:
    """One line from two neighbouring fragments; places near the seam are counted over."""
    left, right = a["tail"], b["head"]
    both, one, other = line_counts([left + right, left, right], common)[0]
    return {
        "v": a["v"] + b["v"] + both - one - other,
        "n": a["n"] + b["n"],
        "head": (a["head"] + right)[:EDGE] if a["n"] < EDGE else a["head"],
        "tail": (left + b["tail"])[-EDGE:] if b["n"] < EDGE else b["tail"],
    }


def _finish(line: dict) -> np.ndarray:
    v, n = line["v"][None], np.array([line["n"]])
    return _line_totals(v, line_kinds(v, [line["head"]], [line["tail"]], n), _ends_stopped([line["tail"]]), n)[0]


def merge_states(out: dict, s: dict, common: np.ndarray) -> dict:
    """State of two neighbouring pieces as one piece; associative."""
    seam = _join_lines(out["open"][-1], s["open"][0], common)
    body = out["body"] + s["body"]
    if len(out["open"]) == 2 and len(s["open"]) == 2:
        body = body + _finish(seam)
    return {"body": body, "open": [*out["open"][:-1], seam, *s["open"][1:]] if len(out["open"]) + len(s["open"]) < 4 else [out["open"][0], s["open"][1]]}


def finish_state(state: dict) -> np.ndarray:
    return state["body"] + sum(_finish(x) for x in state["open"])


_STATE = "id string, piece long, body array<double>, open array<struct<v:array<double>,n:long,head:string,tail:string>>"


def _state_rows(rows: list[tuple[str, int, dict]]) -> pd.DataFrame:
    return pd.DataFrame([{"id": i, "piece": p, "body": s["body"], "open": [{**x, "v": x["v"].tolist()} for x in s["open"]]} for i, p, s in rows], columns=["id", "piece", "body", "open"])


def _states(f: pd.DataFrame) -> Iterator[tuple[str, int, dict]]:
    for i, p, b, o in zip(f["id"], f["piece"], f["body"], f["open"], strict=True):
        yield i, int(p), {"body": np.array(b), "open": [{"v": np.array(x["v"]), "n": int(x["n"]), "head": x["head"], "tail": x["tail"]} for x in o]}


def totals(records: DataFrame, common_words: list[str], piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """(id, t): vector of totals of each text; repeated rows of an id may give repeated rows."""
    common = word_hashes(common_words)

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["text"].tolist()
            for part in tv.blocks(texts, tv.BLOCK_CHARS // 2):
                yield pd.DataFrame({"id": f["id"].to_numpy()[part], "t": list(text_totals(texts[part], common))})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many = max(1, tv.BLOCK_CHARS // piece)
        for f in frames:
            for i, t in zip(f["id"], f["text"], strict=True):
                for at in range(0, -(-len(t) // piece), many):
                    some = range(at, min(at + many, -(-len(t) // piece)))
                    yield pd.DataFrame({"id": i, "piece": list(some), "text": [t[k * piece : (k + 1) * piece] for k in some]})

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["text"].tolist()
            for part in tv.blocks(texts, tv.BLOCK_CHARS // 2):
                yield _state_rows(list(zip(f["id"].iloc[part], f["piece"].iloc[part], piece_states(texts[part], common), strict=True)))

    def join(frames: Iterator[pd.DataFrame], level: int) -> Iterator[pd.DataFrame]:
        """Neighbours come one after another; a task holds one merged state and the rows it has done."""
        done: list[tuple[str, int, dict]] = []
        key: tuple | None = None
        last, state = -1, {}
        for f in frames:
            for i, p, s in _states(f):
                if key == (i, p // level):
                    if p != last:  # else the piece of a repeated row
                        state = merge_states(state, s, common)
                else:
                    if key is not None:
                        done.append((*key, state))
                    key, state = (i, p // level), s
                last = p
            if len(done) >= 256:
                yield _state_rows(done)
                done = []
        if key is not None:
            done.append((*key, state))
        yield _state_rows(done)

    def end(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(i, finish_state(s)) for i, _, s in _states(f)], columns=["id", "t"])

    records = records.select("id", "text")
    short = records.where(F.length("text") <= piece).mapInPandas(whole, "id string, t array<double>")
    pieces = records.where(F.length("text") > piece).mapInPandas(cut, "id string, piece long, text string")
    states = pieces.repartition("id", "piece").mapInPandas(begin, _STATE)
    groups = states.repartition("id", F.expr(f"piece div {fan}")).sortWithinPartitions("id", "piece").mapInPandas(lambda x: join(x, fan), _STATE)
    # A string holds less than 2**31 characters, so a text has at most 2**31 / (piece * fan) groups, folded one by one.
    long = groups.repartition("id").sortWithinPartitions("id", "piece").mapInPandas(lambda x: join(x, 1 << 62), _STATE)
    return short.unionByName(long.mapInPandas(end, "id string, t array<double>"))


def _at(k: int):  # type: ignore[no-untyped-def]
    return F.col("t")[k]


def _of(kind: int, what: str):  # type: ignore[no-untyped-def]
    return _at(WIDTH + kind * len(SUMS) + SUMS.index(what))


def _ratio(a, b):  # type: ignore[no-untyped-def]
    return F.when(b > 0, a / b).otherwise(0.0)


@dataclass(frozen=True)
class Rules:
    """Thresholds of the rules on a text's ratios.  README has how many kinds change when each is moved."""

    #: Cells: words a line at most, lines with figures at least, lines at least.
    cell_words: float = 2.3
    cell_digits: float = 0.2
    cell_lines: float = 6
    #: Natural text: share of common words, or of ideographs.
    natural_common: float = 0.12
    natural_cjk: float = 0.25
    #: Junk: encoded runs, broken encodings, lines of a few marks, marks, few letters and digits.
    encoded: float = 0.3
    broken: float = 0.12
    bits: float = 0.75
    symbols: float = 0.3
    readable: float = 0.6
    #: Word loops: words at least, share of the six commonest stems, words a line, common words at most.
    loop_words: float = 12
    loop_share: float = 0.85
    loop_line: float = 6
    loop_common: float = 0.25
    #: Letter noise: letters at least, share of vowels and of common words at most.
    noise_letters: float = 40
    noise_vowels: float = 0.29
    noise_common: float = 0.06


def kind_of(r: Rules):  # type: ignore[no-untyped-def]
    """The kind by the rules, as a column over the ratios."""
    c = F.col
    cells = (c("plain_words") <= r.cell_words) & (c("plain_digits") >= r.cell_digits) & (c("plain_lines") >= r.cell_lines)
    natural = ((c("plain_common") >= r.natural_common) & ~cells) | ((c("cjk") >= r.natural_cjk) & (c("cjk_points") >= 1))
    mostly_plain = c("plain") >= 0.5 * c("solid")
    loop = (c("alpha") >= r.loop_words) & (c("loop") >= r.loop_share) & (c("plain_words") >= r.loop_line) & (c("cjk") < r.natural_cjk) & (c("common_word_share") < r.loop_common)
    noise = (c("lower") >= r.noise_letters) & (c("vowels") < r.noise_vowels) & (c("common_word_share") < r.noise_common)
    junk = (
        (c("encoded") > r.encoded)
        | (c("broken") > r.broken)
        | ((c("bits") > r.bits) & (c("table_share") + c("list_share") < 0.5))
        | ((c("symbol_ratio") > r.symbols) & (c("readable") < r.readable))
        | ((loop | noise) & mostly_plain)
    )
    list_chars = c("list_share") * c("solid") + F.when(~natural & ~cells, c("plain")).otherwise(0)
    table_chars = c("table_share") * c("solid") + F.when(~natural & cells, c("plain")).otherwise(0)
    return F.when(c("solid") == 0, "prose").when(junk, "junk").when(natural & mostly_plain, "prose").when(list_chars >= table_chars, "list").otherwise("table")


NAMES = ("n_chars", "n_words", "n_common", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "stopped_line_share", "common_word_share", "list_share", "table_share")


def statistics(records: DataFrame, common_words: list[str], piece: int = PIECE, fan: int = FAN, rules: Rules = Rules()) -> DataFrame:
    """(id, counts and ratios, kind): one row per id with a text."""
    return ratios(records, common_words, piece, fan).withColumn("kind", kind_of(rules)).select("id", *NAMES, "kind").dropDuplicates(["id"])


def ratios(records: DataFrame, common_words: list[str], piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """(id, counts, ratios and what the rules ask for besides)."""
    records = records.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    t = totals(records, common_words, piece, fan)
    over = lambda what, *kinds: sum((_of(k, what) for k in kinds[1:]), _of(kinds[0], what))
    every = (LIST, TABLE, LONG_LINE, SHORT_LINE, BITS)
    plain = (LONG_LINE, SHORT_LINE, BITS)
    solid = over("chars", *every)
    lower = _at(VOWEL) + _at(CONSONANT)
    words = _at(WORDS)
    stems = F.slice("t", WIDTH - STEMS + 1, STEMS)
    top = F.aggregate(F.slice(F.sort_array(stems, asc=False), 1, 6), F.lit(0.0), lambda a, x: a + x)
    symbols = _at(OTHER) + _at(SEMI) + _at(BROKEN) + _at(PIPE)
    return t.select(
        "id",
        (sum((_at(k) for k in range(CODES)), F.lit(0)) + over("lines", BLANK, *every) - 1).cast("long").alias("n_chars"),
        words.cast("long").alias("n_words"),
        _at(COMMON).cast("long").alias("n_common"),
        (over("lines", *every)).cast("long").alias("n_lines"),
        F.round(_ratio(lower + _at(UPPER) + _at(DIGIT) + _at(CJK), words), 6).alias("mean_word_length"),
        F.round(_ratio(symbols, solid), 6).alias("symbol_ratio"),
        F.round(_ratio(_at(DIGIT), solid), 6).alias("digit_ratio"),
        F.round(_ratio(_at(STOPPED), over("lines", *every)), 6).alias("stopped_line_share"),
        F.round(_ratio(_at(COMMON), _at(ALPHA)), 6).alias("common_word_share"),
        F.round(_ratio(_of(LIST, "chars"), solid), 6).alias("list_share"),
        F.round(_ratio(_of(TABLE, "chars"), solid), 6).alias("table_share"),
        solid.alias("solid"),
        over("chars", *plain).alias("plain"),
        over("lines", *plain).alias("plain_lines"),
        _ratio(over("common", *plain), over("words", *plain)).alias("plain_common"),
        _ratio(over("words", *plain), over("lines", *plain)).alias("plain_words"),
        _ratio(over("digit_lines", *plain), over("lines", *plain)).alias("plain_digits"),
        _ratio(_at(CJK) + _at(CJK_POINT), solid).alias("cjk"),
        _at(CJK_POINT).alias("cjk_points"),
        _ratio(_at(LONGS), solid).alias("encoded"),
        _ratio(_at(BROKEN), solid).alias("broken"),
        _ratio(_of(BITS, "lines"), over("lines", *every)).alias("bits"),
        _at(ALPHA).alias("alpha"),
        _ratio(top, _at(ALPHA)).alias("loop"),
        lower.alias("lower"),
        _ratio(_at(VOWEL), lower).alias("vowels"),
        _ratio(lower + _at(UPPER) + _at(DIGIT) + _at(CJK), solid).alias("readable"),
    )


def common_words(spark: SparkSession, sf_dir: str) -> list[str]:
    """The fixed list of frequent words: the rules take at most 10,000, so it may go to every task."""
    rows = table(spark, sf_dir, "common_words").where("word is not null").select(F.lower("word").alias("word")).distinct().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("common_words is meant to be a short list")
    return [r.word for r in rows]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at least 80 characters that are mainly list, table or junk."""
    found = statistics(chunk_texts(spark, sf_dir).where(F.length("text") >= MIN_CHARS), common_words(spark, sf_dir))
    return found.where("kind <> 'prose'").select("id", "kind")


def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(chunk_texts(spark, sf_dir), common_words(spark, sf_dir))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain counts of every chunk: characters, words, frequent words and lines that are not blank."""
    return statistics(chunk_texts(spark, sf_dir), common_words(spark, sf_dir)).select("id", "n_chars", "n_words", "n_common", "n_lines")
