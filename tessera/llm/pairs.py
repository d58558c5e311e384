"""Problem 5: broken prompt and response pairs.

For every defect several noisy labelling functions vote on a record (query, answer and the passages of ``result``): 1 for
the defect, -1 against it, 0 no opinion.  The functions of a defect look at different things.  Spark counts the vote
patterns over all records; an expectation-maximisation label model estimates, per defect, how often it occurs and how
reliable each function is, and gives every pattern its posterior.  A record keeps each defect whose posterior exceeds
that defect's cutoff, so it may have several.  No vote settles a defect by itself.

The number of patterns is bounded by the functions (3 to their number per defect), not by the records.  Null answers are
empty; a null query gives no vote on copying and language; a null ``result`` is no passage; null ids take no part;
repeated rows count in the statistics once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.tables import stored, table

#: Posterior a defect must exceed: the middle of the range that is best on records labelled by hand (``choose_cutoff``; the
#: labels are with the tests).
CUTOFFS = {"empty": 0.46, "truncated": 0.16, "refusal": 0.49, "copy": 0.5, "language": 0.51}
#: Start of the estimation and weight of this start against the data, in records.
PRIOR, HIT, FALSE_HIT, STRENGTH = 0.05, 0.9, 0.02, 50.0
ROUNDS = 200

_PLACEHOLDER = re.compile(
    r"(?:n\s*/?\s*a|none|null|nil|nan|tb[dca]|to ?do|undefined|empty|unanswered|pending|not answered|no (?:answer|response|data|result)s?|keine antwort|pas de réponse|sans réponse|aucune réponse|"
    r"未回答|无|无答案|暂无|待定|没有回答|answer|antwort|réponse|response|reply|a|答案|答|回答)\s*[.:：…]*",
    re.I,
)
_ERROR = re.compile(r"\W*(?:error|exception|traceback|fehler|erreur|错误|(?:internal )?server error|http \d{3}|timed? ?out|[a-z]*(?:error|exception))\b\s*[:：(\[]?", re.I)
_APOLOGY = re.compile(
    r"\W*(?:(?:i|we)(?:['’]m| am| are)? (?:really |very |so )?(?:sorry|afraid)|sorry|apologies|i apologi[sz]e|regrettably|unfortunately|to be honest|at this point|my apologies|"
    r"(?:es )?tut mir leid|leider|bedaure|entschuldigung|ich bedaure|je suis désolé|désolé|malheureusement|je regrette|抱歉|对不起|很遗憾|不好意思|很抱歉)",
    re.I,
)
# Inability or unwillingness in the first person, or nothing to go by.
_DECLINE = re.compile(
    r"\b(?:i|we)(?:['’]m| am| are)? (?:cannot|can['’]?t|can not|could not|couldn['’]t|won['’]?t|will not|do not know|don['’]?t know|have no|lack|am not able|are not able|not able|unable|must decline|decline|am unable|are unable|would rather not|prefer not|am not allowed|not in a position|am not in a position|are not in a position|refuse)\b"
    r"|\bit (?:isn['’]t|is not|wouldn['’]t be|would not be) (?:possible|appropriate)\b|\bthere is no way for (?:me|us)\b|\bno basis on which\b|\bi lack\b|\bno answer can be given\b|\bnothing was found\b|\bcame back empty\b"
    r"|\b(?:isn['’]t|is not|are not|aren['’]t) available to (?:me|us)\b|\boutside what (?:i|we)\b|\bholds nothing\b|\bno (?:relevant|matching|suitable)? ?(?:passage|document|source|result|information|match|answer)s? (?:could|can|was|were|is|are) (?:be )?(?:retrieved|found|given|available)\b|\bno information\b"
    r"|\bich (?:kann|darf|möchte|will|weiß)\b[^.]*\b(?:nicht|keine?n?)\b|\bkann ich\b[^.]*\b(?:nicht|keine?n?)\b|\b(?:liegen|liegt) mir keine?\b|\bkeine (?:auskunft|angaben|informationen|passende)\b|\bnichts gefunden\b"
    r"|\bje (?:ne|n['’])\s?\w+ pas\b|\bje préfère ne pas\b|\bne me (?:permet|permettent) (?:pas )?de répondre\b|\baucune? (?:document|information|passage|réponse|résultat)\b|\bje ne sais pas\b|\bimpossible de répondre\b|\bje refuse\b",
    re.I,
)
_DECLINE_ZH = re.compile(r"无法回答|不能作答|不能回答|无法提供|没有找到|未找到|找不到|没有权限|超出了我的|不知道|无可奉告|拒绝回答|没有相关|无法作答|不便")
_CLOSING = re.compile(r"(?:please (?:consult|contact|ask|provide|try)|is there anything else|thank you|try (?:rephrasing|again)|you could (?:contact|ask|try)|let me know|bitte wenden|veuillez|merci|vielen dank|请提供|请联系|谢谢|您可以)", re.I)
_WRAPPER = re.compile(r"^\W*(?:you asked|the question (?:was|is)|your question(?: was| is)?|question|q|query|frage|die frage (?:war|lautet)|sie fragten|vous avez demandé|la question (?:était|est)|问题|您问的是|你问的是|问)\s*[:：-]\s*", re.I)
_STOPS = {
    "en": frozenset("the of at by was and has is to in for that from with because which were had this be been not on near when an are".split()),
    "de": frozenset("der die das in wurde und nicht bei ist mit nur es ich den dem hat seit zwischen dass von zu auf eine ein weil im nach wenn kann keine mir dazu".split()),
    "fr": frozenset("le la les de est à près par que pas je été du des une un et dans sur ne a qui pour en au ce entre depuis avec après n l d".split()),
}
_BRACKETS = re.compile(r"\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]|【[^【】]*】|“[^“”]{0,40}”|«[^«»]{0,40}»")
_CJK = re.compile(r"[㐀-鿿]")
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?。！？;；:]['\"”’»)\]）】]*\s*$|[)\]）】]['\"”’.]*\s*$")
_ASIDE = re.compile(r"(?:[.!?。！？]\s*[(（\[][^()（）]*|[.!?。！？])[)）\]]['\"”’]*\s*$")
_SHORTENED = re.compile(r"(?:\be\.\s?g|\bi\.\s?e|\bcf|\bvgl|\bz\.\s?B|\bbzw|\bp\.\s?ex|\bno|\bd\.\s?h|\bc\.-à-d|\bNr|\bviz)\.\s*$")
_ENTRY = re.compile(r"^\s*(?:\d{1,3}[.)]|[-*•–]|[a-z][.)])(?:\s+|$)")
_HANGING = re.compile(r"(?:[,(\[（，、：-]|\b(?:the|of|at|by|and|to|in|for|that|a|an|or|because|which|der|die|das|den|dem|und|bei|mit|von|le|la|les|de|du|des|et|que|à|see|is|when))\s*$|(?:…|\.\.\.)\s*$", re.I)


def _closed(text: str, listed: bool = False) -> bool:
    """Does the text end with a closing mark?  A bracket closes a list entry, or running text that had closed before it;
    an abbreviation's point closes nothing."""
    last = text[-60:]  # what closes a text stands at its end
    if not _END.search(last) or _SHORTENED.search(last):
        return False
    return listed or len(text) < 45 or text.rstrip("'\"”’ \n")[-1:] not in ")]）】" or bool(_ASIDE.search(text))


_ENDINGS = {
    "en": re.compile(r"\b[a-zà-ÿ]\w*(?:ed|ing|tion|ly)\b"),
    "de": re.compile(r"\b[a-zà-ÿ]\w*(?:ung|keit|lich|isch|ieb|eit|cht|ä|ö|ü|ß)\b|\b[a-zà-ÿ]?\w*[äöüß]\w*\b"),
    "fr": re.compile(r"\b[a-zà-ÿ]\w*(?:eur|ment|ée?s?|eau|ique|ien|oir)\b|\b[a-zà-ÿ]?\w*[éèêàçù]\w*\b"),
}


class Side:
    """A query or an answer outside its brackets: words, script, and its language by two independent signs."""

    def __init__(self, text: str) -> None:
        self.body = _BRACKETS.sub(" ", text) if any(c in text for c in "()（[【“«") else text
        self.han = 0 if self.body.isascii() else len(_CJK.findall(self.body))
        self.words = _WORD.findall(_CJK.sub(" ", self.body).lower() if self.han else self.body.lower())
        self.letters = sum(map(len, self.words)) + self.han

    @cached_property
    def language(self) -> tuple[str | None, int]:
        """Language by script or frequent words, and how clear it is."""
        if self.han >= 4 and self.han * 2 >= len(self.words):
            return "zh", self.han
        counts = {k: sum(map(v.__contains__, self.words)) for k, v in _STOPS.items()}
        best = sorted(counts, key=counts.__getitem__, reverse=True)
        lead = counts[best[0]] - counts[best[1]]
        return (best[0], lead) if lead >= 1 and (counts[best[0]] >= 2 or len(self.words) <= 6) else (None, 0)

    @cached_property
    def form(self) -> str | None:
        """Language by word endings and letters, independent of the frequent words."""
        if len(self.words) < 4:
            return None
        counts = {k: len(r.findall(self.body)) for k, r in _ENDINGS.items()}
        best = sorted(counts, key=counts.__getitem__, reverse=True)
        return best[0] if counts[best[0]] >= 2 and counts[best[0]] > 2 * counts[best[1]] else None


# One of these stands in every refusing sentence.
_REFUSING = re.compile(r"n['’]t|not|unable|lack|decline|refuse|no |nothing|empty|outside|kein|nich|pas|aucun|impossible|无|不|没|未|找|超出|拒", re.I)


def _grams(s: str, n: int = 3) -> set[str]:
    s = re.sub(r"\W+", " ", s.lower()).strip()
    return {s[k : k + n] for k in range(max(len(s) - n + 1, 1))}


def _core(a: str) -> str:
    return re.sub(r"[\s*_`#>~|\"'“”‘’.…\-–—:：。()（）\[\]​]+", " ", a).strip()


# Words that mean the speaker, in the languages at hand; a factual answer about equipment has none.
_SPEAKER = re.compile(r"\b(?:i|we|me|us|my|our|ich|mir|mich|wir|uns|je|j|nous|moi)\b|我", re.I)
_LETTERS = {"de": frozenset("äöüß"), "fr": frozenset("éèêàâçùûîïôœ")}


class Record:
    """A pair with what its functions look at."""

    def __init__(self, query: str | None, answer: str | None, result: list[str]) -> None:
        self.query, self.answer, self.result = query or "", answer or "", result
        self.text = self.answer.strip()
        self.core = _core(self.answer)
        self.bare = _WRAPPER.sub("", self.text)
        self.size = len(self.bare) / max(len(self.query), 1)
        self.sents = [s for s in re.split(r"(?<=[.!?])\s+|(?<=[。！？])|\n+", self.text) if s.strip()]
        self.said, self.asked = Side(self.text), Side(self.query)
        self.lines = [x for x in self.text.split("\n") if x.strip()]
        self.listed = len(self.lines) >= 1 and sum(bool(_ENTRY.match(x)) for x in self.lines) * 2 > len(self.lines)

    @cached_property
    def overlap(self) -> tuple[float, float]:
        """Shares of the answer's, and of the query's, three-character runs that the other has."""
        # A text many times as long as the query holds more than the query.
        if len(self.query) < 8 or len(self.bare) < 8 or len(self.bare) > 8 * len(self.query):
            return 0.0, 0.0
        a, q = _grams(self.bare), _grams(self.query)
        same = len(a & q)
        return same / max(len(a), 1), same / max(len(q), 1)

    @cached_property
    def refusing(self) -> list[bool]:
        """Which sentences decline something or report finding nothing."""
        return [bool(_REFUSING.search(s) and (_DECLINE.search(s) or _DECLINE_ZH.search(s))) for s in self.sents]

    @cached_property
    def passages(self) -> set[str]:
        return set(_TOKENS.findall(" ".join(self.result).lower()))

    @cached_property
    def sentence(self) -> bool:
        """Does the answer have running words of its own, which a placeholder or a message of a program has not?"""
        return self.said.letters >= 12 and len(self.tokens[0]) >= 4 and not _ERROR.match(self.text)

    @cached_property
    def tokens(self) -> tuple[list[str], list[str]]:
        """Words and figures of answer and query; ideographs one by one."""
        cut = lambda x: _TOKENS.findall(x.lower())
        return cut(self.bare), cut(self.query)


_FIGURED = re.compile(r"[^\W_㐀-鿿]*\d[^\W_㐀-鿿]*")
_TOKENS = re.compile(r"[㐀-鿿]|[^\W㐀-鿿]+")
Vote = Callable[[Record], int]


# Empty: a mark, a stock phrase, an error, or words that have nothing to do with the question.


def _no_text(r: Record) -> int:
    return 1 if not any(c.isalnum() for c in r.core) else -1 if len(r.core) > 40 else 0


def _placeholder(r: Record) -> int:
    return 1 if _PLACEHOLDER.fullmatch(r.core) else -1 if len(r.core) > 40 else 0


def _error(r: Record) -> int:
    """A message by its form: it opens as one, and no sentence of an answer comes after it."""
    if not _ERROR.match(r.text):
        return -1 if len(r.core) > 40 else 0
    rest = [s for s in r.sents[1:] if len(s.split()) >= 5 and _END.search(s[-60:]) and not re.search(r"[A-Za-z_]+\(|[/\\][\w.]+|\bline \d+", s)]
    return 0 if rest else 1


def _grounded(r: Record) -> int:
    """Words of the answer, of a few letters at least, that the question or a passage has too."""
    own = {x for x in r.tokens[0] if len(x) >= 4 or "㐀" <= x[0] <= "鿿"}
    if not own:
        return 0
    known = own & set(r.tokens[1])
    if len(known) < 2 and r.result:
        known |= own & r.passages
    return -1 if len(known) >= 2 else 0


# Truncated: by the last mark, the last word, the last entry, the brackets, the last sentence's length, the passage.


def _open_end(r: Record) -> int:
    """No closing mark after running text; where the text is the question's, its end tells nothing."""
    if r.listed or r.overlap[0] >= 0.85:
        return 0
    long = len(r.text) >= 45 or len(_CJK.findall(r.text)) >= 15
    return -1 if _closed(r.text) else 1 if long else -1 if len(r.text) < 30 else 0


def _hanging(r: Record) -> int:
    """The last word or mark calls for more."""
    last = r.text[-60:]
    if _SHORTENED.search(last):
        return 1
    if len(r.tokens[0]) > 3 and not _ENTRY.sub("", r.lines[-1]).strip():  # a number without its entry
        return 1
    return -1 if last[-1:] in tuple(".!?。！？") and last[-3:] != "..." else 1 if len(r.tokens[0]) > 3 and _HANGING.search(last) else 0


def _open_entry(r: Record) -> int:
    """The last entry of a list is cut, unlike the others."""
    if not r.listed or not r.lines or len(r.tokens[0]) < 4:
        return 0
    last, rest = r.lines[-1], r.lines[:-1]
    body = _ENTRY.sub("", last).strip()
    if rest and not _END.search(last[-60:]) and all(_END.search(x[-60:]) for x in rest):
        return 1
    if len(body) < 3 or (rest and len(body) < 0.35 * min(len(_ENTRY.sub("", x)) for x in rest)):
        return 1
    return -1


def _unclosed(r: Record) -> int:
    """An opened bracket never closes."""
    return 1 if sum(r.text.count(c) for c in "(（[") > sum(r.text.count(c) for c in ")）]") else 0


def _short_last(r: Record) -> int:
    """The last sentence has far fewer words than the shortest before it; an aside in brackets is none."""
    if r.listed or len(r.sents) < 2 or r.sents[-1].lstrip()[:1] in tuple("(（["):
        return 0
    size = [max(len(s.split()), len(_CJK.findall(s)) // 2) for s in r.sents]
    return 1 if size[-1] < 0.5 * min(size[:-1]) else -1 if size[-1] > 0.8 * min(size[:-1]) else 0


def _goes_on(r: Record) -> int:
    """A passage has the answer's last words and goes on inside the sentence."""
    tail = " ".join(r.text[-40:].split())
    if len(tail) < 20:
        return 0
    for x in r.result:
        x = " ".join(x.split())
        at = x.find(tail)
        if at >= 0:
            rest = x[at + len(tail) :]
            return 1 if rest[:1].isalnum() or (rest[:1] == " " and rest[1:2].islower()) else -1
    return 0


def _whole_value(r: Record) -> int:
    """A value or a name alone, or the question given back, is whole."""
    return -1 if len(r.core.split()) <= 3 and len(r.core) < 30 or r.overlap[0] >= 0.85 and r.size <= 2.4 else 0


# Refusals: by what is declined, an apology, the speaker, facts, an offer, other sentences.


def _declines(r: Record) -> int:
    return 1 if any(r.refusing) else -1


def _apologises(r: Record) -> int:
    return 1 if _APOLOGY.match(r.text) else 0


def _speaker(r: Record) -> int:
    return 1 if _SPEAKER.search(r.text) else -1


def _states_facts(r: Record) -> int:
    """Figures the question has not; a refusal gives none."""
    return -1 if set(_FIGURED.findall(r.bare.lower())) - set(_FIGURED.findall(r.query.lower())) else 0


def _offers(r: Record) -> int:
    return 1 if r.sents and _CLOSING.search(r.sents[-1]) else 0


def _brief(r: Record) -> int:
    return -1 if len(r.text) > 260 or r.listed else 0


def _answers_too(r: Record) -> int:
    """After what is declined another sentence of some length follows that declines and offers nothing."""
    if not r.sents:
        return 0
    other = [s for s, no in zip(r.sents, r.refusing, strict=True) if not no and not _CLOSING.search(s) and not _APOLOGY.match(s) and (len(s.split()) >= 7 or len(_CJK.findall(s)) >= 10)]
    return -1 if other else 1 if len(r.text) >= 12 and not r.listed else 0


# Copies: by characters, words, order, and what is added.


def _contained(r: Record) -> int:
    if not r.query:
        return 0
    inside = r.overlap[0]
    return 1 if inside >= 0.85 and r.size <= 2.4 else -1 if inside < 0.7 or r.size > 2.6 else 0


def _same_words(r: Record) -> int:
    if not r.query:
        return 0
    if r.size > 4:
        return -1
    a, q = map(set, r.tokens)
    same = len(a & q) / max(len(a | q), 1)
    return 1 if same >= 0.7 and r.size <= 2.4 else -1 if same < 0.45 else 0


def _same_order(r: Record) -> int:
    """The query's words come in a row, whatever stands around them."""
    a, q = r.tokens
    if len(q) < 3:
        return 0
    if len(a) > 3 * len(q):
        return -1
    runs = {tuple(a[k : k + 3]) for k in range(len(a) - 2)}
    share = sum(tuple(q[k : k + 3]) in runs for k in range(len(q) - 2)) / (len(q) - 2)
    return 1 if share >= 0.7 and len(a) <= 2.4 * len(q) else -1 if share < 0.3 else 0


def _adds(r: Record) -> int:
    """Words the query has not: a real answer has several, and so has a passage it draws on."""
    if not r.query:
        return 0
    a, q = r.tokens
    new = set(a) - set(q)
    many = max(3, 0.3 * len(set(q)))
    return -1 if len(new) > many or (len(new) > 1 and r.result and 2 * len(new & r.passages) > len(a)) else 0 if len(a) < 0.5 * len(q) else 1


# Languages: by frequent words, script, word endings, and letters.


def _other_language(r: Record) -> int:
    (a, clear), (q, _) = r.said.language, r.asked.language
    if not a or not q or not r.sentence:
        return 0
    return -1 if a == q else 1 if clear >= 2 or len(r.text) < 60 else 0


def _other_script(r: Record) -> int:
    if not r.query or not r.sentence:
        return 0
    share = [x.han / max(x.letters, 1) for x in (r.said, r.asked)]
    return 1 if abs(share[0] - share[1]) > 0.3 and min(share) < 0.1 else -1 if min(share) > 0.2 else 0


def _other_form(r: Record) -> int:
    """By the endings of words, on both sides."""
    a, q = r.said.form, r.asked.form
    return 0 if not a or not r.sentence or not q or r.asked.han or r.said.han else 1 if a != q else -1


def _other_letters(r: Record) -> int:
    """Letters that only one language has, in several words of the answer, against the query's frequent words."""
    q = r.asked.language[0]
    if not q or not r.sentence or q == "zh" or r.said.han:
        return 0
    marks = {k: sum(not v.isdisjoint(w) for w in r.said.words) for k, v in _LETTERS.items()}
    top = max(marks, key=marks.__getitem__)
    if marks[top] >= 2 and marks[top] > 2 * min(marks.values()):
        return -1 if top == q else 1
    return 0


FUNCTIONS: dict[str, tuple[Vote, ...]] = {
    "empty": (_no_text, _placeholder, _error, _grounded),
    "truncated": (_open_end, _hanging, _open_entry, _unclosed, _short_last, _goes_on, _whole_value),
    "refusal": (_declines, _apologises, _speaker, _states_facts, _offers, _brief, _answers_too),
    "copy": (_contained, _same_words, _same_order, _adds),
    "language": (_other_language, _other_script, _other_form, _other_letters),
}


def votes(records: DataFrame) -> DataFrame:
    """(id, defect, votes): the functions' votes as text such as ``+0-``, one row per distinct record and defect."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[tuple[int, str, str]] = []
            for i, q, a, p in zip(f["id"], f["query"], f["answer"], f["passages"], strict=True):
                r = Record(q, a, [x for x in p if x] if p is not None else [])
                out += [(i, d, "".join("-0+"[v(r) + 1] for v in fs)) for d, fs in FUNCTIONS.items()]
            yield pd.DataFrame(out, columns=["id", "defect", "votes"])

    passages = F.col("result.content") if "result" in records.columns else F.lit(None).cast("array<string>")
    distinct = records.where("id is not null").select("id", "query", "answer", passages.alias("passages")).distinct()
    return distinct.mapInPandas(run, "id long, defect string, votes string")


def label_model(patterns: list[str], counts: np.ndarray) -> np.ndarray:
    """Posterior of the defect for each vote pattern, by expectation-maximisation.

    Functions are independent given the truth; of each, how often it votes for the defect when it votes is estimated for
    either truth, and an abstention tells nothing.  The start is worth ``STRENGTH`` records, which keeps rare defects
    from drifting.
    """
    if not patterns:
        return np.zeros(0)
    x = np.array([["-0+".index(c) - 1 for c in p] for p in patterns])
    n = counts.astype(float)
    m = x.shape[1]
    yes, no, rate = np.full(m, HIT), np.full(m, FALSE_HIT), PRIOR
    p = np.zeros(len(x))
    for _ in range(ROUNDS):
        likely = lambda hit: (np.log(hit) * (x > 0) + np.log(1 - hit) * (x < 0)).sum(axis=1)
        odds = np.log(rate) + likely(yes) - np.log(1 - rate) - likely(no)
        new = 1 / (1 + np.exp(np.clip(-odds, -500, 500)))
        rate = (STRENGTH * PRIOR + (new * n).sum()) / (STRENGTH + n.sum())
        share = lambda w, start: (STRENGTH * start + (w * n) @ (x > 0)) / (STRENGTH + (w * n) @ (x != 0))
        yes, no = np.clip(share(new, HIT), 1e-4, 1 - 1e-4), np.clip(share(1 - new, FALSE_HIT), 1e-4, 1 - 1e-4)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p


def choose_cutoff(posterior: np.ndarray, truth: np.ndarray) -> tuple[float, float, float]:
    """(cutoff, precision, recall) with the best F1 on labelled records: the middle of the widest range of best cutoffs."""
    edges = np.unique(np.concatenate([[0.0], posterior, [1.0]]))
    found = posterior[None, :] > edges[:-1, None]
    both = (found & truth[None, :]).sum(axis=1)
    precision, recall = both / np.maximum(found.sum(axis=1), 1), both / max(int(truth.sum()), 1)
    f1 = 2 * precision * recall / np.maximum(precision + recall, 1e-12)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.diff(edges)[best].argmax()]
    return float((edges[k] + edges[k + 1]) / 2), float(precision[k]), float(recall[k])


def judged(records: DataFrame) -> tuple[DataFrame, pd.DataFrame]:
    """The stored votes (id, defect, votes), and of every pattern (defect, votes) the records, the posterior and whether
    most votes are for the defect."""
    cast = stored(votes(records))
    patterns = cast.groupBy("defect", "votes").agg(F.count("*").alias("records")).orderBy("defect", "votes").toPandas()
    patterns["posterior"] = 0.0
    for _, group in patterns.groupby("defect"):
        patterns.loc[group.index, "posterior"] = label_model(group["votes"].tolist(), group["records"].to_numpy())
    patterns["majority"] = [v.count("+") > v.count("-") for v in patterns["votes"]]
    return cast, patterns


def defects(records: DataFrame, cutoffs: dict[str, float] = CUTOFFS) -> DataFrame:
    """(id, defect, votes, posterior) of every record and defect whose posterior exceeds the cutoff."""
    cast, patterns = judged(records)
    rows = [(r.defect, r.votes, float(r.posterior)) for r in patterns.itertuples() if r.posterior > cutoffs[r.defect]]
    kept = records.sparkSession.createDataFrame(rows, "defect string, votes string, posterior double")
    return cast.join(F.broadcast(kept), ["defect", "votes"]).select("id", "defect", "votes", F.round("posterior", 6).alias("posterior"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(table(spark, sf_dir, "qa_records")).select("id", "defect").distinct()


def p5_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each defective record with the votes and the posterior."""
    return defects(table(spark, sf_dir, "qa_records")).groupBy("id", "defect").agg(F.max("posterior").alias("posterior"), F.min("votes").alias("votes"))


def p5_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the label model makes of each vote pattern, and what a majority of the votes would."""
    _, patterns = judged(table(spark, sf_dir, "qa_records"))
    rows = [(r.defect, r.votes, int(r.records), round(float(r.posterior), 6), bool(r.posterior > CUTOFFS[r.defect]), bool(r.majority)) for r in patterns.itertuples()]
    return spark.createDataFrame(rows, "defect string, votes string, records long, posterior double, flagged boolean, majority boolean")
