"""Problem 8: reading level of each document.

Every sentence of running text gets a distribution over the three bands from a regularised linear model of its words and
character four-grams; a document's mean sentence distribution, weighted by words, goes through a second, calibrated model
to its difficulty (0 easy to 1 demanding) and its band.  Both models are fitted on a bounded sample of labelled documents
(``MAX_LABELLED`` of at most ``MAX_CHARS`` characters, by hash order); every document is scored from its whole text.

Headings, list entries and table rows are not running text.  Null or empty texts and texts without a sentence have a
null difficulty and band.  Labels with nulls are left out, repeated label rows count once, raters who disagree share the
label's weight.  Without any labels the result is null levels.  Other columns are ignored.
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
from tessera.llm.quality import _among, word_hashes
from tessera.plans.tables import table

BANDS = ("basic", "middle", "advanced")
#: Labelled documents the models are fitted on, at most, and how long one may be to be among them: 30 million characters in
#: all.
MAX_LABELLED, MAX_CHARS = 1500, 20_000
#: Share of a language's frequent words that settles it for a line.
CLEAR = 0.12
GRAM = 4
BITS = 15
PENALTY = 2e-5
ROUNDS = 60

_BREAK = re.compile(r"(?<=[.!?])[\"”’')\]]*\s+(?=[\"“‘'(]?[A-ZÄÖÜÉÈÀÇ])|\n+")
_WRAP = re.compile(r"(?<![.!?:;|\n])\n(?=[a-z0-9(])")
_ROW = ("\t", "|", "   ", "....")
_ITEM = re.compile(r"(?:[-*•–]\s|\(?(?:\d{1,3}|[a-z]|[ivx]{1,4})[.)]\s)")


def _row(s: str) -> bool:
    """Fields of a table, or dot leaders."""
    return any(x in s for x in _ROW) or s.count(";") >= 3


def sentences(text: str) -> list[str]:
    """Sentences of the running text: at least four words, closed by a full stop or long enough to be a cut sentence.
    A text without any is read line by line."""
    out = []
    for s in _BREAK.split(_WRAP.sub(" ", text)):
        s = s.strip()
        if s.count(" ") >= 3 and (s[-1] in ".!?\"”')" or s.count(" ") >= 11) and not _row(s) and not (_ITEM.match(s) and len(s) < 160):
            out.append(s)
    return out or [s for x in text.split("\n") if (s := x.strip(" -*•–\t\r")).count(" ") >= 2 and not _row(s)]


@dataclass
class Features:
    """Hashed features of sentences: words, four-grams, and two for the lengths that weigh ``extra`` times.  Indexes stand
    sentence by sentence; ``n_words`` and ``n_grams`` say how many each has."""

    word: np.ndarray
    gram: np.ndarray
    n_words: np.ndarray
    n_grams: np.ndarray
    length: np.ndarray
    size: np.ndarray
    extra: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return self.n_words + self.n_grams + 2 * self.extra


def features(sents: list[str]) -> Features:
    w = tv.words(sents)
    per = w.per_text
    n = max(len(w.cp) - GRAM + 1, 0)
    x = w.cp.astype(np.uint64)
    g = np.zeros(n, np.uint64)
    for k in range(GRAM):
        g = (g + x[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
    # A gram lies inside its sentence if the separator, which is NUL, is not among its characters.
    ends = w.text_start[1:] - 1
    inside = np.ones(n, bool)
    for k in range(GRAM):
        inside[ends[(ends - k >= 0) & (ends - k < n)] - k] = False
    grams = np.maximum(np.diff(w.text_start) - 1 - (GRAM - 1), 0)
    letters = np.concatenate([[0], np.cumsum(w.end - w.start)])
    size = (letters[w.first[1:]] - letters[w.first[:-1]]) / np.maximum(per, 1) * 4
    base = 2 << BITS
    return Features(
        (w.hash & np.uint64((1 << BITS) - 1)).astype(np.int32),
        (g[inside] >> np.uint64(64 - BITS)).astype(np.int32) + (1 << BITS),
        per,
        grams,
        base + np.minimum(per, 63),
        base + 64 + np.minimum(size, 63).astype(np.int64),
        # Length of the sentence and of its words stand for an eighth of its features.
        np.maximum((per + grams) // 16, 1),
    )


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of rows, empty groups included."""
    out = np.zeros((len(counts), values.shape[1]), np.float64)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0)
    return out


FEATURES = (2 << BITS) + 128


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sentence_bands(f: Features, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Distribution over the bands of each sentence."""
    z = _sums(weights[f.word], f.n_words) + _sums(weights[f.gram], f.n_grams) + f.extra[:, None] * (weights[f.length] + weights[f.size])
    return _softmax(z / f.count[:, None] + bias)


def fit_sentences(f: Features, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression with an L2 penalty on mean-pooled features, by Adam over the whole sample."""
    w, b = np.zeros((FEATURES, len(BANDS)), np.float32), np.zeros(len(BANDS), np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    every = np.arange(len(f.count))
    parts = [(f.word, np.repeat(every, f.n_words), 1.0), (f.gram, np.repeat(every, f.n_grams), 1.0), (f.length, every, f.extra), (f.size, every, f.extra)]
    mass = target.sum()
    for k in range(1, ROUNDS + 1):
        d = (sentence_bands(f, w, b) * target.sum(axis=1, keepdims=True) - target) / mass
        gb = d.sum(axis=0)
        d = d / f.count[:, None]
        g = np.stack([sum(np.bincount(index, d[row, c] * times, FEATURES) for index, row, times in parts) for c in range(len(BANDS))], axis=1) + PENALTY * w
        for x, y, p, q in ((g, w, m, v), (gb, b, mb, vb)):
            p *= 0.9
            p += 0.1 * x
            q *= 0.99
            q += 0.01 * x * x
            y -= 0.5 * (p / (1 - 0.9**k)) / (np.sqrt(q / (1 - 0.99**k)) + 1e-8)
    return w, b


def fit_documents(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Calibration: multinomial logistic regression of the document's band on its mean sentence distribution."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((x.shape[1], len(BANDS)))
    for _ in range(2000):
        w -= 1.0 * (x.T @ (_softmax(x @ w) * target.sum(axis=1, keepdims=True) - target) / target.sum() + 1e-3 * w)
    return w


@dataclass
class Model:
    weights: np.ndarray
    bias: np.ndarray
    calibration: np.ndarray

    def documents(self, means: np.ndarray) -> np.ndarray:
        return _softmax(np.hstack([means, np.ones((len(means), 1))]) @ self.calibration)


def document_means(texts: list[str], weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean sentence distribution of each text weighted by words, its words of running text and its sentences."""
    sents = [sentences(t) for t in texts]
    flat = [s for x in sents for s in x]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in sents])
    mean, words = np.zeros((len(texts), len(BANDS))), np.zeros(len(texts))
    for part in tv.blocks(flat):
        f = features(flat[part])
        p = sentence_bands(f, weights, bias) * f.n_words[:, None]
        words += np.bincount(owner[part], f.n_words, len(texts))
        for c in range(len(BANDS)):
            mean[:, c] += np.bincount(owner[part], p[:, c], len(texts))
    return mean / np.maximum(words, 1)[:, None], words, np.bincount(owner, minlength=len(texts))


def fit(texts: list[str], target: np.ndarray) -> Model:
    """Sentence model on two thirds of the labelled texts, calibration on the rest (on all where there are few)."""
    third = np.arange(len(texts)) % 3 == 2 if len(texts) >= 30 else None
    learn = np.flatnonzero(~third) if third is not None else np.arange(len(texts))
    check = np.flatnonzero(third) if third is not None else learn
    sents = [sentences(texts[k]) for k in learn]
    flat = [s for x in sents for s in x]
    each = np.repeat(target[learn], [len(x) for x in sents], axis=0)
    if not flat:
        return Model(np.zeros((FEATURES, len(BANDS)), np.float32), np.zeros(len(BANDS), np.float32), np.zeros((len(BANDS) + 1, len(BANDS))))
    w, b = fit_sentences(features(flat), each)
    mean, words, _ = document_means([texts[k] for k in check], w, b)
    return Model(w, b, fit_documents(mean[words > 0], target[check][words > 0]))


def labelled(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> pd.DataFrame:
    """(text, basic, middle, advanced): at most ``limit`` labelled documents with the shares of their raters' bands; longer
    ones than ``MAX_CHARS`` are not taken."""
    votes = labels.where(F.col("doc_id").isNotNull() & F.col("band").isin(*BANDS)).select("doc_id", "rater", "band").distinct()
    shares = votes.groupBy("doc_id").agg(*[F.avg((F.col("band") == b).cast("double")).alias(b) for b in BANDS])
    short = documents.where(F.col("text").isNotNull() & (F.length("text") <= MAX_CHARS))
    some = shares.join(short.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = short.select("doc_id", "text")
    return texts.join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()


def levels(documents: DataFrame, labels: DataFrame, words_by_lang: dict[str, list[str]], limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, language, n_sentences, n_words, difficulty, band): one row per row of documents with a doc_id."""
    sample = labelled(documents, labels, limit)
    model = fit(sample["text"].tolist(), sample[list(BANDS)].to_numpy(float)) if len(sample) else None
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    langs = sorted(words_by_lang)
    sets = [word_hashes(words_by_lang[x]) for x in langs]

    def language(texts: list[str], stated: list[str | None]) -> list[str | None]:
        """By script, by the frequent words of most lines, else as stated, else English if plain Latin letters."""
        w = tv.words(texts)
        # Lines where a language's frequent words have a clear share count for it with all their words.
        line = np.cumsum((w.cp == 10) | (w.cp == 0))[w.start]
        n_lines = int(line[-1]) + 1 if len(line) else 0
        size = np.bincount(line, minlength=n_lines)
        share = np.zeros((len(texts), max(len(sets), 1)))
        for c, x in enumerate(sets):
            clear = np.bincount(line[_among(w.hash, x)], minlength=n_lines) >= CLEAR * np.maximum(size, 1)
            share[:, c] = np.bincount(w.owner[clear[line]], minlength=len(texts)) / np.maximum(w.per_text, 1)
        owner = np.repeat(np.arange(len(texts)), np.diff(w.text_start))
        letters = tv.word_table()[w.cp]
        count = lambda where: np.bincount(owner[where], minlength=len(texts)) / np.maximum(np.bincount(owner[letters], minlength=len(texts)), 1)
        han, accents = count(letters & (w.cp >= 0x3400) & (w.cp < 0xA000)), count(letters & (w.cp > 0x7F))
        out: list[str | None] = []
        for k, said in enumerate(stated):
            said = (said or "").strip().lower()[:2]
            best = int(share[k].argmax())
            if han[k] > 0.3:
                out.append("zh")
            elif langs and share[k, best] >= 0.5:
                out.append(langs[best])
            elif not w.per_text[k]:
                out.append(None)
            else:
                out.append(said if said in langs else "en" if accents[k] < 0.005 else langs[best] if langs and share[k, best] > 0 else None)
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for f in frames:
            texts = f["text"].fillna("").tolist()
            for part in tv.blocks(texts, tv.BLOCK_CHARS // 2):
                some = texts[part]
                mean, words, n = document_means(some, model.weights, model.bias) if model else (np.zeros((len(some), 3)), np.zeros(len(some)), np.zeros(len(some), int))
                p = model.documents(mean) if model else mean
                known = words > 0
                band = np.array(BANDS, object)[p.argmax(axis=1)]
                yield pd.DataFrame(
                    {
                        "doc_id": f["doc_id"].to_numpy()[part],
                        "language": language(some, f["lang"].tolist()[part]),
                        "n_sentences": n.astype(np.int64),
                        "n_words": words.astype(np.int64),
                        "difficulty": np.where(known, np.round(p @ np.array([0.0, 0.5, 1.0]), 6), np.nan),
                        "band": np.where(known, band, None),
                    }
                )

    stated = F.col("lang") if "lang" in documents.columns else F.lit(None)
    out = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text", stated.cast("string").alias("lang")).mapInPandas(run, "doc_id long, language string, n_sentences long, n_words long, difficulty double, band string")
    return out.withColumn("difficulty", F.when(~F.isnan("difficulty"), F.col("difficulty")))


def frequent_words(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """The fixed list of frequent words by language (at most 10,000 words)."""
    rows = table(spark, sf_dir, "common_words").where("word is not null and lang is not null").select("lang", F.lower("word").alias("word")).distinct().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("common_words is meant to be a short list")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r.lang, []).append(r.word)
    return out


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"), frequent_words(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents whose running text as a whole is advanced."""
    return p8_levels(spark, sf_dir).where("language = 'en' and band = 'advanced'").select("doc_id").distinct()
