"""Problem 6: passages of evaluation items inside training documents.

Spaced-seed hashing: every window of 14 words is hashed under a few fixed masks, each of which ignores some of the 14
positions, on both sides, and the hashes are joined.  Hits are gathered by diagonal (document position minus item
position), so a window that differs in a word still hits under the masks that ignore it; windows that hit under every
mask are equal word for word, as the masks together cover all positions.

A word is a maximal run of letters or digits in lower case; case, punctuation and white space do not matter.  Null or
short texts hold no window and give no rows; null ids take no part; repeated rows change nothing; other columns are
ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bitmap
from tessera.llm import textvec as tv
from tessera.plans.tables import stored, table

RUN = 14
#: Positions that count in each mask; together they cover the window, and each pair of neighbours is ignored by one.
MASKS = ("11101100110111", "10110111101011", "11011011011101")
#: Share of equal words that an overlap with substitutions must reach, beside a full run's worth of equal words.
TOLERANCE = 0.8

_rng = np.random.default_rng(20240606)
_PLACE = _rng.integers(1, 1 << 63, (len(MASKS), RUN), dtype=np.uint64) | np.uint64(1)


def seed_hashes(texts: list[str], masks: tuple[str, ...] = MASKS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of texts: the text and the word position of every window, and its hashes, one row per mask."""
    for part in tv.blocks(texts):
        w = tv.words(texts[part])
        n = len(w.hash) - RUN + 1
        if n <= 0:
            continue
        owner = w.owner
        keep = np.flatnonzero(owner[:n] == owner[RUN - 1 :])
        out = np.zeros((len(masks), len(keep)), np.uint64)
        for m, mask in enumerate(masks):
            h = np.zeros(n, np.uint64)
            for k, on in enumerate(mask):
                if on == "1":
                    h += w.hash[k : n + k] * _PLACE[m, k]
            out[m] = tv.mix(h[keep])
        yield part.start + owner[keep], keep - w.first[owner[keep]], out


def seeds(records: DataFrame, only: np.ndarray | None = None, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(key, mask, h, p) of the windows of (key, text); ``only`` thins them by a bitmap of the other side's hashes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys = f["key"].to_numpy()
            for row, p, hashes in seed_hashes(f["text"].tolist(), masks):
                h = hashes.view(np.int64)
                mask, at = np.nonzero(bitmap.contains(only, h)) if only is not None else np.indices(h.shape).reshape(2, -1)
                if len(at):
                    yield pd.DataFrame({"key": keys[row[at]], "mask": mask.astype(np.int32), "h": h[mask, at], "p": p[at].astype(np.int32)})

    return records.select("key", "text").mapInPandas(run, "key long, mask int, h long, p int")


def seed_hits(documents: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(doc_id, item_id, diagonal, p, n_masks): windows that meet, with how many masks they meet under."""
    documents = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("key"), "text")
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").alias("key"), "text")
    test = stored(seeds(items, masks=masks))
    inside = bitmap.build(test, "h")
    train = seeds(documents, inside, masks)
    test = test.select("mask", "h", F.col("key").alias("item_id"), F.col("p").alias("q"))
    return (
        train.join(test, ["mask", "h"])
        .groupBy(F.col("key").alias("doc_id"), "item_id", (F.col("p") - F.col("q")).alias("diagonal"), "p")
        .agg(F.countDistinct("mask").cast("int").alias("n_masks"), F.collect_set("mask").alias("masks"))
    )


def leaks(documents: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(doc_id, item_id, exact_run, equal_words, span_words): the longest word-for-word run of 14 or more (else 0), and
    the best overlap that tolerates substitutions, as equal words within a span.

    A diagonal counts if it has an exact run, or at least 14 equal words that make up ``TOLERANCE`` of their span.
    """
    hits = stored(seed_hits(documents, items, masks))
    line = ["doc_id", "item_id", "diagonal"]
    by_place = Window.partitionBy(*line).orderBy("p")
    # Windows at most a window's length apart belong to one overlap of their diagonal.
    parts = hits.withColumn("new", (F.col("p") - F.lag("p").over(by_place) > RUN).cast("int"))
    parts = parts.withColumn("part", F.sum(F.coalesce("new", F.lit(0))).over(by_place))
    full = parts.where(F.col("n_masks") == len(masks)).withColumn("run", F.col("p") - F.row_number().over(Window.partitionBy(*line, "part").orderBy("p")))
    exact = full.groupBy(*line, "part", "run").agg((F.count("*") + RUN - 1).alias("length")).groupBy(*line, "part").agg(F.max("length").cast("int").alias("exact_run"))
    places = F.array(*[F.array(*[F.lit(k) for k, on in enumerate(m) if on == "1"]) for m in masks])
    equal = (
        parts.select(*line, "part", "p", F.explode("masks").alias("mask"))
        .select(*line, "part", F.explode(F.transform(F.element_at(places, F.col("mask") + 1), lambda k: F.col("p") + k)).alias("at"))
        .groupBy(*line, "part")
        .agg(F.countDistinct("at").cast("int").alias("equal_words"), (F.max("at") - F.min("at") + 1).cast("int").alias("span_words"))
    )
    found = equal.join(exact, [*line, "part"], "left").withColumn("exact_run", F.coalesce("exact_run", F.lit(0)))
    found = found.where((F.col("exact_run") >= RUN) | ((F.col("equal_words") >= RUN) & (F.col("equal_words") >= TOLERANCE * F.col("span_words"))))
    best = F.max(F.struct("equal_words", "span_words"))
    return found.groupBy("doc_id", "item_id").agg(F.max("exact_run").alias("exact_run"), best.alias("b")).select("doc_id", "item_id", "exact_run", F.col("b.equal_words").alias("equal_words"), F.col("b.span_words").alias("span_words"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items with at least 14 consecutive words in common."""
    return p6_leaks(spark, sf_dir).where(F.col("exact_run") >= RUN).select("doc_id", "item_id")


def p6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the longest run of words that both have."""
    return p6_leaks(spark, sf_dir).where(F.col("exact_run") >= RUN).select("doc_id", "item_id", F.col("exact_run").cast("long").alias("exact_run"))


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report, overlaps with substituted words included."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
