"""Problem 7: mixing sources to target weights.

Documents are measured in tokens of a public tokenizer.  Token mass is summed by source, language and topic, and
iterative proportional fitting rakes the weight of each cell in turn to the source, language and topic marginals; a
weight says how often a document of the cell is used on average and never exceeds its source's ``max_uses``.  A source
whose raked mass falls short of its target cannot reach its share.  Documents are then sampled by those calibrated
weights: the whole part is certain, the fraction goes to the documents whose hash of doc_id is below a threshold, set for
each cell from the token mass by hash so that a source's total is met to about a document.  A rerun selects the same rows.

Topics are clusters of all documents' word vectors (random projections of their words, frequent words left out).

Sources are compared in lower case with runs of other characters as one underscore.  Null or empty texts have no tokens
and are never selected; documents without a known source or doc_id count in the size of the mixture only; a source
without documents cannot reach its share.  Repeated rows are separate documents; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textvec as tv
from tessera.llm.quality import _among, word_hashes
from tessera.llm.reading import frequent_words
from tessera.plans.tables import stored, table

#: Ranks file of a public byte-level BPE, one base64 token and its rank a line, and the pattern that cuts words for it.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Clusters of documents, rounds of their fit, and numbers in a document's vector.
TOPICS, TOPIC_ROUNDS, DIMENSIONS = 6, 6, 32
#: Hash intervals whose token mass is summed to set a cell's threshold.
BINS = 1024

#: Raking ends when no reachable marginal is further off than this, or after ``ROUNDS`` rounds.
TOLERANCE = 1e-6
ROUNDS = 500
FLOOR = 1e-9
#: A source whose raked mass is short of its target by more than this share of it cannot reach its share.
SHORT = 1e-4

_tokenizers: dict[str, object] = {}


def ship_tokenizer(spark: SparkSession, path: str) -> None:
    """Give the tokenizer's file to all executors, once a session; they need no path of their own."""
    if os.path.basename(path) not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(path)


def count_tokens(texts: list[str], path: str = TOKENIZER) -> np.ndarray:
    """Tokens of each text; the tokenizer is read once a worker."""
    import tiktoken

    if path not in _tokenizers:
        shipped = SparkFiles.get(os.path.basename(path))
        with open(shipped if os.path.exists(shipped) else path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _tokenizers[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = _tokenizers[path].encode_ordinary  # type: ignore[attr-defined]
    return np.fromiter((len(encode(t)) for t in texts), np.int64, len(texts))


def source_key(name: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(name), "[^\\p{L}\\p{N}]+", "_"), "^_+|_+$", ""), F.lit(""))


def _vectors(w: tv.Words, frequent: np.ndarray, n: int) -> np.ndarray:
    """Unit vectors of texts: each word counts as a fixed random direction; frequent words and words of figures do not."""
    figure = (w.cp >= 48) & (w.cp <= 57)
    before = np.concatenate([[0], np.cumsum(figure)])
    solid = (before[w.end] == before[w.start]) & (w.end - w.start >= 4) & ~_among(w.hash, frequent)
    h, owner = w.hash[solid], w.owner[solid]
    out = np.empty((n, DIMENSIONS), np.float32)
    for d in range(DIMENSIONS):
        sign = ((h >> np.uint64(d)) & np.uint64(1)).astype(np.float64) * 2 - 1
        out[:, d] = np.bincount(owner, sign, n)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


_MEASURED = "doc_id long, source string, language string, vector array<float>, tokens long"


def measured(documents: DataFrame, words_by_lang: dict[str, list[str]], tokenizer: str = TOKENIZER, count: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """(doc_id, source, language, vector, tokens): source, language, word vector and size of every document, judged by its
    whole text; ``count`` may measure something else than tokens."""
    if count is None:
        ship_tokenizer(documents.sparkSession, tokenizer)
    langs = sorted(words_by_lang)
    lang_sets, lang_names = [word_hashes(words_by_lang[x]) for x in langs], np.array([*langs, "other"], object)
    frequent = np.unique(np.concatenate([*lang_sets, np.zeros(0, np.uint64)]))

    def most(w: tv.Words, n: int) -> np.ndarray:
        if not lang_sets:
            return np.full(n, -1)
        hits = np.stack([np.bincount(w.owner[_among(w.hash, s)], minlength=n) for s in lang_sets], axis=1)
        return np.where(hits.max(axis=1) > 0.04 * w.per_text, hits.argmax(axis=1), -1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["text"].fillna("").tolist()
            for part in tv.blocks(texts):
                some = texts[part]
                w = tv.words(some)
                yield pd.DataFrame(
                    {
                        "doc_id": f["doc_id"].array[part],
                        "source": f["source"].to_numpy()[part],
                        "language": lang_names[most(w, len(some))],
                        "vector": list(_vectors(w, frequent, len(some))),
                        "tokens": count(some) if count else count_tokens(some, tokenizer),
                    }
                )

    return documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").mapInPandas(run, _MEASURED)


def with_topics(sizes: DataFrame, topics: int = TOPICS) -> DataFrame:
    """The stored table of ``measured`` with a topic in the vector's place: clusters fitted on all documents; a document
    without words of its own, or a table without any, has topic -1."""
    blank = F.forall("vector", lambda x: x == 0)
    solid = sizes.where(~blank).select(array_to_vector("vector").alias("vector"))
    if solid.isEmpty():
        return sizes.drop("vector").withColumn("topic", F.lit(-1))
    model = KMeans(k=topics, maxIter=TOPIC_ROUNDS, seed=7, featuresCol="vector", predictionCol="topic").fit(solid)
    named = model.transform(sizes.withColumn("blank", blank).withColumn("vector", array_to_vector("vector")))
    return named.withColumn("topic", F.when(F.col("blank"), -1).otherwise(F.col("topic"))).drop("vector", "blank")


def rake(tokens: np.ndarray, cap: np.ndarray, members: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Weights of cells by capped iterative proportional fitting.

    ``members`` has, for each dimension, the category of every cell, ``targets`` the wanted token mass of every category
    (NaN: free).  Each step scales the uncapped cells of a category to what the capped ones leave; the first dimension
    comes last in a round, so its reachable targets hold exactly.
    """
    w = np.minimum(np.ones(len(tokens)), cap)
    if not len(tokens):
        return w
    for _ in range(ROUNDS):
        before = w.copy()
        for group, target in [*zip(members[1:], targets[1:], strict=True), (members[0], targets[0])]:
            for c in np.flatnonzero(~np.isnan(target)):
                cells = np.flatnonzero(group == c)
                free = np.ones(len(cells), bool)
                while free.any():  # a cell that would pass its cap is fixed there, and the rest is scaled anew
                    now = (w[cells[free]] * tokens[cells[free]]).sum()
                    left = target[c] - (cap[cells[~free]] * tokens[cells[~free]]).sum()
                    if now <= 0:
                        break
                    # A cell is never emptied, so a later step can still raise it.
                    scaled = np.maximum(w[cells[free]] * max(left, 0) / now, FLOOR)
                    over = scaled > cap[cells[free]]
                    w[cells[free]] = np.minimum(scaled, cap[cells[free]])
                    if not over.any():
                        break
                    free[np.flatnonzero(free)[over]] = False
        if np.abs(w - before).max() < TOLERANCE:
            break
    return w


def plan(sizes: DataFrame, weights: DataFrame, shares: dict[str, dict[object, float]] | None = None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Cells with their weight, and one line a source with target, raked mass and whether its share can be reached.

    ``sizes`` is a stored table with source, language, topic and tokens.  ``shares`` may give target shares of ``language``
    and ``topic``; by default each keeps its share of all tokens.  The cells that reach the driver are at most sources x
    languages x topics, whatever the number of documents.
    """
    goals = weights.where("source is not null").groupBy(source_key(F.col("source")).alias("key")).agg(F.min("source").alias("source"), F.max("target_share").alias("target_share"), F.max("max_uses").alias("max_uses"))
    cells = stored(sizes.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")))
    goal = goals.orderBy("key").toPandas()  # one line a source
    size = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    known = cells.join(F.broadcast(goals.select(F.col("key").alias("source"), "max_uses")), "source").orderBy("source", "language", "topic").toPandas()
    known["tokens"] = known["tokens"].fillna(0).astype(float)
    number = {k: n for n, k in enumerate(goal["key"])}
    members = [known["source"].map(number).to_numpy(int)]
    targets = [goal["target_share"].fillna(0).to_numpy(float) * size]
    for name in ("language", "topic"):
        names, group = np.unique(known[name].to_numpy(), return_inverse=True) if len(known) else (np.zeros(0), np.zeros(0, int))
        have = np.bincount(group, known["tokens"], len(names)) if len(names) else np.zeros(0)
        given = (shares or {}).get(name)
        share = np.array([given.get(x, np.nan) for x in names.tolist()]) if given else have / max(have.sum(), 1)
        members.append(group)
        targets.append(share * size)
    cap = known["max_uses"].fillna(0).to_numpy(float)
    known["weight"] = rake(known["tokens"].to_numpy(), cap, members, targets)
    total = lambda x: np.bincount(members[0], x, len(goal)) if len(known) else np.zeros(len(goal))
    goal["documents"], goal["available_tokens"] = total(known["documents"]).astype(int), total(known["tokens"]).astype(int)
    goal["target_tokens"], goal["raked_tokens"] = targets[0], total(known["weight"] * known["tokens"])
    goal["reachable"] = goal["raked_tokens"] >= goal["target_tokens"] * (1 - SHORT)
    return known, goal


def _chance() -> Column:
    """A document's place between 0 and 1, by the hash of its doc_id."""
    return F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def thresholds(usable: DataFrame, cells: pd.DataFrame) -> np.ndarray:
    """For each cell the chance below which a document is used once more than the weight's whole part.

    The token mass of each of ``BINS`` hash intervals is summed in Spark, at most cells x BINS rows.  What one cell of a
    source is over or under, by less than half an interval, is made up for by the source's next cell.
    """
    keys = ["source", "language", "topic"]
    mass = usable.groupBy(*keys, F.floor(_chance() * BINS).cast("int").alias("bin")).agg(F.sum("tokens").alias("tokens")).toPandas()
    at = {k: n for n, k in enumerate(cells[keys].itertuples(index=False, name=None))}
    grid = np.zeros((len(cells), BINS))
    row = np.fromiter((at.get(k, -1) for k in mass[keys].itertuples(index=False, name=None)), np.int64, len(mass))
    grid[row[row >= 0], mass["bin"].to_numpy(np.int64)[row >= 0]] = mass["tokens"].to_numpy(float)[row >= 0]
    out, owed, source = np.zeros(len(cells)), 0.0, None
    for k, c in enumerate(cells.itertuples()):
        owed = owed if c.source == source else 0.0
        source = c.source
        reached = np.concatenate([[0.0], np.cumsum(grid[k])])
        whole = np.floor(c.weight)
        want = c.weight * c.tokens - whole * reached[-1] + owed
        most = len(reached) if whole < c.max_uses else 1
        best = int(np.abs(reached[:most] - want).argmin())
        out[k], owed = best / BINS, want - reached[best]
    return out


def mixture(documents: DataFrame, weights: DataFrame, words_by_lang: dict[str, list[str]], shares: dict[str, dict[object, float]] | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, pd.DataFrame]:
    """Selected documents (doc_id, source, language, topic, tokens, uses) and the line of every source."""
    sizes = stored(with_topics(stored(measured(documents, words_by_lang, tokenizer))))
    cells, goal = plan(sizes, weights, shares)
    spark = documents.sparkSession
    names = dict(zip(goal["key"], goal["source"], strict=True))
    usable = sizes.where("doc_id is not null and tokens > 0")
    rows = [(r.source, r.language, int(r.topic), float(np.floor(r.weight)), float(t), names[r.source]) for r, t in zip(cells.itertuples(), thresholds(usable, cells), strict=True)]
    factor = spark.createDataFrame(rows, "source string, language string, topic int, whole double, below double, name string")
    uses = (F.col("whole") + (_chance() < F.col("below")).cast("int")).cast("long")
    chosen = usable.join(F.broadcast(factor), ["source", "language", "topic"]).withColumn("uses", uses).where("uses > 0")
    return chosen.select("doc_id", F.col("name").alias("source"), "language", "topic", "tokens", "uses"), goal


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, list[str]]]:
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"), frequent_words(spark, sf_dir)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose raked mass falls short of their share, as spelled in the weights."""
    documents, weights, words = _inputs(spark, sf_dir)
    _, goal = plan(with_topics(stored(measured(documents, words))), weights)
    return spark.createDataFrame([(x,) for x in goal["source"][~goal["reachable"]]], "source string")


def p7_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plan with sizes in characters: what each source has, is to give and gives."""
    documents, weights, words = _inputs(spark, sf_dir)
    sizes = measured(documents, words, count=lambda texts: np.fromiter(map(len, texts), np.int64, len(texts)))
    _, goal = plan(with_topics(stored(sizes)), weights)
    lines = [(r.source, int(r.documents), int(r.available_tokens), float(round(r.target_tokens, 2)), float(round(r.raked_tokens, 2)), bool(r.reachable)) for r in goal.itertuples()]
    return spark.createDataFrame(lines, "source string, documents long, available_chars long, target_chars double, raked_chars double, reachable boolean")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection: every chosen document and how often it is used."""
    return mixture(*_inputs(spark, sf_dir))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and what the selection reaches, source by source.

    ``planned_share`` is of a mixture as large as all documents together.  Where some sources fall short, the others
    necessarily make up more than their target of what is selected: ``adjusted_share`` is the best a mixture can give
    then, the short sources' whole capacity and the rest in proportion, ``actual_share`` what this one gives.
    """
    chosen, goal = mixture(*_inputs(spark, sf_dir))
    size = float(goal["target_tokens"].sum() / max(goal["target_share"].sum(), 1e-12)) if len(goal) else 0.0
    best = np.minimum(goal["target_tokens"], goal["available_tokens"] * goal["max_uses"].fillna(0))
    adjusted = best / max(best.sum(), 1)
    lines = spark.createDataFrame(
        [(r.source, float(r.target_share), float(round(a, 6)), int(r.max_uses), int(r.documents), int(r.available_tokens), bool(r.reachable)) for r, a in zip(goal.itertuples(), adjusted, strict=True)],
        "source string, target_share double, adjusted_share double, max_uses int, documents long, available_tokens long, reachable boolean",
    )
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("selected_tokens"), F.max("uses").alias("most_uses"))
    out = stored(lines.join(used, "source", "left").na.fill(0, ["selected_tokens", "most_uses"]))
    whole = float(out.agg(F.sum("selected_tokens")).first()[0] or 1)
    share = lambda of: F.round(F.col("selected_tokens") / F.lit(of), 6)
    return out.select(
        "source", "target_share", share(size or 1.0).alias("planned_share"), "adjusted_share", share(whole).alias("actual_share"),
        "selected_tokens", "available_tokens", "documents", "max_uses", "most_uses", "reachable",
    )
