"""Problem 4: near-duplicate records with small edits, reorderings or insertions.

Each record's set of distinct runs of three words becomes a fingerprint of 96 symbols (b-bit minwise hashes), so that two
records of Jaccard similarity J differ in about 96 * (1 - J) symbols.  Multi-index hashing: the fingerprint is cut into
16 segments of six symbols; within each segment the Hamming ball of radius one is enumerated by leaving out one symbol
at a time, records that meet in any of these tables are fetched, their complete Hamming distance is checked, and what is
left is confirmed on the exact sets of 64-bit run hashes.

Table entries of many classes are compared block against block over several tasks.  Those that a count on every 64th
class shows to be large are routed there before the entries are grouped; the others are met while the grouped entries
stream by, of which a task never holds more than ``HOT`` members of one entry.  The routing does not change the pairs.

Records with the same set form one class, which is searched once.  Null ids or texts take no part, nor do records of
fewer than ``MIN_WORDS`` words; repeated rows of an id count once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bitmap
from tessera.llm import textvec as tv
from tessera.plans.tables import chunk_texts, stored

RUN = 3
SIMILARITY = 0.6
MIN_WORDS = 40
SEGMENTS = 16
SYMBOLS = 6
#: Symbols two fingerprints must share: four standard deviations below what the similarity threshold gives.
SLACK = 4.0
#: A table entry of more classes is compared in blocks spread over tasks, distances first.
HOT = 256
BLOCK = 2048
#: Table entries a task sorts, about 8 MB.
TASK_ENTRIES = 500_000
#: One class in so many is counted to find large entries; an entry with so many of these is routed to the blocks, and at
#: most so many entries are (8 MB), the largest first.
COUNTED, ROUTED, ROUTES = 64, 16, 1_000_000

_SIZE = SEGMENTS * SYMBOLS
_rng = np.random.default_rng(20240601)
_MUL = _rng.integers(1, 1 << 32, _SIZE, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, _SIZE, dtype=np.uint64).astype(np.uint32)


def least_shared(similarity: float) -> int:
    """How many symbols of two complete fingerprints must agree at least."""
    return int(_SIZE * similarity - SLACK * (_SIZE * similarity * (1 - similarity)) ** 0.5)


def run_sets(texts: list[str], size: int = RUN, min_words: int = MIN_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of texts: which texts are long enough, their distinct run hashes one after another, and the counts."""
    for part in tv.blocks(texts):
        w = tv.words(texts[part])
        h, owner, _ = tv.runs(w, size)
        long = w.per_text >= max(min_words, size)
        h, owner = h[long[owner]], owner[long[owner]]
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
        yield part.start + np.flatnonzero(long), h[new], np.bincount(owner[new], minlength=len(long))[long]


def fingerprints(records: DataFrame, size: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, cls, fp): class of equal sets and the fingerprint's symbols, two bytes each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = f["id"].to_numpy()
            for rows, h, count in run_sets(f["text"].tolist(), size, min_words):
                if not len(rows):
                    continue
                first = np.cumsum(count) - count
                cls = tv.mix(np.add.reduceat(tv.mix(h), first) + count.astype(np.uint64))
                x = (h >> np.uint64(32)).astype(np.uint32)
                fp = np.empty((len(rows), _SIZE), np.uint16)
                for k in range(_SIZE):
                    least = np.minimum.reduceat(x * _MUL[k] + _ADD[k], first)
                    fp[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
                yield pd.DataFrame({"id": ids[rows], "cls": cls.view(np.int64), "fp": [r.tobytes() for r in fp]})

    return records.select("id", "text").mapInPandas(run, "id string, cls long, fp binary")


def _symbols(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column.tolist()), np.uint16).reshape(-1, _SIZE)


def table_entries(classes: DataFrame, keys: np.ndarray | None = None, inside: bool = False) -> DataFrame:
    """(key, cls): for every segment the members of the radius-one ball, one per symbol left out; ``keys`` names sorted
    entries to leave out, or with ``inside`` the only ones to keep."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), 2000):
                g = f.iloc[lo : lo + 2000]
                fp = _symbols(g["fp"]).astype(np.uint64).reshape(-1, SEGMENTS, SYMBOLS)
                place = np.arange(SYMBOLS, dtype=np.uint64)
                each = tv.mix(fp + (place[None, None, :] << np.uint64(20)) + (np.uint64(1) << np.uint64(40)))
                table = tv.mix(np.arange(_SIZE, dtype=np.uint64).reshape(SEGMENTS, SYMBOLS) + np.uint64(77))
                key = tv.mix(each.sum(axis=2, dtype=np.uint64)[:, :, None] - each + table[None])
                flat, cls = key.reshape(-1).view(np.int64), np.repeat(g["cls"].to_numpy(), _SIZE)
                if keys is not None:
                    kept = (keys[np.minimum(np.searchsorted(keys, flat), len(keys) - 1)] == flat) == inside
                    flat, cls = flat[kept], cls[kept]
                yield pd.DataFrame({"key": flat, "cls": cls})

    return classes.select("cls", "fp").mapInPandas(run, "key long, cls long")


def _pairs_of_groups(size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs within groups of sorted rows, groups given by size and first row."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for n in np.unique(size):
        base = first[size == n]
        i, j = np.triu_indices(n, 1)
        a.append((base[:, None] + i).ravel())
        b.append((base[:, None] + j).ravel())
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def large_entries(classes: DataFrame, counted: int, routed: int) -> np.ndarray:
    """Sorted keys of the entries that a count on one class in ``counted`` shows to be large."""
    some = classes.where(F.pmod(F.xxhash64("cls"), F.lit(counted)) == 0)
    sizes = table_entries(some).groupBy("key").count().where(F.col("count") >= routed)
    return np.sort(sizes.orderBy(F.desc("count"), "key").limit(ROUTES).select("key").toPandas()["key"].to_numpy(np.int64))


def meetings(entries: DataFrame, parts: int, hot: int = HOT) -> DataFrame:
    """(key, a, b): pairs of classes that meet in an entry; of entries with more than ``hot`` classes the members
    themselves, with b null."""

    def members(key: np.ndarray, cls: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"key": key, "a": cls, "b": pd.array([None] * len(cls), dtype="Int64")})

    def out(key: np.ndarray, cls: np.ndarray) -> Iterator[pd.DataFrame]:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        small = (size > 1) & (size <= hot)
        i, j = _pairs_of_groups(size[small], first[small])
        if len(i):
            yield pd.DataFrame({"key": 0, "a": cls[i], "b": pd.array(cls[j], dtype="Int64")})
        big = np.repeat(size, size) > hot
        if big.any():
            yield members(key[big], cls[big])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, np.int64)
        key, cls, passing = none, none, None  # the entry that may go on, and a large one whose members pass by
        for f in frames:
            if not len(f):
                continue
            k, c = f["key"].to_numpy(np.int64), f["cls"].to_numpy(np.int64)
            if passing is not None:
                own = int(np.searchsorted(k, passing, side="right"))
                if own:
                    yield members(k[:own], c[:own])
                k, c = k[own:], c[own:]
                if not len(k):
                    continue
                passing = None
            key, cls = np.concatenate([key, k]), np.concatenate([cls, c])
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from out(key[:cut], cls[:cut])
                key, cls = key[cut:], cls[cut:]
            if len(key) > hot:
                yield members(key, cls)
                key, cls, passing = none, none, key[0]
        if len(key):
            yield from out(key, cls)

    return entries.repartition(parts, "key").sortWithinPartitions("key", "cls").mapInPandas(run, "key long, a long, b long")


def _hot_pairs(members: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Pairs of large entries within the distance, block against block, so that no task holds an entry whole."""
    members = members.join(members.groupBy("key").agg(F.count("*").alias("n")), "key")
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("a"), blocks)
    spread = members.select("key", "a", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    spread = spread.join(classes.select(F.col("cls").alias("a"), "fp"), "a").select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "a", "fp")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        left, right = g[g["own"] == g["i"].iloc[0]], g[g["own"] == g["j"].iloc[0]]
        x, y, a, b = _symbols(left["fp"]), _symbols(right["fp"]), left["a"].to_numpy(), right["a"].to_numpy()
        found = [np.flatnonzero((y == row).sum(axis=1) >= least) for row in x]
        i, j = np.repeat(np.arange(len(x)), [len(r) for r in found]), np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
        lo, hi = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
        return pd.DataFrame({"a": lo[lo < hi], "b": hi[lo < hi]})

    return spread.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def near_pairs(records: DataFrame, similarity: float = SIMILARITY, size: int = RUN, min_words: int = MIN_WORDS, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Class pairs (a, b, jaccard) and membership (cls, id): what stands in no pair is similar to nothing else."""
    records = records.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text")
    prints = stored(fingerprints(records, size, min_words))
    members = prints.select("cls", "id").distinct()
    classes = stored(prints.dropDuplicates(["cls"]).select("cls", "fp"))
    least = least_shared(similarity)
    spark = records.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-classes.count() * _SIZE // TASK_ENTRIES))
    large = large_entries(classes, COUNTED, ROUTED)
    entries = table_entries(classes, large) if len(large) else table_entries(classes)
    met = stored(meetings(entries, parts, hot).distinct())

    @F.pandas_udf("boolean")
    def close(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series((_symbols(x) == _symbols(y)).sum(axis=1) >= least) if len(x) else pd.Series([], dtype=bool)

    plain = met.where("b is not null").select("a", "b").distinct()
    plain = (
        plain.join(classes.select(F.col("cls").alias("a"), F.col("fp").alias("fa")), "a")
        .join(classes.select(F.col("cls").alias("b"), F.col("fp").alias("fb")), "b")
        .where(close("fa", "fb"))
        .select("a", "b")
    )
    heavy = met.where("b is null").select("key", "a")
    if len(large):
        heavy = stored(heavy.unionByName(table_entries(classes, large, inside=True).select("key", F.col("cls").alias("a"))))
    if not heavy.isEmpty():
        plain = plain.unionByName(_hot_pairs(heavy, classes, least)).distinct()
    pairs = stored(plain)
    return _confirmed(pairs, members, records, similarity, size, min_words), members


def _confirmed(pairs: DataFrame, members: DataFrame, records: DataFrame, similarity: float, size: int, min_words: int) -> DataFrame:
    """(a, b, jaccard) of the pairs whose exact sets reach the similarity; only records of the pairs are read as text."""
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    names = stored(members.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("id")).withColumn("k", F.xxhash64("id")))
    inside = bitmap.build(names.select("k"), "k")
    texts = records.withColumn("k", F.xxhash64("id")).where(bitmap.probe(inside, F.col("k"))).drop("k").join(names.drop("k"), "id").dropDuplicates(["cls"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cls = f["cls"].to_numpy()
            for rows, h, count in run_sets(f["text"].tolist(), size, min_words):
                yield pd.DataFrame({"cls": cls[rows], "runs": [x.tobytes() for x in np.split(h, np.cumsum(count)[:-1])] if len(rows) else []})

    sets = stored(texts.select("cls", "text").mapInPandas(run, "cls long, runs binary"))

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        for k, (p, q) in enumerate(zip(x, y, strict=True)):
            u, v = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            common = len(np.intersect1d(u, v, assume_unique=True))
            out[k] = common / (len(u) + len(v) - common)
        return pd.Series(out)

    return stored(
        pairs.join(sets.select(F.col("cls").alias("a"), F.col("runs").alias("ra")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("runs").alias("rb")), "b")
        .select("a", "b", jaccard("ra", "rb").alias("jaccard"))
        .where(F.col("jaccard") >= similarity)
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ids, copies included, whose sets of runs of three words reach the similarity."""
    pairs, members = near_pairs(chunk_texts(spark, sf_dir))
    left, right = members.select(F.col("cls").alias("a"), F.col("id").alias("x")), members.select(F.col("cls").alias("b"), F.col("id").alias("y"))
    between = pairs.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    within = left.join(right, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(cls, root): the least class reachable from each class of the pairs; labels are joined along the pairs, jumped
    through their own labels and written once a round, until no label changes."""
    edges = stored(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(edges.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    changed = True
    while changed:
        seen = edges.join(labels.select(F.col("cls").alias("b"), "root"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("root").alias("near"))
        step = labels.join(seen, "cls").select("cls", F.least("root", "near").alias("to"), F.col("root").alias("was"))
        jump = labels.select(F.col("cls").alias("to"), F.col("root").alias("far"))
        after = stored(step.join(jump, "to", "left").select("cls", F.least("to", F.coalesce("far", "to")).alias("root"), "was"))
        changed = not after.where("root <> was").isEmpty()
        labels = after.select("cls", "root")
    return labels


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, group_id, n_links): one row per record; the group is its connected component, the links count similar ids."""
    pairs, members = near_pairs(chunk_texts(spark, sf_dir))
    sizes = members.groupBy("cls").agg(F.count("*").alias("copies"))
    ends = pairs.select(F.col("a").alias("cls"), F.col("b").alias("to")).unionByName(pairs.select(F.col("b").alias("cls"), F.col("a").alias("to")))
    links = ends.join(sizes.select(F.col("cls").alias("to"), "copies"), "to").groupBy("cls").agg(F.sum("copies").alias("near"))
    per = sizes.join(links, "cls", "left").join(components(pairs), "cls", "left")
    per = per.select("cls", F.coalesce("root", "cls").alias("root"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    named = stored(members.join(per, "cls"))
    heads = named.groupBy("root").agg(F.min("id").alias("group_id"))
    return named.join(heads, "root").select("id", "group_id", "n_links")
