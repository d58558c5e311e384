"""Problem 3: long exact spans shared between records of different documents.

Every text of at least ``SPAN`` characters is winnowed: of the hashes of its 100-character windows, the least in each
101 consecutive ones is kept, so any common span of 200 characters holds at least one kept hash, at the same place of the
span, in both texts.  The kept hashes form a log-structured index: a batch becomes an immutable run, one row a hash with
the least and the greatest document that holds it, bucketed and sorted by hash; each new run is merge-joined with the
historical runs, which tells the hashes that stand in more than one document; runs are compacted into one when there are
too many.  The texts around the hits are then compared character by character.

Null texts, ids or doc_ids take no part; texts shorter than the span share nothing; repeated rows of one id count once;
columns other than id, doc_id and text are ignored.  A run has a row a hash however often it stands, as hashes are
aggregated before they are shuffled, so a passage that a third of all records hold makes no large bucket.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bitmap
from tessera.llm import textvec as tv
from tessera.plans.states import States
from tessera.plans.tables import chunk_texts, stored, work_dir

#: Length of a shared span that counts, in code points, and of the hashed windows.
SPAN = 200
WINDOW = 100
#: Groups of more occurrences than this are compared through a shuffle of their spans instead of inside a task.
HOT = 512
#: The index is compacted when it has more runs than this.
MAX_RUNS = 3


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:  # type: ignore[no-untyped-def]
    """Minimum or maximum over every ``width`` consecutive values, in log2(width) passes."""
    n = 1
    while n * 2 <= width:
        a = pick(a[: len(a) - n], a[n:])
        n *= 2
    return pick(a[: len(a) - (width - n)], a[width - n :]) if width > n else a


def winnow(texts: list[str], window: int = WINDOW, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept window hashes, the text of each and its position there."""
    width = span - window + 1
    cp, start = tv.code_points(texts)
    n = len(cp) - window + 1
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n)
    owner = np.repeat(np.arange(len(texts)), np.diff(start))
    whole = at + window < start[owner[:n] + 1]
    h = np.where(whole, tv.span_hash(tv.prefix_hash(cp), at, at + window), np.uint64(2**64 - 1))
    least = _slide(h, width, np.minimum)
    last = len(least) + width - 1
    fits = whole[width - 1 : last] & (owner[: len(least)] == owner[width - 1 : last])
    pad = np.zeros(width - 1, np.uint64)
    kept = np.flatnonzero(whole & (_slide(np.concatenate([pad, np.where(fits, least, np.uint64(0)), pad]), width, np.maximum) == h))
    return h[kept], owner[kept], kept - start[owner[kept]]


_OCCURRENCES = "batch int, h long, did long, cid long, p int"


def window_hashes(records: DataFrame, batches: int = 1, window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """(batch, h, did, cid, p): winnowed hashes of every text, with hashes of doc_id and id and the position in the text.
    A document belongs to one batch whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["text"].tolist()
            for part in tv.blocks(texts):
                h, owner, p = winnow(texts[part], window, span)
                at = part.start + owner
                yield pd.DataFrame({**{c: f[c].to_numpy()[at] for c in ("batch", "did", "cid")}, "h": h.view(np.int64), "p": p.astype(np.int32)})

    did = F.xxhash64("doc_id")
    keyed = records.where(F.length("text") >= span).select(F.pmod(did, F.lit(batches)).cast("int").alias("batch"), did.alias("did"), F.xxhash64("id").alias("cid"), "text")
    return keyed.mapInPandas(run, _OCCURRENCES)


_RUN = "h BIGINT, lo BIGINT, hi BIGINT"


@dataclass
class SpanIndex:
    """Log-structured index of window hashes: immutable runs (h, lo, hi), bucketed and sorted by h, under ``root``.

    What runs are live is told by a table of states under ``root``, so a later session that opens the same root goes on
    where this one ended.
    """

    spark: SparkSession
    root: str
    max_runs: int = MAX_RUNS

    def __post_init__(self) -> None:
        self.states = States(self.spark, f"{self.root}/states", "runs array<string>, buckets int")
        self.label = hashlib.md5(self.root.encode()).hexdigest()[:12]
        self.state = self.states.last()
        self.runs = list(self.state.runs) if self.state else []
        self.buckets = self.state.buckets if self.state else int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))
        for name in self.runs:
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_RUN}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'")

    def _write(self, rows: DataFrame) -> str:
        """Hashes of the rows as a run; rows are aggregated before the shuffle, which leaves them as the buckets want them."""
        name = f"run_{self.label}_{self.state.serial + 1 if self.state else 0}_{uuid.uuid4().hex[:6]}"
        run = rows.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        run.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.root}/{name}").option("compression", "lz4").format("parquet").saveAsTable(name)
        return name

    def _publish(self, runs: list[str]) -> None:
        self.state, self.runs = self.states.publish(self.state, runs, self.buckets), runs

    def add(self, occurrences: DataFrame) -> DataFrame:
        """Index a batch (h, did) and give its hashes (h) that stand in more than one document of the batch and of all batches
        before, to be computed from the runs, which never change; compact when there are more than ``max_runs`` runs."""
        name = self._write(occurrences.select("h", F.col("did").alias("lo"), F.col("did").alias("hi")))
        met = self.spark.table(name)
        lo, hi = [F.col("lo")], [F.col("hi")]
        for k, r in enumerate(self.runs):
            old = self.spark.table(r).select("h", F.col("lo").alias(f"lo{k}"), F.col("hi").alias(f"hi{k}"))
            met = met.join(old.hint("merge"), "h", "left")
            lo.append(F.col(f"lo{k}"))
            hi.append(F.col(f"hi{k}"))
        least, most = (F.least(*lo), F.greatest(*hi)) if len(lo) > 1 else (lo[0], hi[0])
        shared = met.where(least != most).select("h")
        self._publish([*self.runs, name])
        if len(self.runs) > self.max_runs:
            self.compact()
        return shared

    def compact(self) -> None:
        """One run in the place of all; the old ones' files stay until the folder is cleared."""
        self._publish([self._write(reduce(DataFrame.unionByName, [self.spark.table(r) for r in self.runs]))])

    def close(self) -> None:
        """Take the runs out of the session's catalogue."""
        for t in self.spark.catalog.listTables(pattern=f"run_{self.label}_*"):
            self.spark.sql(f"DROP TABLE IF EXISTS {t.name}")


def _window_groups(key: np.ndarray, did: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows have a key that stands in several documents, and for each window the first one of its key."""
    order = np.lexsort((did, key))
    k, d = key[order], did[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(first, len(k)))
    shared, ref = np.zeros(len(k), bool), np.zeros(len(k), np.int64)
    shared[order] = np.repeat(d[first] != d[first + size - 1], size)
    ref[order] = np.repeat(order[first], size)
    return shared, ref


def _equal_windows(cp: np.ndarray, start: np.ndarray, one: np.ndarray, other: np.ndarray, span: int) -> np.ndarray:
    """Are the ``span`` characters at ``one`` those at ``other``?  Windows of a pair of rows have one distance, so each
    character of a pair is compared once."""
    pair = np.stack([np.searchsorted(start, one, side="right"), one - other])
    order = np.lexsort((one, pair[1], pair[0]))
    new = np.concatenate([[True], (np.diff(pair[:, order], axis=1) != 0).any(axis=0)])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(order)) - 1
    begin, length = one[order[head]], one[order[tail]] + span - one[order[head]]
    base = np.cumsum(length) - length
    at = np.arange(int(length.sum())) + np.repeat(begin - base, length)
    same = np.concatenate([[0], np.cumsum(cp[at] == cp[at - np.repeat(pair[1][order[head]], length)])])
    where = one[order] + (base - begin)[np.cumsum(new) - 1]
    out = np.zeros(len(one), bool)
    out[order] = same[where + span] - same[where] == span
    return out


def _covered(h: np.ndarray, lo: np.ndarray, off: np.ndarray, did: np.ndarray, texts: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``span`` characters in the contexts that another document's context of the same hash holds at the same
    distance from the hit: row, start, end.  ``lo`` is where a context starts in its text, ``off`` where the hit is in it."""
    cp, start = tv.code_points(texts)
    many = np.maximum(np.diff(start) - span, 0)
    row = np.repeat(np.arange(len(texts)), many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    if not len(row):
        return row, at, at
    place, align = start[row] + at, at - off[row]
    key = tv.span_hash(tv.prefix_hash(cp), place, place + span) ^ tv.mix(h.view(np.uint64)[row] + tv.mix(align.astype(np.uint64)))
    shared, ref = _window_groups(key, did[row])
    if shared.any() and not _equal_windows(cp, start, place[shared], place[ref[shared]], span).all():
        # Two windows hash alike without being alike: number the windows by their characters.
        number: dict[tuple, int] = {}
        key = np.fromiter((number.setdefault((int(h[r]), int(a), texts[r][k : k + span]), len(number)) for r, a, k in zip(row, align, at, strict=True)), np.int64, len(row))
        shared, _ = _window_groups(key, did[row])
    row, at = row[shared], at[shared] + lo[row[shared]]
    if not len(row):
        return row, at, at
    cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]))
    end = np.append(cut[1:], len(row)) - 1
    return row[cut], at[cut], at[end] + span


def _verify(contexts: DataFrame, span: int) -> DataFrame:
    """(cid, did, s, e): shared spans found in groups of equal hash, group by group over sorted partitions.  ``contexts``
    has cid, did, h, hot, lo, off and ctx."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def emit(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
            cuts = np.flatnonzero(np.concatenate([[True], f["h"].to_numpy()[1:] != f["h"].to_numpy()[:-1]]))
            begin = 0
            for end in [*cuts[1:], len(f)]:
                if end - begin >= HOT or end == len(f):
                    g = f.iloc[begin:end]
                    row, s, e = _covered(*(g[c].to_numpy(np.int64) for c in ("h", "lo", "off", "did")), g["ctx"].tolist(), span)
                    yield pd.DataFrame({"cid": g["cid"].to_numpy()[row], "did": g["did"].to_numpy()[row], "s": s.astype(np.int32), "e": e.astype(np.int32)})
                    begin = end

        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if not len(f):
                continue
            last = f["h"].to_numpy() == f["h"].iloc[-1]
            rest = f[last].reset_index(drop=True)
            if not last.all():
                yield from emit(f[~last].reset_index(drop=True))
        if rest is not None and len(rest):
            yield from emit(rest)

    cold = contexts.where("not hot").repartition("h").sortWithinPartitions("h").mapInPandas(run, "cid long, did long, s int, e int")

    # Hot groups: no task holds the group.  Equal contexts are one, and their windows, as two hashes of 64 bits, are counted
    # through a shuffle with partial results; of a context only the first and the last shared window matter.
    both = lambda *c: [F.xxhash64(*c).alias(f"{c[0]}1"), F.xxhash64(F.lit(1), *c).alias(f"{c[0]}2")]
    hot = contexts.where("hot").select("cid", "did", "h", "lo", "off", "ctx", *both("ctx", "h", "off"))
    same = hot.groupBy("ctx1", "ctx2", "h", "off", "ctx").agg(F.min("did").alias("a"), F.max("did").alias("b")).where(F.length("ctx") >= span)
    at = same.select("ctx1", "ctx2", "h", "off", "a", "b", "ctx", F.explode(F.expr(f"sequence(0, length(ctx) - {span})")).alias("at"))
    windows = at.withColumn("w", F.substring(F.col("ctx"), F.col("at") + 1, F.lit(span))).withColumn("align", F.col("at") - F.col("off")).select("ctx1", "ctx2", "a", "b", "at", *both("w", "h", "align"))
    shared = windows.groupBy("w1", "w2").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("w1", "w2")
    marks = windows.join(shared, ["w1", "w2"], "left_semi").groupBy("ctx1", "ctx2").agg(F.min("at").alias("from"), F.max("at").alias("to"))
    spans = hot.join(marks, ["ctx1", "ctx2"]).select("cid", "did", (F.col("lo") + F.col("from")).cast("int").alias("s"), (F.col("lo") + F.col("to") + span).cast("int").alias("e"))
    return cold.unionByName(spans)


_CONTEXTS = "cid long, did long, id string, n_chars int, h array<long>, lo array<int>, off array<int>, ctx array<string>"


def _contexts(records: DataFrame, hits: DataFrame, window: int, span: int) -> DataFrame:
    """The text around every hit, cut while the text is at hand: a row a record, or several for records of many hits."""
    wanted = bitmap.build(hits.select("cid"), "cid")
    around = hits.groupBy("cid", "did").agg(F.collect_set(F.struct("h", "p")).alias("x")).select("cid", "did", F.col("x.h").alias("h"), F.col("x.p").alias("p"))
    keyed = records.where(F.length("text") >= span).withColumn("cid", F.xxhash64("id")).withColumn("did", F.xxhash64("doc_id"))
    # The hashes of id and doc_id together name a record; rows of one id hold one text.
    texts = keyed.where(bitmap.probe(wanted, F.col("cid"))).select("cid", "did", "id", "text").dropDuplicates(["cid", "did"])
    reach = span - window

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for cid, did, i, t, h, p in zip(*(f[c] for c in ("cid", "did", "id", "text", "h", "p")), strict=True):
                for k in range(0, len(p), 512):
                    some = np.asarray(p[k : k + 512])
                    lo = np.maximum(some - reach, 0)
                    rows.append((cid, did, i, len(t), h[k : k + 512], lo, some - lo, [t[a : b + window + reach] for a, b in zip(lo.tolist(), some.tolist(), strict=True)]))
                if len(rows) >= 512:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CONTEXTS.split(", ")])
                    rows = []
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CONTEXTS.split(", ")])

    return stored(texts.join(around, ["cid", "did"]).mapInPandas(cut, _CONTEXTS))


def shared_spans(records: DataFrame, batches: int = 5, window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """(id, n_chars, shared_chars, share, n_spans): each record with how much of it stands word for word in another document.

    ``records`` has id, doc_id and text.  They are read and hashed once and enter the index in ``batches`` batches of whole
    documents; with the default there are enough for the runs to be compacted.
    """
    spark = records.sparkSession
    records = records.where(F.col("id").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("id", "doc_id", "text")
    folder = work_dir(spark)
    window_hashes(records, batches, window, span).write.partitionBy("batch").option("compression", "lz4").parquet(f"{folder}/occurrences")
    occurrences = spark.read.schema(_OCCURRENCES).parquet(f"{folder}/occurrences")
    index = SpanIndex(spark, f"{folder}/index")
    found = [index.add(occurrences.where(F.col("batch") == k)) for k in range(batches)]
    shared = stored(reduce(DataFrame.unionByName, found).distinct())
    index.close()
    inside = bitmap.build(shared, "h")
    hits = stored(occurrences.where(bitmap.probe(inside, F.col("h"))).join(shared, "h").select("h", "did", "cid", "p").distinct())
    many = hits.groupBy("h").count().where(F.col("count") > HOT).select("h", F.lit(True).alias("many"))
    around = _contexts(records, hits, window, span)
    each = around.select("cid", "did", F.explode(F.arrays_zip("h", "lo", "off", "ctx")).alias("x")).select("cid", "did", "x.*")
    each = each.join(many, "h", "left").withColumn("hot", F.coalesce("many", F.lit(False))).drop("many")
    spans = _verify(each, span)
    # Union of the intervals of a record: sorted by start, an interval adds what lies beyond the furthest end so far.
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("s", "e"))),
        F.struct(F.lit(0).alias("chars"), F.lit(-1).alias("end"), F.lit(0).alias("spans")),
        lambda acc, x: F.struct(
            (acc["chars"] + F.greatest(x["e"] - F.greatest(x["s"], acc["end"]), F.lit(0))).alias("chars"),
            F.greatest(x["e"], acc["end"]).alias("end"),
            (acc["spans"] + F.when(x["s"] > acc["end"], 1).otherwise(0)).alias("spans"),
        ),
    )
    per = spans.groupBy("cid", "did").agg(merged.alias("m"))
    names = around.select("cid", "did", "id", "n_chars").distinct()
    return per.join(names, ["cid", "did"]).select(
        "id", "n_chars", F.col("m.chars").alias("shared_chars"), F.round(F.col("m.chars") / F.col("n_chars"), 6).alias("share"), F.col("m.spans").alias("n_spans")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(chunk_texts(spark, sf_dir)).select("id").distinct()


def p3_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with how much of it stands in a record of another document; records that share nothing have 0."""
    texts = chunk_texts(spark, sf_dir).groupBy("id").agg(F.max(F.length("text")).cast("long").alias("n_chars"))
    spans = shared_spans(chunk_texts(spark, sf_dir)).drop("n_chars")
    counts = (F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("shared_chars", "n_spans"))
    return texts.join(spans, "id", "left").select("id", "n_chars", *counts, F.coalesce("share", F.lit(0.0)).alias("share"))
