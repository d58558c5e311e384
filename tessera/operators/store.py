"""A collection of chunks with vectors, kept as parquet.

Each upsert or deletion is one Spark write, partitioned by its generation; a small table of states names the generations
that are live.  A read takes the last generation of each id and leaves out deleted ones; compaction writes what a read
gives as one generation and makes that the only live one, by itself once enough rows are replaced.  A repeated id within
one batch keeps its largest row.  A collection has a fixed vector size; a batch with another size fails and changes
nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.operators.embedding import DIMENSIONS, Embedder, embedded
from tessera.operators.retrieval import ListIndex, retrieve, top
from tessera.plans.states import States
from tessera.plans.tables import stored, work_dir

COLUMNS = ("id", "doc_id", "chunk_id", "text", "vector")
SCHEMA = "id string, doc_id string, chunk_id int, text string, vector array<float>"
#: Rows that go to every task, at most: ids with their generation, or hits.
SMALL = 500_000
#: Live generations, at most, before they are compacted whatever they replace.
MAX_GENERATIONS = 16


def upserted(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows of ``old`` with those of ``new`` in the place of equal keys; the rows of ``new`` have unique keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def _checked(rows: DataFrame) -> DataFrame:
    """The rows, to be sent to every task if they are few enough."""
    rows = stored(rows)
    return F.broadcast(rows) if rows.count() <= SMALL else rows


@dataclass
class Collection:
    """``location`` is a folder all executors share; None puts it under the session's checkpoint folder.  A collection of
    more than ``index_above`` rows is searched through inverted lists; by default it never is."""

    spark: SparkSession
    name: str = "collection"
    dimensions: int = DIMENSIONS
    location: str | None = None
    index_above: int | None = None

    def __post_init__(self) -> None:
        self.root = f"{self.location.rstrip('/')}/{self.name}" if self.location else work_dir(self.spark)
        self.states = States(self.spark, f"{self.root}/states", "generations array<string>, dimensions int, batch long")

    def exists(self) -> bool:
        return self.states.last() is not None

    def _write(self, rows: DataFrame, state: Row | None) -> str:
        """Rows with a flag ``deleted`` as a generation, whose name sorts after those before."""
        name = f"{state.serial + 1 if state else 0:09d}-{uuid.uuid4().hex[:8]}"
        size = F.col("vector").isNull() | (F.size("vector") == self.dimensions)
        vector = F.when(size, F.col("vector")).otherwise(F.raise_error(F.lit(f"vectors of this collection have {self.dimensions} dimensions")))
        out = rows.select("id", "doc_id", "chunk_id", "text", vector.alias("vector"), "deleted", F.lit(name).alias("generation"))
        out.write.mode("append").partitionBy("generation").option("compression", "zstd").parquet(f"{self.root}/rows")
        return name

    def _append(self, rows: DataFrame, batch: int | None = None) -> None:
        state = self.states.last()
        live, last = (list(state.generations), state.batch) if state else ([], None)
        if batch is not None and last is not None and batch <= last:
            return  # a micro-batch that is repeated after a failure
        name = self._write(rows, state)
        self.states.publish(state, [*live, name], self.dimensions, batch if batch is not None else last)
        if self.wants_compaction():
            self.compact()

    def upsert(self, rows: DataFrame, batch: int | None = None) -> None:
        """Append rows (id, doc_id, chunk_id, text, vector); later generations win on read.  A ``batch`` number that is not
        above the last one changes nothing."""
        unique = rows.where("id is not null").select(*COLUMNS).groupBy("id").agg(F.max(F.struct(*COLUMNS[1:])).alias("r")).select("id", "r.*")
        self._append(unique.withColumn("deleted", F.lit(False)), batch)

    def add(self, chunks: DataFrame, embedder: Embedder, batch_size: int = 512, batch: int | None = None) -> None:
        """Embed and upsert chunks (id, doc_id, chunk_id, content); of a repeated id the largest text is embedded."""
        rows = chunks.where("id is not null").select("id", "doc_id", "chunk_id", F.col("content.text").alias("text"))
        unique = rows.groupBy("id").agg(F.max(F.struct("doc_id", "chunk_id", "text")).alias("r")).select("id", "r.*")
        self._append(embedded(unique, embedder, self.dimensions, batch_size=batch_size).withColumn("deleted", F.lit(False)), batch)

    def delete(self, ids: DataFrame) -> None:
        """Take the rows of these ids out; ids that are not there change nothing."""
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "string"), ("chunk_id", "int"), ("text", "string"), ("vector", "array<float>"))]
        self._append(ids.where("id is not null").select("id").distinct().select("id", *empty, F.lit(True).alias("deleted")))

    def _live(self) -> tuple[DataFrame, int]:
        """All rows of the live generations, and how many these are."""
        state = self.states.last()
        names = list(state.generations) if state else []
        try:
            rows = self.spark.read.schema(f"{SCHEMA}, deleted boolean, generation string").parquet(f"{self.root}/rows")
        except AnalysisException:
            rows = self.spark.createDataFrame([], f"{SCHEMA}, deleted boolean, generation string")
        return rows.where(F.col("generation").isin(names)), len(names)

    def read(self) -> DataFrame:
        """The rows that hold.  Where there are several generations, the last one of each repeated id is found on ids alone;
        vectors and texts are not sorted or shuffled for it unless very many ids are repeated."""
        rows, n = self._live()
        if n > 1:
            last = rows.groupBy("id").agg(F.max("generation").alias("_last"), F.count("*").alias("_n")).where("_n > 1").select("id", "_last")
            rows = rows.join(_checked(last), "id", "left").where("_last is null or generation = _last")
        return rows.where("not deleted").select(*COLUMNS)

    def compact(self) -> None:
        """One generation in the place of all; unchanged where there is only one."""
        state = self.states.last()
        if state and len(state.generations) > 1:
            name = self._write(self.read().withColumn("deleted", F.lit(False)), state)
            self.states.publish(state, [name], self.dimensions, state.batch)

    def wants_compaction(self, share: float = 0.2, least: int = 1000) -> bool:
        """Are more than ``share`` of the stored rows, and ``least`` of them, replaced or deleted, or the generations too many?"""
        rows, n = self._live()
        if n < 2 or n > MAX_GENERATIONS:
            return n > 1
        per = rows.groupBy("id").agg(F.count("*").alias("n"), F.max(F.struct("generation", "deleted")).alias("last"))
        total, live = per.agg(F.sum("n"), F.count_if(~F.col("last.deleted"))).first()
        return (total or 0) - live >= least and (total or 0) - live > share * total

    def index(self) -> ListIndex:
        """Inverted lists over the rows that hold, made once a state."""
        state = self.states.last()
        made = ListIndex(self.spark, f"{self.root}/lists-{state.serial if state else 'none'}")
        try:
            self.spark.read.parquet(f"{made.folder}/centres")
            made.id_type = "string"
            return made
        except AnalysisException:
            return made.build(self.read().select("id", "vector"))

    def nearest(self, asked: DataFrame, limit: int = 5, score_threshold: float | None = None) -> DataFrame:
        """(query_id, position, id, score, text) for queries (query_id, vector); texts are read of the hits only."""
        rows = self.read()
        if self.index_above is not None and rows.count() > self.index_above:
            found = top(self.index().search(asked, limit, score_threshold), limit).select("query_id", "position", "id", "score")
        else:
            found = retrieve(asked, rows.select("id", "vector"), limit, score_threshold)
        return rows.select("id", "text").join(_checked(found), "id").select("query_id", "position", "id", "score", "text")

    def retrieve(self, queries: DataFrame, embedder: Embedder, limit: int = 5, score_threshold: float | None = None) -> DataFrame:
        """(query_id, position, id, score, text) for queries (query_id, text)."""
        return self.nearest(embedded(queries.select("query_id", "text"), embedder, self.dimensions).select("query_id", "vector"), limit, score_threshold)
