"""Streaming ingest: files that arrive in a folder become chunks in a collection.

Each micro-batch is upserted by chunk id under its number, so a file seen twice, or a batch repeated after a failure,
changes nothing and no state is kept between batches; the collection compacts itself.

Files are small and many, so a batch takes many of them, a task reads as many as fit its bytes, and a batch is listed by a
few tasks instead of one a file.  Each file is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from tessera.functions.text import normalise_newlines
from tessera.operators import chunking
from tessera.operators.embedding import Embedder
from tessera.operators.store import Collection


#: Files of a micro-batch, at most; the driver holds their list.  Every batch is a generation of the collection, with jobs of its
#: own.
FILES_PER_BATCH = 20_000


def _small_files(spark: SparkSession) -> SparkSession:
    """A session like this one, whose settings for reading many small files leave the caller's alone."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.files.openCostInBytes", "64k")  # by default 4 MB, which makes a task of a few files
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.hive.filesourcePartitionFileCacheSize", "0")  # else the driver keeps the lists of past batches
    return own


def text_stream(spark: SparkSession, folder: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """(source_path, text): whole ``.txt`` files as they arrive."""
    stream = _small_files(spark).readStream.option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_per_batch)
    rows = stream.text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("source_path"), normalise_newlines(F.col("value")).alias("text"))


def chunk_stream(texts: DataFrame, load_method: str = "overlap", chunk_size: int = 1024, overlap: int = 200) -> DataFrame:
    if load_method == "chunked":
        return chunking.prechunked(texts)
    return chunking.overlapped(texts, chunk_size, overlap) if load_method == "overlap" else chunking.direct(texts, chunk_size)


def ingest(spark: SparkSession, folder: str, collection: Collection, embedder: Embedder, checkpoint: str, load_method: str = "overlap", once: bool = True) -> StreamingQuery:
    """Start the ingest; with ``once`` it ends when all present files are in."""

    def upsert(batch: DataFrame, number: int) -> None:
        batch.persist(StorageLevel.DISK_ONLY)  # short and long texts are chunked apart
        try:
            collection.add(chunk_stream(batch, load_method), embedder, batch=number)
        finally:
            batch.unpersist()

    writer = text_stream(spark, folder).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
