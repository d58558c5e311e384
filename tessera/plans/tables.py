"""Reading the tables and keeping intermediate results in the folder that all executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application: Spark serves the archive from the driver to all of them."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent.parent
        base = os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), "tessera_code")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", package.parent, package.name))
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, under a temporary folder if the master is local,
    else an error, as executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, keep: str | None = None) -> DataFrame:
    """Write the rows as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = keep or work_dir(df.sparkSession)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a text, as id, doc_id, text and their load columns; rows loaded again are still repeated."""
    c = table(spark, sf_dir, "chunks")
    return c.where(F.col("content.text").isNotNull() & F.col("id").isNotNull()).select("id", "doc_id", F.col("content.text").alias("text"), "source_path", "load_method")
