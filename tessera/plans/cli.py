"""Command line: ingest a folder into a collection, answer a question sheet, or answer questions as they are typed.

    python -m tessera.plans.cli --docs-dir DIR [--load-method overlap] [--md-file Q.md] [--output OUT]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import questions as Q
from tessera.operators.batch_qa import Answerer, answer_batch, first_passage
from tessera.operators.embedding import Embedder, hashing_embedder
from tessera.operators.store import Collection
from tessera.plans.tables import ship
from tessera.sources.files import load
from tessera.sources.sinks import write_answers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Ingest documents and answer questions")
    p.add_argument("--docs-dir", required=True, help="folder of .txt files, or none to use the collection as it is")
    p.add_argument("--load-method", choices=("chunked", "direct", "overlap"), default="chunked")
    p.add_argument("--db-location", default="memory", help="memory, or a folder that all executors share")
    p.add_argument("--batch-size", type=int, default=100, help="texts embedded at once")
    p.add_argument("--chunk-size", type=int, default=1024)
    p.add_argument("--overlap", type=int, default=200)
    p.add_argument("--split-by", choices=("char", "sentence", "paragraph"), default="char")
    p.add_argument("--md-file", help="question sheet to answer")
    p.add_argument("--output", help="where the answers go")
    p.add_argument("--dimensions", type=int, default=1024)
    p.add_argument("--limit", type=int, default=5, help="passages for a question")
    p.add_argument("--score-thresholds", type=float, nargs="+", default=[0.3, 0.2, 0.1], help="tried from the highest on until passages are found")
    return p


def ask(collection: Collection, embedder: Embedder, query: str, answerer: Answerer = first_passage, limit: int = 5, thresholds: tuple[float, ...] = (0.0,)) -> str:
    """The answer to one question; an error becomes the answer, as in a batch."""
    one = collection.spark.createDataFrame([("", 0, 0, query)], "category string, q_pos int, id long, text string")
    return answer_batch(one, collection, embedder, answerer, limit, thresholds=thresholds).first().answer


def main(args: list[str] | None = None, spark: SparkSession | None = None, answerer: Answerer = first_passage, embedder: Embedder | None = None) -> str | None:
    """Returns where the answers were written, if a sheet was given; else answers what is typed until ``exit``."""
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    ship(spark)
    collection = Collection(spark, "collection", a.dimensions, None if a.db_location == "memory" else a.db_location)
    embedder, thresholds = embedder or hashing_embedder(a.dimensions), tuple(a.score_thresholds)
    if a.docs_dir.lower() != "none":
        chunks = load(spark, a.docs_dir, a.load_method, a.chunk_size, a.overlap, a.split_by)
        # Files of equal content have equal ids and texts; a collection keeps one.
        collection.add(chunks.drop("source_path").dropDuplicates(["id"]), embedder, a.batch_size)
    if a.md_file:
        sheet = spark.read.text(a.md_file, wholetext=True).select(F.col("value").alias("text"))
        listed, questions = Q.categories(sheet), Q.parse(sheet)
        print(Q.summary_text(Q.summary(listed, questions)).first()[0])
        return write_answers(answer_batch(questions, collection, embedder, answerer, a.limit, thresholds=thresholds), a.output)
    while (query := input("question (exit ends): ")).strip() != "exit":
        print(ask(collection, embedder, query, answerer, a.limit, thresholds))
    return None


if __name__ == "__main__":
    main()
