"""Writers: answer files, named texts and folders of files."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.answers import lines


def default_name(now: datetime | None = None) -> str:
    return f"answers_{now or datetime.now():%Y%m%d_%H%M%S}.json"


def write_answers(records: DataFrame, path: str | None = None, three: bool = False) -> str:
    """Write one object a record, or three, each followed by a blank line, sorted by category and place in the sheet.

    The rows are range-sorted over files, so no task holds them all; the files in name order are the whole.
    """
    target = path or default_name()
    ordered = lines(records, three).orderBy("category", "q_pos", "part").select("line")
    ordered.write.option("lineSep", "\n\n").text(target)
    return target


def write_texts(texts: DataFrame, path: str) -> None:
    """Write named texts (name, text) as JSON lines, many a file.  Texts of one name are numbered from the second on, as one
    would otherwise take the other's place."""
    order = Window.partitionBy("name").orderBy(*[c for c in ("path", "text") if c in texts.columns])
    again = F.row_number().over(order)
    stem = F.regexp_replace("name", r"\.txt$", "")
    named = texts.withColumn("_n", again).select(F.when(F.col("_n") == 1, F.col("name")).otherwise(F.concat(stem, F.lit("-"), F.col("_n").cast("string"), F.lit(".txt"))).alias("name"), "text")
    named.write.json(path)


def write_files(rows: DataFrame, folder: str) -> int:
    """Write the ``body`` (binary) of each row as a ``.txt`` file of its own; gives their number.

    Spark's writer starts a process a file to set its mode where Hadoop has no native library.  Names go by task and place,
    so a task that runs again writes the same files.
    """
    fs, root = FileSystem.from_uri(folder)
    fs.create_dir(root)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (fs, root), part, n = FileSystem.from_uri(folder), TaskContext.get().partitionId(), 0
        for f in frames:
            for body in f["body"]:
                with fs.open_output_stream(f"{root}/part-{part:05d}-{n:07d}.txt") as file:
                    file.write(bytes(body))
                n += 1
        yield pd.DataFrame({"n": [n]})

    return rows.select("body").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0
