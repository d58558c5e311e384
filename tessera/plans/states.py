"""States of something kept in a folder: a small table to which each change appends a row, by Spark's own writer."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F


@dataclass
class States:
    """``columns`` describes a state; the rows have ``serial`` and ``writer`` besides."""

    spark: SparkSession
    path: str
    columns: str

    def last(self) -> Row | None:
        """The state that holds, None before the first; of writers at the same time the least name holds."""
        try:
            rows = self.spark.read.schema(f"serial long, writer string, {self.columns}").parquet(self.path)
        except AnalysisException:
            return None
        return rows.orderBy(F.desc("serial"), "writer").first()

    def publish(self, after: Row | None, *values: object) -> Row:
        """Append the state that comes after the one given; an error if another writer's holds instead."""
        writer, serial = uuid.uuid4().hex, after.serial + 1 if after else 0
        rows = self.spark.createDataFrame([(serial, writer, *values)], f"serial long, writer string, {self.columns}")
        rows.coalesce(1).write.mode("append").parquet(self.path)
        now = self.last()
        if now is None or now.writer != writer:
            raise RuntimeError("another writer changed the state at the same time")
        return now
