"""Positions of rows in an order, without bringing a table or a hot group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.tables import stored


def positions(rows: DataFrame, order: tuple[str, ...], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """All columns and ``name``: the position from 0 in the order of ``order`` within each group of ``by``.

    Rows are range-partitioned by group and order, so a large group spreads over partitions; a row's position is its place
    in its partition plus the group's rows in the partitions before, of which there is one count a partition and group.
    Rows equal in ``order`` get adjacent positions in no fixed order; null keys sort first; an empty table stays empty.
    """
    keys = [*by, *order]
    placed = stored(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n"))
    before = before.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(by)], "_before")
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_{k}"))
    joined = placed.join(before, same).select(*placed.columns, "_before")
    place = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1
    return joined.withColumn(name, place.cast("long") + F.col("_before")).drop("_part", "_before")


def batches(rows: DataFrame, batch_size: int, order: str) -> DataFrame:
    """All columns and ``batch``: rows in the order of a unique column, ``batch_size`` at a time, from 0."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    return positions(rows, (order,), "_at").withColumn("batch", F.floor(F.col("_at") / batch_size).cast("long")).drop("_at")
