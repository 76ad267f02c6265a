"""Positions of records and chunks of so many of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import stored


def with_record_index(df: DataFrame, *order: str) -> DataFrame:
    """df with record_index, the place of each row in the order of the given columns, from 0; without a single-task sort.

    Rows are range-partitioned and sorted once, and written with their partition and place in it; the partitions' sizes,
    one row each, give what to add.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("__m", F.monotonically_increasing_id()), "ranged")  # partition << 33 | place
    part = F.shiftright("__m", 33)
    sizes = ranged.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = ranged.withColumn("__p", part).join(F.broadcast(offsets), "__p")
    return placed.select(*df.columns, (F.col("__before") + F.col("__m").bitwiseAND((1 << 33) - 1)).alias("record_index"))


def chunked(df: DataFrame, records: int, skip: tuple[int, ...] = ()) -> DataFrame:
    """df (record_index) with part, the number of its chunk; chunks in `skip` are left out."""
    out = df.withColumn("part", F.expr(f"record_index div {records}"))
    return out.filter(~F.col("part").isin(*skip)) if skip else out
