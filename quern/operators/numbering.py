"""Numbers over a whole table in an order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import scratch

LOCAL = 2**33 - 1


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "id", first: int = 1) -> DataFrame:
    """rows with `name`, counted from `first` in the order: rows are dealt into ranges and sorted there, and each range begins after the counts of those before it.

    The order should be total: ties are numbered in any way, once (the ranges are stored before they are counted). The offsets are one number a range."""
    keys = [f"_o{i}" for i in range(len(order))]
    dealt = rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    path = scratch(rows.sparkSession, "numbered")
    dealt.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path).withColumns({"_part": F.shiftright("_row", 33), "_row": F.col("_row").bitwiseAND(LOCAL)})
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_row") + F.col("_before") + first).drop("_part", "_row", "_before")
