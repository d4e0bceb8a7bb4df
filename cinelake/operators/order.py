"""Numbers in a total order without gathering the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.sources.snapshots import written


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... in the given order (ties in any order).

    Rows are sorted within ranges and written; a row's number is its place in its range plus the rows of the ranges before,
    of which the driver gets one count each.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    sorted_ = written(sorted_, "sorted")
    part = F.shiftrightunsigned("_place", 33)  # Spark's ids: the task above, the row in it below
    counts = sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, starts = 0, []
    for r in counts:
        starts.append((r.part, before))
        before += r.n
    starts = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    met = sorted_.join(F.broadcast(starts), part == F.col("_part"))  # a row for each task
    return met.withColumn(name, F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1).drop("_place", "_part", "_before")
