"""Ordered lists and exact medians of groups, without gathering the rows of a large group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of a joined list that a sheet needs; its cells hold half as many.
LIST = 65_536
#: Numbers of a slice of a whole list.
WIDE = 65_536


def joined_lists(rows: DataFrame, keys: list[str], value: str, order: str, most: int | None = LIST, every: int = 1_024) -> DataFrame:
    """keys and ``list``: a group's values joined by newlines in the order of ``order``, the first ``most`` characters,
    or all of them (None).

    ``order`` is an integer, different for each row, as ``numbered`` makes it; keys aren't null, null values are left out.
    Where a group's values take more than ``most`` characters, lengths are added up by slices of ``every`` numbers, and only
    the slices that the text reaches into are gathered: ``most`` characters and one slice at most. Other groups are gathered
    as they are. A whole list is joined slice by slice first, then from the slices' texts. No rows give no groups.
    """
    d = rows.select(*keys, F.col(value).alias("_value"), F.col(order).cast("long").alias("_at")).where(F.col("_value").isNotNull())
    if most is None:
        texts = d.groupBy(*keys, F.expr(f"_at div {WIDE}").alias("_slice")).agg(F.array_sort(F.collect_list(F.struct("_at", "_value"))).alias("_all"))
        texts = texts.select(*keys, "_slice", F.array_join("_all._value", "\n").alias("_text"))
        listed = texts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_slice", "_text"))).alias("_all"))
        return listed.select(*keys, F.array_join("_all._text", "\n").alias("list"))
    size = F.sum(F.length("_value") + 1).alias("_size")
    long = d.groupBy(*keys).agg(size).where(F.col("_size") > most).drop("_size")
    d = d.withColumn("_slice", F.expr(f"_at div {every}"))
    slices = d.join(long, keys, "left_semi").groupBy(*keys, "_slice").agg(size)
    before = F.sum("_size").over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    last = slices.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") <= most).groupBy(*keys).agg(F.max("_slice").alias("_last"))
    near = d.join(last, keys, "left").where("_last IS NULL OR _slice <= _last")
    listed = near.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_value"))).alias("_all"))
    return listed.select(*keys, F.substring(F.array_join("_all._value", "\n"), 1, most).alias("list"))


def medians(rows: DataFrame, keys: list[str], value: str, hot: int = 100_000) -> DataFrame:
    """keys and ``median``: the exact median of a group's values that aren't null, the mean of the middle two if even.

    A group of more than ``hot`` values is narrowed first: two approximate percentiles, a little off the middle, enclose it,
    the values below are counted, and only those in between are counted one by one and added up in order. Should the
    percentiles miss the middle, which the counts show, all the group's values are taken so. Keys aren't null; groups without
    a value have no row.
    """
    d = rows.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    large = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot)
    plain = d.join(large, keys, "left_anti").groupBy(*keys).agg(F.median("_v").alias("median"))
    of_large = d.join(large, keys)
    near = of_large.groupBy(*keys).agg(F.percentile_approx("_v", [0.499, 0.501], 10_000).alias("_q"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    sides = of_large.join(near, keys).groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.first("_q").alias("_q"), F.first("_min").alias("_min"), F.first("_max").alias("_max"),
        F.count_if(F.col("_v") < F.col("_q")[0]).alias("_below"), F.count_if(F.col("_v") <= F.col("_q")[1]).alias("_upto"),
    )
    left, right = F.expr("(_n - 1) div 2"), F.expr("_n div 2")  # places of the middle values, from 0
    holds = (F.col("_below") <= left) & (F.col("_upto") > right)
    sides = sides.select(
        *keys, "_n", F.when(holds, F.col("_q")[0]).otherwise(F.col("_min")).alias("_low"), F.when(holds, F.col("_q")[1]).otherwise(F.col("_max")).alias("_high"),
        F.when(holds, F.col("_below")).otherwise(0).alias("_below"),
    )
    inside = d.join(sides, keys).where(F.col("_v").between(F.col("_low"), F.col("_high"))).groupBy(*keys, "_n", "_below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))
    inside = inside.withColumn("_end", F.col("_below") + upto)
    at = lambda place: F.max(F.when((F.col("_end") - F.col("_c") <= place) & (place < F.col("_end")), F.col("_v")))
    narrowed = inside.groupBy(*keys).agg((at(left) * 0.5 + at(right) * 0.5).alias("median"))
    return plain.unionByName(narrowed)
