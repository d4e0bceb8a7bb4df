"""What several corpus operators share: shared scratch tables, key hashing, text batches, tree merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.sources.snapshots import new_path

def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir, or one of our own where it is unset);
    everything goes when the driver ends."""
    return new_path(spark, label)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it again.

    The commit protocol of the writer makes retried and speculative tasks safe, and later stages that lose an executor
    read the table instead of running its inputs again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tree_merge(rows: DataFrame, keys: list[str], best: list[Column], row_id: str, fan_in: int = 16) -> DataFrame:
    """Groups equal keys through a tree of sorted runs, and hands each group's result back down the same tree.

    ``rows`` needs the key columns and ``row_id``; ``best`` orders the members of a group, and the smallest wins.
    Rows are dealt into runs by a hash of ``row_id``. In each round ``fan_in`` neighbouring runs meet and are merged by
    key (a sort aggregate: the smallest candidate and the sum of the sizes), until one run is left. No task ever gets
    more rows of one key than a run holds of it, or ``fan_in`` merged rows, however large the group is; the way back
    joins on (key, run) and keeps the same bound.

    Adds: ``best`` struct (fields b0..bn) of the whole group and ``group_size`` long. A key that holds a null groups
    with the same nulls. Empty input gives an empty result.
    """
    spark = rows.sparkSession
    width, rounds = fan_in, 1
    while width < shuffle_width(spark):
        width, rounds = width * fan_in, rounds + 1
    rows = rows.withColumn("__tm_run", F.pmod(F.xxhash64(row_id), F.lit(width)).cast("int"))
    named = F.struct(*[c.alias(f"b{i}") for i, c in enumerate(best)])
    level = rows.groupBy(*keys, "__tm_run").agg(F.min(named).alias("__tm_best"), F.count(F.lit(1)).alias("__tm_n"))
    levels = []
    for _ in range(rounds):
        levels.append(level.select(*keys, "__tm_run"))
        level = level.withColumn("__tm_run", F.shiftright("__tm_run", fan_in.bit_length() - 1)).groupBy(*keys, "__tm_run")
        level = level.agg(F.min("__tm_best").alias("__tm_best"), F.sum("__tm_n").alias("__tm_n"))
    down = level.filter("__tm_n > 1")
    for below in reversed(levels):
        parent = below.withColumn("__tm_up", F.shiftright("__tm_run", fan_in.bit_length() - 1))
        down = down.withColumnRenamed("__tm_run", "__tm_up")
        down = _null_safe(parent, down, [*keys, "__tm_up"], "inner").drop("__tm_up")
    out = _null_safe(rows, down, [*keys, "__tm_run"], "left")
    return (
        out.withColumn("best", F.coalesce("__tm_best", named))
        .withColumn("group_size", F.coalesce("__tm_n", F.lit(1).cast("long")))
        .drop("__tm_run", "__tm_best", "__tm_n")
    )


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    right = right.select(*[F.col(c).alias(f"__r_{c}") for c in on], *[c for c in right.columns if c not in on])
    met = [left[c].eqNullSafe(right[f"__r_{c}"]) for c in on]
    cond = met[0]
    for c in met[1:]:
        cond = cond & c
    return left.join(right, cond, how).drop(*[f"__r_{c}" for c in on])


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column without nulls (they count as empty), with 64-bit offsets."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col.cast(pa.large_string()), "")


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and each text's start (one more entry at the end)."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, len(texts) + 1, 8 * texts.offset)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cuts Arrow batches so that a slice holds about ``most`` bytes of text (or one longer text), to bound memory."""
    for batch in batches:
        texts = text_column(batch, text)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(texts):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start)
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift, multiply) over an array; wraps by design."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))
