"""Embedding near-dedup: an exact metric range join over pivot cells with boundary replication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import materialize
from cinelake.llm.components import least_ids

#: Vectors that a cell aims at, bytes of pivots in all at most, and vectors of a cell that one task compares with another block.
CELL, PIVOT_BYTES, BLOCK = 4096, 32 << 20, 4096


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a binary column of doubles of equal length."""
    if len(column) == 0:
        return np.zeros((0, 1))
    return np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in column), np.float64).reshape(len(column), -1)


def _cosine_at_least(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Cosines of unit vectors' pairs at or over the threshold; values near it are summed again one by one."""
    g = x @ y.T
    hit = g >= threshold
    for i, j in zip(*np.nonzero(np.abs(g - threshold) < 1e-12), strict=True):
        hit[i, j] = float(np.sum(x[i] * y[j])) >= threshold
    return hit


def _cells(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of unit vectors: the row, the cell, and whether it is the row's home."""
    d2 = np.maximum(0, 2 - 2 * (x @ pivots.T))
    near = d2.argmin(axis=1)
    least = np.sqrt(d2[np.arange(len(x)), near])
    apart = np.sqrt(np.maximum(0, 2 - 2 * (pivots[near] @ pivots.T)))
    to = np.sqrt(d2) <= least[:, None] + 2 * radius
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d2 - least[:, None] ** 2) / (2 * apart)
    to &= ~(plane > radius + 1e-9)
    to[np.arange(len(x)), near] = True
    which, cells = np.nonzero(to)
    return which, cells, near[which] == cells


def near_vectors(
    df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK, cell: int = CELL,
    pivot_bytes: int = PIVOT_BYTES,
) -> DataFrame:
    """One row per input row: id, n_links (other vectors linked directly), component_id, kept.

    Two vectors link when their labels are equal and not null and their cosine, in double precision, is at least
    ``threshold``. A vector that is null, empty, all zero, or holds null or non-finite components links with nothing, nor
    do vectors of different lengths. component_id is the smallest id that links reach (the row's own id included), and
    kept marks the rows that have it. Rows with equal label and vector are one node of the join and count in n_links one
    by one, repeated ids too; a null id takes part and is never a component's id unless it is alone. Other columns are
    not read. An empty table gives no rows. Nodes are named by SHA-256 of label and unit vector.

    On unit vectors the threshold is a distance r. Pivots (one for each ``cell`` vectors, spread by hash, of ``pivot_bytes``
    in all at most) cut a label into cells; a vector's home is its nearest pivot's cell. By the triangle inequality, a vector within r of
    somebody at home in cell j is at most 2 r farther from pivot j than from its own: it is copied to those cells, unless
    the plane between the two pivots is farther than r. Each pair meets in the home of its member with the smaller cell,
    so no cell needs another. A cell's vectors are compared in blocks of at most ``block``, each pair of blocks a task of
    its own; a task returns link counts and a forest of links, never all pairs.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("string").alias("__label"), F.col(vector_col).cast("array<double>").alias("__v"))
    good = F.col("__label").isNotNull() & (F.size("__v") > 0) & ~F.coalesce(F.exists("__v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    good = good & F.coalesce(F.exists("__v", lambda x: x != 0), F.lit(False))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column(2)
            lists = batch.column(3).filter(good)
            size = np.zeros(batch.num_rows, np.int64)
            size[good.to_numpy(zero_copy_only=False)] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            if len(x):
                own = size[size > 0]
                start = np.cumsum(own) - own
                x /= np.repeat(np.maximum.reduceat(np.abs(x), start), own)
                x /= np.repeat(np.sqrt(np.add.reduceat(x * x, start)), own)
            blobs = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(8 * np.append(0, ends)), pa.py_buffer(x)])
            blobs = pc.if_else(good, blobs, pa.scalar(None, pa.large_binary())).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blobs], ["__id", "__label", "__u"])

    units = materialize(rows.select("__id", "__label", F.coalesce(good, F.lit(False)), "__v").mapInArrow(unit, "__id long, __label string, __u binary"), "units")
    name = F.unhex(F.sha2(F.concat(F.unhex(F.sha2("__u", 256)), F.col("__label").cast("binary")), 256))
    units = units.withColumn("node", F.when(F.col("__u").isNotNull(), name))
    # a node per distinct label and vector; the minimum and the count are aggregated before the shuffle
    nodes = units.where("node IS NOT NULL").groupBy("node").agg(
        F.min("__id").alias("rep"), F.first("__label").alias("label"), F.count(F.lit(1)).alias("times"), F.first("__u").alias("u")
    )
    nodes = materialize(nodes.select("node", "rep", "label", F.octet_length("u").alias("dim"), "times", "u"), "vectors")

    # pivots: one for each `cell` vectors of a label (and length), pivot_bytes in all at most, spread by hash
    total, longest = nodes.agg(F.count(F.lit(1)), F.max("dim")).first()
    want = min(pivot_bytes // max(longest or 1, 1), -(-total // cell))
    if want > 1:
        share = min(1.0, 4.0 * want / total)
        some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30))).select("label", "dim", "node", "u")
        sample = some.orderBy(F.xxhash64("node"), "node").limit(want).collect()
    else:
        sample = []
    chosen: dict[tuple[str, int], list[bytes]] = {}
    for r in sample:
        chosen.setdefault((r.label, r.dim), []).append(bytes(r.u))
    pivots = {k: np.frombuffer(b"".join(v), np.float64).reshape(len(v), -1) for k, v in chosen.items()}
    shared = spark.sparkContext.broadcast(pivots)  # at most pivot_bytes
    radius = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            groups: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(labels, dims, strict=True)):
                groups.setdefault(key, []).append(i)
            for key, members in groups.items():
                own = shared.value.get(key)
                # a few rows at a time, so that their distances to all pivots stay small
                step = max(1, (1 << 22) // len(own)) if own is not None else len(members)
                for a in range(0, len(members), step):
                    part = batch.take(pa.array(members[a : a + step]))
                    if own is None:
                        which, cells, home = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64), np.ones(part.num_rows, bool)
                    else:
                        which, cells, home = _cells(_matrix(part.column(5)), own, radius)
                    out = part.take(pa.array(which))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cells), pa.array(home)], ["node", "rep", "label", "dim", "times", "u", "cell", "home"])

    dealt = materialize(nodes.mapInArrow(deal, "node binary, rep long, label string, dim int, times long, u binary, cell long, home boolean"), "cells")
    size = dealt.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    parted = dealt.join(materialize(size, "sizes"), ["label", "dim", "cell"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # blocks i <= j meet in task (i, j); each vector goes to the row and the column of its own block
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    parted = parted.select("label", "dim", "cell", "node", "times", "u", "home", "mine", other)
    parted = parted.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x = np.concatenate([_matrix(c) for c in table.column("u").chunks])
        times, mine = table.column("times").to_numpy(), table.column("mine").to_numpy()
        home = table.column("home").to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        links, root, edges = np.zeros(len(x), np.int64), np.arange(len(x)), []
        for k in range(0, len(left), 512):
            own = left[k : k + 512]
            hit = _cosine_at_least(x[own], x[right], threshold) & (own[:, None] != right[None])
            # a link counts for a vector in its home cell, where all its partners are, at home or as visitors
            links[own] += hit @ times[right]
            if i != j:
                links[right] += hit.T @ times[own]
            for r in np.flatnonzero(hit.any(axis=1)).tolist():
                mates = right[hit[r]]
                clusters, first = np.unique(root[mates], return_index=True)
                apart = clusters != root[own[r]]
                if apart.any():
                    edges += [(own[r], m) for m in mates[first[apart]]]
                    all_of = np.append(clusters, root[own[r]])
                    root[np.isin(root, all_of)] = all_of.min()
        own_nodes = pa.concat_arrays(table.column("node").chunks)
        ends = np.array(edges, np.int64).reshape(-1, 2)
        counted = np.flatnonzero(home & (links > 0))
        return pa.table(
            {
                "node": pa.concat_arrays([own_nodes.take(pa.array(counted)), pa.nulls(len(ends), pa.binary())]),
                "links": pa.concat_arrays([pa.array(links[counted]), pa.nulls(len(ends), pa.int64())]),
                "a": pa.concat_arrays([pa.nulls(len(counted), pa.binary()), own_nodes.take(pa.array(ends[:, 0]))]),
                "b": pa.concat_arrays([pa.nulls(len(counted), pa.binary()), own_nodes.take(pa.array(ends[:, 1]))]),
            }
        )

    found = parted.groupBy("label", "dim", "cell", "i", "j").applyInArrow(compare, "node binary, links long, a binary, b binary")
    found = materialize(found, "links")
    links = found.where("node IS NOT NULL").groupBy(F.col("node").alias("__node")).agg(F.sum("links").alias("links"))
    component = least_ids(nodes, found.where("a IS NOT NULL").select("a", "b")).select(F.col("node").alias("__linked"), "component")
    facts = nodes.select("node", "rep", "times").join(links, F.col("node") == F.col("__node"), "left").join(component, F.col("node") == F.col("__linked"), "left")
    facts = facts.select(F.col("node").alias("__node"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = units.select("__id", "node").join(materialize(facts, "facts"), F.col("node") == F.col("__node"), "left")
    component = F.coalesce("component", "__id")
    return out.select(
        F.col("__id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.col("__id").eqNullSafe(component).alias("kept"),
    )


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_vectors`` of all embeddings at a cosine of 0.98: vec_id, n_links, component_id, kept. Nulls, non-finite
    components, repeated rows and empty tables as stated there."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, count(l.b) AS n_links, any_value(c.component_id) AS component_id, e.vec_id = any_value(c.component_id) AS kept
FROM embeddings e JOIN comp c ON c.a = e.vec_id LEFT JOIN link l ON l.a = e.vec_id
GROUP BY e.vec_id
"""
