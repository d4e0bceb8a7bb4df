"""Hard-negative mining: exact inner products, bracketed by a table of pivot distances of augmented vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelake.llm.common import materialize

#: Pivots in all, and rows and anchors that one task compares.
PIVOTS, ROWS, ANCHORS = 16, 4096, 16384
_LEAST, _MOST = -(2**63), 2**63 - 1
_POSITIVES = "anchor long, anchor_id long, id long, score long"
_NEGATIVES = "anchor long, positive int, anchor_id long, positive_id long, positive_score long, id long, score long"


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(values), -1)


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with an integer vector; beyond the range of a long they stop at its ends."""
    if not len(x) or not len(q):
        return np.zeros(len(x), np.int64)
    xs, qs = x.astype(np.float64), q.astype(np.float64)
    if np.abs(xs).max() * np.abs(qs).max() * len(q) < 2.0**53:
        return (xs @ qs).astype(np.int64)
    return np.array([min(max(sum(a * b for a, b in zip(row, q.tolist(), strict=True)), _LEAST), _MOST) for row in x.tolist()], np.int64)


class _Bracket:
    """What the pivot table says of the scores of rows with an anchor.

    A row x becomes (x, sqrt(M - |x|^2)), an anchor q becomes (q, 0), where M is the largest |x|^2: their squared distance is
    |q|^2 + M - 2 <q, x>. Both have their distances to the pivots; by the triangle inequality the distance lies between the
    largest difference and the least sum of them, so the score lies between ``low`` and ``high``. Slack covers rounding.
    """

    def __init__(self, table: np.ndarray, most: float):
        self.table, self.most = table, most

    def of(self, own: np.ndarray, norm: float, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.table.shape[1]:
            return np.full(len(rows), -np.inf), np.full(len(rows), np.inf)
        near, far = np.zeros(len(rows)), np.full(len(rows), np.inf)
        for k in range(self.table.shape[1]):
            d = self.table[rows, k]
            near = np.maximum(near, np.abs(d - own[k]))
            far = np.minimum(far, d + own[k])
        whole, slack = norm + self.most, 1e-9 * (norm + self.most) + 1
        return (whole - far * far) / 2 - slack, (whole - near * near) / 2 + slack


def _best(ids: list, scores: np.ndarray, most: int) -> list[int]:
    """The first ``most`` places, higher scores first, then smaller ids, null ids last."""
    at = np.arange(len(scores))
    if len(scores) > most:  # all that tie with the last one stay
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
    return sorted(at.tolist(), key=lambda r: (-int(scores[r]), ids[r] is None, ids[r] or 0))[:most]


def _first(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first rows of each key by score, then id; the window's limit is applied before the shuffle, too."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _paired(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, block: int, many: int) -> DataFrame:
    """Rows and anchors dealt to the pairs of their blocks (r, a), of vectors of one length."""
    r, a = max(1, -(-n_rows // block)), max(1, -(-n_anchors // many))
    mine = lambda n: F.pmod(F.xxhash64("place"), F.lit(n)).cast("int")
    left = rows.select("place", "vec_id", "label", "v", "norm", "far", F.lit(None).cast("array<struct<id:long,score:long>>").alias("positives"), mine(r).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("a"))
    right = anchors.select("place", "vec_id", "label", "v", "norm", "far", "positives", F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("r"), mine(a).alias("a"))
    both = left.withColumn("asks", F.lit(False)).unionByName(right.withColumn("asks", F.lit(True)))
    return both.withColumn("dim", F.size("v"))


def hard_negatives(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 10,
    least: int = 30, most: int = 90, scale: int = 256, pivots: int = PIVOTS, block: int = ROWS, many: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hardest negatives of each anchor and positive.

    Components become floor(scale * x); a score is an inner product of those, exact (one that doesn't fit a long stops at its
    ends). Higher scores come first, ties by smaller id, null ids last. anchor: a condition on id_col and label_col; its rows
    are the anchors. An anchor's positives are its first ``positives`` other rows of the same label; for each, the first
    ``negatives`` rows of other labels come whose score is least to most percent of the positive's (none if that is negative).

    Rows with a null label or vector, or a null or non-finite component, take no part. Vectors of different lengths are never
    compared. Rows are told apart by their place in the table, so that repeated rows and ids each count. Other columns are not
    read. No rows or no anchors give no rows.

    Every anchor meets every row: in blocks of ``block`` rows and ``many`` anchors, a pair of blocks a task. The stored pivot
    distances bracket each score there, and only rows whose bracket can reach the wanted range are multiplied out. A task
    returns its own first rows, of which a window with a limit takes the first of all.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    rows = rows.select("vec_id", "label", "asks", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = materialize(rows.withColumns({"norm": norm, "place": F.monotonically_increasing_id()}), "vectors")  # the place is kept with the row
    n_rows, n_anchors, top = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max("norm")).first()
    top = top or 0.0
    chosen = rows.select("v", "norm").orderBy(F.xxhash64("place"), "place").limit(pivots).collect() if n_anchors else []
    table: dict[int, list[np.ndarray]] = {}
    for p in chosen:
        table.setdefault(len(p.v), []).append(np.append(np.array(p.v, np.float64), np.sqrt(max(0.0, top - p.norm))))
    shared = spark.sparkContext.broadcast({k: np.stack(v) for k, v in table.items()})  # PIVOTS vectors

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the distances to the pivots of the vector's length, of rows as such and of anchors as what they ask."""
        for batch in batches:
            out = []
            for asks in (False, True):
                lists: list[list[float]] = [[]] * batch.num_rows
                sizes = pc.list_value_length(batch.column(3)).to_numpy()
                for dim in np.unique(sizes):
                    own = shared.value.get(int(dim))
                    at = np.flatnonzero(sizes == dim)
                    if own is None:
                        continue
                    x = _matrix(batch.column(3).take(pa.array(at)), np.float64)
                    norms = batch.column(4).to_numpy(zero_copy_only=False)[at]
                    last = np.zeros(len(at)) if asks else np.sqrt(np.maximum(0.0, top - norms))
                    squares = [((x - p[:-1]) ** 2).sum(axis=1) + (last - p[-1]) ** 2 for p in own]
                    for i, row in zip(at.tolist(), np.sqrt(squares).T.tolist(), strict=True):
                        lists[i] = row
                out.append(pa.array(lists, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, "far", "far_asks"])

    schema = "place long, vec_id long, label long, v array<long>, norm double, asks boolean, far array<double>, far_asks array<double>"
    stored = materialize(rows.select("place", "vec_id", "label", "v", "norm", "asks").mapInArrow(far, schema), "pivots")
    none = F.lit(None).cast("array<struct<id:long,score:long>>")
    anchors = stored.where("asks").select("place", "vec_id", "label", "v", "norm", F.col("far_asks").alias("far"), none.alias("positives"))
    stored = stored.select("place", "vec_id", "label", "v", "norm", "far")

    def unpacked(block: pa.Table) -> tuple:
        asks = block.column("asks").to_numpy(zero_copy_only=False)
        mine, others = block.filter(pa.array(~asks)), block.filter(pa.array(asks))
        x = _matrix(mine.column("v"), np.int64) if mine.num_rows else np.zeros((0, 0), np.int64)
        table = _matrix(mine.column("far"), np.float64) if mine.num_rows else np.zeros((0, 0))
        return mine, others, x, _Bracket(table, top)

    def nearest(block: pa.Table) -> pa.Table:
        mine, others, x, bracket = unpacked(block)
        label, place, ids, out = mine.column("label").to_numpy(), mine.column("place").to_numpy(), mine.column("vec_id").to_pylist(), []
        members = {int(k): np.flatnonzero(label == k) for k in np.unique(label)}
        for q in others.to_pylist():
            own = members.get(q["label"], np.zeros(0, np.int64))
            own = own[place[own] != q["place"]]
            if not len(own):
                continue
            low, high = bracket.of(np.array(q["far"]), q["norm"], own)
            if len(own) > positives:  # the fifth of the lower ends is reached by five rows
                own = own[high >= np.partition(low, len(low) - positives)[len(low) - positives]]
            found = _scores(x[own], np.array(q["v"], np.int64))
            for k in _best([ids[r] for r in own], found, positives):
                out.append((q["place"], q["vec_id"], ids[own[k]], int(found[k])))
        return pa.table(dict(zip(("anchor", "anchor_id", "id", "score"), (pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)), strict=True)))

    def hardest(block: pa.Table) -> pa.Table:
        mine, others, x, bracket = unpacked(block)
        label, ids, out = mine.column("label").to_numpy(), mine.column("vec_id").to_pylist(), []
        unlike = {int(k): np.flatnonzero(label != k) for k in np.unique(label)}
        for q in others.to_pylist():
            own = unlike.get(q["label"], np.arange(len(label)))
            ranges = [(-(-least * p["score"] // 100), most * p["score"] // 100) for p in q["positives"]]
            ranges = [(max(a, _LEAST), min(b, _MOST)) for a, b in ranges]
            low, high = bracket.of(np.array(q["far"]), q["norm"], own)
            own = own[(high >= min(a for a, _ in ranges)) & (low <= max(b for _, b in ranges))]
            if not len(own):
                continue
            found, names = _scores(x[own], np.array(q["v"], np.int64)), [ids[r] for r in own]
            for k, (p, (a, b)) in enumerate(zip(q["positives"], ranges, strict=True)):
                inside = np.flatnonzero((found >= a) & (found <= b))
                for r in _best([names[i] for i in inside], found[inside], negatives):
                    out.append((q["place"], k, q["vec_id"], p["id"], p["score"], names[inside[r]], int(found[inside[r]])))
        names = ("anchor", "positive", "anchor_id", "positive_id", "positive_score", "id", "score")
        kinds = [pa.int32() if n == "positive" else pa.int64() for n in names]
        return pa.table(dict(zip(names, (pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)), strict=True)))

    paired = lambda a: _paired(stored, a, n_rows, n_anchors, block, many).groupBy("dim", "r", "a")
    first = _first(paired(anchors).applyInArrow(nearest, _POSITIVES), ["anchor"], positives)
    first = first.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))  # a few positives
    first = first.select("anchor", F.transform("p", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives"))
    asked = materialize(anchors.drop("positives").join(first, F.col("place") == F.col("anchor")).drop("anchor"), "anchors")
    out = _first(materialize(paired(asked).applyInArrow(hardest, _NEGATIVES), "hardest"), ["anchor", "positive"], negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hard_negatives`` of all embeddings, asked by the rows whose vec_id is divisible by 100; where it is divisible by 7 the label
    is the next one first. Nulls, non-finite components, ties, repeated rows and empty tables as stated there."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
