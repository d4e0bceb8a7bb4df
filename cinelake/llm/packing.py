"""Best-fit packing of tokenised documents: minimum bin slack by bitset subset sums over the available lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelake.llm.bpe import encoder
from cinelake.llm.common import materialize, slices


def document_pieces(
    df: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encodes every whole text, appends ``end_id`` and cuts only documents of more than ``capacity`` ids into pieces.

    One row per piece: id, piece (from 0), start, length, ids_crc32 (of little-endian unsigned 32-bit ids), and the ids
    themselves with ``with_ids``. Null and empty texts give one piece that holds ``end_id`` alone. Repeated rows and null
    ids each give their own pieces. Other columns are not read.
    """
    kind = dict(df.dtypes)[id_col]
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch, texts in slices(batches, "__text"):
            owner, piece, start, length, crc, kept = [], [], [], [], [], []
            for k, ids in enumerate(enc.encode(texts.to_pylist())):
                ids += end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    owner.append(k), piece.append(p), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(np.frombuffer(part, "<u4").astype(np.int64))
            cols = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.list_(pa.int64()))] * with_ids, names)

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def fullest(available: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """Of (length, count) pairs, a choice whose sum is as near ``room`` as any is, as (length, how many).

    A big integer is the bitset of reachable sums; each length adds its copies in powers of two. The search stops once
    the room is filled exactly; else the highest reachable sum wins. Bitsets of all steps give the way back.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # length, copies in this step, sums before it
    for length, count in available:
        left, take = min(count, room // length), 1
        while left > 0:
            take = min(take, left)
            more = (reach | reach << (length * take)) & mask
            if more != reach:
                steps.append((length, take, reach))
                reach = more
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> at & 1:
            at -= length * copies
            chosen[length] = chosen.get(length, 0) + copies
    return sorted(chosen.items(), reverse=True)


def plan_bins(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Fills bins by minimum slack from a histogram (counts[length]); returns table rows and the number of bins.

    Per bin the longest available piece is placed and the rest of the room is filled as far as any combination of the
    available pieces can; the combination is then removed, as often as the histogram holds it. Each choice uses up a
    length (down to less than one more copy of the combination), so their number depends on the capacity and hardly on
    the number of pieces. Table rows: length, first rank, repeats, first bin, offset: the piece of that length with rank
    ``first rank + copy * repeats + i`` goes to bin ``first bin + i``, ``copy`` lengths after ``offset``.
    """
    left = counts.astype(np.int64).tolist()
    used = [0] * len(left)
    rows, bins, top = [], 0, capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            break
        left[top] -= 1
        combo = dict(fullest([(n, left[n]) for n in range(min(top, capacity - top), 0, -1) if left[n]], capacity - top))
        left[top] += 1
        combo[top] = combo.get(top, 0) + 1
        repeats = min(left[n] // k for n, k in combo.items())
        at = 0
        for n, k in sorted(combo.items(), reverse=True):
            rows.append((n, used[n], repeats, bins, at))
            used[n] += k * repeats
            left[n] -= k * repeats
            at += n * k
        bins += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5), bins


def best_fit_pack(pieces: DataFrame, capacity: int = 4096, length_col: str = "length") -> DataFrame:
    """Adds sequence_id and offset (both long) to rows that have a length of 1 to ``capacity``.

    The driver sees only the histogram of lengths (at most ``capacity`` rows) and returns a table of placements whose size
    is bound by the capacity. Rows get a rank among those of their length from the rank within their task and the counts
    of the tasks before it, so that no length is gathered anywhere, however many rows share it. Rows of equal length are
    interchangeable; repeated rows take a place each. Null lengths and lengths outside 1..capacity are an error. No rows
    give no sequences.
    """
    fields = pieces.schema.fieldNames()
    at = fields.index(length_col)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            if batch.column(at).null_count or (len(length) and not (1 <= length.min() and length.max() <= capacity)):
                raise ValueError(f"lengths must be 1 to {capacity}")
            order = np.argsort(length, kind="stable")
            run = length[order]
            local = np.empty(len(length), np.int64)
            local[order] = np.arange(len(run)) - np.searchsorted(run, run) + seen[run]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), task, np.int32)), pa.array(local)], [*fields, "__task", "__local"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", __task int, __local long"
    ranked = materialize(pieces.mapInArrow(rank, schema), "pieces")
    counts = ranked.groupBy(F.col(length_col).alias("__len"), F.col("__task").alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__base", F.sum("__n").over(W.partitionBy("__len").orderBy("__t")) - F.col("__n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for n, c in counts.groupBy("__len").agg(F.sum("__n")).collect():
        histogram[n] = c
    table, _ = plan_bins(histogram, capacity)
    keys = table[:, 0] << 48 | table[:, 1]
    kept = [c for c in fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            spot = batch.column(len(fields)).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, length << 48 | spot, side="right") - 1]
            copy, which = np.divmod(spot - row[:, 1], row[:, 2])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(row[:, 3] + which), pa.array(row[:, 4] + copy * length)], [*kept, "sequence_id", "offset"])

    joined = ranked.join(before, (F.col(length_col) == F.col("__len")) & (F.col("__task") == F.col("__t")))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return joined.select(*[F.col(f"`{c}`") for c in fields], (F.col("__local") + F.col("__base")).alias("__rank")).mapInArrow(place, out)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_pieces`` of all documents, placed by ``best_fit_pack``: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. Null and empty texts are a piece of one id; repeated rows, null ids and empty tables as stated there."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # written first, so that no executor holds the workers of two Python steps at once
    return best_fit_pack(materialize(document_pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "cut"))
