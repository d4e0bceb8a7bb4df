"""Pairs of texts whose similarity reaches a threshold: candidates by equal remains of short texts and by shared segments of
longer ones, exact bounds, then the ratio itself."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinelake.functions.text import normalize_alias, or_empty, ratio_of_keys
from cinelake.sources.snapshots import written

#: Rows of a batch of segments.
BATCH = 50_000
#: Remains that a short text has at most, and the length of the longest text that counts as short.
REMAINS, SHORT = 500, 256


class Bounds:
    """What a similarity of at least ``least`` percent (one decimal, half of it allowed for rounding) says of two lengths.

    The matching blocks of two texts follow each other in both, so M matched characters leave len(a) + len(b) - 2 M edits,
    each of which spoils one segment of b at most.
    """

    def __init__(self, least: float):
        if not 70 <= least <= 100:
            raise ValueError("the bounds need a similarity of 70 to 100")
        self.least, self.share = least, (least - 0.05) / 100 - 1e-9

    def edits(self, both: int) -> int:
        return int((1 - self.share) * both)

    def partners(self, size: int) -> tuple[int, int]:
        """Lengths that a text of this length can be similar to."""
        wide = (2 - self.share) / self.share
        return max(1, -int(-size / wide // 1)), int(size * wide)

    def segment(self, size: int) -> tuple[int, int]:
        """The length of a text's segments and how many of them any partner must hold one of. Segments of four and more are
        cut a character shorter than that needs, which leaves a choice of rare ones."""
        need = self.edits(size + self.partners(size)[1]) + 1
        length = max(1, size // need)
        return length - 1 if length > 3 else length, min(need, size)

    def common(self, both: int) -> int:
        """Characters that two texts of this total length must have in common at least, as a whole number."""
        return math.ceil(self.share * both / 2)

    def drops(self, size: int, longest: int) -> list[int]:
        """How many characters a text of this length loses to become what it has in common, at least, with a partner of each
        length up to ``longest``."""
        return sorted({size - self.common(size + n) for n in range(1, longest + 1) if self.common(size + n) <= min(size, n)})

    def short(self) -> int:
        """The length up to which no text has more than REMAINS remains."""
        fits = lambda longest: all(sum(math.comb(n, k) for k in self.drops(n, longest)) <= REMAINS for n in range(1, longest + 1))
        longest = 1
        while longest < SHORT and fits(longest + 1):
            longest += 1
        return longest

    def matched(self, a: int | np.ndarray, b: int | np.ndarray) -> float | np.ndarray:
        """Characters that two texts of these lengths must have in common at least."""
        return self.share * (a + b) / 2


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def _cut(nodes: DataFrame, bounds: Bounds, every: bool) -> DataFrame:
    """node, size, place, gram, need of keys: their segments, or (every) all grams as long as a partner's segments may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = lru_cache(4096)(lambda size: sorted({bounds.segment(n)[0] for n in range(bounds.partners(size)[0], bounds.partners(size)[1] + 1)}))

        def rows() -> Iterator[tuple]:
            for node, key in _keys(batches):
                size = len(key)
                length, need = bounds.segment(size)
                for n in lengths(size) if every else [length]:
                    for at in range(0, size - n + 1, 1 if every else n):
                        yield node, size, at, key[at : at + n], need

        yield from _batches(rows(), pa.schema({"node": pa.int64(), "size": pa.int32(), "place": pa.int32(), "gram": pa.string(), "need": pa.int32()}))

    return nodes.select("node", "key").mapInArrow(run, "node long, size int, place int, gram string, need int")


def _remains(nodes: DataFrame, bounds: Bounds, longest: int) -> DataFrame:
    """node, size, rest of keys of ``longest`` characters at most: what is left of them without as many characters, in any
    places, as ``drops`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drops = lru_cache(None)(lambda size: bounds.drops(size, longest))
        rows = ((node, len(key), rest) for node, key in _keys(batches) for k in drops(len(key)) for rest in {"".join(c) for c in combinations(key, len(key) - k)})
        yield from _batches(rows, pa.schema({"node": pa.int64(), "size": pa.int32(), "rest": pa.string()}))

    return nodes.where(F.length("key") <= longest).select("node", "key").mapInArrow(run, "node long, size int, rest string")


def _counts(keys: list[str]) -> np.ndarray:
    """How often characters occur in each key, in 64 classes of characters."""
    codes = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % 64
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    return np.bincount(64 * owner + codes, minlength=64 * len(keys)).reshape(-1, 64)


def _verified(pairs: DataFrame, bounds: Bounds) -> DataFrame:
    """a, b, similarity of the pairs (a, b, a_key, b_key) that reach the threshold. Lengths and the counts of characters, which
    bound the ratio from above, come first, for a batch at once; the ratio is difflib's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, last = difflib.SequenceMatcher(None), None
        for batch in batches:
            (x, i), (y, j) = ((d.dictionary.to_pylist(), d.indices.to_numpy()) for d in (batch.column(k).dictionary_encode() for k in (2, 3)))
            sizes = [np.array([len(k) for k in own], np.int64)[at] for own, at in ((x, i), (y, j))]
            least, most, left, right = bounds.matched(*sizes), np.minimum(*sizes), _counts(x), _counts(y)
            for k in range(0, len(i), BATCH):
                part = slice(k, k + BATCH)
                most[part] = np.minimum(most[part], np.minimum(left[i[part]], right[j[part]]).sum(axis=1))
            near, found = np.flatnonzero(most >= least), []
            for k in near.tolist():
                if y[j[k]] != last:
                    last = y[j[k]]
                    matcher.set_seq2(last)
                found.append(ratio_of_keys(x[i[k]], last, matcher))
            hit = np.array(found, np.float64) >= bounds.least
            own = batch.take(pa.array(near[hit]))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.array(found, np.float64)[hit])], ["a", "b", "similarity"])

    return pairs.select("a", "b", "a_key", "b_key").mapInArrow(run, "a long, b long, similarity double")


def keyed(df: DataFrame, text: str) -> DataFrame:
    """df with ``key``, the normal form of a text by which titles are compared; null counts as empty."""
    return df.withColumn("key", normalize_alias(or_empty(F.col(text))))


def similar_keys(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b, similarity for all keys of left and right (column ``key``) whose similarity is ``least`` or more (70 at least).

    The value is functions.text.similarity of the two, in this order. Keys are compared once each, however many rows have
    them; empty ones are similar to nothing. No rows on a side give none.

    Two short texts (``Bounds.short``) that are similar have so many characters in common, in the same order, that deleting
    the others leaves the same rest: they meet by equal rests. Where a text is longer, by the pigeonhole, of edits + 1 segments
    of b one stands in a as it is, not farther from its place than the edits allow; of b's segments the rarest are kept, and
    they meet the grams of a by equality. What met goes through the bounds by length and by counts of characters, and then
    through the ratio. Every join is sorted and merged: none hands a table to the driver, however small its files are.
    """
    bounds = Bounds(least)
    nodes = lambda df, name: written(df.select("key").where("key <> ''").distinct().withColumn("node", F.monotonically_increasing_id()), name)
    a = nodes(left, "left")
    b = a if right is left else nodes(right, "right")
    short, longest = bounds.short(), max(df.agg(F.coalesce(F.max(F.length("key")), F.lit(0))).first()[0] for df in {id(df): df for df in (a, b)}.values())
    own = lambda df, n: df.select(F.col("node").alias(n), F.col("size").alias(f"{n}_size"), "rest")
    common = F.ceil(F.lit(bounds.share) * (F.col("a_size") + F.col("b_size")) / 2)
    met = own(_remains(a, bounds, short), "a").join(own(_remains(b, bounds, short), "b").hint("merge"), "rest").where(F.length("rest") == common).select("a", "b")
    if longest > short:
        met = met.unionByName(_by_segments(a, b, bounds, short))
    pairs = written(met.distinct(), "candidates")
    named = lambda df, n: df.select(F.col("node").alias(n), F.col("key").alias(f"{n}_key")).hint("merge")
    found = written(_verified(pairs.join(named(a, "a"), "a").join(named(b, "b"), "b").sortWithinPartitions("b"), bounds), "similar")
    return found.join(named(a, "a"), "a").join(named(b, "b"), "b").select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), "similarity")


def _by_segments(a: DataFrame, b: DataFrame, bounds: Bounds, short: int) -> DataFrame:
    """a, b of the nodes that share a segment, for pairs of which one or both are longer than ``short``."""
    near = F.length("key") >= bounds.partners(short + 1)[0]
    cut = written(_cut(b.where(near), bounds, False), "segments")
    often = cut.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    rare = F.row_number().over(W.partitionBy("node").orderBy("often", "place"))
    cut = cut.join(often.hint("merge"), "gram").withColumn("rare", rare).where("rare <= need")
    cut = cut.select("gram", F.col("node").alias("b"), F.col("size").alias("b_size"), F.col("place").alias("b_place"))
    grams = _cut(a.where(near), bounds, True).select("gram", F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("place").alias("a_place"))
    edits = F.floor((F.col("a_size") + F.col("b_size")) * (1 - bounds.share))
    longer, shift = F.col("a_size") - F.col("b_size"), F.col("a_place") - F.col("b_place")
    fits = (F.greatest("a_size", "b_size") > short) & (F.abs(longer) <= edits) & (2 * shift <= edits + longer) & (-2 * shift <= edits - longer)
    return grams.join(cut.hint("merge"), "gram").where(fits).select("a", "b")
