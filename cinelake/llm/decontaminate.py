"""Benchmark decontamination: one Aho-Corasick automaton over the windows of test items, texts scanned once."""

from __future__ import annotations

import string
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import materialize, text_column

#: Words of a window, and bytes of windows that one automaton holds at most.
WINDOW, AUTOMATON_BYTES = 10, 8 << 20
#: Fixed value: what stands between words, once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lower-case bytes of words, and a blank for all that stands between them; bytes over 0x7F belong to words.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
#: hits: maximal runs of hit words by their numbers from 0 (first, last), and where they are in the text's UTF-8 bytes.
FOUND = "n_words long, n_hit long, item_ids array<string>, hits array<struct<first:long,last:long,start:long,stop:long>>"


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """gram (words with a blank between them), item (the id as text) for every window of the items: ``window`` consecutive
    words, or all words of an item that has fewer. Null texts and texts without a word have none; rows are distinct."""
    low = F.translate(F.col(text_col).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    words = items.select(F.col(id_col).cast("string").alias("item"), F.filter(F.split(low, BETWEEN), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return words.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, window), " "))).alias("gram")).distinct()


class Scanner:
    """The automaton of (gram, item) pairs. A gram stands between blanks, so that it only meets whole words."""

    def __init__(self, pairs: list[tuple[bytes, str | None]]):
        grams: dict[bytes, list[str | None]] = {}
        for gram, item in pairs:
            grams.setdefault(gram, []).append(item)
        self.found = ahocorasick.Automaton()
        for gram, items in grams.items():
            self.found.add_word(f" {gram.decode('latin-1')} ", (gram.count(b" ") + 1, tuple(items)))  # a letter a byte
        if grams:
            self.found.make_automaton()
        self.some = bool(grams)

    def scan(self, raw: bytes) -> tuple[int, list[str], list[tuple[int, int, int, int]]]:
        """Words, items in the order of their text, and the runs of hit words."""
        folded = raw.translate(_FOLD)
        words = folded.split()
        if not words or not self.some:
            return len(words), [], []
        met = list(self.found.iter(f" {b' '.join(words).decode('latin-1')} "))
        if not met:
            return len(words), [], []
        blank = np.frombuffer(b" " + folded + b" ", np.uint8) == 32
        start, stop = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
        last = np.searchsorted(np.cumsum(stop - start + 1), [at for at, _ in met])  # the word before the blank where a match ends
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, last - np.array([n for _, (n, _) in met]) + 1, 1)
        np.add.at(edges, last + 1, -1)
        turn = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(edges[:-1]) > 0, [0]])))
        hits = [(int(a), int(b) - 1, int(start[a]), int(stop[b - 1])) for a, b in zip(turn[::2], turn[1::2], strict=True)]
        return len(words), sorted({x for _, (_, own) in met for x in own if x is not None}), hits


def _joined(hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs that overlap or follow each other as one."""
    out: list[tuple[int, int, int, int]] = []
    for first, last, start, stop in sorted(hits):
        if out and first <= out[-1][1] + 1:
            f, l, a, b = out.pop()
            out.append((f, max(l, last), a, max(b, stop)))
        else:
            out.append((first, last, start, stop))
    return out


def _rows(found: list[tuple[int, list[str], list[tuple[int, int, int, int]]]]) -> list[pa.Array]:
    """The columns of FOUND."""
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "stop")]))
    hits = [[dict(zip(("first", "last", "start", "stop"), h, strict=True)) for h in own] for _, _, own in found]
    hit = [sum(last - first + 1 for first, last, _, _ in own) for _, _, own in found]
    return [pa.array([n for n, _, _ in found], pa.int64()), pa.array(hit, pa.int64()), pa.array([x for _, x, _ in found], pa.list_(pa.string())), pa.array(hits, kind)]


def find_windows(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per row of df: id, n_words, n_hit (words inside an occurrence of a window of the items), item_ids (items with
    occurring windows, as text, sorted), hits (runs of hit words, with their byte offsets in the text as it is).

    items: item_id, text. A-Z count as lower case; a word is a run of digits, letters a to z and bytes over 0x7F. A null text
    has no words, and neither has an item without one any window. Items that share an id are one item; an item whose id is null
    hits words but is never named. Rows of df may repeat and have null ids: each has its own row. Other columns are not read.
    Without items nothing is hit; without rows there are none.

    All windows together make one automaton, of which each worker builds its own from a broadcast list. The list's size is
    measured first: past ``most_bytes`` windows are dealt out by a hash over several automata, each within the bound, and the
    texts are read once for each of them; what they find in a text is put together by the text's SHA-256.
    """
    spark = df.sparkSession
    windows = materialize(windows_of(items, text_col="text", window=window), "windows")
    size = windows.agg(F.sum(F.octet_length("gram") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    parts = -(-size // most_bytes) or 1
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def scanned(part: int, texts: DataFrame, schema: str) -> DataFrame:
        own = windows if parts == 1 else windows.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part)
        pairs = spark.sparkContext.broadcast([(r.gram.encode("utf-8"), r.item) for r in own.collect()])  # about most_bytes at most

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(pairs.value)
            for batch in batches:
                found = [scanner.scan(x.as_buffer().to_pybytes()) for x in text_column(batch, "text").cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *_rows(found)], names=[batch.schema.names[0], "n_words", "n_hit", "item_ids", "hits"])

        return texts.mapInArrow(each, schema)

    if parts == 1:
        return scanned(0, rows, f"id {kind}, {FOUND}").withColumnRenamed("id", id_col)
    named = materialize(rows.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "text"), "texts")
    found = [materialize(scanned(p, named.select("sha", "text"), f"sha string, {FOUND}").dropDuplicates(["sha"]), "found") for p in range(parts)]

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, names, hits in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                out.append((n, sorted({x for own in names for x in own}), _joined([tuple(h.values()) for own in hits for h in own])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_rows(out)], names=["sha", "n_words", "n_hit", "item_ids", "hits"])

    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = every.groupBy("sha").agg(F.first("n_words").alias("n_words"), F.collect_list("item_ids").alias("names"), F.collect_list("hits").alias("hits"))  # a row for each automaton
    every = materialize(every.mapInArrow(together, f"sha string, {FOUND}"), "every")
    return named.select("id", "sha").join(every, "sha").select(F.col("id").alias(id_col), "n_words", "n_hit", "item_ids", "hits")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``find_windows`` of all documents and all benchmark items: doc_id, n_words, n_hit, n_items, items_sha256 (of the item
    ids, joined by commas), contaminated. Nulls, repeated rows, ties and empty tables as stated there."""
    found = find_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH low AS (
  SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), cut AS (
  SELECT side, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low
), word AS (
  SELECT side, id, len(w) AS n_words, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM cut
), size AS (
  SELECT DISTINCT least(len(w), 10) AS n FROM cut WHERE side = 'b' AND len(w) > 0
), gram AS (
  SELECT side, id, p, n, n_words, string_agg(word, ' ') OVER (PARTITION BY side, id, n ORDER BY p ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS g
  FROM word, size
), win AS (
  SELECT DISTINCT id AS item_id, n, g FROM gram WHERE side = 'b' AND n = least(n_words, 10) AND p + n - 1 <= n_words
), hit AS (
  SELECT d.id AS doc_id, d.p, d.n, w.item_id FROM gram d JOIN win w ON d.n = w.n AND d.g = w.g WHERE d.side = 'd' AND d.p + d.n - 1 <= d.n_words
), hits AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hit)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT c.id AS doc_id, len(c.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM cut c LEFT JOIN hits h ON h.doc_id = c.id LEFT JOIN named i ON i.doc_id = c.id WHERE c.side = 'd'
"""
