"""Suffix-array dedup: merged Burrows-Wheeler transforms find every byte string that an earlier document holds too."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import byte_view, materialize, mix, shuffle_width, slices
from cinelake.llm.words import gram_hashes, prefix_sums, span_hashes

#: Length of the grams whose hashes deal out the text; a match of the default length holds 31 of them.
GRAM = 20
#: Bytes of text whose hashes are made at once, so that they stay in the processor's cache.
CHUNK = 1 << 16
#: Different runs of one gram hash over which their windows are dealt out by a second gram hash too.
HOT = 512


# ---- dealing out: every window of `length` bytes belongs to the smallest gram hash in it -----------------------------


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def fragments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Maximal runs of window starts with the same smallest gram hash: text, start, windows, mark (the hash), key.

    Equal windows have equal marks, so windows can only match within a mark; and ``key``, a hash of the run's bytes, tells
    equal runs. Windows never cross texts.
    """
    parts, i = [], 0
    while i + 1 < len(offsets):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        parts.append(_fragments(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, gram))
        parts[-1]["text"] += i
        parts[-1]["start"] += offsets[i]
        i = j
    kinds = {"text": np.int64, "start": np.int64, "windows": np.int64, "mark": np.uint64, "key": np.uint64}
    return {k: np.concatenate([p[k] for p in parts] or [np.zeros(0, t)]) for k, t in kinds.items()}


def _fragments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    total = len(data) - length + 1
    if total <= 0:
        return {k: np.zeros(0, np.int64) for k in ("text", "start", "windows")} | {k: np.zeros(0, np.uint64) for k in ("mark", "key")}
    sums = prefix_sums(data)
    low = _least(gram_hashes(data, gram, sums), length - gram + 1)
    fits = np.zeros(len(data) + 1, np.int8)
    size = np.diff(offsets)
    long = size >= length
    np.add.at(fits, offsets[:-1][long], 1)
    np.add.at(fits, (offsets[1:] - length + 1)[long], -1)
    valid = np.cumsum(fits[:total], dtype=np.int8) > 0
    change = np.empty(total, bool)
    change[0] = True
    np.not_equal(low[1:], low[:-1], out=change[1:])
    change[1:] |= ~valid[:-1]
    start = np.flatnonzero(valid & change)
    stop = np.empty(total, bool)
    stop[-1] = True
    stop[:-1] = change[1:] | ~valid[1:]
    windows = np.flatnonzero(valid & stop) - start + 1
    return {
        "text": np.searchsorted(offsets, start, side="right") - 1,
        "start": start,
        "windows": windows,
        "mark": low[start],
        "key": span_hashes(data, start, start + windows + length - 1, sums),
    }


def second_marks(data: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts runs of one mark further, by the second smallest gram hash of each window: run, start, windows, second hash.

    Equal windows of runs with equal marks have equal second hashes, too. A window whose grams all have the run's mark has
    the largest number.
    """
    size = windows + length - 1
    begin = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(starts - begin[:-1], size) + np.arange(begin[-1])]
    hashes = np.append(gram_hashes(flat, gram), np.zeros(gram - 1, np.uint64))
    inside = np.arange(begin[-1]) < np.repeat(begin[1:] - gram + 1, size)
    hashes[~inside] = ~np.uint64(0)
    mark = np.minimum.reduceat(hashes, begin[:-1])
    hashes[hashes == np.repeat(mark, size)] = ~np.uint64(0)
    low = _least(hashes, length - gram + 1)
    run = np.repeat(np.arange(len(starts)), windows)
    at = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    second = low[begin[run] + at]
    cut = _runs(run, second)
    return run[cut], starts[run[cut]] + at[cut], np.diff(np.append(cut, len(run))), second[cut]


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Slices of an array of 8-byte values as a binary column."""
    ends = np.append(cuts, len(values)) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows starts in sorted columns."""
    if len(columns[0]) == 0:
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


#: Facts of a document: keys (of runs of windows), places (a run's first byte << 32 | its windows) and, of kind RUNS and
#: HOT_RUNS, the names of their marks, of kind PARTS, the part of the run that is removed (first window << 32 | windows).
GONE, RUNS, PARTS, HOT_RUNS = 0, 1, 2, 3
FACTS = "doc long, kind int, keys binary, places binary, extra binary"


def _by_doc(kind: int, doc: np.ndarray, keys: np.ndarray, places: np.ndarray, extra: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """FACTS, one row per document."""
    order = np.argsort(doc, kind="stable")
    columns = [x[order] for x in (keys, places, *([] if extra is None else [extra]))]
    doc = doc[order]
    cuts = _runs(doc)
    for a in range(0, len(cuts), 20_000):
        part = cuts[a : a + 20_000]
        lo, hi = part[0], cuts[a + 20_000] if a + 20_000 < len(cuts) else len(doc)
        blobs = [_blobs(x[lo:hi], part - lo) for x in columns] + [pa.array([b""] * len(part), pa.binary())] * (extra is None)
        yield pa.RecordBatch.from_arrays([pa.array(doc[part]), pa.array(np.full(len(part), kind, np.int32)), *blobs], ["doc", "kind", "keys", "places", "extra"])


# ---- Burrows-Wheeler transforms of string collections ------------------------------------------------------------------


def _refine(order: np.ndarray, head: np.ndarray, loose: np.ndarray, key: np.ndarray, kind: str) -> np.ndarray:
    """Orders the rows at the places ``loose`` by ``key`` within their blocks, in place, and numbers the new blocks.

    order: the row at each place; head: the first place of each row's block, by row. Returns the places that are still in
    blocks of two rows or more.
    """
    rows = order[loose]
    block = head[rows]
    by = np.argsort(block * len(head) + key, kind=kind)
    rows, block, key = rows[by], block[by], key[by]
    order[loose] = rows
    new = np.ones(len(rows), bool)
    new[1:] = (block[1:] != block[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(rows)))
    head[rows] = np.repeat(loose[first], size)
    return loose[np.repeat(size > 1, size)]


def _blocks(keys: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by key, the first place of each row's block of equal keys, and the places in blocks of two or more."""
    order = np.argsort(keys, kind=kind).astype(np.int64)
    first = _runs(keys[order])
    size = np.diff(np.append(first, len(order)))
    head = np.empty(len(order), np.int64)
    head[order] = np.repeat(first, size)
    return order, head, np.flatnonzero(np.repeat(size > 1, size))


def sort_suffixes(packed: np.ndarray, step: int, left: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Order of all suffixes of strings that end in symbols of their own, by prefix doubling of what is still equal.

    packed: the first ``step`` symbols of each suffix as a number (nothing after the end); left: symbols to the end, the
    end's own included; owner: the string, whose number decides between suffixes that are equal up to their ends.
    """
    order, head, loose = _blocks(packed, "quicksort")
    while len(loose):
        rows = order[loose]
        inside = left[rows] > step  # in a block, all or none
        key = owner[rows]
        key[inside] = head[rows[inside] + step]
        loose = _refine(order, head, loose, key, "quicksort")
        step *= 2
    return order


def transforms(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per group: its number, the transform of its strings (uint8: 0 for a string's end, else byte + 1; UTF-8 has no byte
    over 0xF4), and the strings' indices."""
    by = np.argsort(group, kind="stable")
    starts, sizes, group = starts[by], sizes[by], group[by]
    full = sizes + 1
    begin = np.concatenate([[0], np.cumsum(full)])
    n, count = begin[-1], len(sizes)
    owner = np.repeat(np.arange(count), full)
    at = np.arange(n) - begin[owner]
    left = full[owner] - at
    symbol = np.zeros(n + 4, np.uint64)
    inner = np.flatnonzero(left > 1)
    symbol[inner] = data[starts[owner[inner]] + at[inner]].astype(np.uint64) + np.uint64(1)
    packed = symbol
    for k in (1, 2, 4):  # eight symbols, two more at a time
        ahead = np.zeros(n + 4, np.uint64)
        ahead[:n] = np.where(left > k, packed[k : n + k], 0)
        packed = packed << np.uint64(8 * k) | ahead
    order = sort_suffixes(packed[:n], 8, left, owner)
    cuts = _runs(group)
    if len(cuts) > 1:
        number = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, count)))
        order = order[np.argsort(number[owner[order]].astype(np.uint16 if len(cuts) < 1 << 16 else np.int64), kind="stable")]
    before = np.where(at[order] == 0, 0, symbol[order - 1]).astype(np.uint8)
    for k, a in enumerate(cuts.tolist()):
        b = int(cuts[k + 1]) if k + 1 < len(cuts) else count
        yield int(group[a]), before[begin[a] : begin[b]], by[a:b]


def walk(back: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of each row: all strings are walked back from the rows of their ends at once."""
    string, offset = np.empty(len(back), np.int32), np.empty(len(back), np.int32)
    row, live = ends, np.arange(len(sizes))
    string[row], offset[row] = live, sizes
    length = 0
    while True:
        length += 1
        keep = sizes[live] >= length
        if not keep.all():
            live, row = live[keep], row[keep]
        if len(live) == 0:
            return string, offset
        row = back[row]
        string[row], offset[row] = live, sizes[live] - length


def merge(shards: list[np.ndarray], ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merges transforms by refining their interleave until it has the order of the first ``depth`` symbols.

    ends: strings per shard. The interleave holds, for each place of the merged order, a row of a shard; rows of one shard
    always stand in the shard's own order, so its suffixes are never sorted anew. It starts as a stable merge of the
    shards, ascending runs already, by their first symbols (eight at most), which the transforms give by stepping on from
    row to row. A round takes the blocks of equal rows that are of two shards or more: a block's shards are merged, stably
    again, by the places of the suffixes that start where the equal symbols end, which the interleave has ordered already,
    so the number of equal symbols doubles. A block of one shard is settled: it has that shard's order. No text is compared.
    Ends of strings are all different.

    Returns, for each place, the row in the shards laid end to end, and the length of the prefix it shares with the place
    before, ``depth`` at most. And, for ``walk``, the steps back and the rows of the ends.
    """
    symbols = np.concatenate(shards)
    n = len(symbols)
    base = np.concatenate([[0], np.cumsum([len(s) for s in shards])])
    shard = np.repeat(np.arange(len(shards), dtype=np.int32), np.diff(base))
    ahead = np.concatenate([np.argsort(s, kind="stable").astype(np.int32) + np.int32(base[k]) for k, s in enumerate(shards)])  # without the first symbol
    back = np.empty(n, np.int32)
    back[ahead] = np.arange(n, dtype=np.int32)
    lead = np.concatenate([np.arange(base[k], base[k] + e) for k, e in enumerate(ends)])
    packed, steps = symbols[ahead].astype(np.uint64), [ahead]
    for k in (1, 2, 4):
        more = np.where(packed & np.uint64(255) != 0, packed[steps[-1]], 0)  # nothing follows an end
        packed = packed << np.uint64(8 * k) | more
        steps.append(steps[-1][steps[-1]])
    first = have = min(depth, 8)
    packed >>= np.uint64(8 * (8 - have))

    def onward(rows: np.ndarray, by: int) -> np.ndarray:
        for k in (8, 4, 2, 1):
            while by >= k:
                rows, by = steps[k.bit_length() - 1][rows], by - k
        return rows

    order, head, loose = _blocks(packed, "stable")  # merges runs that ascend
    # a block whose symbols hold an end is one of ends, which all differ: by shard, then as in the shard
    ended = packed[order[loose]] & np.uint64(255) == 0
    head[order[loose[ended]]] = loose[ended]
    loose = _mixed(order, head, loose[~ended], shard)
    while have < depth and len(loose):
        step = min(have, depth - have)
        loose = _mixed(order, head, _refine(order, head, loose, head[onward(order[loose], step)], "stable"), shard)
        have += step
    return order, _common(order, packed, onward, first, depth), back, lead


def _mixed(order: np.ndarray, head: np.ndarray, loose: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """The places in blocks of two shards or more. In other blocks each row has its own place from now on."""
    if len(loose) == 0:
        return loose
    cut = _runs(head[order[loose]])
    whose = shard[order[loose]]
    size = np.diff(np.append(cut, len(loose)))
    mixed = np.repeat(np.minimum.reduceat(whose, cut) < np.maximum.reduceat(whose, cut), size)
    settled = loose[~mixed]
    head[order[settled]] = settled
    return loose[mixed]


def _common(order: np.ndarray, packed: np.ndarray, onward: Callable[[np.ndarray, int], np.ndarray], first: int, depth: int) -> np.ndarray:
    """Length of the prefix that each place of the interleave shares with the place before, ``depth`` at most.

    packed: the first ``first`` symbols of each row. Neighbours that agree in all of them step on and compare the next.
    """
    common = np.zeros(len(order), np.int32)
    at, a, b = np.arange(1, len(order)), order[:-1], order[1:]
    digits = np.uint64(1) << np.arange(0, 8 * first, 8, dtype=np.uint64)
    for have in range(0, depth, first):
        differ = packed[a] ^ packed[b]
        equal = differ == 0
        common[at[~equal]] = have + first - np.searchsorted(digits, differ[~equal], side="right")
        at, a, b = at[equal], a[equal], b[equal]
        symbols = packed[a]
        ended = symbols & np.uint64(255) == 0
        if ended.any():  # as many symbols as come before the end
            common[at[ended]] = have + sum(((symbols[ended] >> np.uint64(8 * k)) & np.uint64(255) != 0).astype(np.int32) for k in range(first))
            at, a, b = at[~ended], a[~ended], b[~ended]
        if len(at) == 0:
            break
        a, b = onward(a, first), onward(b, first)
    common[at] = depth
    return np.minimum(common, depth)


# ---- the operator -------------------------------------------------------------------------------------------------------


def repeated_strings(
    df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", output: str = "spans", carry: tuple[str, ...] = (), hot: int = HOT
) -> DataFrame:
    """Removes every byte that a string of ``length`` bytes covers which also starts in a document with a smaller id.

    One row per input row. ``output`` "spans": id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes) and
    spans, array of (start, end) of the maximal removed runs in bytes; "text": id and kept_text, the remaining bytes
    without what is left of cut characters. ``carry``: further columns to keep as they are. Texts are whole UTF-8 texts; null counts as empty. Strings don't cross documents and
    are judged on the input. Documents with the same id remove nothing from each other; a row with a null id removes
    nothing and loses nothing. No other column is read. An empty table gives no rows.

    Windows are dealt out by the smallest gram hash in them (``fragments``), in which equal windows agree. Of equal runs
    of windows the smallest id is enough to know. Where one gram hash has different runs from two or more documents, their
    strings go through the suffix arrays: each task sends the transform of its strings, and the transforms of a bucket
    are merged; places that share ``length`` bytes are the repeated intervals. The runs of a gram hash that has more than
    ``hot`` different ones are first dealt out anew by the second smallest gram hash of each window. Runs are named by
    their place in a document; a fact counts only where the bytes at that place have the run's hash, so rows that share an
    id are told apart. Text is moved compressed, by id.
    """
    spark = df.sparkSession
    width = shuffle_width(spark)
    parts, buckets = 8 * width, 16 * width
    docs = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    named = docs.where("__id IS NOT NULL")

    def part_of(mark: np.ndarray, n: int) -> np.ndarray:
        return ((mix(mark) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "__text"):
            data, offsets = byte_view(texts)
            found = fragments(data, offsets, length)
            if len(found["start"]) == 0:
                continue
            order = np.argsort(found["key"])
            found = {k: v[order] for k, v in found.items()}
            key, doc = found["key"], batch.column(0).to_numpy()[found["text"]]
            place = ((found["start"] - offsets[found["text"]]) << 32 | found["windows"]).astype(np.uint64)
            first = _runs(key)
            here = doc == np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(key))))
            # repeated within this batch: known to be removed, whatever others hold
            gone = doc[~here], key[~here], place[~here]
            doc, key, place, mark = doc[here], key[here], place[here], found["mark"][here]
            part = part_of(mark, parts)
            order = np.argsort(part.astype(np.uint16) if parts < 65536 else part, kind="stable")
            part, doc, key, place, short = part[order], doc[order], key[order], place[order], mix(mark[order]).astype(np.uint32)
            cut = _runs(part)
            rows = [pa.array(part[cut].astype(np.int32)), _blobs(short, cut), _blobs(key, cut), _blobs(doc, cut), _blobs(place, cut)]
            yield pa.RecordBatch.from_arrays(rows, ["part", "marks", "keys", "docs", "places"])
            if len(gone[0]):
                cut = np.arange(0, len(gone[0]), 4096)
                to = (parts + gone[1][cut] % np.uint64(parts)).astype(np.int32)
                rows = [pa.array(to), pa.array([b""] * len(cut), pa.binary()), _blobs(gone[1], cut), _blobs(gone[0], cut), _blobs(gone[2], cut)]
                yield pa.RecordBatch.from_arrays(rows, ["part", "marks", "keys", "docs", "places"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for i, p in enumerate(batch.column(0).to_pylist()):
                key, doc, place = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((2, np.uint64), (3, np.int64), (4, np.uint64)))
                if p >= parts:
                    yield from _by_doc(GONE, doc, key, place)
                    continue
                # the part and 32 bits of the mark name a bucket
                name = np.uint64(p) << np.uint64(32) | np.frombuffer(batch.column(1)[i].as_buffer(), np.uint32).astype(np.uint64)
                for own, x in zip(held, (name, key, doc, place), strict=True):
                    own.append(x)
        if not held[0]:
            return
        name = np.concatenate(held[0])
        order = np.argsort(name)
        sorted_ = name[order]
        many = np.zeros(len(name), bool)
        same = sorted_[1:] == sorted_[:-1]
        many[1:] |= same
        many[:-1] |= same
        order = order[many]
        if len(order) == 0:
            return
        name, key, doc, place = name[order], *(np.concatenate(x)[order] for x in held[1:])
        held.clear()
        size = place & np.uint64(0xFFFFFFFF)
        order = np.lexsort((doc, size, key, name))
        name, key, doc, place, size = name[order], key[order], doc[order], place[order], size[order]
        run = _runs(name, key, size)
        times = np.diff(np.append(run, len(key)))
        later = doc > np.repeat(doc[run], times)
        if later.any():
            yield from _by_doc(GONE, doc[later], key[later], place[later])
        # marks with two runs or more of two documents or more
        at = _runs(name[run])
        kinds = np.diff(np.append(at, len(run)))
        apart = np.minimum.reduceat(doc[run], at) < np.maximum.reduceat(doc[run], at)
        for kind, chosen in ((RUNS, apart & (kinds <= hot)), (HOT_RUNS, apart & (kinds > hot))):
            ask = np.repeat(np.repeat(chosen, kinds), times) & ~later
            if ask.any():
                yield from _by_doc(kind, doc[ask], key[ask], place[ask], name[ask])

    dealt = named.mapInArrow(deal, "part int, marks binary, keys binary, docs binary, places binary")
    found = materialize(dealt.repartition(width, "part").mapInArrow(match, FACTS), "matches")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch, texts in slices(batches, "__text"):
            raw = [packer.compress(x.as_buffer()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), *batch.columns[2:]], ["__id", "__z", *batch.schema.names[2:]])

    def unpacked(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            at, held, size = 0, [], 0
            for i, z in enumerate(batch.column(1)):
                held.append(unpacker.decompress(z.as_buffer()))
                size += len(held[-1])
                if size >= most or i + 1 == batch.num_rows:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
                    yield batch.slice(at, i + 1 - at), np.frombuffer(b"".join(held), np.uint8), offsets
                    at, held, size = i + 1, [], 0

    def told(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All values of a column of lists of blobs, and the row each belongs to."""
        lists = pc.fill_null(column, []) if column.null_count else column
        blobs = lists.flatten()
        sizes = pc.binary_length(blobs).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return np.frombuffer(b"".join(x.as_buffer() for x in blobs), np.uint64), np.repeat(owner, sizes)

    def spans(keys: np.ndarray, places: np.ndarray, rows: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and windows of runs, and whether their row's text has the run there."""
        start, windows = (places >> np.uint64(32)).astype(np.int64), (places & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start += offsets[rows]
        fits = np.flatnonzero(start + windows + length - 1 <= offsets[rows + 1])
        true = np.zeros(len(keys), bool)
        if len(fits):
            true[fits] = span_hashes(data, start[fits], start[fits] + windows[fits] + length - 1) == keys[fits]
        return start, windows, true

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in unpacked(batches):
            strings = []
            for c in (2, 5):  # runs, then those of hot marks
                keys, rows = told(batch.column(c))
                places, _ = told(batch.column(c + 1))
                names, _ = told(batch.column(c + 2))
                start, windows, true = spans(keys, places, rows, data, offsets)
                keys, places, names, rows, start, windows = (x[true] for x in (keys, places, names, rows, start, windows))
                shift = np.zeros(len(keys), np.int64)
                if c == 5 and len(keys):
                    run, at, windows, second = second_marks(data, start, windows, length)
                    shift = at - start[run]
                    keys, places, rows, start, names = keys[run], places[run], rows[run], at, mix(names[run] ^ mix(second))
                strings.append((start, windows + length - 1, batch.column(0).to_numpy()[rows], keys, places, shift, part_of(names, buckets)))
            start, sizes, doc, keys, places, shift, bucket = (np.concatenate(x) for x in zip(*strings, strict=True))
            if len(start) == 0:
                continue
            made = [(q, bwt.tobytes(), *[x[i].tobytes() for x in (sizes, doc, keys, places, shift)]) for q, bwt, i in transforms(data, start, sizes, bucket)]
            q, *blobs = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), *[pa.array(b, pa.binary()) for b in blobs]], ["bucket", "bwt", "sizes", "docs", "keys", "places", "shifts"])

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list] = {}
        for batch in batches:
            for i, q in enumerate(batch.column(0).to_pylist()):
                kinds = (np.uint8, np.int64, np.int64, np.uint64, np.uint64, np.int64)
                shards.setdefault(q, []).append([np.frombuffer(batch.column(c + 1)[i].as_buffer(), t) for c, t in enumerate(kinds)])
        while shards:
            bwts, sizes, *facts = zip(*shards.popitem()[1], strict=True)
            row, common, back, ends = merge(list(bwts), np.array([len(s) for s in sizes]), length)
            same = common >= length
            both = same.copy()
            both[:-1] |= same[1:]
            if not both.any():
                continue
            string, offset = walk(back, ends, np.concatenate(sizes))
            doc, key, place, shift = (np.concatenate(x) for x in facts)
            row, same = row[both], same[both]
            doc_at = doc[string[row]]
            start = np.flatnonzero(~same)
            least = np.repeat(np.minimum.reduceat(doc_at, start), np.diff(np.append(start, len(row))))
            hit = row[doc_at > least]
            if len(hit):
                # neighbouring windows of a string are one part of its run
                at = np.sort(string[hit].astype(np.int64) << 32 | offset[hit])
                head = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                own, windows = at[head] >> 32, np.diff(np.append(head, len(at)))
                part = (shift[own] + (at[head] & 0xFFFFFFFF)) << 32 | windows
                yield from _by_doc(PARTS, doc[own], key[own], place[own], part.astype(np.uint64))

    packed = named.mapInArrow(squeeze, "__id long, __z binary")

    def gathered(facts: DataFrame, kinds: dict[int, tuple[str, ...]]) -> DataFrame:
        """Per document, lists of the blobs of each kind of fact."""
        d = facts.groupBy("doc").agg(*[F.collect_list(F.when(F.col("kind") == k, F.struct(*names))).alias(f"f{k}") for k, names in kinds.items()])
        return d.select("doc", *[F.col(f"f{k}.{c}").alias(f"{c}{k}") for k, names in kinds.items() for c in names])

    wants = gathered(found.where(F.col("kind").isin(RUNS, HOT_RUNS)), dict.fromkeys((RUNS, HOT_RUNS), ("keys", "places", "extra")))
    strings = packed.join(wants, F.col("__id") == F.col("doc")).drop("doc")
    strings = strings.mapInArrow(shard, "bucket int, bwt binary, sizes binary, docs binary, keys binary, places binary, shifts binary")
    windows = materialize(strings.repartition(width, "bucket").mapInArrow(intervals, FACTS), "windows")
    facts = gathered(found.where(F.col("kind") == GONE).unionByName(windows), {GONE: ("keys", "places"), PARTS: ("keys", "places", "extra")})
    kind = dict(df.dtypes)[id_col]
    rest = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" if output == "spans" else "kept_text string"

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in unpacked(batches):
            cover = np.zeros(len(data) + 1, np.int64)
            for c in (2, 4):  # whole runs, then parts of runs
                keys, rows = told(batch.column(c))
                if len(keys) == 0:
                    continue
                start, windows, true = spans(keys, told(batch.column(c + 1))[0], rows, data, offsets)
                if c == 4:
                    part, _ = told(batch.column(6))
                    start, windows = start + (part >> np.uint64(32)).astype(np.int64), (part & np.uint64(0xFFFFFFFF)).astype(np.int64)
                start, windows = start[true], windows[true]
                cover += np.bincount(start, minlength=len(cover)) - np.bincount(start + windows + length - 1, minlength=len(cover))
            gone = np.cumsum(cover[:-1]) > 0
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            starts = np.flatnonzero(gone & (edge[:-1] | np.concatenate([[True], ~gone[:-1]])))
            ends = np.flatnonzero(gone & (edge[1:] | np.concatenate([~gone[1:], [True]]))) + 1
            bound = np.searchsorted(starts, offsets)
            kept = [data[a:b][~gone[a:b]].tobytes() if bound[i] < bound[i + 1] else data[a:b].tobytes() for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))]
            if output != "spans":
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()), *batch.columns[7:]], [id_col, "kept_text", *carry])
                continue
            size = np.diff(offsets)
            home = np.repeat(offsets[:-1], np.diff(bound))
            pairs = pa.StructArray.from_arrays([pa.array(starts - home), pa.array(ends - home)], ["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size),
                    pa.array(size - np.array([len(k) for k in kept], np.int64)),
                    pa.array(np.diff(bound)),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pairs),
                    *batch.columns[7:],
                ],
                [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *carry],
            )

    more = "".join(f", `{c}` {dict(df.dtypes)[c]}" for c in carry)
    kept = [F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)]
    whole_docs = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"), *kept)
    all_packed = whole_docs.mapInArrow(squeeze, "__id long, __z binary" + "".join(f", __c{i} {dict(df.dtypes)[c]}" for i, c in enumerate(carry)))
    joined = all_packed.join(facts, F.col("__id") == F.col("doc"), "left")
    facts_of = [f"{c}{k}" for k, names in ((GONE, ("keys", "places")), (PARTS, ("keys", "places", "extra"))) for c in names]
    joined = joined.select(F.col("__id").cast(kind).alias("__id"), "__z", *facts_of, *[f"__c{i}" for i in range(len(carry))])
    return joined.mapInArrow(cut_out, f"`{id_col}` {kind}, {rest}{more}")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repeated_strings`` of all documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Nulls, repeated ids, empty
    texts and tables as stated there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_strings(docs).drop("spans")
