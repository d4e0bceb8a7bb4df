"""N-gram Jaccard join: universe partition, segment subsets and one-deletion neighbourhoods, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinelake.llm.common import byte_view, materialize, mix, shuffle_width, slices, tree_merge
from cinelake.llm.components import least_ids
from cinelake.llm.words import span_hashes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_PLACE = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407], np.uint64)
_SALT = np.uint64(0x8CB92BA72F3D8DD7)

#: Shingles and sets that one verification task holds at most at once, unless a single text has more.
TASK_SHINGLES, TASK_SETS = 1 << 21, 2048
#: Tasks over which the nodes of one leader spread where facts of leaders are joined to them.
SPREAD = 32


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (64-bit hashes of ``width`` lower-cased words, sorted) of each text, and each set's start."""
    data, offsets = byte_view(texts)
    n = len(texts)
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    data = _LOWER[data]
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (edge[:-1] | np.concatenate([[True], ~solid[:-1]])))
    ends = np.flatnonzero(solid & (edge[1:] | np.concatenate([~solid[1:], [True]]))) + 1
    word = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)  # first word of each text
    count = np.diff(first)
    total = np.maximum(len(word) - width + 1, 0)
    gram = np.zeros(total, np.uint64)
    for k in range(width):
        gram += word[k : k + total] * _PLACE[k % 5]
    gram = mix(gram)
    sets, sizes = [], np.zeros(n, np.int64)
    for i in np.flatnonzero(count).tolist():
        a, c = first[i], count[i]
        if c < width:
            with np.errstate(over="ignore"):
                own = mix((word[a : a + c] * _PLACE[:c]).sum(keepdims=True) + np.uint64(c) * _SALT)
        else:
            own = np.sort(gram[a : a + c - width + 1])
            if len(own) > 1:
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                own = own[keep]
        sets.append(own)
        sizes[i] = len(own)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def set_keys(flat: np.ndarray, bounds: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, as signed integers; 0 for empty sets. Of the first, only the last ``bits`` bits."""
    out = []
    for salt in (np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ salt))])
        key = mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ salt)
        out.append(np.where(np.diff(bounds) > 0, key, np.uint64(0)).view(np.int64))
    return out[0] & np.uint64((1 << bits) - 1).astype(np.int64), out[1]


def _names(keys: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """Both hashes of each set as one value."""
    return np.stack(keys, axis=1).view("V16").ravel().tolist()


def bands(longest: int) -> np.ndarray:
    """First sizes of the size bands: neighbours differ by the factor 16/9, so a pair spans two of them at most once."""
    out = [1]
    while out[-1] <= longest:
        out.append(max(out[-1] + 1, out[-1] * 16 // 9))
    return np.array(out, np.int64)


def scheme(top: int) -> tuple[int, bool]:
    """Segments of the band whose largest set has ``top`` shingles, and whether one-deletion neighbourhoods are indexed.

    The cost is the number of signatures and the documents that share one by chance. Large sets: one signature per
    segment, with so many segments that those with content outnumber the allowed differences. Small sets have so few
    segments that this leaves single shingles or empty segments; there each segment counts twice, by its neighbourhood.
    """
    if top <= 60:
        return max(1, top // 4 if top > 5 else 1, -(-(top // 3 + 1) // 2)), True
    return -int(-top // (2.4 if top > 1000 else 2.0 if top > 300 else 1.7)), False


def signatures(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of each set and the set's number. Two sets with 7 * |difference| <= |X| + |Y| share one.

    The universe of hashes is cut into m equal ranges, so a sorted set falls into segments. A pair may differ in at most
    H shingles, so of more than H segments one has no difference (of more than H / 2, one has at most one). Allocation:
    a set emits its segments by classes that depend only on their content, cheapest first (two and more shingles, then
    single ones by hash, then empty ones), until it has emitted more than H. An equal segment is of the same class on
    both sides, and the set that stops first has enough, so the pair meets there. With neighbourhoods, classes go by
    the number of shingles and each set also emits the class just below the one it stops at.
    """
    size = np.diff(bounds)
    docs = np.flatnonzero(size)
    if len(docs) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edges = bands(int(size.max()))
    band = np.searchsorted(edges, size, side="right") - 1
    tops = np.append(edges[1:] - 1, edges[-1] * 16 // 9)
    plans = [scheme(int(t)) for t in tops]
    segments, near = np.array([p[0] for p in plans], np.int64), np.array([p[1] for p in plans])
    hashed = mix(flat ^ _SALT)
    out, who = [], []
    for lower in range(4):
        b = band - lower
        fits = (size > 0) & (b >= 0)
        fits &= (lower == 0) | (4 * tops[np.maximum(b, 0)] >= 3 * size)
        b = np.maximum(b, 0)
        most = size // 3 if lower == 0 else (size + np.minimum(tops[b], size)) // 7
        for deletion in (False, True):
            mine = np.flatnonzero(fits & (near[b] == deletion))
            if len(mine) == 0:
                continue
            n = size[mine]
            start = np.concatenate([[0], np.cumsum(n)])
            pick = np.repeat(bounds[mine] - start[:-1], n) + np.arange(start[-1])
            doc = np.repeat(np.arange(len(mine)), n)
            m = segments[b[mine]]
            seg = ((flat[pick] >> np.uint64(32)) * m[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            head = np.empty(len(pick), bool)
            head[0] = True
            head[1:] = (doc[1:] != doc[:-1]) | (seg[1:] != seg[:-1])
            at = np.flatnonzero(head)
            owner, number, count = doc[at], seg[at], np.diff(np.append(at, len(pick)))
            content = np.add.reduceat(hashed[pick], at)
            need = most[mine] + 1
            place = mix((b[mine][owner].astype(np.uint64) << np.uint64(40)) | (number.astype(np.uint64) << np.uint64(2)) | np.uint64(1))
            if deletion:
                stop = np.zeros(len(mine), np.int64)  # emit segments of at least stop - 1 shingles
                for t in (1, 2, 3, 4):
                    enough = 2 * np.bincount(owner[count >= t], minlength=len(mine)) >= need
                    stop[enough] = t
                send = count >= stop[owner] - 1
                empties = stop <= 1
            else:
                kind = np.where(count >= 2, 0, 1 + (content >> np.uint64(62)).astype(np.int64))
                have = np.cumsum(np.bincount(owner * 5 + kind, minlength=5 * len(mine)).reshape(-1, 5), axis=1)
                stop = (have < need[:, None]).sum(axis=1)
                send = kind <= stop[owner]
                empties = stop == 5
            out.append(mix(content[send] * _PLACE[1] + place[send]))
            who.append(mine[owner[send]])
            if deletion:
                group = np.cumsum(head) - 1
                token = np.flatnonzero(send[group])
                group = group[token]
                out.append(mix((content[group] - hashed[pick[token]]) * _PLACE[1] + place[group]))
                who.append(mine[owner[group]])
            for i in np.flatnonzero(empties).tolist():
                gone = np.setdiff1d(np.arange(m[i]), number[owner == i]).astype(np.uint64)
                out.append(mix(mix((np.uint64(b[mine][i]) << np.uint64(40)) | (gone << np.uint64(2)) | np.uint64(1))))
                who.append(np.full(len(gone), mine[i]))
    return np.concatenate(out), np.concatenate(who)


def parity_sketch(grams: np.ndarray) -> bytes:
    """Parities of the numbers of shingles whose hashes end in the same bits; 2 to 4 times as many bits as shingles."""
    width = 1 << max(6, (2 * len(grams) - 1).bit_length())
    bits = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _aligned(sketches: list[np.ndarray]) -> np.ndarray:
    """All sketches folded to the narrowest width among them (halves of a parity sketch add up to the next narrower one)."""
    width = min(len(x) for x in sketches)
    return np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in sketches])


def links_within(size: np.ndarray, sketches: list[np.ndarray], sets: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect every pair of sets with 100 * intersection >= percent * union; linear in number.

    Leaders take what links to them; then clusters that are still apart are compared member by member. The sketches (whose
    distance is at most the symmetric difference) and the sizes rule out most comparisons; the rest are counted exactly.
    Without ``sets``, what the sketches can't rule out counts as linked.
    """
    n = len(size)
    parity = _aligned(sketches)

    def linked(i: int, others: np.ndarray) -> np.ndarray:
        both = size[others] + size[i]
        differ = np.bitwise_count(parity[others] ^ parity[i]).sum(axis=1, dtype=np.int64)
        # differ <= |symmetric difference| = union - intersection <= both * (100 - percent) / (100 + percent)
        near = others[(100 + percent) * np.maximum(differ, np.abs(size[others] - size[i])) <= (100 - percent) * both]
        if len(near) == 0 or sets is None:
            return near
        own = sets[i]
        tokens = np.concatenate([sets[j] for j in near])
        spot = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
        cuts = np.concatenate([[0], np.cumsum(size[near])[:-1]])
        common = np.add.reduceat((own[spot] == tokens).astype(np.int64), cuts)
        return near[100 * common >= percent * (size[near] + size[i] - common)]

    links, clusters, rest = [], [], np.arange(n)
    while len(rest):
        leader, rest = int(rest[0]), rest[1:]
        hit = linked(leader, rest)
        links += [(leader, int(j)) for j in hit]
        clusters.append(np.concatenate([[leader], hit]))
        rest = rest[~np.isin(rest, hit)]
    root = np.arange(len(clusters))
    of = np.empty(n, np.int64)
    for k, c in enumerate(clusters):
        of[c] = k
    for k, c in enumerate(clusters):
        if len(c) < 2:
            continue
        for i in c[1:].tolist():  # its leader has been compared with all that came later
            apart = k + 1 + np.flatnonzero(root[k + 1 :] != root[k])
            if len(apart) == 0:
                break
            for j in linked(i, np.concatenate([clusters[x] for x in apart])).tolist():
                if root[of[j]] != root[k]:
                    root[root == root[of[j]]] = root[k]
                    links.append((i, j))
    return links


def _words(table: pa.Table, name: str, at: np.ndarray) -> list[np.ndarray]:
    column = table.column(name)
    return [np.frombuffer(column[int(i)].as_buffer(), np.uint64) for i in at]


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sets of a group, by the unsigned order of their buckets: bucket, node2, a row of each."""
    node, node2 = table.column("node").to_numpy(), table.column("node2").to_numpy()
    order = np.lexsort((node2, node.view(np.uint64)))
    a, b = node[order], node2[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[new], b[new], order[new]


def _possible(rows: DataFrame, percent: int) -> DataFrame:
    """lead, part, core, node: the buckets of each group (lead, part) that sketches connect with others, by such component.

    rows: lead, part, node, node2, n, sketch. Sets that no sketch connects are left out: they link with nothing in the group.
    """

    def run(table: pa.Table) -> pa.Table:
        node, _, at = _distinct(table)
        size = table.column("n").to_numpy()[at]
        root = np.arange(len(node))
        for i, j in links_within(size, _words(table, "sketch", at), None, percent):
            a, b = root[i], root[j]
            root[root == max(a, b)] = min(a, b)
        keep = np.flatnonzero(np.bincount(root, minlength=len(node))[root] > 1)
        lead, part = table.column("lead")[0].as_py(), table.column("part")[0].as_py()
        return pa.table({"lead": np.full(len(keep), lead), "part": np.full(len(keep), part, np.int32), "core": node[root[keep]], "node": node[keep]})

    return rows.groupBy("lead", "part").applyInArrow(run, "lead long, part int, core long, node long")


def _verify(rows: DataFrame, groups: list[str], percent: int) -> DataFrame:
    """Links (a, a2 with b, b2) among the sets of each group. rows: the group columns, node, node2, grams (binary)."""

    def run(table: pa.Table) -> pa.Table:
        node, node2, at = _distinct(table)
        sets = _words(table, "grams", at)
        size = np.array([len(s) for s in sets], np.int64)
        sketches = [np.frombuffer(parity_sketch(s), np.uint64) for s in sets]
        found = np.array(links_within(size, sketches, sets, percent), np.int64).reshape(-1, 2)
        a, b = found[:, 0], found[:, 1]
        return pa.table({"a": node[a], "a2": node2[a], "b": node[b], "b2": node2[b]})

    return rows.groupBy(*groups).applyInArrow(run, "a long, a2 long, b long, b2 long")


def _named(key: str, key2: str) -> Column:
    """A set's name of 128 bits."""
    return F.struct(F.col(key).alias("k"), F.col(key2).alias("k2"))


def _with_lead_facts(rows: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """rows (lead, node, ...) with the facts of their leaders, one row a leader, dealt by leader and a salt of the node, so
    that a very common leader's rows are in SPREAD tasks. Each fact is repeated as often: for few leaders only."""
    salted = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SPREAD)).cast("int"))
    return rows.join(salted, ["lead", "__salt"], how).drop("__salt")


def jaccard_classes(
    df: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text", task_shingles: int = TASK_SHINGLES, task_sets: int = TASK_SETS, key_bits: int = 64
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id: the smallest id that links reach; node: 128 bits of the set; kept:
    true for the rows of one set and id in each component, the smallest id.

    Two texts link when 100 * intersection >= percent * union of their sets of distinct ``width``-word shingles (words
    are runs of characters other than blanks, A-Z lower-cased; a shorter text is one shingle). Only percent >= 75 is
    covered by the signatures. Null, empty and blank texts have no shingles, link with nothing and are their own
    component. Texts with equal sets are one node of the join, found by 128-bit hashes of the sets; repeated rows share it.
    Rows that share an id but not a set have each their own component. A row with a null id takes part, and a component of
    such rows alone has a null id. Other columns are not read. An empty table gives no rows.

    Texts are read three times and never gathered: for set hashes, for signatures, and for the sets of those nodes that
    share a signature. Signatures travel packed. In each group of equal signatures every node is paired with the first;
    nodes paired with the same one meet in tasks of at most ``task_shingles`` shingles and ``task_sets`` sets: first their parity sketches, which
    leave out what can't link, then the sets of the rest, for a forest of verified links. Of a larger group, each part is
    verified with the first node, and what didn't link meets every part.

    Candidates go by buckets, the first ``key_bits`` (64) of a set's 128 bits: what is found for a bucket is looked into
    for all sets in it. Buckets of several sets are groups of their own, too. Links and components go by all 128 bits.
    """
    if percent < 75:
        raise ValueError("signatures cover percent >= 75")
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "__text"):
            flat, bounds = shingle_sets(texts, width)
            k1, k2 = set_keys(flat, bounds, key_bits)
            sketch = pa.array([parity_sketch(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(k1), pa.array(k2), sketch], ["__id", "__n", "__k", "__k2", "__sketch"])

    thin = materialize(docs.mapInArrow(hashes, "__id long, __n long, __k long, __k2 long, __sketch binary"), "sets")
    sketches = thin.where("__n > 0").groupBy(F.col("__k").alias("__key"), F.col("__k2").alias("node2")).agg(F.min("__n").alias("n"), F.min("__sketch").alias("sketch"))
    thin = thin.drop("__sketch")
    grouped = tree_merge(thin, ["__k", "__k2", "__n"], [F.col("__id").isNull(), F.col("__id")], "__id")
    grouped = materialize(grouped.select("__id", "__n", "__k", "__k2", F.col("best.b1").alias("__rep"), "group_size"), "nodes")
    first = grouped.where("__id <=> __rep AND __n > 0")
    nodes = first.select("__k", "__k2", "__rep").dropDuplicates(["__k", "__k2"])
    buckets = first.groupBy("__k").agg(F.max("__n").alias("__n"), (F.min("__k2") != F.max("__k2")).alias("shared"))
    buckets = materialize(buckets, "buckets")

    parts = 8 * shuffle_width(spark)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # a set's signatures leave a task once
        for _, texts in slices(batches, "__text"):
            flat, bounds = shingle_sets(texts, width)
            keys = set_keys(flat, bounds, key_bits)
            key, fresh = keys[0], []
            for i, k in enumerate(_names(keys)):
                if bounds[i + 1] > bounds[i] and k not in seen:
                    seen.add(k)
                    fresh.append(i)
            if not fresh:
                continue
            new = np.array(fresh)
            n = np.diff(bounds)[new]
            cut = np.concatenate([[0], np.cumsum(n)])
            flat = flat[np.repeat(bounds[new] - cut[:-1], n) + np.arange(cut[-1])]
            sig, who = signatures(flat, cut)
            part = ((sig >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part.astype(np.uint16) if parts < 65536 else part, kind="stable")
            sig, who, part = sig[order], key[new][who[order]], part[order]
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            stop = np.append(at[1:], len(part))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[at].astype(np.int32)),
                    pa.array([sig[a:b].tobytes() for a, b in zip(at, stop, strict=True)], pa.binary()),
                    pa.array([who[a:b].tobytes() for a, b in zip(at, stop, strict=True)], pa.binary()),
                ],
                ["part", "sigs", "sets"],
            )

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sigs, sets = None, [], []
        for batch in batches:  # in the order of the parts; one is worked through at a time
            for part, sig, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if part != now:
                    yield from pair_part(sigs, sets)
                    now, sigs, sets = part, [], []
                sigs.append(np.frombuffer(sig.as_buffer(), np.uint64))
                sets.append(np.frombuffer(own.as_buffer(), np.uint64))
        yield from pair_part(sigs, sets)

    def pair_part(sigs: list[np.ndarray], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not sigs:
            return
        sig, who = np.concatenate(sigs), np.concatenate(sets)
        order = np.argsort(sig)
        sig, who = sig[order], who[order]
        same = sig[1:] == sig[:-1]
        many = np.zeros(len(sig), bool)
        many[1:] |= same
        many[:-1] |= same
        sig, who = sig[many], who[many]
        if len(sig) == 0:
            return
        at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        lead = np.repeat(np.minimum.reduceat(who, at), np.diff(np.append(at, len(sig))))
        a, b = lead[lead != who], who[lead != who]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        a, b = a[new].view(np.int64), b[new].view(np.int64)
        for k in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 50_000]), pa.array(b[k : k + 50_000])], ["lead", "node"])

    packed = docs.select("__text").mapInArrow(sign, "part int, sigs binary, sets binary")
    pairs = packed.repartition(shuffle_width(spark), "part").sortWithinPartitions("part").mapInArrow(pair, "lead long, node long")
    pairs = materialize(pairs.distinct(), "pairs")

    # how many parts the nodes of a leader need
    needed = F.ceil(F.greatest(F.sum("__n") / task_shingles, F.count(F.lit(1)) / task_sets)).cast("int")
    weight = pairs.join(buckets, F.col("node") == F.col("__k")).select("lead", "__n")
    weight = weight.unionByName(buckets.where("shared").select(F.col("__k").alias("lead"), "__n"))
    weight = materialize(weight.groupBy("lead").agg(needed.alias("parts")), "leaders")
    # leaders of several parts have over task_sets nodes or task_shingles shingles each, so they are few
    members = _with_lead_facts(pairs, weight.where("parts > 1"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    members = members.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    leads = weight.select("lead", F.col("lead").alias("node"), "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    members = materialize(members.select("lead", "node", "parts", "part").unionByName(leads), "members")

    rows = members.join(sketches, F.col("node") == F.col("__key")).select("lead", "part", "node", "node2", "n", "sketch")
    possible = materialize(_possible(rows, percent), "possible")
    wanted = possible.select("node").unionByName(members.where("parts > 1").select("node")).distinct()
    wanted = wanted.join(nodes, F.col("node") == F.col("__k")).select(F.col("node").alias("__node"), F.col("__k2").alias("node2"), "__rep")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch, texts in slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packer.compress(x.as_buffer()) for x in texts], pa.binary())], ["__id", "__z"])

    def squeeze_keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = zstandard.ZstdCompressor(level=1), set()
        for _, texts in slices(batches, "__text"):
            keys = set_keys(*shingle_sets(texts, width), key_bits)
            fresh = [i for i, k in enumerate(_names(keys)) if k not in seen and not seen.add(k)]
            packed = pa.array([packer.compress(texts[i].as_buffer()) for i in fresh], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys[0][fresh]), pa.array(keys[1][fresh]), packed], ["__key", "__key2", "__z"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256)
                flat, bounds = shingle_sets(pa.array([unpacker.decompress(z.as_buffer()) for z in rows.column(2)], pa.large_binary()), width)
                k1, k2 = set_keys(flat, bounds, key_bits)
                own = np.flatnonzero((k1 == rows.column(0).to_numpy()) & (k2 == rows.column(1).to_numpy()))  # an id may have several texts
                grams = [flat[bounds[i] : bounds[i + 1]].tobytes() for i in own]
                yield pa.RecordBatch.from_arrays([pa.array(k1[own]), pa.array(k2[own]), pa.array(grams, pa.binary())], ["__node", "node2", "grams"])

    # a node's text is found by its id, and by the hash of its set where it has no id
    texts = docs.mapInArrow(squeeze, "__id long, __z binary").join(wanted, F.col("__id") == F.col("__rep")).select("__node", "node2", "__z")
    nameless = docs.where("__id IS NULL").mapInArrow(squeeze_keyed, "__key long, __key2 long, __z binary")
    met = (F.col("__key") == F.col("__node")) & (F.col("__key2") == F.col("node2"))
    nameless = nameless.join(wanted.where("__rep IS NULL"), met).select("__node", "node2", "__z")
    texts = texts.unionByName(nameless)
    sets = materialize(texts.mapInArrow(keep, "__node long, node2 long, grams binary"), "grams")
    rows = possible.join(sets, F.col("node") == F.col("__node")).select("lead", "part", "core", "node", "node2", "grams")
    links = materialize(_verify(rows, ["lead", "part", "core"], percent), "links")

    if not members.where("parts > 1").isEmpty():
        large = members.where("parts > 1")
        direct = links.select(F.col("a").alias("lead"), F.col("b").alias("node"))
        direct = direct.unionByName(links.select(F.col("b").alias("lead"), F.col("a").alias("node")))
        shared = buckets.where("shared").select("__k")  # a link of one of its sets says nothing of the others
        direct = direct.join(shared, F.col("lead") == F.col("__k"), "left_anti").join(shared, F.col("node") == F.col("__k"), "left_anti")
        loose = large.join(direct, ["lead", "node"], "left_anti").where("lead <> node")
        loose = loose.join(buckets, F.col("node") == F.col("__k"))
        blocks = loose.groupBy("lead").agg(needed.alias("blocks"))
        loose = _with_lead_facts(loose, blocks, "inner").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        loose = loose.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "node")
        again = _with_lead_facts(large, blocks, "inner").select("lead", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node")
        again = again.unionByName(loose).distinct().join(sets, F.col("node") == F.col("__node")).select("lead", "part", "block", "node", "node2", "grams")
        links = links.unionByName(materialize(_verify(again, ["lead", "part", "block"], percent), "links"))

    named = nodes.select(_named("__k", "__k2").alias("node"), F.col("__rep").alias("rep"))
    component = materialize(least_ids(named, links.select(_named("a", "a2").alias("a"), _named("b", "b2").alias("b"))), "components")
    out = grouped.withColumn("__set", _named("__k", "__k2")).join(component, F.col("__set") == F.col("node"), "left")
    alone = (F.col("__n") == 0) | F.col("node").isNull()
    own = F.when(F.col("__n") == 0, F.col("__id")).when(F.col("node").isNull(), F.col("__rep"))
    return out.select(
        F.col("__id").alias(id_col),
        F.col("__n").alias("n_shingles"),
        F.when(alone, own).otherwise(F.col("component")).alias("component_id"),
        F.col("__set").alias("node"),
        F.when(alone, F.col("__id").eqNullSafe(own)).otherwise(F.col("first") & F.col("__id").eqNullSafe(F.col("component"))).alias("kept"),
    )


def with_nodes(df: DataFrame, width: int = 5, text_col: str = "text") -> DataFrame:
    """The rows with ``node``, by which jaccard_classes names the set of a text (zeros without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text_col):
            keys = set_keys(*shingle_sets(texts, width))
            node = pa.StructArray.from_arrays([pa.array(k) for k in keys], ["k", "k2"])
            yield pa.RecordBatch.from_arrays([*batch.columns, node], [*batch.schema.names, "node"])

    node = T.StructType([T.StructField("k", T.LongType()), T.StructField("k2", T.LongType())])
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("node", node)]))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``jaccard_classes`` of all documents: doc_id, n_shingles, component_id. Nulls, empty texts, repeated rows and ids and
    empty tables as stated there."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
