"""Drifted schema rewrite, hard negatives and decontamination against brute force, with nulls, ties, repeated rows and empty tables."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cinelake.llm import decontaminate, drift, hard_negatives

CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, key string, rank int"


def _clients(n, seed=3):
    r = random.Random(seed)
    pick = lambda *x: r.choice([None, *x])
    out = []
    for _ in range(n):
        when = None if r.random() < 0.1 else datetime(2024, 1, 1) + timedelta(microseconds=r.randrange(10**13))
        balance = pick(-1.5, 0.1, 1e9 / 3, float("nan"), float("inf"), -0.0, 7.25)
        out.append((pick(*range(40), 2**40, -5), r.randrange(9), pick("crm", "web"), when, pick("Ä|b", "c\nd"), pick("x@y"), pick("Rom", ""), pick(3, 4), "s", balance, "k", 1))
    return out


def _shown(v):
    if isinstance(v, float):
        return str(math.floor(1048576 * v)) if math.isfinite(v) else str(v)
    if isinstance(v, datetime):
        return str((v - datetime(1970, 1, 1)) // timedelta(microseconds=1))
    return "?" if v is None else str(v)


def _final_rows(rows, schema_rows=1000):
    """Brute force: by file_no, its version and rows as the rewrite leaves them. Rows with equal ids come in any order."""
    crc = lambda i: 2**32 if i is None else zlib.crc32(str(i).encode())
    ordered = sorted((x[:10] for x in rows), key=lambda x: (crc(x[0]), x[0] or 0))
    each, out = 1 + len(rows) // schema_rows, {}
    for r, x in enumerate(ordered):
        no = r // each
        v = zlib.crc32(f"7:{no}".encode()) % 24
        v = v if v <= 15 else 0
        x = list(x)
        if v & 4:
            x[6], x[7] = "none", -1
        if v & 8 and x[9] is not None:
            x[9] = float(np.float32(x[9]))
        out.setdefault(no, (v, []))[1].append(x)
    return out


def _write(spark, tmp_path, rows):
    spark.createDataFrame(rows, CLIENTS).repartition(3).write.parquet(f"{tmp_path}/clients.parquet")
    return str(tmp_path)


def test_drift_unique_ids(spark, tmp_path):
    rows = [(k * 7 - 90, *x[1:]) for k, x in enumerate(_clients(2300))]
    got = {r.file_no: r for r in drift.op11_drift(spark, _write(spark, tmp_path, rows)).collect()}
    want = _final_rows(rows)
    assert set(got) == set(want) and {v for v, _ in want.values()} == set(range(16))
    names = [n for n, _ in drift.CLIENTS]
    for no, (version, own) in want.items():
        r = got[no]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.version, r.n_rows, r.rewritten) == (version, len(own), version != 0)
        assert r.n_nulls == sum(v is None for x in own for v in x)
        assert r.ids_sha256 == sha(",".join(_shown(x[0]) for x in own)) and r.rows_sha256 == sha("\n".join("|".join(map(_shown, x)) for x in own))
        start = [n for n in names if not (version & 4 and n in ("city", "nation_id"))]
        if version & 1:
            start = [{"name": "email", "email": "name"}.get(n, n) for n in start]
        if version & 2:
            start = start[:1] + start[:0:-1]
        assert r.start_columns == ",".join(start) and r.columns == ",".join(names)
        f = pq.ParquetFile(r.path.removeprefix("file://"))
        assert f.schema_arrow.equals(drift.EVOLVED, check_metadata=False) and [drift.field_id(x) for x in f.schema_arrow] == list(range(1, 11))
        assert f.read().column("client_id").to_pylist() == [x[0] for x in own]
    folders = {os.path.dirname(r.path.removeprefix("file://")) for r in got.values()}
    assert len(folders) == 1 and len(os.listdir(folders.pop())) == len(want)


def test_drift_repeated_ids(spark, tmp_path):
    """A third of the rows has one id, another third is one row: all rows are kept, ranges are cut inside them."""
    rows = [(5, *x[1:]) for x in _clients(900, 1)] + [(11, 1, "crm", None, "n", "e", "c", 1, "s", 2.5, "k", 1)] * 900 + _clients(900, 4)
    d = _write(spark, tmp_path, rows)
    got = {r.file_no: r for r in drift.op11_drift(spark, d).collect()}
    want = _final_rows(rows)
    assert {no: (v, len(own)) for no, (v, own) in want.items()} == {no: (r.version, r.n_rows) for no, r in got.items()}
    ids = [x for no in sorted(got) for x in pq.read_table(got[no].path.removeprefix("file://")).column("client_id").to_pylist()]
    assert ids == [x[0] for no in sorted(want) for x in want[no][1]] and ids[-1] is None
    names = [n for n, _ in drift.CLIENTS]
    ranked = drift.rank_into_files(spark.read.parquet(f"{d}/clients.parquet").select(*names), "client_id", names)
    assert sorted(k[1] for k in ranked.rows.keys().collect()) == list(range(len(rows)))
    keys = spark.createDataFrame([(1, 1, h, 0) for h in range(50)] + [(2, 2, 7, s) for s in range(500)], "crc long, id long, hash long, salt long")
    cuts = drift._cuts(keys, 550, 4)
    assert len([c for c in cuts if c[:3] == (2, 2, 7)]) >= 5 and len(cuts) <= 3 + 2 * 4 * 4


def test_drift_empty(spark, tmp_path):
    assert drift.op11_drift(spark, _write(spark, tmp_path, [])).count() == 0


def test_drift_runs_again(tmp_path):
    """A file rewritten twice, as by a task that is run again, is the same."""
    kind = drift.drifted(15)
    out = drift._Parquet(str(tmp_path), "a", kind) if (tmp_path / "files").mkdir() is None else None
    values = {"client_id": [1], "name": ["mail"], "email": ["nm"]}
    out.writer.write_table(pa.Table.from_arrays([pa.array(values.get(f.name, [None]), f.type) for f in kind], schema=kind))
    out.close()
    for _ in range(2):
        drift.evolve_file(str(tmp_path), "a", "b", drift.EVOLVED, drift.MISSING)
        row = pq.read_table(tmp_path / "files" / "b").to_pylist()[0]
        assert (row["client_id"], row["name"], row["email"], row["city"], row["nation_id"], row["balance"]) == (1, "nm", "mail", "none", -1, None)


def _negatives(rows, positives=5, negatives=10):
    """Brute force over (id, label, vector) rows; anchors have ids divisible by 100."""
    ok = []
    for i, label, v in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out, key = [], lambda s: (-s[0], s[1] is None, s[1] or 0)
    for a, (i, label, v) in enumerate(ok):
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), j, other == label) for b, (j, other, w) in enumerate(ok) if b != a and len(w) == len(v)]
        for score, j, same in sorted((s for s in scored if s[2]), key=key)[:positives]:
            fits = sorted((s for s in scored if not s[2] and 30 * score <= 100 * s[0] <= 90 * score), key=key)[:negatives]
            out += [(i, j, r + 1, n, score, s) for r, (s, n, _) in enumerate(fits)]
    return Counter(out)


VECTORS = "vec_id long, label int, embedding array<float>, place int, norm string"


@pytest.mark.parametrize("block,many,pivots", [(4096, 16384, 16), (50, 2, 3), (64, 3, 0)])
def test_hard_negatives(spark, tmp_path, block, many, pivots):
    r = np.random.default_rng(5)
    centres = r.normal(size=(4, 8))
    rows = [(k, int(k % 4), (centres[k % 4] * 0.3 + r.normal(size=8) * 0.3).astype("f4").tolist()) for k in range(420)]
    rows += [(500, 1, rows[1][2]), (500, 1, rows[1][2]), (501, 1, rows[1][2]), (None, 1, rows[1][2]), (600, 2, [0.0] * 8), (700, None, [1.0] * 8), (800, 1, None)]
    rows += [(900, 3, [float("nan")] * 8), (901, 3, [float("inf")] + [0.0] * 7), (902, 2, [None] * 8), (1000, 1, [1.0, 2.0]), (1001, 1, [1.0, 1.0]), (1002, 2, [0.5, 0.5]), (1100, 1, [])]
    rows += [(1003 + k, 2, rows[1][2]) for k in range(30)]  # ties
    df = spark.createDataFrame([(i, c, v, 1, "x") for i, c, v in rows], VECTORS)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    own = df.select("vec_id", label.alias("label"), "embedding")
    got = hard_negatives.hard_negatives(own, F.col("vec_id") % 100 == 0, block=block, many=many, pivots=pivots)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(x[n] for n in names) for x in got.collect()) == _negatives(rows)
    if block == 50:
        df.write.parquet(f"{tmp_path}/embeddings.parquet")
        assert Counter(tuple(x[n] for n in names) for x in hard_negatives.op12_hard_negatives(spark, str(tmp_path)).collect()) == _negatives(rows)
        assert hard_negatives.hard_negatives(own.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_brackets_hold_and_large_scores():
    r = np.random.default_rng(1)
    x, q = r.integers(-300, 300, (200, 6)).astype(np.float64), r.integers(-300, 300, 6).astype(np.float64)
    norms = (x * x).sum(axis=1)
    most = norms.max()
    full = np.c_[x, np.sqrt(most - norms)]
    table = np.sqrt(((full[:, None] - full[None, :5]) ** 2).sum(axis=2))
    own = np.sqrt(((np.append(q, 0) - full[:5]) ** 2).sum(axis=1))
    low, high = hard_negatives._Bracket(table, most).of(own, float(q @ q), np.arange(200))
    assert (low <= x @ q).all() and (x @ q <= high).all() and (high - low).min() < 2 * most
    big = np.array([[2**62, 5], [3, 4]])
    assert hard_negatives._scores(big, np.array([7, 1])).tolist() == [2**63 - 1, 25] and hard_negatives._scores(big, np.array([1, 2])).tolist() == [2**62 + 10, 11]


def _contaminated(docs, items, window=10):
    word = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode()))
    grams = {}
    for i, t in items:
        w = word(t)
        for k in range(max(1, len(w) - window + 1)) if w else []:
            grams.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, names = word(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    names |= grams[g]
        names = sorted(str(x) for x in names if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def _texts():
    r = random.Random(2)
    words = ["alpha", "Beta", "gämma", "d4", "ÉTÉ", "日本", "x"]
    some = lambda n: r.choice([" ", ", ", "\n", "_"]).join(r.choice(words) for _ in range(n))
    items = [(k, some(r.choice([1, 2, 9, 10, 11, 25]))) for k in range(2, 30)] + [(2, some(12)), (None, "only here null"), (31, None), (32, "--- ..."), (33, "")]
    docs = [(k, some(r.choice([0, 1, 30, 200]))) for k in range(60)]
    docs += [(60 + k, f"{some(20)} !! {t} ?? {some(5)}") for k, (_, t) in enumerate(items)]
    docs += [(99, None), (None, items[3][1]), (98, "Only HERE, null."), (98, "Only HERE, null."), (97, "alphax beta"), (96, "  "), (95, "w " * 300_000 + (items[5][1] or "") + " end")]
    return docs, items


@pytest.mark.parametrize("most", [decontaminate.AUTOMATON_BYTES, 600])
def test_decontaminate(spark, tmp_path, most):
    docs, items = _texts()
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, gram string, n_words int")
    own = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate.find_windows(df, own, most_bytes=most)
    want = _contaminated(docs, items)
    digest = lambda r: (r.doc_id, r.n_words, r.n_hit, len(r.item_ids), hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.n_hit > 0)
    rows = got.collect()
    assert sorted(map(digest, rows), key=str) == want
    texts = {i: (t or "").encode() for i, t in docs}
    for r in rows:
        assert sum(h["last"] - h["first"] + 1 for h in r.hits) == r.n_hit and all(a["last"] + 1 < b["first"] for a, b in zip(r.hits, r.hits[1:], strict=False))
        for h in r.hits:  # the bytes of the text as it is are those words
            inside = re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", texts[r.doc_id][h["start"] : h["stop"]])
            assert len(inside) == h["last"] - h["first"] + 1
    if most > 600:
        df.write.parquet(f"{tmp_path}/documents.parquet")
        own.write.parquet(f"{tmp_path}/benchmark.parquet")
        assert sorted((tuple(r) for r in decontaminate.op13_decontaminate(spark, str(tmp_path)).collect()), key=str) == want
        assert decontaminate.find_windows(df.limit(0), own).count() == 0
        clean = decontaminate.find_windows(df, own.limit(0)).collect()
        assert len(clean) == len(docs) and not any(r.n_hit for r in clean)
