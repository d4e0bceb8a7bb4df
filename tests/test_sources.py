"""Listing, work split by cost, snapshots, responses that stay when a job fails, and input that can't be read."""

import io
import json
import os
import time
import urllib.error
import zipfile
from collections import Counter
from dataclasses import replace
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from cinelake.config import Settings
from cinelake.plans.scan import scan, write_reports
from cinelake.sources import cache, files, xlsx
from cinelake.sources.catalogue import Catalogue, asked
from tests.test_scan import _lines, archive  # noqa: F401


def test_listing_opens_one_deep_folder(spark, tmp_path, monkeypatch):
    deep = tmp_path / "in" / "only" / "one"
    for k in range(12):
        (deep / f"f{k}" / ".hidden").mkdir(parents=True)
        (deep / f"f{k}" / "sub").mkdir()
        for n in range(3):
            (deep / f"f{k}" / "sub" / f"{n}.mkv").write_bytes(b"x")
        (deep / f"f{k}" / ".hidden" / "no.mkv").write_bytes(b"x")
    for n in range(25):
        (deep / f"{n}.mp4").write_bytes(b"x")
    (deep / "gone.mkv").symlink_to(tmp_path / "nowhere")
    monkeypatch.setattr(files, "FLAT", 10)
    reader = files._Reader([str(tmp_path / "in"), str(tmp_path / "missing"), str(deep / "3.mp4")], 8)
    parts = reader.partitions()
    assert 12 + 3 <= len(parts) <= 32
    found = [row[0] for p in parts for row in reader.read(p)]
    want = Counter({str(p.resolve()): 1 for p in deep.rglob("*.m*") if ".hidden" not in str(p) and p.exists()}) + Counter([str(deep / "3.mp4")])
    assert Counter(found) == want
    assert Counter(row[0] for p in files._Reader([str(tmp_path / "in")], 1).partitions() for row in reader.read(p)) == want - Counter([str(deep / "3.mp4")])
    assert files.list_archive(spark, [str(tmp_path / "in")]).count() == 61


@pytest.mark.parametrize(("sizes", "tasks"), [([1] * 50, 8), ([10**9, *[10] * 40], 8), ([(7919 * k) % 10_007 for k in range(3000)], 8), ([5], 8)])
def test_tasks_of_equal_cost(spark, sizes, tasks):
    """Also 50 small rows are spread over the tasks; a large one has a task for itself."""
    df = spark.createDataFrame([(f"/p{k}", s) for k, s in enumerate(sizes)], "path string, size_bytes long").coalesce(1)
    rows = files.split_by_cost(df, F.col("size_bytes"), tasks).withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r.path, r.size_bytes) for r in rows) == sorted((f"/p{k}", s) for k, s in enumerate(sizes))
    load = Counter()
    for r in rows:
        load[r.part] += r.size_bytes
    assert len(load) == min(len(sizes), tasks) and max(load.values()) <= max(max(sizes), 1.25 * sum(sizes) / tasks)
    assert files.split_by_cost(df.limit(0), F.col("size_bytes")).count() == 0


def test_hashing_is_spread(spark, tmp_path):
    names = []
    for k in range(40):
        (tmp_path / f"{k}").write_bytes(b"x" * k)
        names.append((str(tmp_path / f"{k}"), k))
    todo = spark.createDataFrame([*names, (str(tmp_path / "none"), 3)], "path string, size_bytes long").coalesce(1)
    done = files.hashed(todo, "full", 8).withColumn("part", F.spark_partition_id()).collect()
    assert len({r.part for r in done}) == 8 and {r.path: r.value for r in done}[names[7][0]] == files.full_hash(names[7][0])
    assert next(r.failure for r in done if r.path.endswith("none")).startswith("sha256: ")


def test_snapshots_switch_when_complete(spark, tmp_path, monkeypatch):
    rows = lambda n: spark.createDataFrame([(f"/{k}", 1, 1, "{}") for k in range(n)], cache.SNAPSHOT)
    root = str(tmp_path)
    assert cache.read_snapshot(spark, root).count() == 0
    cache.write_snapshot(rows(2), root)
    reader = cache.read_snapshot(spark, root)
    # a driver that stops after the table is written, before it is marked, changes nothing
    with monkeypatch.context() as m:
        m.setattr(cache, "mark", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            cache.write_snapshot(rows(9), root)
    assert cache.read_snapshot(spark, root).count() == 2 == reader.count()
    cache.write_snapshot(cache.merged_snapshot(rows(5), cache.read_snapshot(spark, root)), root)
    assert cache.read_snapshot(spark, root).count() == 5 and reader.count() == 2  # who has opened the one before still reads it
    cache.write_snapshot(rows(1), root)
    assert cache.read_snapshot(spark, root).count() == 1 and len(cache.versions(spark, root)) == 2
    assert len(os.listdir(cache.snapshot_path(root))) == 2


def test_answers_stay_when_the_job_fails(spark, tmp_path):
    """A service that breaks the task after some answers: they are not asked for again."""
    folder, log = str(tmp_path / "responses"), str(tmp_path / "log")

    def fetch(url, headers, timeout):
        with open(log, "a") as f:
            f.write(url + "\n")
        if len(open(log).readlines()) == 6:
            raise SystemExit("stopped")
        return "{}"

    requests = spark.createDataFrame([(f"k{k}", f"/{k}", "{}") for k in range(10)], "cache_key string, path string, params string").coalesce(1)
    catalogue = Catalogue(key="k", fetch=fetch, per_second=0)
    with pytest.raises(Exception, match="stopped|SystemExit|exited"):
        asked(requests, catalogue, folder, tasks=1, together=2).collect()
    kept = cache.read_table(spark, folder, cache.RESPONSES)
    assert kept.count() == 5
    out = cache.answered(requests, lambda r: asked(r, catalogue, folder), folder)
    assert out.where("response = '{}' AND error = ''").count() == 10 and len(_lines(tmp_path / "log")) == 6 + 5
    # what is kept but can't be read is asked for again
    cache.store_answers(folder, [("k3", "{broken", datetime.now(UTC))])
    assert cache.answered(requests, lambda r: asked(r, catalogue, folder), folder).where("response = '{}'").count() == 10
    assert len(_lines(tmp_path / "log")) == 12


def test_requests_share_a_rate(spark, tmp_path):
    requests = spark.createDataFrame([(f"k{k}", f"/{k}", "{}") for k in range(6)], "cache_key string, path string, params string").coalesce(1)
    began = time.time()
    got = asked(requests, Catalogue(key="k", fetch=lambda *a: "[1]", per_second=2), str(tmp_path / "r"), tasks=1).collect()
    assert time.time() - began > 2 and {r.error for r in got} == {"the response is no object"}


@pytest.mark.parametrize(
    ("errors", "waits", "result"),
    [
        ([TimeoutError("read timed out")], [1], "{}"),
        ([ConnectionResetError("reset"), TimeoutError("slow")], [1, 2], "{}"),
        ([TimeoutError("slow")] * 3, [1, 2], "network: slow"),
        ([("Wed, 21 Oct 2026 07:28:00 GMT", 429), (None, 429)], [2, 4], "{}"),
        ([("7", 429), ("60", 429)], [7, 10], "{}"),
        ([("1", 429)] * 3, [1, 1], "HTTP 429: body"),
        ([(None, 500)], [], "HTTP 500: body"),
    ],
)
def test_requests_that_fail(monkeypatch, errors, waits, result):
    slept, left = [], list(errors)
    monkeypatch.setattr(time, "sleep", slept.append)

    def fetch(url, headers, timeout):
        if not left:
            return "{}"
        e = left.pop(0)
        if isinstance(e, tuple):
            e = urllib.error.HTTPError(url, e[1], "no", {"Retry-After": e[0]} if e[0] else {}, io.BytesIO(b"body"))
        raise e

    try:
        got = Catalogue(key="k", fetch=fetch).get("/x", {})
    except RuntimeError as e:
        got = str(e)
    assert got == result and slept == waits


def test_records_that_cannot_be_read_are_probed_again(spark, archive):  # noqa: F811
    own = Settings(roots=(str(archive / "in"),), cache=str(archive / "cache"), hash_mode="none")
    said = []
    before = {r.path: r for r in scan(spark, own, str(archive / "ffprobe"), said.append)["records"].collect()}
    assert said[:2] == ["Found 5 media files.", "[5/5] scanned  (cache hits: 0)"]
    snapshot = cache.read_snapshot(spark, own.cache)
    broken = F.when(F.col("path").contains("Red"), "{no json").when(F.col("path").contains("Show"), '{"path":"/another"}').otherwise(F.col("record_json"))
    cache.write_snapshot(snapshot.withColumn("record_json", broken), own.cache)
    found = scan(spark, own, str(archive / "ffprobe"), said.append)
    assert {r.path: r for r in found["records"].collect()} == before and "[5/5] scanned  (cache hits: 3)" in said
    assert len(_lines(archive / "probed")) == 7
    assert scan(spark, own, str(archive / "ffprobe"))["known"].count() == 5


def test_probe_that_cannot_start_is_an_error(spark, archive):  # noqa: F811
    own = Settings(roots=(str(archive / "in"),), cache=str(archive / "cache"), hash_mode="none")
    rows = scan(spark, own, str(archive / "no-such-program"))["records"].collect()
    assert len(rows) == 5 and all("no-such-program" in r.error and not r.ffprobe_ok for r in rows)
    (archive / "ffprobe").write_text("#!/bin/sh\necho no json\n")
    rows = scan(spark, replace(own, refresh=True), str(archive / "ffprobe"))["records"].collect()
    assert len(rows) == 5 and all(r.error and not r.ffprobe_ok for r in rows)


def test_any_failure_of_a_request_is_its_groups_error(spark, archive):  # noqa: F811
    def fetch(url, headers, timeout):
        if "Night" in url:
            raise KeyError("odd")
        return json.dumps({"results": []})

    own = Settings(roots=(str(archive / "in"),), cache=str(archive / "cache"), catalogue=Catalogue(key="k", fetch=fetch), responses=str(archive / "responses"), hash_mode="none")
    found = scan(spark, own, str(archive / "ffprobe"))
    assert Counter(r["Match Status"] for r in found["Film Records"].collect()) == {"ERROR": 1, "NO_MATCH": 1}
    write_reports(found, str(archive / "out.xlsx"))


def test_cells(spark, tmp_path):
    path = str(tmp_path / "o.xlsx")
    long = "😀" * 40_000
    xlsx.write_workbook(path, {"S": spark.createDataFrame([(1.5, "OK", long, None)], "`Size GiB` double, Status string, Files string, None string")})
    with zipfile.ZipFile(path) as z:
        sheet, styles = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/styles.xml").decode()
    assert f'<c r="A2" s="{xlsx._SIZE}"><v>1.5</v></c>' in sheet and 'formatCode="0.000"' in styles and "FF1F4E78" in styles
    text = sheet.split('<c r="C2"')[1].split("</t>")[0].split('preserve">')[1]
    assert len(text.encode("utf-16-le")) // 2 <= 32_767 and text.endswith("…") and set(text[:-1]) == {"😀"}
    assert styles.count("<xf ") == 2 + len(xlsx._FILLS) + 2 and f's="{2 + xlsx._FILLS.index("E2F0D9")}"' in sheet
