"""The whole scan over a folder, with a program and a service that stand in for the real ones; settings; the workbook."""

import os
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cinelake import __main__ as program
from cinelake.config import Settings, read_ini, settings
from cinelake.operators.order import numbered
from cinelake.plans import reports
from cinelake.plans.scan import scan, write_reports
from cinelake.sources import cache, snapshots
from cinelake.sources.catalogue import Catalogue
from cinelake.sources.xlsx import write_workbook

PROBE = """#!/bin/sh
for last; do :; done
echo "$last" >> {log}
case "$last" in *broken*) echo "bad file" >&2; exit 1;; esac
echo '{{"format":{{"duration":"5400.0","format_name":"matroska","tags":{{"title":"Night Bus"}}}},"streams":[{{"codec_type":"video","codec_name":"h264","width":1920,"height":1080}},{{"codec_type":"audio","codec_name":"eac3","channels":6}}]}}'
"""


@pytest.fixture
def archive(tmp_path):
    files = {
        "Night.Bus.2001.1080p.NF.WEB-DL.DDP5.1.x264.mkv": b"a" * 50, "Night.Bus.2001.1080p.NF.TH.WEB-DL.DDP5.1.H.264.mkv": b"a" * 50,
        "Show.S01E02.1080p.NF.WEB-DL.DDP5.1.H.264.mkv": b"b", "broken.1999.avi": b"cc", "Red.River.2002.1080p.NF.WEB-DL.DDP5.1.H.264.mp4": b"ddd", "notes.txt": b"x",
    }
    (tmp_path / "in").mkdir()
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    probe = tmp_path / "ffprobe"
    probe.write_text(PROBE.format(log=tmp_path / "probed"))
    probe.chmod(0o755)
    return tmp_path


def _lines(path):
    return path.read_text().splitlines() if path.exists() else []


def test_scan_twice(spark, archive):
    asked = str(archive / "asked")

    def fetch(url, headers, timeout):
        with open(asked, "a") as f:
            f.write(url + "\n")
        if "/search/" in url and "Night" in url:
            return '{"results":[{"id":7,"title":"Night Bus","original_title":"","release_date":"2001-02-03"}]}'
        if "/search/" in url:
            return '{"results":[]}'
        return (
            '{"id":7,"title":"Night Bus","original_title":"Rot Duan","original_language":"th","release_date":"2001-02-03","runtime":90,'
            '"production_countries":[{"iso_3166_1":"TH","name":"Thailand"}],"alternative_titles":{"titles":[{"title":"Late Bus","iso_3166_1":"US"},{"title":"Late Bus","iso_3166_1":"US"}]}}'
        )

    own = Settings(roots=(str(archive / "in"), str(archive / "missing")), cache=str(archive / "cache"), catalogue=Catalogue(key="k", fetch=fetch), responses=str(archive / "responses"))
    found = scan(spark, own, str(archive / "ffprobe"))
    counts = write_reports(found, str(archive / "out.xlsx"))
    assert len(_lines(archive / "probed")) == 5 and list(counts) == reports.METRICS
    want = {
        "Files scanned": "5", "ffprobe errors": "1", "x264 rename candidates": "1", "Film Records": "2", "TMDb review rows": "1", "TMDb high-confidence files": "2",
        "Title Alias rows": "5", "Exact duplicate rows": "2", "Possible same-film rows": "2", "Multi-version title groups": "1", "Filename review/unparsed": "1",
    }
    assert {k: counts[k] for k in want} == want
    inventory = {r["Filename"]: r for r in found["Inventory"].collect()}
    assert len(found["Inventory"].columns) == 62 and inventory["broken.1999.avi"]["Error"] == "bad file"
    assert inventory["Show.S01E02.1080p.NF.WEB-DL.DDP5.1.H.264.mkv"]["TMDb Match"] == "SKIPPED_TV_EPISODE"
    assert sorted(r["Alias"] for r in found["Title Aliases"].collect()) == ["Late Bus", "Night Bus", "Night Bus", "Red River", "Rot Duan"]
    with zipfile.ZipFile(archive / "out.xlsx") as z:
        book = z.read("xl/workbook.xml").decode()
        assert all(f'name="{s}"' in book for s in reports.SHEETS) and len([n for n in z.namelist() if "worksheets" in n]) == 10
    # nothing is probed or asked again; the records, also those of failed probes, are the same
    before, searches = {r.path: r for r in found["records"].drop("ord").collect()}, len(_lines(archive / "asked"))
    again = scan(spark, own, str(archive / "ffprobe"))
    assert len(_lines(archive / "probed")) == 5 and len(_lines(archive / "asked")) == searches and again["known"].count() == 5
    assert {r.path: r for r in again["records"].drop("ord").collect()} == before
    # a changed file and --refresh are probed
    (archive / "in" / "broken.1999.avi").write_bytes(b"longer")
    assert scan(spark, replace(own, catalogue=None, hash_mode="none"), str(archive / "ffprobe"))["known"].count() == 4
    assert len(_lines(archive / "probed")) == 6
    last = scan(spark, replace(own, catalogue=None, refresh=True), str(archive / "ffprobe"))
    assert len(_lines(archive / "probed")) == 11 and {r["Match Status"] for r in last["Film Records"].collect()} == {"NOT_RUN"}


def test_failed_requests_are_errors_and_not_cached(spark, archive):
    def fetch(url, headers, timeout):
        raise RuntimeError("HTTP 500: no")

    own = Settings(roots=(str(archive / "in"),), cache=str(archive / "cache"), catalogue=Catalogue(key="k", fetch=fetch), responses=str(archive / "responses"), hash_mode="none")
    found = scan(spark, own, str(archive / "ffprobe"))
    assert {(r["Match Status"]) for r in found["Film Records"].collect()} == {"ERROR"}
    assert {r["Notes"] for r in found["TMDb Review"].collect()} == {"HTTP 500: no"} and found["Exact Duplicates"].count() == 0
    assert cache.read_table(spark, own.responses, cache.RESPONSES).count() == 0


def test_empty_archive(spark, tmp_path):
    found = scan(spark, Settings(roots=(str(tmp_path / "none"),), cache=str(tmp_path / "cache")), "false")
    assert write_reports(found, str(tmp_path / "out.xlsx"))["Files scanned"] == "0"


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("SOMEWHERE", "/films")
    ini = tmp_path / "c.ini"
    ini.write_text('﻿[scanner]\nroots =\n    "$SOMEWHERE/a"\n    /b\nhash_mode = all\noutput = $SOMEWHERE/o.xlsx\n[tmdb]\nenabled = Yes\napi_key = inikey\nmax_candidates = 0\ncache_ttl_days = x\ntimeout = 7\n', encoding="utf-8")
    own, unlocked = settings(["--config", str(ini)], {"TMDB_API_KEY": " envkey "})
    assert own.roots == ("/films/a", "/b") and own.hash_mode == "all" and own.output == "/films/o.xlsx" and not unlocked
    assert own.catalogue.key == "envkey" and own.catalogue.timeout == 7 and own.max_candidates == 3 and own.response_days == 30 and own.catalogue.language == "en-US"
    own, unlocked = settings(["--config", str(ini), "--no-tmdb", "--hash", "none", "--output", "x.xlsx", "--refresh", "/c"], {})
    assert own.catalogue is None and not unlocked and own.hash_mode == "none" and own.roots == ("/c",) and own.refresh and own.output == "x.xlsx"
    assert settings(["--config", str(tmp_path / "no.ini"), "--tmdb"], {})[1] is True
    assert read_ini(str(tmp_path / "no.ini"))["scanner"]["roots"] == ""
    assert program.main(["--config", str(tmp_path / "no.ini")]) == 2


def test_numbers_without_gathering(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit(1).alias("x")).repartition(7)
    got = numbered(df, ["k"], "n").collect()
    assert [r.n for r in sorted(got, key=lambda r: r.k)] == list(range(1, 1001)) and numbered(df.limit(0), ["k"], "n").count() == 0


def test_tables_follow_their_sources_and_go(spark, tmp_path):
    from cinelake.plans.queries import records

    part = lambda n: spark.range(1, n + 1).select(F.col("id").alias("p_partkey"), F.lit(3).alias("p_size")).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    part(3)
    assert records(spark, str(tmp_path)).count() == 3
    part(5)
    assert records(spark, str(tmp_path)).count() == 5
    home = next(h for h in snapshots._OPENED if spark.sparkContext.applicationId in h)
    assert os.path.isdir(home.removeprefix("file://"))
    snapshots.drop(home)
    snapshots._KEPT.clear()
    assert not os.path.exists(home.removeprefix("file://"))


def test_long_sheets_go_on(spark, tmp_path):
    path = str(tmp_path / "out.xlsx")
    write_workbook(path, {"Numbers": spark.range(10).coalesce(1), "Exact": spark.range(3).coalesce(1)}, most=4)
    with zipfile.ZipFile(path) as z:
        assert [n for n in ("Numbers", "Numbers (2)", "Numbers (3)", "Numbers (4)", "Exact") if f'name="{n}"' in z.read("xl/workbook.xml").decode()] == ["Numbers", "Numbers (2)", "Numbers (3)", "Numbers (4)", "Exact"]
        assert "<v>9</v>" in z.read("xl/worksheets/sheet4.xml").decode() and len([n for n in z.namelist() if "worksheets" in n]) == 5
