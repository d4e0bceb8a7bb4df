"""Golden filenames, codec tables, group rules, sources and sinks of the archive inventory."""

import difflib
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from cinelake.functions.text import alias_key, duration_text, rate, similarity, title_key, to_int
from cinelake.operators import compare as C
from cinelake.operators import duplicates, films
from cinelake.operators.filenames import FIELDS, parse_filenames
from cinelake.operators.records import FIELDS as RECORD
from cinelake.operators.records import inventory_records
from cinelake.plans import queries
from cinelake.sources import cache, files
from cinelake.sources.catalogue import Catalogue
from cinelake.sources.xlsx import write_workbook

GOLDEN = {
    "Title.2015.NF.WEB-DL.DDP2.0.H.264.mkv": "Title|2015||NF|WEB-DL||DDP|2.0||H.264|OK|",
    "Film.2015.1080p.NF.TH.WEB-DL.DDP5.1.Atmos.H.264.mkv": "Film|2015|1080p|NF|WEB-DL|TH|DDP|5.1|Atmos|H.264|OK|",
    "Film.2015.1080p.NF.WEB-DL.TH.DD5.1.x264.mkv": "Film|2015|1080p|NF|WEB-DL|TH|DD|5.1||x264|LEGACY|",
    "Film.2015.1080p.NF.WEB-DL.DD+5.1.H.264.mkv": "Film|2015|1080p|NF|WEB-DL||DD+|5.1||H.264|LEGACY|",
    "Film.2015.1080p.NF.WEB-DL.AAC.2.0.H.264-kass.mkv": "Film|2015|1080p|NF|WEB-DL||AAC|2.0||H.264|REVIEW|trailing annotation after video codec: -kass",
    "Film.2015.1080p.NF.WEB-DL.AAC2.0.H.264.1999.mkv": "Film|2015|1080p|NF|WEB-DL||AAC|2.0||H.264|REVIEW|unexpected trailing token after video codec: 1999",
    "Taxi.720p.1080p.MUBI.WEB-DL.DDP5.1.H.264.mkv": "Taxi||1080p|MUBI|WEB-DL||DDP|5.1||H.264|REVIEW|release year missing; additional resolution token in title area: 720p",
    "Show.S01E02.1080p.NF.WEB-DL.DDP5.1.H.264.mkv": "Show S01E02||1080p|NF|WEB-DL||DDP|5.1||H.264|OK|",
    "Film.20XX.1080p.NF.WEB-DL.DDP5.1.H.265.mkv": "Film|20XX|1080p|NF|WEB-DL||DDP|5.1||H.265|REVIEW|placeholder year: 20XX",
    "Film.2015.1080p.NF.WEB-DL.XYZ.5.1.H.264.mkv": "Film|2015|1080p|NF|WEB-DL||XYZ.5.1|||H.264|REVIEW|channel token missing/unrecognized; audio token unrecognized: XYZ.5.1",
    "Film.2015.1080p.WEB-DL.DDP5.1.H.264.mkv": "Film|2015|1080p||||||||REVIEW|source/release-type structure was not recognized",
    "Film.1999.avi": "Film|1999|||||||||UNPARSED|No recognizable technical boundary found",
    "Film.2015.1080p.NF.WEB.DL.DDP5.1.H.264.mkv": "Film|2015|1080p|NF|WEB-DL||DDP|5.1||H.264|OK|",
    None: "||||||||||UNPARSED|No recognizable technical boundary found",
}


def test_filenames(spark):
    names = list(GOLDEN)
    rows = parse_filenames(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, filename string")).collect()
    assert {names[r.i]: "|".join(r[f] for f in FIELDS) for r in rows} == GOLDEN


def test_text_functions(spark):
    assert title_key("ที่รัก") == "ท ร ก" and title_key("A [x] B") == "a b" and title_key("A_b-c.d") == "a b c d" and title_key(None) == ""
    assert similarity("x", "x") == 100 and similarity("", "x") == 0 and similarity("tide", "diet") == 25.0 and similarity("diet", "tide") == 50.0
    row = spark.range(1).select(
        duration_text(F.lit(59.5)).alias("a"), duration_text(F.lit(None).cast("double")).alias("b"), rate(F.lit("24000/1001")).alias("c"), rate(F.lit("25/0")).alias("d"), to_int(F.lit("12.7")).alias("e")
    )
    r = row.first()
    assert (r.a, r.b, round(r.c, 3), r.d, r.e) == ("0:01:00", "", 23.976, None, 12)


def test_similarity_query(spark, tmp_path):
    """q19 against difflib: whole names that differ only after 60 characters, nulls, repeated names."""
    start = "The same sixty characters and more stand at the front of these texts: "
    names = [start + f"tail {i} " * (3 * i) for i in range(4)] + [None, "", start + "item 41"] + [start + f"item {i}" for i in range(45)] + ["Ann Lee", "ann  LEE", "Ann Lea"]
    spark.createDataFrame([(i, n) for i, n in enumerate(names)], "client_id long, name string").write.parquet(f"{tmp_path}/clients.parquet")
    rows = queries.q19(spark, str(tmp_path)).collect()
    keys = {alias_key(n) for n in names} - {""}
    want = {(a, b): round(difflib.SequenceMatcher(None, a, b).ratio() * 100, 1) for a in keys for b in keys if a != b}
    assert {(r.name, r.other): r.similarity for r in rows} == {k: v for k, v in want.items() if v >= 95} and len(rows) > 100


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: C.resolution_class(F.lit(1920), F.lit(800), F.lit("")), "1080p"),
        (lambda: C.resolution_class(F.lit(720), F.lit(576), F.lit("tt")), "576i"),
        (lambda: C.resolution_class(F.lit(640), F.lit(352), F.lit("")), "352p"),
        (lambda: C.compare_resolution(F.lit("1080p"), F.lit("1080i")), "REVIEW"),
        (lambda: C.compare_resolution(F.lit(""), F.lit("720p")), "MISMATCH"),
        (lambda: C.compare_resolution(F.lit("4K"), F.lit("2160p")), "OK"),
        (lambda: C.compare_video(F.lit("x264"), F.lit("H264")), "LEGACY"),
        (lambda: C.compare_audio_codec(F.lit("AAC"), F.lit("eac3"), F.array(F.lit("eac3"), F.lit("aac"))), "REVIEW"),
        (lambda: C.compare_audio_channels(F.lit("5.1"), F.lit(2), F.array(F.lit(2), F.lit(6))), "REVIEW"),
        (lambda: C.detect_hdr(F.lit(""), F.lit("bt2020"), F.lit("yuv420p10le"), F.lit("")), "10-bit / BT.2020"),
        (lambda: C.channel_label(F.lit(5)), "5ch"),
        (lambda: C.rename_target(F.lit("A.x264.mkv"), F.lit("x264"), F.lit("H264")), "A.H.264.mkv"),
        (lambda: C.rename_target(F.lit("A.x264-k.mkv"), F.lit("x264"), F.lit("H264")), ""),
        (lambda: films.local_id(F.lit("x"), F.lit("y")), "LOCAL-89EDCD3BE181"),
    ],
)
def test_rules(spark, make, want):
    assert spark.range(1).select(make().alias("v")).first().v == want


def test_empty_and_broken_probes(spark):
    listing = spark.createDataFrame(
        [(0, "/a/x.mkv", "/a", "x.mkv", 1, 0, None, "gone"), (1, None, None, None, None, None, "{", None)],
        "ord long, path string, root string, filename string, size_bytes long, mtime_ns long, probe_json string, error string",
    )
    rows = inventory_records(listing).orderBy("ord").collect()
    assert [(r.ffprobe_ok, r.metadata_check, r.duration_text, r.error) for r in rows] == [(False, "REVIEW", "", "gone"), (False, "REVIEW", "", "")]
    assert inventory_records(listing.limit(0)).count() == 0 and inventory_records(listing).columns == ["ord", *RECORD]


def _films(spark, rows):
    blank = {c: F.lit("") for c in ("streaming_source", "filename_variant", "duration_text", "resolution", "video_codec", "path", "sha256")}
    return spark.createDataFrame(rows, "ord int, normalized_title string, filename_year string, duration_sec double").withColumns(blank)


@pytest.mark.parametrize(
    ("rows", "groups"),
    [
        ([(0, "abc", "2001", 5400.0), (1, "abc", "", 5410.0)], [{0, 1}]),
        ([(0, "abc", "2001", None), (1, "abc", "2001", 0.0), (2, "abc", "2010", None)], [{0, 1}]),
        ([(0, "abc", "", 5400.0), (1, "abc", "", 5520.0)], [{0, 1}]),
        ([(0, "abc", "", 5400.0), (1, "abc", "", 5410.0), (2, "abc", "", 9000.0)], [{0, 1}]),
        ([(0, "ab", "", 1.0), (1, "ab", "", 1.0)], []),
    ],
)
def test_same_film(spark, rows, groups):
    found = {}
    for r in duplicates.same_film_groups(_films(spark, rows)).collect():
        found.setdefault(r._group, set()).add(r.ord)
    assert [found[k] for k in sorted(found)] == groups


def test_listing_and_hashes(spark, tmp_path):
    (tmp_path / "in" / ".skip").mkdir(parents=True)
    for name, data in {"in/A.MKV": b"x", "in/b.mp4": b"x", "in/c.txt": b"x", "in/.skip/d.mkv": b"x", "in/.e.mkv": b"yy"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.list_archive(spark, [str(tmp_path / "in"), str(tmp_path / "missing")])
    rows = found.orderBy("ord").collect()
    assert [r.filename for r in rows] == [".e.mkv", "A.MKV", "b.mp4"]
    base = found.select("path", "size_bytes", F.lit("").alias("quick_hash"), F.lit("").alias("sha256"))
    done = duplicates.hash_cascade(base, lambda t: files.hashed(t, "quick"), lambda t: files.hashed(t, "full"))
    by = {os.path.basename(r.path): (r.quick_hash != "", r.sha256 != "") for r in done.collect()}
    assert by == {".e.mkv": (False, False), "A.MKV": (True, True), "b.mp4": (True, True)}


def test_caches(spark):
    listing = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "path string, size_bytes long, mtime_ns long")
    old = spark.createDataFrame([("a", 1, 1, "{}"), ("b", 1, 2, "{}"), ("gone", 1, 1, "{}")], "path string, size_bytes long, mtime_ns long, record_json string")
    known, todo = cache.split_known(listing, old)
    assert [r.path for r in known.collect()] == ["a"] and [r.path for r in todo.collect()] == ["b"]
    assert sorted(r.path for r in cache.merged_snapshot(todo.withColumn("record_json", F.lit("n")), old).collect()) == ["a", "b", "gone"]


def test_response_cache_keeps_every_user(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "2024-01-29 00:00:00"), (2, 501, "2024-01-28 00:00:00"), (3, 1, "2024-01-27 00:00:00")], "event_id long, user_id long, ts string")
    rows.withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.cache_key, r.fetched_at) for r in queries.q26(spark, str(tmp_path)).collect()}
    assert got == {("1", "2024-01-29 00:00:00"), ("501", "2024-01-28 00:00:00")}


def test_catalogue_falls_back_without_year():
    seen = []

    def fetch(url, headers, timeout):
        seen.append(url)
        return '{"results":[]}' if "year" in url else '{"results":[{"id":1}]}'

    assert '"id":1' in Catalogue(key="k", fetch=fetch).search("t", "2001") and len(seen) == 2
    assert Catalogue(key="k").cache_key("/p", {"b": 1, "a": 2, "c": ""}) == "/p?a=2&b=1"


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "out.xlsx")
    write_workbook(path, {"One": spark.createDataFrame([("OK", True, 1.5)], "Status string, Flag boolean, N double"), "None": spark.range(0)})
    with zipfile.ZipFile(path) as z:
        one, none = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/worksheets/sheet2.xml").decode()
    assert "YES" in one and "1.5" in one and "No rows" in none


def test_film_decisions(spark):
    groups = spark.createDataFrame(
        [("L1", "Alpha", "alpha", "2001", 90.0, 1, "p1", ["Alpha"], 0), ("L2", "Alpha", "alpha x", "2001", 90.0, 1, "p2", ["Alpha X"], 1)],
        "local_id string, title string, normalized_title string, year string, runtime_min double, n_files long, files string, aliases array<string>, first_ord int",
    )
    names = "path string, filename string, filename_title string, normalized_title string, filename_year string, filename_standard string"
    records = spark.createDataFrame([("p1", "a", "Alpha", "alpha", "2001", "CURRENT"), ("p2", "b", "Alpha X", "alpha x", "2001", "CURRENT")], names)
    local = records.select("path", films.local_id(F.col("normalized_title"), F.col("filename_year")).alias("made"))
    groups = groups.join(local, F.col("files") == F.col("path")).withColumn("local_id", F.col("made")).drop("path", "made")
    searches = groups.select("local_id", F.lit('{"results":[{"id":7,"title":"Alpha","original_title":"","release_date":"2001-02-03"}]}').alias("response"))
    details = '{"id":7,"title":"Alpha","original_title":"Alfa","original_language":"th","release_date":"2001-02-03","runtime":90,"production_countries":[{"iso_3166_1":"TH","name":"Thailand"}]}'
    catalogue = spark.createDataFrame([(7, details)], "id long, response string")
    scored = films.score_candidates(groups, films.rank_candidates(groups, searches), catalogue)
    matches = films.decide(groups, searches, scored)
    assert {(r.status, r.confidence, r.margin) for r in matches.collect()} == {("HIGH_CONFIDENCE", 100.0, 100.0)}
    out = films.film_records(groups, matches, records)
    film = out["films"].collect()
    assert [(r["Film Record ID"], r["Match Status"], r["Files"], r["Original Thai Title"], r["Paths"]) for r in film] == [("TMDB-7", "HIGH_CONFIDENCE / MERGED", 2, "Alfa", "p1\np2")]
    assert sorted((r.path, r.film_record_id, r.tmdb_id) for r in out["enrichment"].collect()) == [("p1", "TMDB-7", 7), ("p2", "TMDB-7", 7)]
    assert sorted(r["Alias"] for r in out["aliases"].collect()) == ["Alfa", "Alpha", "Alpha X"]
    assert films.film_records(groups, films.not_run(groups), records)["films"].count() == 2


def test_records_tasks_are_bounded(spark, tmp_path):
    """One small file with many rows: a task's share doesn't grow with them; records run as code that HotSpot compiles."""
    from cinelake.sources.snapshots import kept

    n, name = 9 * queries.FILES + 1, "spark.sql.codegen.hugeMethodLimit"
    spark.range(n, numPartitions=1).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    parts = queries.media_view(spark, str(tmp_path)).select("k").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(parts) == 10 and sum(parts) == n and max(parts) < 1.2 * queries.FILES
    before, seen = spark.conf.get(name), []
    kept(spark, f"{tmp_path} limits", lambda: seen.append(int(spark.conf.get(name))) or spark.range(1))
    assert seen == [8_000] and spark.conf.get(name) == before


def test_similar_titles_need_names_alone(spark, tmp_path, monkeypatch):
    """q27 as its SQL says, without records, and each different name read once."""
    import duckdb

    made = []
    monkeypatch.setattr(queries, "records", lambda *_: pytest.fail("records were made"))
    real = queries.parse_filenames
    monkeypatch.setattr(queries, "parse_filenames", lambda df, **k: made.append(df.count()) or real(df, **k))
    ids = [k for k in range(700) if k % 350 < 60] * 3
    spark.createDataFrame([(k, 1) for k in ids], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = queries.q27(spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(tuple(r) for r in got) == sorted(c.execute(queries.ORACLES["q27_similar_titles"]).fetchall()) and len(got) > 100
    assert made == [len({r.filename for r in queries.media_view(spark, str(tmp_path)).collect()})] and made[0] <= len(ids) / 3
