"""Lists and medians of groups, held against the plain way on small and large groups."""

import random
import statistics

from pyspark.sql import functions as F

from cinelake.operators import duplicates, films
from cinelake.operators.groups import joined_lists, medians


def test_lists_end_where_they_are_cut(spark):
    r = random.Random(1)
    rows = [(k, "x" * r.randint(0, 9) if r.random() > 0.1 else None, i) for i, k in enumerate(r.choice("aaaabc") for _ in range(3_000))]
    d = spark.createDataFrame(rows, "k string, v string, at long").repartition(5)
    for most, every in ((100, 7), (1_000, 64), (10**6, 64)):
        got = {x.k: x.list for x in joined_lists(d, ["k"], "v", "at", most, every).collect()}
        assert got == {k: "\n".join(v for own, v, _ in rows if own == k and v is not None)[:most] for k in "abc"}
    assert joined_lists(d.limit(0), ["k"], "v", "at").count() == 0


def test_medians_are_exact(spark):
    r = random.Random(2)
    make = {
        "even": [r.random() for _ in range(2_000)],
        "odd": [r.random() ** 9 * 1e9 for _ in range(2_001)],
        "ties": [float(r.randint(0, 3)) for _ in range(3_000)],
        "halves": [1.0] * 700 + [2.0] * 700,
        "one value": [5.5] * 1_000,
        "small": [3.0, 1.0, 2.5, 9.0],
        "single": [4.25],
        "none": [None],
    }
    rows = [(k, v) for k, own in make.items() for v in own]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "k string, v double").repartition(6)
    want = {k: statistics.median(own) for k, own in make.items() if own != [None]}
    for hot in (0, 500, 10**6):  # all narrowed, some, none
        assert {x.k: x.median for x in medians(d, ["k"], "v", hot).collect()} == want, hot
    assert medians(d.limit(0), ["k"], "v").count() == 0


def test_a_title_of_many_files(spark):
    n = 100_000
    d = spark.range(n, numPartitions=8).select(
        F.format_string("/films/%06d.mkv", "id").alias("path"), (F.col("id") + 1).alias("ord"), F.format_string("%06d.mkv", "id").alias("filename"), F.lit("Alpha").alias("filename_title"),
        F.lit("alpha").alias("normalized_title"), F.lit("2001").alias("filename_year"), F.lit("CURRENT").alias("filename_standard"), F.lit("").alias("title_tag"), F.lit("").alias("filename_variant"),
        (F.col("id") % 7_001 + 61.0).alias("duration_sec"), F.lit(1080).alias("height"), F.lit(5000).alias("computed_bitrate_kbps"), F.lit(6).alias("max_audio_channels"),
        F.lit(False).alias("has_english_sub"), F.lit("").alias("hdr"),
    )
    (best,) = duplicates.best_versions(d).collect()
    text = "\n".join(f"/films/{i:06d}.mkv" for i in range(n))
    assert best["Versions"] == n and best["Files"] == text[:65_536]
    (group,) = films.local_groups(d).collect()
    assert group.n_files == n and group.files == text[:65_536] and group.aliases == ["Alpha"]
    assert group.runtime_min == round(statistics.median(i % 7_001 + 61.0 for i in range(n)) / 60, 1)
    found = films.film_records(films.local_groups(d), films.not_run(films.local_groups(d)), d)
    assert found["enrichment"].count() == n and found["films"].collect()[0]["Files"] == n


def test_whole_lists(spark, tmp_path):
    """q14 lists every path of a title, as its SQL does, where they take more than a sheet's text; slices keep their order."""
    import duckdb

    from cinelake.plans import queries

    rows = [(i % 3, f"v{i}" if i % 7 else None, (i * 7_919) % 400_009 * 3) for i in range(5_000)]  # several slices
    d = spark.createDataFrame(rows, "k int, v string, at long").repartition(5)
    want = {k: "\n".join(v for own, v, _ in sorted(rows, key=lambda x: x[2]) if own == k and v) for k in range(3)}
    assert {x.k: x.list for x in joined_lists(d, ["k"], "v", "at", None).collect()} == want
    assert joined_lists(d.limit(0), ["k"], "v", "at", None).count() == 0

    spark.range(1, 1_301).select((F.col("id") * 350).alias("p_partkey"), (F.col("id") % 50 + 1).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    got = queries.q14(spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    asked = c.execute(queries.ORACLES["q14_best_versions"])
    names = [x[0] for x in asked.description]
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(asked.fetchall()) and max(len(r.files) for r in got) > 65_536
