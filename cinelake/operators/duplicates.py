"""Exact duplicates by a hash cascade, probable copies of a film, and the best version of each title."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.functions.text import or_empty
from cinelake.operators.groups import LIST, joined_lists
from cinelake.operators.order import numbered


def _yes(c: Column) -> Column:
    return F.when(c, "YES").otherwise("")


def colliding(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur more than once. Counts are aggregated before the shuffle and joined back, which can be split."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return df.join(many, keys, "left_semi")


def hash_cascade(files: DataFrame, quick: Callable[[DataFrame], DataFrame], full: Callable[[DataFrame], DataFrame], mode: str = "candidates") -> DataFrame:
    """Adds quick_hash, sha256 and hash_error to rows of (path, size_bytes, quick_hash, sha256).

    ``quick`` and ``full`` take rows of (path, size_bytes) and return (path, value, failure). mode "none" changes nothing;
    "all" hashes every file; anything else hashes only files whose size collides, and fully only those whose size and
    quick hash collide. Hashes that are known already are kept. Failures leave the hash empty.
    """
    files = files.withColumns({"quick_hash": or_empty(F.col("quick_hash")), "sha256": or_empty(F.col("sha256")), "hash_error": F.lit("")})
    if mode == "none":
        return files

    def filled(df: DataFrame, chosen: DataFrame, run: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
        todo = chosen.where(F.col(name) == "").select("path", "size_bytes").distinct()
        found = run(todo).select(F.col("path").alias("_path"), F.col("value").alias("_value"), F.col("failure").alias("_failure"))
        met = df.join(found, F.col("path") == F.col("_path"), "left")
        said = F.concat_ws(" | ", F.nullif("hash_error", F.lit("")), F.nullif("_failure", F.lit("")))
        return met.withColumns({name: F.when(F.col(name) == "", or_empty(F.col("_value"))).otherwise(F.col(name)), "hash_error": said}).drop("_path", "_value", "_failure")

    if mode == "all":
        return filled(filled(files, files, quick, "quick_hash"), files, full, "sha256")
    first = filled(files, colliding(files, ["size_bytes"]), quick, "quick_hash")
    return filled(first, colliding(first.where("quick_hash <> ''"), ["size_bytes", "quick_hash"]), full, "sha256")


def _numbered(groups: DataFrame, keys: list[str], number: bool) -> DataFrame:
    return numbered(groups, keys, "_group") if number else groups.withColumn("_group", F.lit(None).cast("long"))


def exact_duplicates(records: DataFrame, number: bool = True) -> DataFrame:
    """Rows that share a non-empty SHA-256, with the number of their group in the order of the hash (null without ``number``,
    for those who only count)."""
    groups = records.where("sha256 <> ''").groupBy(F.col("sha256").alias("_sha")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    groups = _numbered(groups, ["_sha"], number)
    return records.join(groups, F.col("sha256") == F.col("_sha")).select(
        F.col("_group").alias("Duplicate Group"),
        F.col("sha256").alias("SHA256"),
        F.col("size_gib").alias("Size GiB"),
        F.col("duration_text").alias("Duration"),
        F.col("resolution").alias("Resolution"),
        F.col("path").alias("Path"),
    )


def same_film_groups(records: DataFrame, tolerance: int = 120, number: bool = True) -> DataFrame:
    """Probable copies of a film: equal titles of three characters or more, apart by known years, then by running time.

    Years part a title only if two known ones differ (unknown years then stay together); running times part a set only if
    the known ones span more than ``tolerance`` seconds, into buckets of that width (half-even; unknown ones apart). Adds
    ``_group`` in the order of title and first appearance (null without ``number``). records needs ``ord``; a null or zero
    duration is unknown.

    Counts, first places and spans are aggregated by title and year, of which a title has few, and by bucket, and joined back:
    the rows of a frequent title never meet in one task.
    """
    d = records.withColumn("_title", F.trim("normalized_title")).where(F.length("_title") >= 3)
    d = d.withColumns({"_seconds": F.nullif(F.col("duration_sec"), F.lit(0.0)), "_y": or_empty(F.col("filename_year"))})
    one = F.count(F.lit(1)).alias("_n")
    years = d.groupBy("_title", "_y").agg(one, F.min("ord").alias("_ord"), F.min("_seconds").alias("_least"), F.max("_seconds").alias("_most"))
    known = F.nullif("_y", F.lit(""))
    titles = years.groupBy("_title").agg(F.sum("_n").alias("_n1"), F.coalesce(F.min(known) != F.max(known), F.lit(False)).alias("_apart")).where("_n1 > 1")
    years = years.join(titles, "_title").withColumn("_yk", F.when(F.col("_apart"), F.coalesce(known, F.lit("?"))).otherwise("*"))
    sets = years.groupBy("_title", "_yk").agg(
        F.sum("_n").alias("_n2"), F.min("_ord").alias("_ord1"), F.coalesce(F.max("_most") - F.min("_least") > tolerance, F.lit(False)).alias("_wide")
    )
    d = d.join(years.select("_title", "_y", "_yk").join(sets.where("_n2 > 1").drop("_n2"), ["_title", "_yk"]), ["_title", "_y"])
    bucket = F.when(~F.col("_wide"), F.lit(0)).when(F.col("_seconds").isNull(), F.lit(-1)).otherwise(F.bround(F.col("_seconds") / tolerance).cast("long"))
    d = d.withColumn("_bucket", bucket)
    groups = d.groupBy("_title", "_yk", "_bucket").agg(one, F.min("_ord1").alias("_ord1"), F.min("ord").alias("_ord2")).where("_n > 1").drop("_n")
    return d.drop("_ord1").join(_numbered(groups, ["_title", "_ord1", "_ord2"], number), ["_title", "_yk", "_bucket"])


def same_film_report(records: DataFrame, tolerance: int = 120, number: bool = True) -> DataFrame:
    d = same_film_groups(records, tolerance, number)
    named = {
        "Possible Group": "_group", "Normalized Title": "_title", "Filename Year": "filename_year", "Source": "streaming_source", "Variant": "filename_variant",
        "Duration": "duration_text", "Duration sec": "duration_sec", "Resolution": "resolution", "Computed kbps": "computed_bitrate_kbps", "Video": "video_codec",
        "Audio Tracks": "audio_tracks", "Max Audio Ch": "max_audio_channels",
    }
    rest = {"Size GiB": "size_gib", "Path": "path", "Exact SHA256": "sha256"}
    return d.select(
        *[F.col(c).alias(n) for n, c in named.items()], _yes(F.col("has_english_sub")).alias("English Subs"), *[F.col(c).alias(n) for n, c in rest.items()]
    )


def best_versions(records: DataFrame, most: int | None = LIST) -> DataFrame:
    """A row per title (three characters or more, two files or more): its variants and the best of what its files offer.

    Files are its paths in the listing's order: the first ``most`` characters, more than a sheet's cell shows, or all (None).
    Versions counts all of them.
    """
    own = records.where(F.length("normalized_title") >= 3)
    d = own.groupBy("normalized_title").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("filename_variant", F.lit("")))), ", ").alias("variants"),
        F.nullif(F.max("height"), F.lit(0)).alias("height"),
        F.nullif(F.max("computed_bitrate_kbps"), F.lit(0)).alias("kbps"),
        F.nullif(F.max("max_audio_channels"), F.lit(0)).alias("channels"),
        F.bool_or("has_english_sub").alias("english"),
        F.bool_or(F.col("hdr") != "").alias("hdr"),
    )
    return d.where("n > 1").join(joined_lists(own, ["normalized_title"], "path", "ord", most), "normalized_title", "left").select(
        F.col("normalized_title").alias("Normalized Title"),
        F.col("n").alias("Versions"),
        F.col("variants").alias("Variants"),
        F.col("height").alias("Highest Height"),
        F.col("kbps").alias("Highest Computed kbps"),
        F.col("channels").alias("Max Audio Ch"),
        _yes(F.col("english")).alias("Any English Subs"),
        _yes(F.col("hdr")).alias("Any HDR"),
        or_empty(F.col("list")).alias("Files"),
    )
