"""Codec tables, resolution classes and the checks of a name's promises against measured properties, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinelake.functions import tokens as T
from cinelake.functions.text import lookup, or_empty


def _bare(value: Column) -> Column:
    return F.regexp_replace(F.lower(or_empty(value)), "[^a-z0-9]+", "")


def canonical_video_codec(value: Column) -> Column:
    return lookup(T.VIDEO_CODEC, _bare(value), _bare(value))


def canonical_audio_codec(value: Column) -> Column:
    return F.when(F.lower(F.trim(or_empty(value))).isin("dd+", "ddplus"), "eac3").otherwise(lookup(T.AUDIO_CODEC, _bare(value), _bare(value)))


def display_audio_codec(value: Column) -> Column:
    return lookup(T.AUDIO_NAME, canonical_audio_codec(value), F.upper(or_empty(value)))


def channel_count(token: Column) -> Column:
    return lookup(T.CHANNEL_COUNT, F.lower(F.trim(or_empty(token))), F.lit(None).cast("int"))


def channel_label(count: Column) -> Column:
    count = F.coalesce(count.cast("int"), F.lit(0))
    return F.when(count == 0, "").otherwise(lookup(T.CHANNEL_LABEL, count, F.concat(count.cast("string"), F.lit("ch"))))


def resolution_of_token(token: Column) -> Column:
    low = F.lower(F.trim(or_empty(token)))
    return F.when(low.isin("4k", "uhd"), "2160p").otherwise(low)


def resolution_class(width: Column, height: Column, field_order: Column) -> Column:
    order = F.lower(or_empty(field_order))
    base = (
        F.when((width >= 3000) | (height >= 1600), "2160")
        .when((width >= 1600) | (height >= 900), "1080")
        .when((width >= 1100) | (height >= 650), "720")
        .when(height >= 520, "576")
        .when(height >= 430, "480")
        .otherwise(height.cast("string"))
    )
    woven = ~order.isin("", "unknown", "progressive") & order.rlike("tt|bb|tb|bt")
    known = (F.coalesce(width, F.lit(0)) != 0) & (F.coalesce(height, F.lit(0)) != 0)
    return F.when(known, F.concat(base, F.when(woven, "i").otherwise("p"))).otherwise("")


def compare_resolution(named: Column, actual: Column) -> Column:
    lines = F.regexp_extract(actual, r"^(\d+)", 1)
    expected = resolution_of_token(named)
    return (
        F.when(actual == "", "REVIEW")
        .when(named == "", F.when(lines == "", "REVIEW").when(lines.try_cast("int") >= 720, "MISMATCH").otherwise("OK"))
        .when(expected == actual, "OK")
        .when(F.regexp_replace(expected, "[pi]+$", "") == F.regexp_replace(actual, "[pi]+$", ""), "REVIEW")
        .otherwise("MISMATCH")
    )


def compare_video(named: Column, actual: Column) -> Column:
    return (
        F.when((named == "") | (actual == ""), "REVIEW")
        .when(canonical_video_codec(named) != canonical_video_codec(actual), "MISMATCH")
        .when(F.lower(named).isin(T.LEGACY_VIDEO), "LEGACY")
        .otherwise("OK")
    )


def compare_audio_codec(named: Column, primary: Column, all_codecs: Column) -> Column:
    """primary: codec name of the primary track; all_codecs: array of the codec names of all tracks."""
    want = canonical_audio_codec(named)
    return (
        F.when((named == "") | (F.coalesce(F.size(all_codecs), F.lit(0)) <= 0), "REVIEW")
        .when(canonical_audio_codec(primary) == want, F.when(F.upper(F.trim(named)) == "DD+", "LEGACY").otherwise("OK"))
        .when(F.exists(all_codecs, lambda c: canonical_audio_codec(c) == want), "REVIEW")
        .otherwise("MISMATCH")
    )


def compare_audio_channels(named: Column, primary: Column, all_counts: Column) -> Column:
    want = channel_count(named)
    return (
        F.when(want.isNull() | (F.coalesce(F.size(all_counts), F.lit(0)) <= 0), "REVIEW")
        .when(primary == want, "OK")
        .when(F.coalesce(F.exists(all_counts, lambda c: c == want), F.lit(False)), "REVIEW")
        .otherwise("MISMATCH")
    )


def detect_audio_features(stream: Column) -> Column:
    low = F.lower(or_empty(stream))
    return F.when(low.contains("atmos") | low.rlike(r"(?U)\bjoc\b"), "Atmos").otherwise("")


def compare_audio_features(named: Column, actual: Column) -> Column:
    return F.when(named == "", "OK").when((F.lower(named) == "atmos") & (F.lower(or_empty(actual)) == "atmos"), "OK").otherwise("REVIEW")


def combine_status(standard: Column, checks: list[Column], probed: Column) -> Column:
    held = F.array(*checks)
    return (
        F.when(~probed, "REVIEW")
        .when(F.array_contains(held, "MISMATCH"), "MISMATCH")
        .when(standard.isin("UNPARSED", "REVIEW") | F.array_contains(held, "REVIEW"), "REVIEW")
        .when((standard == "LEGACY") | F.array_contains(held, "LEGACY"), "LEGACY")
        .otherwise("OK")
    )


def detect_hdr(transfer: Column, primaries: Column, pixel_format: Column, side_data: Column) -> Column:
    transfer, primaries, pixel_format, side = (F.lower(or_empty(c)) for c in (transfer, primaries, pixel_format, side_data))
    return (
        F.when(side.contains("dolby vision") | side.contains("dovi"), "Dolby Vision")
        .when(transfer.isin("smpte2084", "pq"), "HDR10/PQ")
        .when(transfer.isin("arib-std-b67", "hlg"), "HLG")
        .when(pixel_format.contains("10") & (primaries == "bt2020"), "10-bit / BT.2020")
        .otherwise("")
    )


def bit_depth(pixel_format: Column) -> Column:
    p = F.lower(or_empty(pixel_format))
    has = lambda n: p.rlike(f"p{n}|{n}le|{n}be")
    return F.when(has(16), "16").when(has(12), "12").when(has(10), "10").when(p != "", "8").otherwise("")


def is_english(language: Column, title: Column) -> Column:
    return F.lower(F.concat(or_empty(language), F.lit(" "), or_empty(title))).rlike("eng|en ")


def rename_target(filename: Column, named_video: Column, actual_video: Column) -> Column:
    """The name with ``.x264`` before its suffix spelt ``.H.264``, if the file is that codec; else empty."""
    new = F.regexp_replace(filename, r"(?i)\.x264(\.[^.]*)?$", ".H.264$1")
    wanted = (F.lower(named_video) == "x264") & (canonical_video_codec(actual_video) == "h264") & filename.rlike(r"(?i)\.x264\.[^.]+$")
    return F.when(wanted, new).otherwise("")

