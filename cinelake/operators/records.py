"""Inventory records: a listed file, its name's fields, its probe document's properties and the checks between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.functions.text import duration_text, nfkc, or_empty, rate, step, to_int
from cinelake.operators import compare as C
from cinelake.operators.filenames import normalized_titles, parse_filenames, stem

# The record's fields in order.
FIELDS = [
    "path", "root", "filename", "extension", "size_bytes", "size_gib", "modified", "duration_sec", "duration_text", "container",
    "overall_bitrate_kbps", "computed_bitrate_kbps", "video_codec", "video_profile", "video_encoder", "width", "height", "resolution",
    "actual_resolution_class", "fps", "pixel_format", "bit_depth", "hdr", "video_bitrate_kbps", "audio_tracks", "audio_summary",
    "primary_audio_codec", "primary_audio_channels", "actual_audio_features", "max_audio_channels", "has_51", "subtitle_tracks", "subtitle_summary",
    "has_english_sub", "title_tag", "filename_title", "normalized_title", "filename_year", "name_resolution", "streaming_source", "release_type",
    "filename_variant", "name_audio", "name_channels", "name_audio_features", "name_video", "filename_standard", "filename_parse_notes",
    "resolution_match", "audio_match", "channels_match", "audio_features_match", "video_match", "metadata_check", "rename_candidate", "rename_status",
    "rename_target", "quick_hash", "sha256", "ffprobe_ok", "error",
]

_NAMES = {
    "title": "filename_title", "year": "filename_year", "resolution": "name_resolution", "source": "streaming_source", "release_type": "release_type",
    "variant": "filename_variant", "audio_codec": "name_audio", "channels": "name_channels", "audio_features": "name_audio_features",
    "video_codec": "name_video", "standard": "filename_standard", "notes": "filename_parse_notes",
}


# The fields of a probe document that are read; tags are looked up by their exact names.
_STREAM = (
    "codec_type string, codec_name string, profile string, width string, height string, field_order string, avg_frame_rate string, r_frame_rate string, "
    "pix_fmt string, color_transfer string, color_primaries string, side_data_list string, bit_rate string, channels string, channel_layout string, "
    "disposition map<string,string>, tags map<string,string>"
)
_FORMAT = "duration string, bit_rate string, format_name string, tags map<string,string>"


def _first(*values: Column) -> Column:
    """The first that is there and not empty; else empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def _tag(s: Column, *names: str) -> Column:
    return _first(*[s["tags"][n] for n in names])


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def _language(s: Column) -> Column:
    return F.lower(F.trim(_tag(s, "language", "LANGUAGE")))


def _audio_text(s: Column) -> Column:
    count, bits = to_int(s["channels"]), to_int(s["bit_rate"])
    profile = _first(s["profile"])
    size = F.when(F.coalesce(count, F.lit(0)) != 0, F.concat(count.cast("string"), F.lit("ch"))).otherwise(_first(s["channel_layout"]))
    speed = F.when(F.coalesce(bits, F.lit(0)) != 0, F.concat(F.bround(bits / 1000).cast("long").cast("string"), F.lit("kbps"))).otherwise("")
    return _joined(_language(s), F.upper(_first(s["codec_name"])), F.when(F.lower(profile) == "unknown", "").otherwise(profile), size, speed)


def _subtitle_text(s: Column) -> Column:
    return _joined(_language(s), F.upper(_first(s["codec_name"])), F.trim(_tag(s, "title")))


def probe_columns(df: DataFrame, probe: str = "probe_json", size: str = "size_bytes") -> DataFrame:
    """Adds the measured fields from a probe document (JSON text). A null, empty or unreadable document measures nothing:
    texts are empty, numbers null, counts 0, and ``ffprobe_ok`` is false. The document is read once, and each stream once."""
    d = step(df, {"_doc": F.from_json(F.col(probe), "format string, streams array<string>")})
    ok = F.col("_doc.format").isNotNull() | F.col("_doc.streams").isNotNull()
    streams = F.coalesce(F.col("_doc.streams"), F.array().cast("array<string>"))
    read = F.transform(streams, lambda s: F.struct(s.alias("raw"), F.from_json(s, _STREAM).alias("s")))
    d = step(d, {"ffprobe_ok": F.coalesce(ok, F.lit(False)), "_format": F.from_json("_doc.format", _FORMAT), "_streams": read})
    of = lambda kind: F.filter("_streams", lambda x: x["s"]["codec_type"] == kind)
    d = step(d, {"_audio": of("audio"), "_subs": F.transform(of("subtitle"), lambda x: x["s"]), "_video": F.try_element_at(of("video"), F.lit(1))["s"]})
    audio, video, fmt = F.col("_audio"), F.col("_video"), F.col("_format")
    chosen = F.filter(audio, lambda x: to_int(x["s"]["disposition"]["default"]) == 1)
    d = step(
        d,
        {
            "_first": F.coalesce(F.try_element_at(chosen, F.lit(1)), F.try_element_at(audio, F.lit(1))),
            "_seconds": fmt["duration"].try_cast("double"),
            "_overall": to_int(fmt["bit_rate"]),
            "width": to_int(video["width"]).cast("int"),
            "height": to_int(video["height"]).cast("int"),
            "_fps": rate(_first(video["avg_frame_rate"], video["r_frame_rate"])),
            "_counts": F.transform(audio, lambda x: to_int(x["s"]["channels"])),
            "_codecs": F.transform(audio, lambda x: _first(x["s"]["codec_name"])),
        }
    )
    seconds, w, h = F.col("_seconds"), F.col("width"), F.col("height")
    most = F.nullif(F.array_max(F.transform("_counts", lambda c: F.coalesce(c, F.lit(0)))), F.lit(0))
    kbps = lambda c: F.bround(c / 1000).cast("int")
    primary = F.col("_first")["s"]
    return step(
        d,
        {
            "_primary_codec": _first(primary["codec_name"]),
            "_primary_count": to_int(primary["channels"]),
            "duration_sec": F.bround(seconds, 3),
            "duration_text": duration_text(seconds),
            "container": _first(fmt["format_name"]),
            "overall_bitrate_kbps": kbps(F.nullif(F.col("_overall"), F.lit(0))),
            "computed_bitrate_kbps": F.when(seconds > 0, F.bround(F.col(size) * 8 / seconds / 1000).cast("int")),
            "video_codec": F.upper(_first(video["codec_name"])),
            "video_profile": _first(video["profile"]),
            "video_encoder": F.trim(_tag(video, "encoder", "ENCODER", "writing_library", "WRITING_LIBRARY")),
            "resolution": F.when((F.coalesce(w, F.lit(0)) != 0) & (F.coalesce(h, F.lit(0)) != 0), F.concat(w, F.lit("x"), h)).otherwise(""),
            "actual_resolution_class": C.resolution_class(w, h, _first(video["field_order"])),
            "fps": F.bround(F.nullif(F.col("_fps"), F.lit(0.0)), 3),
            "pixel_format": _first(video["pix_fmt"]),
            "bit_depth": C.bit_depth(_first(video["pix_fmt"])),
            "hdr": C.detect_hdr(_first(video["color_transfer"]), _first(video["color_primaries"]), _first(video["pix_fmt"]), _first(video["side_data_list"])),
            "video_bitrate_kbps": F.nullif(kbps(to_int(video["bit_rate"])), F.lit(0)),
            "audio_tracks": F.size(audio),
            "audio_summary": F.array_join(F.filter(F.transform(audio, lambda x: _audio_text(x["s"])), lambda x: x != ""), " | "),
            "primary_audio_codec": F.when(F.col("_first").isNull(), "").otherwise(C.display_audio_codec(_first(primary["codec_name"]))),
            "primary_audio_channels": C.channel_label(to_int(primary["channels"])),
            "actual_audio_features": C.detect_audio_features(F.col("_first")["raw"]),
            "max_audio_channels": most.cast("int"),
            "has_51": F.coalesce(most >= 6, F.lit(False)),
            "subtitle_tracks": F.size("_subs"),
            "subtitle_summary": F.array_join(F.filter(F.transform("_subs", _subtitle_text), lambda x: x != ""), " | "),
            "has_english_sub": F.exists("_subs", lambda s: C.is_english(_language(s), _tag(s, "title"))),
            "title_tag": F.trim(_tag(fmt, "title", "TITLE")),
        }
    )


def inventory_records(listing: DataFrame) -> DataFrame:
    """The 61 fields of each listed file, and ``ord`` if the listing has it.

    listing: path, root, filename, size_bytes, mtime_ns, probe_json, error and, if known, quick_hash and sha256. A null
    path or name counts as empty text, null hashes and errors too. A file without a usable probe document is a REVIEW.
    """
    d = listing
    for c in ("quick_hash", "sha256", "error"):
        d = d.withColumn(c, or_empty(F.col(c)) if c in d.columns else F.lit(""))
    keep = ["ord"] if "ord" in listing.columns else []
    d = d.withColumns({"path": or_empty(F.col("path")), "root": or_empty(F.col("root")), "filename": or_empty(F.col("filename"))})
    d = d.select(*keep, "path", "root", "filename", "size_bytes", "mtime_ns", "probe_json", "error", "quick_hash", "sha256", nfkc(stem(F.col("filename"))).alias("_stem"))
    d = normalized_titles(parse_filenames(d, stems="_stem"), stems="_stem").withColumnsRenamed({k: v for k, v in _NAMES.items() if k != v})
    d = probe_columns(d)
    ok = F.col("ffprobe_ok")
    review = lambda c: F.when(ok, c).otherwise("REVIEW")
    d = step(
        d,
        {
            "extension": F.lower(F.regexp_extract("filename", r"^.+(\.[^.]+)$", 1)),
            "size_gib": F.bround(F.col("size_bytes") / (1 << 30), 3),
            "modified": F.date_format(F.timestamp_micros(F.expr("mtime_ns div 1000")), "yyyy-MM-dd HH:mm:ss"),
            "resolution_match": review(C.compare_resolution(F.col("name_resolution"), F.col("actual_resolution_class"))),
            "audio_match": review(C.compare_audio_codec(F.col("name_audio"), F.col("_primary_codec"), F.col("_codecs"))),
            "channels_match": review(C.compare_audio_channels(F.col("name_channels"), F.col("_primary_count"), F.col("_counts"))),
            "audio_features_match": C.compare_audio_features(F.col("name_audio_features"), F.when(ok, F.col("actual_audio_features")).otherwise("")),
            "video_match": review(C.compare_video(F.col("name_video"), F.col("video_codec"))),
            "rename_target": F.when(ok, C.rename_target(F.col("filename"), F.col("name_video"), F.col("video_codec"))).otherwise(""),
        }
    )
    checks = [F.col(c) for c in ("resolution_match", "audio_match", "channels_match", "audio_features_match", "video_match")]
    renamed, fine = F.col("rename_target") != "", F.forall(F.array(*checks[:3]), lambda c: c.isin("OK", "LEGACY"))
    d = step(
        d,
        {
            "metadata_check": C.combine_status(F.col("filename_standard"), checks, ok),
            "rename_candidate": F.when(renamed, "YES").otherwise(""),
            "rename_status": F.when(renamed & fine, "SAFE").when(renamed, "REVIEW").otherwise(""),
        }
    )
    return d.select(*keep, *FIELDS)
