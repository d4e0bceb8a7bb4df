"""The filename grammar as columns: what a name promises about title, year, source and codecs, and what is odd about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.functions import tokens as T
from cinelake.functions.text import nfkc, normalize_title_text, or_empty, step

FIELDS = ["title", "year", "resolution", "source", "release_type", "variant", "audio_codec", "channels", "audio_features", "video_codec", "standard", "notes"]

_BOUNDARY = rf"(?i)^([^\n]+)\.({T.RESOLUTION})\.([^\n]+)$"
_RELEASE_FIRST = rf"(?i)^([^\n]+)\.([^.]+)\.({T.RELEASE})(?:\.([^\n]+))?$"
_RELEASE = rf"(?i)^([^\n]+?)\.({T.RELEASE})(?:\.([^\n]+))?$"
_YEAR = rf"^([^\n]+)\.((?:{T.CENTURIES})\p{{Nd}}{{2}})$"
_HALF_YEAR = rf"(?i)^([^\n]+)\.((?:{T.CENTURIES})XX)$"
_ANY_YEAR = rf"(?<!\p{{Nd}})((?:{T.CENTURIES})\p{{Nd}}{{2}})(?!\p{{Nd}})"
_ANNOTATED = rf"(?i)(?:^|\.)({T.VIDEO})((?:[-_][^.]+| \(\p{{Nd}}+\)|\.[^.]+))$"
_COMPACT = rf"(?i)(?:^|\.)({T.AUDIO})({T.CHANNELS})$"
_SOURCE = rf"(?i)^(.*?)((?:(?:^|\.)(?:{T.VARIANT}))*)$"


def _tail(token: str) -> str:
    return rf"(?i)(?:^|\.)({token})$"


def _cut(text: Column, pattern: str) -> Column:
    """The text before what the pattern finds at its end, without trailing dots."""
    return F.regexp_replace(F.regexp_replace(text, pattern, ""), r"\.+$", "")


def _parts(text: Column) -> Column:
    return F.filter(F.split(text, r"\."), lambda t: t != "")


def _variant(token: Column) -> Column:
    return F.when(F.upper(token) == "TH", "TH").when(token.rlike(r"(?i)^v\p{Nd}+$"), F.lower(token)).otherwise(token)


def pretty(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[._]+", " "), r"(?U)\s+", " "))


def stem(name: Column) -> Column:
    """The name without its last suffix; a leading or trailing dot starts none."""
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def parse_filenames(df: DataFrame, filename: str = "filename", prefix: str = "", stems: str | None = None) -> DataFrame:
    """Adds the FIELDS (each with ``prefix``) for the names in a column; all are text, empty where nothing is known. stems: a
    column that has the names' NFKC stems already.

    The last resolution token with something after it splits a name; without one, the last release token does, and the
    missing resolution stands for SD. A name without either is UNPARSED. A null name counts as empty and is UNPARSED.
    """
    keep = df.columns
    d = df.withColumn("_p_stem", F.col(stems) if stems else nfkc(stem(or_empty(F.col(filename)))))
    s = F.col("_p_stem")
    mode = F.when(s.rlike(_BOUNDARY), F.when(F.regexp_extract(s, _BOUNDARY, 3).rlike(_RELEASE), "full").otherwise("loose")).when(s.rlike(_RELEASE_FIRST), "sd").otherwise("none")
    d = step(d, {"_p_mode": mode, "_p_rest": F.regexp_extract(s, _BOUNDARY, 3)})
    m, rest = F.col("_p_mode"), F.col("_p_rest")
    sd = m == "sd"
    d = step(
        d,
        {
            "_p_prefix": F.when(sd, F.regexp_extract(s, _RELEASE_FIRST, 1)).otherwise(F.regexp_extract(s, _BOUNDARY, 1)),
            "_p_res": F.when(m.isin("full", "loose"), F.regexp_extract(s, _BOUNDARY, 2)).otherwise(""),
            "_p_source": F.when(sd, F.regexp_extract(s, _RELEASE_FIRST, 2)).when(m == "full", F.regexp_extract(rest, _RELEASE, 1)).otherwise(""),
            "_p_release": F.when(sd, F.regexp_extract(s, _RELEASE_FIRST, 3)).when(m == "full", F.regexp_extract(rest, _RELEASE, 2)).otherwise(""),
            "_p_tech": F.when(sd, F.regexp_extract(s, _RELEASE_FIRST, 4)).when(m == "full", F.regexp_extract(rest, _RELEASE, 3)).otherwise(""),
        }
    )
    p = F.col("_p_prefix")
    years = F.regexp_extract_all(s, F.lit(_ANY_YEAR), 1)
    d = step(d, {"_p_last": or_empty(F.try_element_at(years, F.lit(-1)))})
    last = F.col("_p_last")
    d = step(
        d,
        {
            "_p_year": F.when(m == "none", last).when(p.rlike(_YEAR), F.regexp_extract(p, _YEAR, 2)).otherwise(F.upper(F.regexp_extract(p, _HALF_YEAR, 2))),
            "_p_raw": F.when(m == "none", F.when((last != "") & F.endswith(s, F.concat(F.lit("."), last)), F.substring(s, F.lit(1), F.length(s) - F.length(last) - 1)).otherwise(s))
            .when(p.rlike(_YEAR), F.regexp_extract(p, _YEAR, 1))
            .when(p.rlike(_HALF_YEAR), F.regexp_extract(p, _HALF_YEAR, 1))
            .otherwise(p),
            "_p_note1": F.when(p.rlike(_YEAR), F.lit(None))
            .when(p.rlike(_HALF_YEAR), F.concat(F.lit("placeholder year: "), F.upper(F.regexp_extract(p, _HALF_YEAR, 2))))
            .when(~pretty(p).rlike(T.EPISODE), "release year missing"),
            "_p_dots": F.regexp_replace(F.col("_p_tech"), r"^\.+|\.+$", ""),
        }
    )
    resolutions = [t.lower() for t in T.RESOLUTION.split("|")]
    raw, tech = F.col("_p_raw"), F.col("_p_dots")
    d = step(
        d,
        {
            "_p_embedded": F.filter(_parts(raw), lambda t: F.lower(t).isin(resolutions)),
            "_p_plain": tech.rlike(_tail(T.VIDEO)),
            "_p_marked": tech.rlike(_ANNOTATED),
        }
    )
    plain, marked = F.col("_p_plain"), ~F.col("_p_plain") & F.col("_p_marked")
    d = step(
        d,
        {
            "_p_title": F.when((F.size("_p_embedded") > 0) & (m != "none"), F.array_join(F.filter(_parts(raw), lambda t: ~F.lower(t).isin(resolutions)), ".")).otherwise(raw),
            "_p_video": F.when(plain, F.regexp_extract(tech, _tail(T.VIDEO), 1)).when(marked, F.regexp_extract(tech, _ANNOTATED, 1)).otherwise(""),
            "_p_mark": F.when(marked, F.regexp_extract(tech, _ANNOTATED, 2)).otherwise(""),
            "_p_a": F.regexp_replace(F.when(plain, _cut(tech, _tail(T.VIDEO))).when(marked, _cut(tech, _ANNOTATED)).otherwise(tech), r"^\.+|\.+$", ""),
        }
    )
    a = F.col("_p_a")
    d = step(d, {"_p_feature": F.regexp_extract(a, _tail(T.FEATURE), 1), "_p_b": F.when(a.rlike(_tail(T.FEATURE)), _cut(a, _tail(T.FEATURE))).otherwise(a)})
    b = F.col("_p_b")
    d = step(d, {"_p_head": F.when(b.rlike(_tail(T.CHANNELS)), _cut(b, _tail(T.CHANNELS)))})
    head = F.col("_p_head")
    apart, together = F.coalesce(head.rlike(_tail(T.AUDIO)), F.lit(False)), b.rlike(_COMPACT)
    d = step(
        d,
        {
            "_p_audio": F.when(apart, F.regexp_extract(head, _tail(T.AUDIO), 1)).when(together, F.regexp_extract(b, _COMPACT, 1)).otherwise(b),
            "_p_channels": F.when(apart, F.regexp_extract(b, _tail(T.CHANNELS), 1)).when(together, F.regexp_extract(b, _COMPACT, 2)).otherwise(""),
            "_p_mods": _parts(F.when(apart, _cut(head, _tail(T.AUDIO))).when(together, _cut(b, _COMPACT)).otherwise("")),
            "_p_src": F.array_join(_parts(F.col("_p_source")), "."),
        }
    )
    known = lambda t: t.rlike(rf"(?i)^(?:{T.VARIANT})$")
    mods, audio = F.col("_p_mods"), F.col("_p_audio")
    odd = F.array_join(F.filter(mods, lambda t: ~known(t)), ".")
    variants = F.concat(_parts(F.regexp_extract("_p_src", _SOURCE, 2)), F.filter(mods, known))
    embedded = F.when(F.size("_p_embedded") > 0, F.concat(F.lit("additional resolution token in title area: "), F.array_join("_p_embedded", ", ")))
    mark = F.col("_p_mark")
    technical = [
        F.when(mark.startswith("."), F.concat(F.lit("unexpected trailing token after video codec: "), F.substr(mark, F.lit(2)))).when(
            mark != "", F.concat(F.lit("trailing annotation after video codec: "), mark)
        ),
        F.when(odd != "", F.concat(F.lit("technical modifier unrecognized: "), odd)),
        F.when(F.col("_p_video") == "", "video codec token missing/unrecognized"),
        F.when(F.col("_p_channels") == "", "channel token missing/unrecognized"),
        F.when(audio == "", "audio codec token missing").when(~audio.rlike(rf"(?i)^(?:{T.AUDIO})$"), F.concat(F.lit("audio token unrecognized: "), audio)),
    ]
    notes = (
        F.when(m == "none", F.array(F.lit("No recognizable technical boundary found")))
        .when(m == "loose", F.array_compact(F.array("_p_note1", embedded, F.lit("source/release-type structure was not recognized"))))
        .otherwise(F.array_compact(F.array("_p_note1", embedded, *technical)))
    )
    legacy = F.lower("_p_video").isin(T.LEGACY_VIDEO) | (F.upper(audio) == "DD+")
    d = step(d, {"_p_notes": notes})
    standard = F.when(m == "none", "UNPARSED").when(F.size("_p_notes") > 0, "REVIEW").when(legacy, "LEGACY").otherwise("OK")
    out = {
        "title": pretty(F.col("_p_title")),
        "year": F.col("_p_year"),
        "resolution": F.col("_p_res"),
        "source": F.regexp_extract("_p_src", _SOURCE, 1),
        "release_type": F.when(F.upper("_p_release") == "WEB.DL", "WEB-DL").otherwise(F.col("_p_release")),
        "variant": F.array_join(F.array_distinct(F.transform(variants, _variant)), "."),
        "audio_codec": audio,
        "channels": F.col("_p_channels"),
        "audio_features": F.col("_p_feature"),
        "video_codec": F.col("_p_video"),
        "standard": standard,
        "notes": F.array_join("_p_notes", "; "),
    }
    return step(d, {prefix + f: out[f] for f in FIELDS}).select(*[F.col(f"`{c}`") for c in keep], *[prefix + f for f in FIELDS])


def normalized_titles(df: DataFrame, filename: str = "filename", title: str = "title", standard: str = "standard", name: str = "normalized_title", stems: str | None = None) -> DataFrame:
    """Adds the normal form of the parsed title; a name whose title is empty is stripped of noise words instead."""
    s = F.col(stems) if stems else nfkc(stem(or_empty(F.col(filename))))
    s = F.regexp_replace(s, T.BRACKET, " ")
    s = F.regexp_replace(s, _ANY_YEAR, " ")
    s = F.regexp_replace(s, T.EPISODE, " ")
    for pattern in T.NOISE:
        s = F.regexp_replace(s, "(?iU)" + pattern, " ")
    s = F.regexp_replace(s, r"[._\-]+", " ")
    for pattern in T.NOISE_LATE:
        s = F.regexp_replace(s, "(?iU)" + pattern, " ")
    return df.withColumn(name, normalize_title_text(F.when(F.col(title) != "", F.col(title)).otherwise(s)))
