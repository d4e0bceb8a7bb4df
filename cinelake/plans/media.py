"""A media view derived from ``part``: components, the filename rendered from them and a probe document, in SQL that
both engines read. Oracles use the components, so they are independent of the parser."""

from __future__ import annotations


def pick(n: str, *values: str) -> str:
    """The value at n modulo the number of values."""
    cases = " ".join(f"WHEN {i} THEN {v if v.isdigit() else repr(v)}" for i, v in enumerate(values))
    return f"(CASE ({n}) % {len(values)} {cases} END)"


MEDIA = f"""
m0 AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS s FROM {{part}}),
m1 AS (
  SELECT k, s, k % 350 AS t, k % 13 AS defect,
    {pick("k % 350", "Silver Moon", "Red River", "Night Bus", "Golden Field", "Quiet House")} || ' ' || CAST(k % 350 AS STRING) AS title,
    CAST(1990 + (k % 350) % 20 + (CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END) AS STRING) AS good_year,
    {pick("k", "1080p", "720p", "2160p", "", "480p")} AS res,
    {pick("k", "NF", "AMZN", "MUBI")} AS source,
    {pick("k", "", "TH", "", "v2")} AS variant,
    {pick("k", "WEB-DL", "BluRay")} AS release_type,
    {pick("k + 1", "DDP", "AAC", "DD", "DD+")} AS audio,
    {pick("k + 1", "5.1", "2.0", "5.1", "5.1")} AS channels,
    CASE WHEN k % 11 = 0 THEN 'Atmos' ELSE '' END AS feature,
    {pick("k", "H.264", "H.265", "x264", "x265", "H264", "AVC")} AS video,
    {pick("k + (CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END)", "1920", "1280", "3840", "720", "640")} AS w,
    {pick("k + (CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END)", "800", "720", "2160", "576", "480")} AS h,
    {pick("k + (CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END)", "h264", "hevc", "h264", "hevc", "h264", "h264")} AS vcodec,
    {pick("k + 1 + (CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END)", "eac3", "aac", "ac3", "eac3")} AS acodec,
    {pick("k + 1 + (CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END)", "6", "2", "6", "6")} AS achannels,
    CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS second,
    {pick("k", "eng", "tha", "ben", "")} AS sub,
    {pick("k", "", "smpte2084", "", "arib-std-b67", "bt709")} AS transfer,
    {pick("k", "yuv420p", "yuv420p10le", "yuv420p12le", "")} AS pix,
    CASE WHEN k % 31 = 0 THEN 0 ELSE 1 END AS probed,
    5400 + (k % 3) * 50 + (CASE WHEN k % 10 = 0 THEN 3600 ELSE 0 END) AS seconds
  FROM m0
),
m2 AS (
  SELECT *,
    CASE defect WHEN 1 THEN '' WHEN 2 THEN '20XX' WHEN 6 THEN '' WHEN 5 THEN '' ELSE good_year END AS year,
    CASE defect WHEN 5 THEN 'clip ' || chr(CAST(97 + k % 26 AS INT)) || CAST(k % 1000 AS STRING) || '.mp4'
      ELSE replace(title, ' ', '.') || CASE defect WHEN 6 THEN '.S01E02' ELSE '' END
        || CASE defect WHEN 1 THEN '' WHEN 2 THEN '.20XX' WHEN 6 THEN '' ELSE '.' || good_year END
        || CASE WHEN res = '' THEN '' ELSE '.' || res END || '.' || source || CASE WHEN variant = 'TH' AND res <> '' THEN '.TH' ELSE '' END || '.' || release_type
        || CASE WHEN variant = 'v2' OR variant = 'TH' AND res = '' THEN '.' || variant ELSE '' END || '.' || audio || channels || CASE WHEN feature = '' THEN '' ELSE '.' || feature END || '.' || video
        || CASE defect WHEN 3 THEN '-kass' ELSE '' END || '.mkv' END AS filename,
    CASE WHEN probed = 0 THEN NULL ELSE
      '{{"format":{{"duration":"' || CAST(seconds AS STRING) || '.0","bit_rate":"4000000","format_name":"matroska,webm","tags":{{"title":"' || title || '"}}}},"streams":['
      || '{{"codec_type":"video","codec_name":"' || vcodec || '","width":' || CAST(w AS STRING) || ',"height":' || CAST(h AS STRING)
      || ',"avg_frame_rate":"24000/1001","pix_fmt":"' || pix || '","color_transfer":"' || transfer || '","color_primaries":"bt2020"}},'
      || CASE WHEN second = 1 THEN '{{"codec_type":"audio","codec_name":"mp3","channels":2}},' ELSE '' END
      || '{{"codec_type":"audio","codec_name":"' || acodec || '","channels":' || CAST(achannels AS STRING) || ',"disposition":{{"default":1}}'
      || CASE WHEN k % 22 = 0 THEN ',"profile":"Dolby Atmos"' ELSE '' END || '}}'
      || CASE WHEN sub = '' THEN '' ELSE ',{{"codec_type":"subtitle","codec_name":"subrip","tags":{{"language":"' || sub || '"}}}}' END || ']}}' END AS probe_json
  FROM m1
)
"""

#: Checks of the components, for oracles: names as the parser's fields.
CHECKED = """
m3 AS (
  SELECT *,
    CASE WHEN defect = 5 THEN 'UNPARSED' WHEN defect IN (1, 2, 3) THEN 'REVIEW' WHEN video IN ('x264', 'x265', 'H264') OR audio = 'DD+' THEN 'LEGACY' ELSE 'OK' END AS standard,
    CASE WHEN w >= 3000 OR h >= 1600 THEN '2160p' WHEN w >= 1600 OR h >= 900 THEN '1080p' WHEN w >= 1100 OR h >= 650 THEN '720p' WHEN h >= 520 THEN '576p' ELSE '480p' END AS class,
    CASE WHEN video IN ('H.265', 'x265') THEN 'hevc' ELSE 'h264' END AS want_video,
    CASE audio WHEN 'AAC' THEN 'aac' WHEN 'DD' THEN 'ac3' ELSE 'eac3' END AS want_audio,
    CASE channels WHEN '2.0' THEN 2 ELSE 6 END AS want_channels
  FROM m2
),
m4 AS (
  SELECT *,
    CASE WHEN probed = 0 THEN 'REVIEW' WHEN defect = 5 OR res = '' THEN CASE WHEN class IN ('2160p', '1080p', '720p') THEN 'MISMATCH' ELSE 'OK' END
      WHEN res = class THEN 'OK' ELSE 'MISMATCH' END AS resolution_match,
    CASE WHEN probed = 0 OR defect = 5 THEN 'REVIEW' WHEN acodec = want_audio THEN CASE audio WHEN 'DD+' THEN 'LEGACY' ELSE 'OK' END ELSE 'MISMATCH' END AS audio_match,
    CASE WHEN probed = 0 OR defect = 5 THEN 'REVIEW' WHEN achannels = want_channels THEN 'OK' WHEN second = 1 AND want_channels = 2 THEN 'REVIEW' ELSE 'MISMATCH' END AS channels_match,
    CASE WHEN defect = 5 OR feature = '' THEN 'OK' WHEN probed = 1 AND k % 22 = 0 THEN 'OK' ELSE 'REVIEW' END AS audio_features_match,
    CASE WHEN probed = 0 OR defect = 5 THEN 'REVIEW' WHEN vcodec <> want_video THEN 'MISMATCH' WHEN video IN ('x264', 'x265', 'H264') THEN 'LEGACY' ELSE 'OK' END AS video_match
  FROM m3
),
m5 AS (
  SELECT *,
    CASE WHEN probed = 0 THEN 'REVIEW'
      WHEN 'MISMATCH' IN (resolution_match, audio_match, channels_match, audio_features_match, video_match) THEN 'MISMATCH'
      WHEN standard IN ('UNPARSED', 'REVIEW') OR 'REVIEW' IN (resolution_match, audio_match, channels_match, audio_features_match, video_match) THEN 'REVIEW'
      WHEN standard = 'LEGACY' OR 'LEGACY' IN (resolution_match, audio_match, channels_match, audio_features_match, video_match) THEN 'LEGACY' ELSE 'OK' END AS metadata_check,
    CASE WHEN probed = 1 AND defect NOT IN (3, 5) AND video = 'x264' AND vcodec = 'h264' THEN 'YES' ELSE '' END AS rename_candidate,
    CASE WHEN defect = 5 THEN 'clip ' || chr(CAST(97 + k % 26 AS INT)) || CAST(k % 1000 AS STRING) ELSE lower(title) END AS norm,
    CASE WHEN defect = 5 THEN '' ELSE year END AS known_year,
    '/archive/' || CAST(k AS STRING) || '/' || filename AS path
  FROM m4
)
"""
SPARK = ("WITH " + MEDIA).replace("{", "{{").replace("}", "}}").replace("{{part}}", "{part}")
DUCK = ("WITH " + MEDIA + "," + CHECKED).replace("{part}", "part").replace("AS STRING)", "AS VARCHAR)")
