"""Fixed values of the archive's naming scheme and of its codec tables; results depend on each of them."""

from __future__ import annotations

# File kinds, grammar tokens and year prefixes, in their natural order.
EXTENSIONS = [".mkv", ".mp4", ".m4v", ".mov", ".avi", ".wmv", ".ts", ".m2ts", ".mts", ".mpg", ".mpeg", ".vob", ".webm", ".flv", ".iso"]
RESOLUTION = "2160p|1080p|1080i|720p|576p|480p|360p|4K|UHD"
RELEASE = r"WEB-DL|WEB\.DL|WEBRip|WEB-Rip|BluRay|Blu-Ray|BDRip|BRRip|REMUX|HDTV|DVDRip|DVD|VHSRip|VHS-Rip"
VIDEO = r"H\.?264|H\.?265|x264|x265|AVC|HEVC|AV1"
CHANNELS = r"7\.1|6\.1|5\.1|4\.0|3\.0|2\.1|2\.0|1\.0|mono|stereo"
AUDIO = r"DDP|DD\+|DD|EAC3|E-AC-3|AC3|AC-3|AAC|DTS-HD\.MA|DTS-HD|DTS|TRUEHD|FLAC|OPUS|MP3|LPCM|PCM"
FEATURE = "Atmos"
VARIANT = r"TH|v\p{Nd}+"
CENTURIES = "18|19|20|24|25"
EPISODE_MARK = r"\b(?:s\d{1,2}e\d{1,3}|ep(?:isode)?[ ._-]?\d{1,4})\b"
EPISODE = "(?iU)" + EPISODE_MARK
BRACKET = r"[\[({][^\])}]{1,45}[\])}]"
SKIPPED_FOLDERS = ["$RECYCLE.BIN", "System Volume Information"]

# Words that the fallback title normaliser deletes.
NOISE = [
    r"\b(?:2160p|1080p|1080i|720p|576p|480p|4k|uhd|hdr10\+?|hdr|dv|dolby[ ._-]?vision)\b",
    r"\b(?:web[ ._-]?dl|web[ ._-]?rip|webrip|bluray|blu[ ._-]?ray|bdrip|brrip|remux|hdtv|dvd(?:rip)?|vhs(?:rip)?)\b",
    r"\b(?:x264|x265|h\.?264|h\.?265|hevc|avc|av1|mpeg[ ._-]?2|vc[ ._-]?1)\b",
    r"\b(?:aac(?:2\.0|5\.1)?|ac3|eac3|ddp?|dts(?:hd)?|truehd|atmos|flac|opus|mp3)\b",
    r"\b(?:proper|repack|internal|limited|uncut|extended|remastered|restored|criterion)\b",
    r"\b(?:thai|th|eng|english|subbed|subs?|softsubs?|hardsubs?)\b",
]
NOISE_LATE = [r"\b(?:cd|disc|disk|part)[ ._-]?\d+\b", r"\b(?:r\d+)\b", r"\b(?:proper|repack)\b"]

# Codec spellings, their display names, channel tokens and labels.
VIDEO_CODEC = {"h264": "h264", "x264": "h264", "avc": "h264", "avc1": "h264", "h265": "hevc", "x265": "hevc", "hevc": "hevc", "hev1": "hevc", "hvc1": "hevc"}
AUDIO_CODEC = {
    "ddp": "eac3", "eac3": "eac3", "dd": "ac3", "ac3": "ac3", "aac": "aac", "dts": "dts", "dtshd": "dts", "dtshdma": "dts",
    "truehd": "truehd", "flac": "flac", "opus": "opus", "mp3": "mp3", "pcm": "pcm", "lpcm": "pcm",
}
AUDIO_NAME = {"eac3": "DDP", "ac3": "DD", "aac": "AAC", "dts": "DTS", "truehd": "TRUEHD", "flac": "FLAC", "opus": "OPUS", "mp3": "MP3", "pcm": "PCM"}
CHANNEL_COUNT = {"mono": 1, "stereo": 2, "1.0": 1, "2.0": 2, "2.1": 3, "3.0": 3, "4.0": 4, "5.1": 6, "6.1": 7, "7.1": 8}
CHANNEL_LABEL = {1: "1.0", 2: "2.0", 3: "3ch", 4: "4.0", 6: "5.1", 7: "6.1", 8: "7.1"}
LEGACY_VIDEO = ["x264", "x265", "h264", "h265"]
