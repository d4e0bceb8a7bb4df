"""Settings of a scan: command line, configuration file and environment."""

from __future__ import annotations

import argparse
import configparser
import os
from dataclasses import dataclass
from datetime import date
from pathlib import Path

from cinelake.sources.catalogue import Catalogue
from cinelake.sources.files import HOME

# Names and defaults of the configuration file's fields and of the files beside the program.
SCANNER = {"roots": "", "output": "", "ffprobe": "", "hash_mode": ""}
TMDB = {
    "enabled": "false", "access_token": "", "api_key": "", "language": "en-US", "cache": "", "cache_ttl_days": "30", "timeout": "20",
    "max_candidates": "3", "auto_match_score": "90", "auto_match_margin": "8",
}
HASH_MODES = ["candidates", "all", "none"]


@dataclass(frozen=True)
class Settings:
    """What a scan needs. cache and responses are folders; catalogue is None if films are not looked up."""

    roots: tuple[str, ...] = ()
    output: str = ""
    cache: str = ""
    ffprobe: str = ""
    hash_mode: str = "candidates"
    refresh: bool = False
    catalogue: Catalogue | None = None
    responses: str = ""
    response_days: int = 30
    max_candidates: int = 3
    least_score: float = 90.0
    least_margin: float = 8.0


def expanded(path: str) -> str:
    return os.path.expandvars(os.path.expanduser(path))


def number(text: str, otherwise: float) -> float:
    """The number that a field holds; the default for text that is none, and for 0."""
    try:
        return float(text) or otherwise
    except ValueError:
        return otherwise


def read_ini(path: str) -> dict[str, dict[str, str]]:
    """The fields of the sections scanner and tmdb, with defaults; a missing file or section leaves them all."""
    ini = configparser.ConfigParser()
    ini.read(path, encoding="utf-8-sig")
    return {name: {k: ini.get(name, k, fallback=v) for k, v in fields.items()} for name, fields in (("scanner", SCANNER), ("tmdb", TMDB))}


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cinelake", description="Scan media files and write a workbook with their inventory.")
    p.add_argument("roots", nargs="*", help="folders or files to scan")
    p.add_argument("--config", default=str(HOME / "cinelake.ini"), help="configuration file")
    p.add_argument("--output", default="", help="workbook to write")
    p.add_argument("--cache", default=str(HOME / ".cinelake"), help="folder of the records kept from earlier scans")
    p.add_argument("--ffprobe", default="", help="the ffprobe program")
    p.add_argument("--hash", choices=HASH_MODES, default="", help="which files are hashed")
    p.add_argument("--refresh", action="store_true", help="probe all files, whatever is kept")
    p.add_argument("--tmdb", action="store_true", help="look films up in the catalogue")
    p.add_argument("--no-tmdb", action="store_true", help="don't, whatever the configuration says")
    return p


def settings(argv: list[str] | None = None, environ: dict[str, str] | None = None) -> tuple[Settings, bool]:
    """The settings, and whether the catalogue is wanted but has no credentials. The command line comes before the file, the
    environment's credentials before the file's; --no-tmdb comes first of all."""
    a, env = arguments().parse_args(argv), os.environ if environ is None else environ
    ini = read_ini(a.config)
    own, tmdb = ini["scanner"], ini["tmdb"]
    roots = a.roots or [r for line in own["roots"].splitlines() if (r := line.strip().strip('"'))]
    wanted = (a.tmdb or tmdb["enabled"].strip().lower() in ("1", "true", "yes", "on")) and not a.no_tmdb
    catalogue = Catalogue(
        token=(env.get("TMDB_ACCESS_TOKEN") or tmdb["access_token"]).strip(), key=(env.get("TMDB_API_KEY") or tmdb["api_key"]).strip(),
        language=tmdb["language"] or TMDB["language"], timeout=number(tmdb["timeout"], 20),
    )
    output = a.output or expanded(own["output"]) or str(HOME / f"Media_Inventory_{date.today():%Y-%m-%d}.xlsx")
    return Settings(
        roots=tuple(expanded(r) for r in roots),
        output=output,
        cache=expanded(a.cache),
        ffprobe=a.ffprobe or own["ffprobe"],
        hash_mode=a.hash or own["hash_mode"] or HASH_MODES[0],
        refresh=a.refresh,
        catalogue=catalogue if wanted and catalogue.configured else None,
        responses=expanded(tmdb["cache"]) or str(Path(expanded(a.cache)) / "responses"),
        response_days=int(number(tmdb["cache_ttl_days"], 30)),
        max_candidates=int(number(tmdb["max_candidates"], 3)),
        least_score=number(tmdb["auto_match_score"], 90),
        least_margin=number(tmdb["auto_match_margin"], 8),
    ), wanted and not catalogue.configured
