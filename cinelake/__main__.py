"""python -m cinelake ROOT...: scans media files and writes the workbook."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from cinelake.config import settings
from cinelake.plans.scan import scan, write_reports
from cinelake.sources.files import find_ffprobe


def main(argv: list[str] | None = None) -> int:
    own, unlocked = settings(argv)
    if not own.roots:
        print("No roots are given, neither on the command line nor in the configuration file.", file=sys.stderr)
        return 2
    program = find_ffprobe(own.ffprobe)
    print(f"ffprobe: {program}\nCache: {own.cache}\nOutput: {own.output}\nHash mode: {own.hash_mode}")
    if unlocked:
        print("WARNING: the catalogue is enabled but has no credentials.", file=sys.stderr)
    print("Catalogue: " + (f"language={own.catalogue.language}, cache={own.responses}" if own.catalogue else "off; local film records are made"))
    spark = SparkSession.builder.appName("cinelake").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()  # plans sooner
    found = scan(spark, own, program, print)
    counts = write_reports(found, own.output)
    print("DONE")
    for label, n in counts.items():
        print(f"{label}: {n}")
    print(f"Workbook: {own.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
