"""The whole scan: listing, kept records, probes, hashes, films, the ten sheets."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinelake.config import Settings
from cinelake.operators import duplicates, films
from cinelake.operators.records import FIELDS, inventory_records
from cinelake.plans import reports
from cinelake.sources import cache, files
from cinelake.sources.catalogue import detailed, searched
from cinelake.sources.snapshots import compiled, written
from cinelake.sources.xlsx import write_workbook


def film_layer(records: DataFrame, own: Settings) -> dict[str, DataFrame]:
    """films, aliases, reviews and enrichment of records: local groups, and their matches if a catalogue is configured.

    A request that fails makes an ERROR of its group, with what was said; it is not cached.
    """
    groups = written(films.local_groups(records), "groups")
    if own.catalogue is None:
        matches, scored = films.not_run(groups), None
    else:
        found = written(searched(groups, own.catalogue, own.responses, own.response_days), "searches")
        ranked = written(films.rank_candidates(groups, found, own.max_candidates), "ranked")
        details = written(detailed(ranked, own.catalogue, own.responses, own.response_days), "details")
        failed = ranked.join(details.where("error <> ''"), "id").groupBy("local_id").agg(F.min("error").alias("failed"))
        found = found.join(failed, "local_id", "left").withColumn("error", F.coalesce(F.nullif("error", F.lit("")), "failed", F.lit(""))).drop("failed")
        scored = written(films.score_candidates(groups, ranked, details.where("error = ''").drop("error")), "scored")
        matches = written(films.decide(groups, found, scored, own.least_score, own.least_margin), "matches")
    out = films.film_records(groups, matches, records)
    out["enrichment"] = out["enrichment"].unionByName(films.skipped_enrichment(records))
    out["reviews"] = films.review_rows(groups, matches, scored if scored is not None else films.no_candidates(groups.sparkSession))
    return out


def record_schema(records: DataFrame) -> T.StructType:
    return T.StructType([records.schema[c] for c in FIELDS])


def scan(spark: SparkSession, own: Settings, program: str, say: Callable[[str], None] | None = None) -> dict[str, DataFrame]:
    """records, and the reports by name. Files whose size and time are those of a kept record that can be read are not probed
    again; failed probes are kept, too. Records are written back with their hashes. say: gets a line for each step."""
    say = say or (lambda text: None)
    listing = written(files.list_archive(spark, list(own.roots)), "listing")
    n = listing.count()
    say(f"Found {n} media files.")
    old = cache.read_snapshot(spark, own.cache)
    schema = record_schema(inventory_records(listing.limit(0).withColumns({"probe_json": F.lit(""), "error": F.lit("")})))
    readable = F.from_json("record_json", schema)["path"] == F.col("path")
    known, todo = cache.split_known(listing, old.limit(0) if own.refresh else old, readable)
    known, todo = written(known, "known"), written(todo, "todo")
    hits = known.count()
    probed = written(files.probed(todo, program), "probed")
    say(f"[{n}/{n}] scanned  (cache hits: {hits})")
    fresh = inventory_records(probed)
    again = known.select("ord", F.from_json("record_json", schema).alias("r")).select("ord", "r.*")
    with compiled(spark):
        records = written(fresh.unionByName(again), "records")
    say("Duplicate hashing...")
    hashed = duplicates.hash_cascade(records, lambda t: files.hashed(t, "quick"), lambda t: files.hashed(t, "full"), own.hash_mode)
    said = F.concat_ws(" | ", F.nullif("error", F.lit("")), F.nullif("hash_error", F.lit("")))
    records = written(hashed.withColumn("error", said).select("ord", *FIELDS), "hashed")
    states = records.join(listing.select("ord", "mtime_ns"), "ord").select("path", "size_bytes", "mtime_ns", F.to_json(F.struct(*FIELDS)).alias("record_json"))
    cache.write_snapshot(cache.merged_snapshot(states.dropDuplicates(["path"]), old), own.cache)
    return {"records": records, "known": known, **reports_of(records, film_layer(records, own))}


def reports_of(records: DataFrame, layer: dict[str, DataFrame], generated: str | None = None) -> dict[str, DataFrame]:
    """The ten sheets by name, in order. What several sheets read is written once; the summary counts rows without making them."""
    layer = {k: written(v, k) for k, v in layer.items()}
    sheets = {
        "Inventory": reports.inventory(records, layer["enrichment"]),
        "Metadata Review": reports.metadata_review(records),
        "Rename Candidates": reports.rename_candidates(records),
        "Exact Duplicates": duplicates.exact_duplicates(records),
        "Possible Same Film": duplicates.same_film_report(records),
        "Multi-Version Summary": duplicates.best_versions(records),
        "Film Records": layer["films"],
        "Title Aliases": layer["aliases"],
        "TMDb Review": layer["reviews"],
    }
    return sheets | {"Summary": summary_of(records, layer, generated)}


def summary_of(records: DataFrame, layer: dict[str, DataFrame], generated: str | None = None) -> DataFrame:
    """The summary sheet of records and their film layer: counts only, nothing is numbered, listed or written."""
    counted = {
        "Film Records": layer["films"], "Title Aliases": layer["aliases"], "TMDb Review": layer["reviews"], "Exact Duplicates": duplicates.exact_duplicates(records, number=False),
        "Possible Same Film": duplicates.same_film_report(records, number=False), "Multi-Version Summary": duplicates.best_versions(records),
    }
    generated = generated or datetime.now().isoformat(sep=" ", timespec="seconds")
    return reports.summary(records, layer["enrichment"], {label: counted[name] for label, name in reports.SIZES.items()}, generated)


def write_reports(found: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Writes the workbook, each sheet in its order, and returns the summary's metrics."""
    records = found["records"]
    ordered = {k: found[k] for k in reports.SHEETS}
    place = records.select(F.col("path").alias("_path"), "ord").groupBy("_path").agg(F.min("ord").alias("_ord"))
    for name in ("Inventory", "Metadata Review", "Rename Candidates"):
        ordered[name] = ordered[name].join(place, F.col("Path") == F.col("_path")).orderBy("_ord").drop("_path", "_ord")
    by = {
        "Exact Duplicates": ["Duplicate Group", "Path"], "Possible Same Film": ["Possible Group", "Path"], "Multi-Version Summary": ["Normalized Title"], "Film Records": ["Film Record ID"],
        "Title Aliases": ["Film Record ID", "Status", "Alias"], "TMDb Review": ["Local Group ID", "Candidate Rank"],
    }
    for name, keys in by.items():
        ordered[name] = ordered[name].orderBy(*keys)
    summary = ordered["Summary"].collect()  # 22 rows
    write_workbook(path, ordered, reports.WIDTHS, {"Inventory": 3})
    return {r.metric: r.value for r in summary}
