"""Snapshots of what is expensive to get: technical records by file state, and catalogue responses with an age limit."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from datetime import datetime

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.sources.snapshots import file_system, written

#: Version of the records' schema; a snapshot of another version is not read.
VERSION = 9


def split_known(listing: DataFrame, snapshot: DataFrame, readable: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Listed files with their cached record (path, size and time all equal), and the files that need a probe. readable: which
    rows of the snapshot hold a record that can be read; others are as good as none."""
    known = snapshot.where(F.col("record_json").isNotNull() & (F.lit(True) if readable is None else F.coalesce(readable, F.lit(False)))).select("path", "size_bytes", "mtime_ns", "record_json").dropDuplicates(["path", "size_bytes", "mtime_ns"])
    met = listing.join(known, ["path", "size_bytes", "mtime_ns"], "left")
    return met.where("record_json IS NOT NULL"), met.where("record_json IS NULL").drop("record_json")


def merged_snapshot(fresh: DataFrame, old: DataFrame) -> DataFrame:
    """The next snapshot: fresh rows replace old ones of the same path; paths that are gone stay."""
    return fresh.unionByName(old.join(fresh.select("path").distinct(), "path", "left_anti"))


def snapshot_path(root: str, version: int = VERSION) -> str:
    return f"{root.rstrip('/')}/records-v{version}"


SNAPSHOT = "path string, size_bytes long, mtime_ns long, record_json string"
RESPONSES = "cache_key string, fetched_at timestamp, response_json string"


def read_table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The Parquet table in a folder; without one, no rows. Files that are still being written start with a dot."""
    path, system = file_system(spark, folder)
    return spark.read.schema(schema).parquet(folder) if system.exists(path) else spark.createDataFrame([], schema)


#: Stands in a snapshot's folder once all of it is there.
COMPLETE = "_COMPLETE"


def versions(spark: SparkSession, root: str, version: int = VERSION) -> list[str]:
    """The names of the complete snapshots of a schema's version, oldest first."""
    path, system = file_system(spark, snapshot_path(root, version))
    if not system.exists(path):
        return []
    folders = sorted(x.getPath().getName() for x in system.listStatus(path) if x.isDirectory() and x.getPath().getName().startswith("snapshot-"))
    return [f for f in folders if system.exists(file_system(spark, f"{snapshot_path(root, version)}/{f}/{COMPLETE}")[0])]


def read_snapshot(spark: SparkSession, root: str, version: int = VERSION) -> DataFrame:
    """The newest complete snapshot of this version of the schema; without one, no rows."""
    found = versions(spark, root, version)
    if found:
        return spark.read.schema(SNAPSHOT).parquet(f"{snapshot_path(root, version)}/{found[-1]}")
    return spark.createDataFrame([], SNAPSHOT)


def write_snapshot(df: DataFrame, root: str, version: int = VERSION, keep: int = 2) -> None:
    """Adds a snapshot, which readers follow from the moment that its marker stands in its folder: until then, and if the
    driver stops before, they have the one before. df may read that one. Of the older ones ``keep`` - 1 stay, for readers that
    have opened them; the rest, and what was never completed, goes."""
    spark, home = df.sparkSession, snapshot_path(root, version)
    known = versions(spark, root, version)
    number = 1 + max([int(f.split("-")[1]) for f in known], default=0)
    name = f"snapshot-{number:010d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{home}/{name}")
    mark(spark, f"{home}/{name}/{COMPLETE}")
    path, system = file_system(spark, home)
    stay = [*known, name][-keep:]
    for x in system.listStatus(path):
        if x.getPath().getName().startswith("snapshot-") and x.getPath().getName() not in stay:
            system.delete(x.getPath(), True)


def mark(spark: SparkSession, path: str) -> None:
    """Makes an empty file, in one step."""
    own, system = file_system(spark, path)
    system.create(own, True).close()


def fresh_responses(cache: DataFrame, now, days: int = 30) -> DataFrame:
    """The latest response of each key that is at most ``days`` old (one day at least) at ``now`` (column)."""
    young = cache.where(F.col("fetched_at") >= now - F.make_dt_interval(F.lit(max(days, 1))))
    latest = F.max(F.struct("fetched_at", "response_json")).alias("latest")
    return young.groupBy("cache_key").agg(latest).select("cache_key", "latest.*")


def store_answers(folder: str, rows: list[tuple[str, str, datetime]]) -> None:
    """Adds responses (key, JSON text, time) to the cache in a folder, as one file, which is there as a whole or not at all.
    Called from tasks, so that what has been answered stays if the job fails."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), os.path.abspath(folder.removeprefix("file:")))
    fs.create_dir(root, recursive=True)
    keys, texts, times = zip(*rows, strict=True)
    table = pa.table({"cache_key": pa.array(keys, pa.string()), "fetched_at": pa.array(times, pa.timestamp("us", "UTC")), "response_json": pa.array(texts, pa.string())})
    name = uuid.uuid4().hex
    pq.write_table(table, f"{root}/.{name}", filesystem=fs)
    fs.move(f"{root}/.{name}", f"{root}/answers-{name}.parquet")


def answered(requests: DataFrame, ask: Callable[[DataFrame], DataFrame], folder: str, days: int = 30) -> DataFrame:
    """cache_key, response, error for requests (cache_key and what ``ask`` needs): from the cache in the folder if it has
    young ones that can be read, else asked, once per key.

    ask: gets requests, returns cache_key, response, error, and stores what was answered in the folder as it goes.
    """
    spark = requests.sparkSession
    known = fresh_responses(read_table(spark, folder, RESPONSES), F.current_timestamp(), days).where(F.try_parse_json("response_json").isNotNull())
    met = written(requests.dropDuplicates(["cache_key"]).join(known, "cache_key", "left"), "requests")
    fresh = written(ask(met.where("response_json IS NULL").drop("fetched_at", "response_json")), "answers")
    return met.where("response_json IS NOT NULL").select("cache_key", F.col("response_json").alias("response"), F.lit("").alias("error")).unionByName(fresh)
