"""Tables written once and read by several reports, in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OPENED: dict[str, tuple] = {}
_KEPT: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on one machine, or one below a cluster's warehouse."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return "file://" + os.path.join(tempfile.gettempdir(), "cinelake-snapshots")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_snapshots"


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path and file system of a path."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for this application; all of them are deleted when the driver ends, also after spark.stop()."""
    home = f"{shared_folder(spark)}/cinelake-tables-{spark.sparkContext.applicationId}"
    if home not in _OPENED:
        _OPENED[home] = file_system(spark, home)
        atexit.register(drop, home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def drop(home: str) -> None:
    """Deletes an application's tables; Hadoop's file system outlives the Spark context."""
    if home in _OPENED:
        path, system = _OPENED.pop(home)
        try:
            system.delete(path, True)
        except Exception as e:  # the driver's JVM is gone already
            print(f"{home} is left: {e}")


def folder_state(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of all files below a folder: it changes when a table in it does."""
    path, system = file_system(spark, folder)
    found, out = system.listFiles(path, True), []
    while found.hasNext():
        x = found.next()
        out.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return repr(sorted(out))


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """While this lasts, what Spark would generate as methods that HotSpot refuses to compile (8,000 bytes and more) runs as
    single expressions instead. The many steps of a record make such methods, and interpreted ones are slow."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 8_000)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(spark: SparkSession, key: str, make) -> DataFrame:
    """The table of ``make()``, written once per session and key, and read by every report that asks for it."""
    own = (spark.sparkContext.applicationId, key)
    if own not in _KEPT:
        path = new_path(spark, "kept")
        with compiled(spark):
            make().write.parquet(path)
        _KEPT[own] = path
    return spark.read.parquet(_KEPT[own])


def written(df: DataFrame, name: str) -> DataFrame:
    """df from a Parquet table of its own. Probing is costly and reports read records many times; the table also keeps the
    optimizer from pushing a report's filter through every step that made the columns."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
