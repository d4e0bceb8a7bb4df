"""Files of an archive: the listing as a data source, hashes from byte ranges, and probe documents."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import shutil
import subprocess
import zlib
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cinelake.functions.text import casefold
from cinelake.functions.tokens import EXTENSIONS, SKIPPED_FOLDERS
from cinelake.operators.order import numbered
from cinelake.sources.snapshots import written

SCHEMA = "path string, root string, filename string, extension string, size_bytes long, mtime_ns long"
CHUNK, BLOCK = 4 << 20, 8 << 20
#: Files of one folder that a task of the listing looks at, and what opening a file costs, as bytes.
FLAT, OPEN = 10_000, 1 << 20
#: The folder that holds this package.
HOME = Path(__file__).resolve().parents[2]


class ArchiveListing(DataSource):
    """``spark.read.format("archive_listing").option("roots", "/a\\n/b").load()``: a row per video file.

    A root that is a file counts if its suffix does; a missing root is passed over. Folders whose name starts with a dot
    and the system's own are skipped; files that start with a dot are not; folders that can't be read have no files, and a file
    that goes meanwhile has no row. Roots that overlap list a file twice.

    Folders are opened level by level until there are ``tasks`` (64) of them to hand out, so that one deep folder is many tasks,
    too; the planner opens at most 16 times as many. Files of the folders it has opened are dealt out by a hash of their names,
    at most ``FLAT`` of them a task.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("roots", "").splitlines(), int(self.options.get("tasks", 64)))


class _Part(InputPartition):
    """Of each folder: its root, and which share of its own files (i of n), or (0 of 0) all files below it."""

    def __init__(self, folders: list[tuple[str, str, int, int]]):
        self.folders = folders


def _wanted(folder: str) -> bool:
    return folder not in SKIPPED_FOLDERS and not folder.startswith(".")


def _entries(folder: str) -> tuple[list[str], int]:
    """The folders in a folder that are listed, and how many files it has."""
    folders, files = [], 0
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    folders += [e.path] if _wanted(e.name) else []
                else:
                    files += 1
    except OSError:
        pass
    return sorted(folders), files


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], tasks: int):
        self.roots, self.tasks = [r.strip() for r in roots if r.strip()], tasks

    def partitions(self) -> list[_Part]:
        parts, frontier, opened = [], deque(), []
        for root in self.roots:
            if os.path.isfile(root):
                parts.append(_Part([(os.path.dirname(root), root, 0, 1)]))
            elif os.path.isdir(root):
                frontier.append((root, root))
        for _ in range(16 * self.tasks):
            if not frontier or len(frontier) + len(parts) >= self.tasks:
                break
            root, folder = frontier.popleft()
            folders, files = _entries(folder)
            frontier.extend((root, f) for f in folders)
            shares = -(-files // FLAT)
            if shares == 1:
                opened.append((root, folder, 0, 1, files))
            else:
                parts += [_Part([(root, folder, i, shares)]) for i in range(shares)]
        held = 0
        for root, folder, i, n, files in opened:  # small ones together
            if not held or held + files > FLAT:
                parts.append(_Part([]))
                held = 0
            parts[-1].folders.append((root, folder, i, n))
            held += files
        parts += [_Part([(root, folder, 0, 0)]) for root, folder in frontier]
        return parts or [_Part([])]

    def read(self, part: _Part) -> Iterator[tuple]:
        for root, start, i, n in part.folders:
            if os.path.isfile(start):
                found = iter([start])
            elif n == 0:
                found = _below(start)
            else:
                found = (p for p in _files(start) if n == 1 or zlib.crc32(os.fsencode(p)) % n == i)
            for path in found:
                if os.path.splitext(path)[1].lower() in EXTENSIONS or Path(path).suffix.lower() in EXTENSIONS:
                    try:
                        real = Path(path).resolve()
                        stat = real.stat()
                    except (OSError, RuntimeError):
                        continue
                    yield (str(real), root, real.name, real.suffix.lower(), stat.st_size, stat.st_mtime_ns)


def _files(folder: str) -> Iterator[str]:
    try:
        with os.scandir(folder) as entries:
            yield from (e.path for e in entries if e.is_file())
    except OSError:
        return


def _below(start: str) -> Iterator[str]:
    for folder, folders, names in os.walk(start):
        folders[:] = [f for f in folders if _wanted(f)]
        yield from (os.path.join(folder, n) for n in names)


def list_archive(spark, roots: list[str]) -> DataFrame:
    """The listing with ``ord``, its place in the order of the case-folded paths, from 1."""
    spark.dataSource.register(ArchiveListing)
    df = spark.read.format("archive_listing").option("roots", "\n".join(roots)).load()
    return numbered(df.withColumn("_fold", casefold("path")), ["_fold", "path"], "ord").drop("_fold")


def quick_hash(path: str, chunk: int = CHUNK) -> str:
    """SHA-256 of the first chunk, the last one if the file is longer, and the size as text."""
    size, h = os.path.getsize(path), hashlib.sha256()
    with open(path, "rb") as f:
        h.update(f.read(chunk))
        if size > chunk:
            f.seek(size - chunk)
            h.update(f.read(chunk))
    h.update(str(size).encode())
    return h.hexdigest()


def full_hash(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(BLOCK):
            h.update(block)
    return h.hexdigest()


def split_by_cost(files: DataFrame, cost: Column, tasks: int | None = None) -> DataFrame:
    """The rows dealt to ``tasks`` partitions (four for each core if not given, one for each row at most) of about equal cost,
    longest first: what costs over an eighth of a partition's share goes to the partition with the least so far, and the rest
    by a hash to the room that is left. The driver gets the former, at most eight for each partition.

    files is read more than once, so it should be a table or a scan. Adaptive execution leaves the partitions as they are.
    """
    spark = files.sparkSession
    rows = files.withColumn("_cost", cost.cast("double"))
    n, total = rows.agg(F.count(F.lit(1)), F.sum("_cost")).first()
    tasks = max(1, min(n, tasks or 4 * spark.sparkContext.defaultParallelism))
    share = (total or 0.0) / tasks
    large = rows.where(F.col("_cost") > share / 8).select("path", "_cost").orderBy(F.desc("_cost"), "path").collect()
    loads = [(0.0, k) for k in range(tasks)]
    placed = []
    for r in large:
        load, k = heapq.heappop(loads)
        heapq.heappush(loads, (load + r["_cost"], k))
        placed.append((r.path, k))
    room = [(k, max(0.0, share - load)) for load, k in sorted(loads, key=lambda x: x[1])]
    free = sum(x for _, x in room) or 1.0
    ends, so_far = [], 0.0
    for _, x in room:
        so_far += x / free
        ends.append(so_far)
    at = F.pmod(F.xxhash64("path"), F.lit(1 << 30)) / float(1 << 30)
    by_hash = F.least(F.size(F.filter(F.array(*[F.lit(e) for e in ends[:-1]]).cast("array<double>"), lambda e: e <= at)), F.lit(tasks - 1))
    placed = spark.createDataFrame(placed, "_path string, _task int")
    rows = rows.join(F.broadcast(placed), F.col("path").eqNullSafe(F.col("_path")), "left")  # eight for each partition at most
    return rows.withColumn("_task", F.coalesce("_task", by_hash)).repartitionById(tasks, F.col("_task")).select(*files.columns)


def hashed(files: DataFrame, kind: str, tasks: int | None = None) -> DataFrame:
    """path, value, failure for rows of (path, size_bytes); kind is "quick" or "full". Bytes are read in blocks, never whole
    files, and tasks have about the same number of bytes to read."""
    run, said = {"quick": (quick_hash, "quick hash"), "full": (full_hash, "sha256")}[kind]
    size = F.coalesce("size_bytes", F.lit(0))
    cost = OPEN + (F.least(size, F.lit(2 * CHUNK)) if kind == "quick" else size)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    rows.append((path, run(path), ""))
                except (OSError, ValueError) as e:
                    rows.append((path, "", f"{said}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "value", "failure"])

    return split_by_cost(written(files, f"to-{kind}"), cost, tasks).select("path").mapInPandas(each, "path string, value string, failure string")


def find_ffprobe(explicit: str = "") -> str:
    """The given program, or the one in the folder of this package, or the one on the path."""
    if explicit and os.path.isfile(explicit):
        return explicit
    for beside in (HOME / "ffprobe.exe", HOME / "ffprobe"):
        if beside.is_file():
            return str(beside)
    if found := shutil.which("ffprobe"):
        return found
    raise FileNotFoundError("ffprobe was not found")


def probed(files: DataFrame, ffprobe: str, tasks: int | None = None) -> DataFrame:
    """Adds probe_json and error: the document of each file's path, or what the program said when it failed, or why it could
    not be started. files is a table; its rows are dealt evenly to tasks."""
    names = files.columns
    files = split_by_cost(files, F.lit(1), tasks)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs, errors = [], []
            for path in batch["path"]:
                doc, error = None, ""
                try:
                    done = subprocess.run([ffprobe, "-v", "error", "-show_format", "-show_streams", "-print_format", "json", path], capture_output=True, text=True, encoding="utf-8", errors="replace", check=False)
                    if done.returncode:
                        error = done.stderr.strip() or f"ffprobe return code {done.returncode}"
                    else:
                        json.loads(doc := done.stdout)
                except (OSError, ValueError) as e:
                    doc, error = None, str(e)
                docs.append(doc)
                errors.append(error)
            yield batch.assign(probe_json=docs, error=errors)[[*names, "probe_json", "error"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", probe_json string, error string"
    return files.mapInPandas(each, schema)
