"""Drifted schema rewrite: rows ranked and dealt to files by custom partitioners, files rewritten by field ids into one schema."""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import materialize, shuffle_width
from cinelake.sources.snapshots import shared_folder

#: Rows that a writer holds before they become a row group.
GROUP = 1 << 16
_ID = b"PARQUET:field_id"
#: Rows without an id come after all others, whose crc32 is below this.
_LAST = 1 << 32

#: The evolved schema of clients, with field ids 1 to 10 in this order, and what stands for a missing column.
CLIENTS = [
    ("client_id", pa.int64()), ("master_id", pa.int64()), ("source", pa.string()), ("updated_at", pa.timestamp("us")), ("name", pa.string()),
    ("email", pa.string()), ("city", pa.string()), ("nation_id", pa.int64()), ("segment", pa.string()), ("balance", pa.float64()),
]
MISSING = {"nation_id": -1, "city": "none"}


def with_ids(fields: list[tuple[str, pa.DataType, int]]) -> pa.Schema:
    """A schema of nullable fields (name, type, Parquet field id)."""
    return pa.schema([pa.field(n, t, True, {_ID: str(i)}) for n, t, i in fields])


EVOLVED = with_ids([(n, t, k + 1) for k, (n, t) in enumerate(CLIENTS)])


def field_id(f: pa.Field) -> int:
    return int(f.metadata[_ID])


def drifted(version: int, schema: pa.Schema = EVOLVED) -> pa.Schema:
    """The schema of a starting file: what the version's bits make of the evolved one. Field ids stay with their values."""
    fields = [(f.name, f.type, field_id(f)) for f in schema]
    if version & 8:
        fields = [(n, {"balance": pa.float32(), "nation_id": pa.int32()}.get(n, t), i) for n, t, i in fields]
    if version & 1:
        fields = [({"name": "email", "email": "name"}.get(n, n), t, i) for n, t, i in fields]
    if version & 4:
        fields = [x for x in fields if x[0] not in ("nation_id", "city")]
    if version & 2:
        fields = fields[:1] + fields[:0:-1]
    return with_ids(fields)


def version_of(file_no: int) -> int:
    v = zlib.crc32(f"7:{file_no}".encode()) % 24
    return v if v <= 15 else 0


def store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path in it of a path with or without a scheme."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))


class _Parquet:
    """A file written row group by row group beside its place, which it takes when it is whole. A task that is run again, or
    runs twice, puts the same file there."""

    def __init__(self, folder: str, name: str, schema: pa.Schema):
        self.fs, root = store(folder)
        self.beside, self.target = f"{root}/attempts/{uuid.uuid4().hex}", f"{root}/files/{name}"
        self.fs.create_dir(f"{root}/attempts", recursive=True)
        self.writer = pq.ParquetWriter(self.beside, schema, filesystem=self.fs)

    def close(self) -> None:
        self.writer.close()
        if not isinstance(self.fs, pyarrow.fs.LocalFileSystem) and self.fs.get_file_info(self.target).type != pyarrow.fs.FileType.NotFound:
            self.fs.delete_file(self.target)  # local moves replace it in one step
        self.fs.move(self.beside, self.target)


def _cuts(keys: DataFrame, total: int, width: int) -> list[tuple[int, int, int, int]]:
    """Where ranges of the sort key (crc, id, hash, salt) begin: equal ranges of crc32, which spreads ids evenly, and further
    cuts inside an id, or inside equal rows, with more rows than half a range should have. There are at most 2 * width of those."""
    cuts = [((k << 32) // width, -(1 << 63), -(1 << 63), -(1 << 63)) for k in range(1, width)]
    most = max(64, total // (2 * width))
    counts = keys.groupBy("crc", "id", "hash").agg(F.count(F.lit(1)).alias("n"))
    steps = lambda n: [-(1 << 63) + (j << 64) // -(-n // most) for j in range(-(-n // most) + 1)]
    for r in counts.groupBy("crc", "id").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect():
        cuts += [(r.crc, r.id, h, -(1 << 63)) for h in steps(r.n)]
    for r in counts.where(F.col("n") > most).collect():
        cuts += [(r.crc, r.id, r.hash, s) for s in steps(r.n)]
    return sorted(set(cuts))


@dataclass(frozen=True)
class Ranked:
    """rows: ((file_no, rank), values), sorted, whole files in each partition; files: their number; tasks: of the partitions."""

    rows: RDD
    files: int
    tasks: int


def rank_into_files(df: DataFrame, id_col: str, columns: list[str], files: int = 1000) -> Ranked:
    """Rows of the columns in the order of the unsigned crc32 of the decimal id, then the id; row r of N is in file
    r // (1 + N // files).

    Rows with equal ids come in the order of a hash of all their columns; a null id comes last. A custom partitioner deals rows
    to ranges of that order, cut further where one id or one repeated row is frequent, and sorts each range in the shuffle; a
    row's rank is its place there plus the ranges before, of which the driver gets one count each. A second one deals rows by
    file number, sorted by (file_no, rank): a file is written by one task, in order.
    """
    spark, width = df.sparkSession, shuffle_width(df.sparkSession)
    own = F.col(id_col).cast("long")
    crc = F.coalesce(F.crc32(own.cast("string").cast("binary")), F.lit(_LAST))
    rows = df.select(crc.alias("crc"), F.coalesce(own, F.lit(0).cast("long")).alias("id"), F.xxhash64(*columns).alias("hash"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), *columns)
    total = df.count()
    cuts = _cuts(rows, total, width) if total else []
    keyed = rows.rdd.map(lambda r: (tuple(r[:4]), tuple(r[4:])))
    ranges = keyed.repartitionAndSortWithinPartitions(len(cuts) + 1, lambda key: bisect_right(cuts, key))
    counts = dict(ranges.mapPartitionsWithIndex(lambda i, part: [(i, sum(1 for _ in part))]).collect())
    before, so_far = {}, 0
    for i in sorted(counts):
        before[i], so_far = so_far, so_far + counts[i]
    each = 1 + so_far // files
    n = -(-so_far // each)
    tasks = max(1, min(n, max(width, 64)))

    def placed(i: int, part: Iterator) -> Iterator:
        for k, (_, values) in enumerate(part):
            yield ((before[i] + k) // each, before[i] + k), values

    dealt = ranges.mapPartitionsWithIndex(placed).repartitionAndSortWithinPartitions(tasks, lambda key: key[0] * tasks // n)
    return Ranked(dealt, n, tasks)


def _file_name(file_no: int) -> str:
    return f"file-{file_no:05d}.parquet"


def write_starting_files(ranked: Ranked, folder: str, schema: pa.Schema) -> RDD:
    """Writes a file for each file_no in the version's drifted schema: (file_no, version, n_rows, columns)."""
    place = {field_id(f): k for k, f in enumerate(schema)}

    def put(writer: pq.ParquetWriter, kind: pa.Schema, rows: list[tuple]) -> None:
        if rows:
            values = list(zip(*rows, strict=True))
            columns = [pa.array(values[k], schema.field(k).type).cast(f.type, safe=False) for f in kind for k in (place[field_id(f)],)]
            writer.write_table(pa.Table.from_arrays(columns, schema=kind))

    def each(part: Iterator) -> Iterator:
        out, held, no, n = None, [], -1, 0
        for (file_no, _), values in part:
            if file_no != no:
                if out:
                    put(out.writer, kind, held)
                    out.close()
                    yield no, version_of(no), n, ",".join(kind.names)
                no, n, held, kind = file_no, 0, [], drifted(version_of(file_no), schema)
                out = _Parquet(folder, _file_name(no), kind)
            held.append(values)
            n += 1
            if len(held) == GROUP:
                put(out.writer, kind, held)
                held = []
        if out:
            put(out.writer, kind, held)
            out.close()
            yield no, version_of(no), n, ",".join(kind.names)

    return ranked.rows.mapPartitions(each)


def _open(fs: pyarrow.fs.FileSystem, path: str) -> pq.ParquetFile:
    return pq.ParquetFile(path, filesystem=fs)


def evolve_file(folder: str, name: str, to: str, schema: pa.Schema, missing: dict) -> None:
    """Writes files/to from files/name: columns are found by field id, cast to the schema's types and put in its order; one
    that isn't there gets its value of ``missing`` in each row, or null without one. Rows keep their order, nulls stay."""
    fs, root = store(folder)
    with _open(fs, f"{root}/files/{name}") as source:
        at = {field_id(f): f.name for f in source.schema_arrow}
        out = _Parquet(folder, to, schema)
        for batch in source.iter_batches(GROUP):
            columns = []
            for f in schema:
                if own := at.get(field_id(f)):
                    columns.append(batch.column(own).cast(f.type))
                else:
                    columns.append(pa.array([missing.get(f.name)] * batch.num_rows, f.type))
            out.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
        out.close()


def _shown(value) -> str:
    """A field of a row's text: null as ?, a double as the floor of 2^20 times it (nan, inf and -inf as such)."""
    if value is None:
        return "?"
    if isinstance(value, float):
        return str(math.floor(1048576 * value)) if math.isfinite(value) else str(value)
    return str(value)


def describe_file(fs: pyarrow.fs.FileSystem, path: str) -> tuple[int, int, str, str, str]:
    """Rows, nulls, SHA-256 of the first column's values and of the rows, and the columns of a file, read as a stream."""
    ids, rows, n, nulls = hashlib.sha256(), hashlib.sha256(), 0, 0
    with _open(fs, path) as source:
        names = source.schema_arrow.names
        for batch in source.iter_batches(GROUP):
            nulls += sum(c.null_count for c in batch.columns)
            columns = [(c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c).to_pylist() for c in batch.columns]
            lines = ["|".join(map(_shown, row)) for row in zip(*columns, strict=True)]
            if lines:
                ids.update((("," if n else "") + ",".join(map(_shown, columns[0]))).encode())
                rows.update((("\n" if n else "") + "\n".join(lines)).encode())
            n += batch.num_rows
    return n, nulls, ids.hexdigest(), rows.hexdigest(), ",".join(names)


def rewrite_drifted(starts: DataFrame, folder: str, files: int, tasks: int, schema: pa.Schema = EVOLVED, missing: dict | None = None) -> DataFrame:
    """Turns the starting files of a folder into files of one schema, and says of each final file: file_no, version, n_rows,
    n_nulls, ids_sha256, rows_sha256, start_columns, columns, path, rewritten.

    starts: file_no, version, columns. Files are dealt by number, a file is rewritten by one task, as a stream. A rewritten
    file stands beside its starting file first; only when all are there do the starting files go, so that a task that is run
    again finds what it needs, and the folder then holds one file of each number. Version 0 is not touched.
    """
    spark, missing = starts.sparkSession, MISSING if missing is None else missing
    final = lambda r: _file_name(r.file_no) if r.version == 0 else "evolved-" + _file_name(r.file_no)

    def dealt(df: DataFrame) -> RDD:
        return df.rdd.map(lambda r: ((r.file_no, 0), r)).repartitionAndSortWithinPartitions(tasks, lambda key: key[0] * tasks // files).values()

    def evolve(part: Iterator) -> Iterator:
        for r in part:
            if r.version:
                evolve_file(folder, _file_name(r.file_no), final(r), schema, missing)
            yield r.file_no, r.version, r.columns

    def finish(part: Iterator) -> Iterator:
        fs, root = store(folder)
        for r in part:
            start = f"{root}/files/{_file_name(r.file_no)}"
            if r.version and fs.get_file_info(start).type != pyarrow.fs.FileType.NotFound:
                fs.delete_file(start)
            n, nulls, ids, rows, columns = describe_file(fs, f"{root}/files/{final(r)}")
            yield r.file_no, r.version, n, nulls, ids, rows, r.columns, columns, f"{folder}/files/{final(r)}", r.version != 0

    done = materialize(spark.createDataFrame(dealt(starts).mapPartitions(evolve), "file_no long, version long, columns string"), "rewritten")
    schema = "file_no long, version long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string, path string, rewritten boolean"
    return materialize(spark.createDataFrame(dealt(done).mapPartitions(finish), schema), "final")


def op11_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clients, sorted and dealt to files of drifted schemas in a new folder under spark.checkpoint.dir, and what
    ``rewrite_drifted`` made of them. The folder stays.

    Repeated rows and ids stay, ordered by a hash of the row; a null id comes last (``?`` in the digests), nulls of other columns
    stay nulls. Other columns are not read. An empty table gives no files and no rows. Tasks write through pyarrow's file
    systems (local, hdfs, s3, gs, abfs).
    """
    clients = spark.read.parquet(f"{sf_dir}/clients.parquet")
    if dict(clients.dtypes)["updated_at"] == "timestamp":
        micros = F.unix_micros("updated_at")
    else:
        micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', updated_at)")
    names = [n for n, _ in CLIENTS]
    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    rows = clients.select(*[(micros if n == "updated_at" else F.col(n).cast(kinds[t])).alias(n) for n, t in CLIENTS])
    folder = f"{shared_folder(spark)}/op11-drift-{uuid.uuid4().hex}"
    fs, root = store(folder)
    fs.create_dir(f"{root}/files", recursive=True)
    ranked = rank_into_files(rows, "client_id", names)
    starts = spark.createDataFrame(write_starting_files(ranked, folder, EVOLVED), "file_no long, version long, n_rows long, columns string")
    out = rewrite_drifted(materialize(starts, "starts"), folder, ranked.files, ranked.tasks)
    fs.delete_dir(f"{root}/attempts") if ranked.files else None  # what tasks that were lost have left
    return out
