"""WARC: write pages into Zstandard archives (dictionary first, one frame per record) and read them back, validated."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinelake.llm.common import materialize, scratch_path, text_column, tree_merge

#: Fixed values of the formats: magic numbers, the dictionary's skippable frame, the revisit profile.
FRAME = 0xFD2FB528
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1\r\n"
#: An empty skippable frame. Spark's text writer puts it after each archive, where readers of Zstandard pass over it.
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def train_dictionary(pages: DataFrame, html: str = "html", rows: int = 400, most_bytes: int = 32_768) -> bytes:
    """A Zstandard dictionary from at most ``rows`` pages of at most ``most_bytes`` characters, picked by hash order.

    It only steers compression. Too few or too uniform pages give a raw dictionary of the record layout.
    """
    some = pages.select(F.col(html).alias("h")).filter(F.length("h").between(64, most_bytes))
    taken = [r.h.encode() for r in some.orderBy(F.xxhash64("h")).limit(rows).collect()]
    try:
        return zstandard.train_dictionary(16_384, taken).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return VERSION + b"WARC-Type: response\r\nWARC-Record-ID: <urn:page:>\r\nContent-Length: \r\nHTTP/1.1 200 OK\r\n<html><body><p>"


def _record(page, uri, payload: bytes, refers_to, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    archive_bytes: int = 4 << 20,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Writes one record per page into archives below ``path``, each about ``archive_bytes`` of compressed data.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest id becomes a response and the
    others revisit it (payloads are equal if SHA-256 and length are); all other pages are responses. Null html is an empty payload, a null url becomes ``about:blank``,
    a null id is written as ``null`` and is never a response that others revisit. Repeated rows get a record each; if
    they hold the largest id, each is a response. Columns beside the three are not read. No pages give no archive.

    Each task hands whole archives as rows to Spark's text writer, one file a row, so that its commit protocol makes
    retries safe on any file system; the line end is an empty skippable frame.
    """
    dictionary = train_dictionary(pages, html_col)
    source = pages.select(
        F.col(id_col).alias("__page"), F.col(url_col).cast("string").alias("__url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("__html")
    )
    thin = source.select("__page", F.unhex(F.sha2("__html", 256)).alias("__sha"), F.octet_length("__html").alias("__bytes"))
    thin = materialize(thin, "payloads")
    grouped = tree_merge(thin, ["__sha", "__bytes"], [F.col("__page").isNull(), -F.col("__page"), F.col("__page")], "__page")
    target = F.col("best.b2")
    revisit = (F.col("group_size") > 1) & (F.col("__bytes") >= min_bytes) & target.isNotNull() & ~target.eqNullSafe(F.col("__page"))
    refers = grouped.select(F.col("__page").alias("__p"), F.col("__sha").alias("__s"), target.alias("__refers")).where(revisit).dropDuplicates(["__p", "__s"])
    rows = source.join(refers, source["__page"].eqNullSafe(F.col("__p")) & (F.unhex(F.sha2("__html", 256)) == F.col("__s")), "left")
    rows = rows.select(F.col("__page").cast("string"), "__url", "__html", F.col("__refers").cast("string"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = zstandard.ZstdCompressionDict(dictionary)
        prepared.precompute_compress(level=3)
        packer = zstandard.ZstdCompressor(level=3, dict_data=prepared, write_checksum=True, write_content_size=True)
        lead = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary
        held, size = [lead], 0
        for batch in batches:
            texts = text_column(batch, "__html")
            for page, url, html, to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist(), strict=True):
                uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
                held.append(packer.compress(_record("null" if page is None else page, uri, html.as_buffer().to_pybytes(), to, date)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
                    held, size = [lead], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

    out = rows.mapInArrow(archives, "archive binary").select(F.col("archive").cast("string"))
    out.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, found by walking its block headers."""
    info = data[at + 4]
    single = info >> 5 & 1
    pos = at + 5 + (1 - single) + (0, 1, 2, 4)[info & 3] + ((1 if single else 0), 2, 4, 8)[info >> 6]
    while True:
        if pos + 3 > len(data):
            raise ValueError("a frame is cut off")
        block = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    pos += 4 * (info >> 2 & 1)
    if pos > len(data):
        raise ValueError("a frame is cut off")
    return pos


def records(data: bytes) -> Iterator[bytes]:
    """The decoded records of an archive: the dictionary of the leading skippable frame applies to every later frame."""
    view, pos, decoder = memoryview(data), 0, zstandard.ZstdDecompressor()
    while pos < len(view):
        if pos + 8 > len(view):
            raise ValueError("bytes after the last frame")
        magic, size = struct.unpack_from("<II", view, pos)
        if magic in SKIPPABLE:
            body = bytes(view[pos + 8 : pos + 8 + size])
            if len(body) != size:
                raise ValueError("a skippable frame is cut off")
            if magic == DICTIONARY_FRAME:
                if pos:
                    raise ValueError("the dictionary is not in the leading frame")
                if body[:4] == struct.pack("<I", FRAME):
                    body = zstandard.ZstdDecompressor().decompress(body)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            pos += 8 + size
        elif magic == FRAME:
            end = frame_end(view, pos)
            yield decoder.decompressobj().decompress(view[pos:end])
            pos = end
        else:
            raise ValueError(f"no frame starts at byte {pos}")


def _headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"not a header line: {line[:60]!r}")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8")
    return out


def parse_record(raw: bytes) -> dict:
    """Fields of one record; ValueError if its version, headers, lengths or digest don't hold."""
    if not raw.startswith(VERSION):
        raise ValueError("no WARC/1.1 version line")
    head, gap, rest = raw[len(VERSION) :].partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("the header has no end")
    fields = _headers(head)
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in fields:
            raise ValueError(f"no {need}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"content-length is {size}, the block has {len(rest) - 4} bytes")
    bare = lambda x: x.strip("<>").removeprefix("urn:page:") if x else None
    out = {"record_id": bare(fields["warc-record-id"]), "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"), "refers_to": bare(fields.get("warc-refers-to"))}
    out |= {"payload": None, "payload_bytes": None, "payload_digest": None, "error": None}
    if out["record_type"] in ("response", "revisit"):
        line, _, web = rest[:size].partition(b"\r\n")
        head, gap, payload = web.partition(b"\r\n\r\n")
        if not line.startswith(b"HTTP/") or not gap:
            raise ValueError("no HTTP header in the block")
        told = int(_headers(head).get("content-length", "-1"))
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if out["record_type"] == "response":
            if told != len(payload):
                raise ValueError(f"HTTP content-length is {told}, the payload has {len(payload)} bytes")
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError("the payload doesn't match its digest")
            out["payload"] = payload
        elif fields.get("warc-profile") != PROFILE or not out["refers_to"] or payload:
            raise ValueError("a revisit needs its profile, a target and no payload")
        out |= {"payload_bytes": told, "payload_digest": digest}
    return out


def read_warc(spark: SparkSession, path: str, strict: bool = True, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``path`` (see RECORD), decoded frame by frame.

    Every record is checked: version line, header lines, mandatory fields, both content lengths, the frame's checksum,
    and the digest of a response's payload. What fails the check stops the read; with ``strict`` off it gives a row with
    ``error`` set and the remaining fields null. A folder without archives gives no rows.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.name, {"payload": pa.binary(), "payload_bytes": pa.int64()}.get(f.name, pa.string())) for f in RECORD])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                try:
                    for raw in records(content.as_py()):
                        try:
                            row = parse_record(raw)
                        except (ValueError, UnicodeDecodeError) as e:
                            row = dict.fromkeys(schema.names) | {"error": str(e)}
                        if strict and row["error"]:
                            raise RuntimeError(f"invalid record: {row['error']}")
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row["payload"] or b"") + 200
                        if size > 1 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                except (ValueError, zstandard.ZstdError) as e:
                    if strict:
                        raise
                    rows.append(dict.fromkeys(schema.names) | {"error": str(e)})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written with ``write_warc`` and read back: page_id (null for null), payload_bytes, payload_digest,
    record_type, refers_to. Nulls, empty payloads, repeated rows and empty tables as stated there."""
    path = scratch_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_warc(pages, path)
    kind = dict(pages.dtypes)["page_id"]
    number = lambda c: F.col(c).try_cast(kind).alias("page_id" if c == "record_id" else c)
    return read_warc(spark, path, with_payload=False).select(number("record_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
  FROM pages
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p
"""
