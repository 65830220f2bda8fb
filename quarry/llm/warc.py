"""WARC archives in Zstandard frames with a dictionary: writer and reader."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import shared_path, small_batches, staged

#: Fixed values of the formats: magic numbers and the record's version line.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes given to a decoder at once.
SLICE = 1 << 14

RECORD = "archive string, position long, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary, error string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    body = payload if kind == "response" else b""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/octet-stream", f"Content-Length: {len(body)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, keep: str = "max", roll_bytes: int = 16 << 20, dictionary_bytes: int = 16384) -> DataFrame:
    """Writes one record per row into .warc.zst files under path; returns archive, records.

    The payload is the UTF-8 text, null counts as empty. Of rows with equal payloads of
    min_bytes bytes or more, that with the largest id (keep="min": smallest) is a
    response and the others are revisits of it; of rows that repeat this id one is the
    response. A null id is the smallest. Equal means equal SHA-1 and length.

    Payloads stay in the partitions they are read in if the rows that share a payload are
    few enough for Spark to broadcast (a staged table of ids and digests); else they are
    joined by id and digest, so a payload that many pages share is spread. A file ends past roll_bytes of payload; its dictionary is trained on its own
    first records and leads it in a skippable frame. A file is written under a name of
    its attempt and then renamed; a failed attempt leaves no archive. Only pyarrow's own
    file systems are written to (local, HDFS, S3, GCS).
    """
    small_batches(pages.sparkSession)
    key = [F.col("digest"), F.col("bytes")]
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.length("payload"))
    best = (F.max if keep == "max" else F.min)(F.struct(F.col("id").isNotNull().alias("known"), "id"))
    kept = rows.where(F.col("bytes") >= min_bytes).groupBy(*key).agg(best.alias("kept"), F.count("*").alias("n")).where("n > 1")
    # one row for each id and payload; few, as a rule, and then broadcast by Spark
    told = rows.groupBy("id", *key).agg(F.count("*").alias("rows")).join(kept, ["digest", "bytes"])
    told = staged(told.select(F.col("id").alias("id_"), F.col("digest").alias("digest_"), F.col("kept.id").alias("first"), "rows"), "revisits")
    all_ = rows.join(told, F.col("id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_")), "left")
    is_first = F.col("rows").isNull() | F.col("id").eqNullSafe(F.col("first"))
    again = F.coalesce(F.col("rows") > 1, F.lit(False)) & is_first
    turn = F.row_number().over(Window.partitionBy("id", "digest").orderBy("id", "digest"))
    all_ = all_.where(~again).withColumn("is_first", is_first).unionByName(all_.where(again).withColumn("is_first", turn == 1))
    ready = all_.select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("is_first").alias("response"), F.col("first").cast("string").alias("first"))
    return ready.mapInArrow(_written(path, roll_bytes, dictionary_bytes), "archive string, records long")


def _written(path: str, roll_bytes: int, dictionary_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        held, size, done = [], 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, response, first = (batch[c][i].as_py() for c in ("id", "url", "payload", "response", "first"))
                uri = re.sub(r"[\x00-\x20\x7f]", "", url or "")
                held.append(record_bytes("response" if response else "revisit", f"urn:page:{page}", uri, payload, digest_of(payload), f"urn:page:{first}"))
                size += len(held[-1])
                if size >= roll_bytes:
                    done.append(_write_file(store, root, held, dictionary_bytes))
                    held, size = [], 0
        if held:
            done.append(_write_file(store, root, held, dictionary_bytes))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["archive", "records"])

    return run


def _write_file(store, root: str, records: list[bytes], dictionary_bytes: int) -> tuple[str, int]:
    try:
        trained = zstandard.train_dictionary(dictionary_bytes, [r[:65536] for r in records[:400]])
    except zstandard.ZstdError:  # too few or too short to train on
        trained = None
    coder = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True)
    name = f"{uuid.uuid4().hex}.warc.zst"
    with store.open_output_stream(f"{root}/.{name}.tmp") as out:
        if trained:
            out.write(dictionary_frame(trained.as_bytes()))
        for record in records:
            out.write(coder.compress(record))
    store.move(f"{root}/.{name}.tmp", f"{root}/{name}")
    return name, len(records)


def read_archives(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """One row per record of the .warc.zst files under path (any store that Spark reads).

    names: a frame with a column archive; only files of these names are read (those of
    tasks that counted; a lost executor may have left others). Columns: see RECORD. error
    tells what is wrong with a record: then what could be read stands in the others. A
    file without a dictionary frame is read without one. A file must fit in a task's
    memory (2 GB at most); an empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    if names is not None:
        files = files.join(names.select("archive").distinct(), "archive", "left_semi")
    return files.mapInArrow(_read, RECORD)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            held, size = [], 0
            for record in records_of(batch["content"][i].as_buffer()):
                held.append({"archive": batch["archive"][i].as_py()} | record)
                size += len(record["payload"] or b"") + 1000
                if size > 4 << 20:
                    yield _records(held)
                    held, size = [], 0
            yield _records(held)


def _records(held: list[dict]) -> pa.RecordBatch:
    text, long = pa.string(), pa.int64()
    kinds = [("archive", text), ("position", long), ("record_type", text), ("record_id", text), ("refers_to", text), ("target_uri", text), ("payload_digest", text), ("payload_bytes", long), ("payload", pa.binary()), ("error", text)]
    return pa.RecordBatch.from_pylist(held, pa.schema(kinds))


def records_of(content) -> Iterator[dict]:
    """The records of one archive: its dictionary first, then one frame after another."""
    data, at = memoryview(content), 0
    dictionary = None
    while at + 8 <= len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_FRAME and not at:
                raw = bytes(data[8 : 8 + size])
                if raw[:4] == struct.pack("<I", ZSTD_FRAME):  # a dictionary may be packed itself
                    raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
                dictionary = zstandard.ZstdCompressionDict(raw)
            at += 8 + size
            continue
        if magic != ZSTD_FRAME:
            yield _record(at, None, "no frame here")
            return
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts, end = [], at
        try:
            while not decoder.eof and end < len(data):
                parts.append(decoder.decompress(data[end : end + SLICE]))
                end = min(end + SLICE, len(data))
        except zstandard.ZstdError as e:
            yield _record(at, None, f"broken frame: {e}")
            return
        if not decoder.eof:
            yield _record(at, None, "the frame is cut short")
            return
        yield parsed(at, b"".join(parts))
        at = end - len(decoder.unused_data)
    if at != len(data):
        yield _record(at, None, "bytes after the last frame")


def _record(position: int, headers: dict | None, error: str | None, payload: bytes | None = None) -> dict:
    h = headers or {}
    name = lambda k: h[k].strip("<>") if k in h else None
    length = h.get("x-payload-length", "")
    return {
        "position": position, "record_type": h.get("warc-type"), "record_id": name("warc-record-id"), "refers_to": name("warc-refers-to"), "target_uri": h.get("warc-target-uri"),
        "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": int(length) if length.isdigit() else None if payload is None else len(payload), "payload": payload, "error": error,
    }


def parsed(position: int, block: bytes) -> dict:
    """Checks one record: version, headers, block length, its end, and the payload's
    length and digest where it is there."""
    head, found, rest = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        return _record(position, None, "no WARC header")
    headers = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+\-.^_`|~0-9A-Za-z]+", key):
            return _record(position, headers, "a header line has no name")
        headers[key.decode().lower()] = value.strip().decode("utf-8", "replace")
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in headers:
            return _record(position, headers, f"no {key}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        return _record(position, headers, "the block's length is wrong")
    payload = rest[:-4]
    if headers["warc-type"] == "response":
        if headers.get("x-payload-length", str(len(payload))) != str(len(payload)):
            return _record(position, headers, "the payload's length is wrong", payload)
        if headers.get("warc-payload-digest", f"sha1:{digest_of(payload)}") != f"sha1:{digest_of(payload)}":
            return _record(position, headers, "the payload's digest is wrong", payload)
    if headers["warc-type"] == "revisit" and "warc-refers-to" not in headers:
        return _record(position, headers, "no warc-refers-to")
    return _record(position, headers, None, payload)


def warc_query(pages: DataFrame) -> DataFrame:
    """Writes all pages, reads the archives back and tells about each record."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    names = f"{path}/names"
    write_archives(pages, path).write.parquet(names)
    got = read_archives(spark, path, spark.read.parquet(names))
    page = lambda c: F.when(F.col(c) != "urn:page:None", F.substring(c, 10, 20).cast("long"))
    wrong = F.col("error").isNotNull()
    return got.select(
        F.when(wrong, F.raise_error(F.concat(F.lit("bad record: "), "error"))).otherwise(page("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(F.col("record_type") == "revisit", page("refers_to")).alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS kept FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM q
"""
