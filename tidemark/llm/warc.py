"""WARC bundles: seekable Zstandard archives of crawl records, with revisit records for equal payloads.

A bundle is a sequence of independent Zstandard frames, each holding whole WARC records
of about ``frame_bytes``, closed by a skippable frame with the seek table (the published
seekable format: per frame its compressed and decompressed size, then a footer). An index
table maps every record to (bundle, frame, offset in the frame's content, length), so one record
costs one read of one frame.

Of records with equal payloads of at least ``revisit_bytes`` the one with the smallest
page_id is the response; the others are revisit records without a payload, which keep the
response's HTTP header, digest and full length and name the record they refer to.

Scale: digests (not pages) are grouped to find the responses; the join back is between two
plain exchanges, which adaptive execution splits at a payload that a third of all pages
share. Each task streams its rows into bundles of bounded size in a folder that driver
and executors share (under spark.checkpoint.dir unless given), through the file system of
its address. A file's name is unique to the task attempt and the index lists only files of
attempts that Spark committed, so a repeated or lost task leaves nothing wrong behind.

Defined results: a null page is an empty payload; a null url is an empty target; rows that
share the smallest page_id of a payload are all responses; a null page_id is never the smallest unless there is
no other; pages are taken whole at any length; repeated rows are written each; other columns are not read; an empty table writes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ship
from tidemark.session import ensure_checkpoint_dir, materialize

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def warc_record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit's block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)),
            ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response"),
            ("X-Page-ID", "" if page_id is None else str(page_id))]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers, HTTP length and payload (None for a revisit) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    return {"fields": fields, "length": length, "payload": payload if fields["WARC-Type"] == "response" else None}


class Bundle:
    """Writes one seekable archive."""

    def __init__(self, fs, path: str, frame_bytes: int, level: int):
        self.fs, self.path, self.frame_bytes = fs, path, frame_bytes
        self.out, self.squeeze = fs.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.held, self.size, self.written = [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame's content) of the record."""
        if self.held and self.size + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.frames), self.size
        self.held.append(record)
        self.size += len(record)
        return place

    def flush(self):
        if self.held:
            frame = self.squeeze.compress(b"".join(self.held))
            self.out.write(frame)
            self.written += len(frame)
            self.frames.append((len(frame), self.size))
            self.held, self.size = [], 0

    def close(self):
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """(start, compressed size, content size) per frame, from the footer of an open archive."""
    end = f.size()
    n, _flags, magic = struct.unpack("<IBI", f.read_at(9, end - 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    sizes = struct.iter_unpack("<II", f.read_at(8 * n, end - 9 - 8 * n))
    out, at = [], 0
    for packed, size in sizes:
        out.append((at, packed, size))
        at += packed
    return out


def _digests(batches):
    for b in batches:
        payloads = [(x or "").encode() for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(map(len, payloads), pa.int64()),
                                          pa.array([hashlib.sha1(p).digest() for p in payloads], pa.binary())], ["page_id", "bytes", "sha1"])


def _write(folder: str, frame_bytes: int, bundle_bytes: int, level: int):
    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        context, bundle, n = TaskContext.get(), None, 0
        attempt = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        for b in batches:
            rows = []
            for page_id, url, page, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                payload = (page or "").encode()
                digest = digest_of(payload)
                record = warc_record(page_id, url or "", payload, digest, refers_to)
                if bundle is None:
                    bundle = Bundle(fs, f"{base}/{attempt}-{n:04d}.warc.zst", frame_bytes, level)
                    n += 1
                frame, offset = bundle.add(record)
                rows.append((record_id(page_id, digest), bundle.path[len(base) + 1:], frame, offset, len(record)))
                if bundle.written >= bundle_bytes:
                    bundle.close()
                    bundle = None
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                                             ["record_id", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()
    return run


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3) -> str:
    """Write the archives and their index; returns the folder: ``bundles/*.warc.zst`` and ``index`` (Parquet:
    record_id, bundle, frame, offset, length)."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    elif folder.startswith("file:/") and not folder.startswith("file://"):
        folder = f"file://{folder[5:]}"
    fs, base = pafs.FileSystem.from_uri(f"{folder}/bundles")
    fs.create_dir(base, recursive=True)
    thin = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = thin.schema["page_id"].dataType
    digests = materialize(thin.select("page_id", "html").mapInArrow(_digests, T.StructType([
        T.StructField("page_id", kind), T.StructField("bytes", T.LongType()), T.StructField("sha1", T.BinaryType())])))
    firsts = materialize(digests.where(F.col("bytes") >= revisit_bytes).groupBy("sha1").agg(
        F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    again = digests.join(firsts, "sha1").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).where("refers_to is not null")
    again = again.select(F.col("page_id").alias("again_id"), F.col("sha1").alias("again_sha1"), "refers_to").distinct()
    rows = thin.withColumn("sha1", F.unhex(F.sha1(F.coalesce("html", F.lit("")))))
    rows = rows.join(again, rows["page_id"].eqNullSafe(again["again_id"]) & (rows["sha1"] == again["again_sha1"]), "left")
    index = rows.select("page_id", "url", "html", "refers_to").mapInArrow(
        _write(f"{folder}/bundles", frame_bytes, bundle_bytes, level), "record_id string, bundle string, frame int, offset long, length long")
    index.write.parquet(f"{folder}/index")
    return folder


def _read(folder: str, with_payload: bool):
    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        name, source, table, frame_no, content = None, None, None, None, b""
        for b in batches:
            out = []
            for bundle, frame, offset, length in zip(*(b.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length"))):
                if bundle != name:
                    if source is not None:
                        source.close()
                    source = fs.open_input_file(f"{base}/{bundle}")
                    name, table, frame_no = bundle, seek_table(source), None
                if frame != frame_no:
                    start, packed, size = table[frame]
                    content = zstandard.ZstdDecompressor().decompress(source.read_at(packed, start), max_output_size=size)
                    frame_no = frame
                r = parse_record(content[offset:offset + length])
                f = r["fields"]
                digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                if r["payload"] is not None and (digest_of(r["payload"]) != digest or len(r["payload"]) != r["length"]):
                    raise ValueError(f"damaged record {f['WARC-Record-ID']}")
                out.append((f["WARC-Record-ID"], f["X-Page-ID"] or None, f["WARC-Target-URI"], r["length"], digest, f["WARC-Type"],
                            f.get("X-Refers-To-Page-ID"), r["payload"].decode() if with_payload and r["payload"] is not None else None))
            cols = list(zip(*out)) or [()] * 8
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["record_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
    return run


def read(spark: SparkSession, folder: str, record_ids: DataFrame | None = None, with_payload: bool = False,
         id_type: str = "long") -> DataFrame:
    """Records of the archives, each read through the index: (record_id, page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload). ``record_ids`` (column record_id) selects some."""
    ship(spark)
    index = spark.read.parquet(f"{folder}/index")
    if record_ids is not None:
        index = index.join(record_ids.select("record_id"), "record_id", "left_semi")
    places = index.select("bundle", "frame", "offset", "length").repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    found = places.mapInArrow(_read(f"{folder}/bundles", with_payload), "record_id string, page_id string, url string, payload_bytes long, "
                              "payload_digest string, record_type string, refers_to string, payload string")
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
