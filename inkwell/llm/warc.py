"""Zstandard WARC archives: writer and reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; every
record is a zstd frame of its own, compressed with it. Pages with equal payloads of at least
``least`` bytes become one response (the smallest id) and revisits that refer to it. The digest's
first id is found by a grouped minimum before any payload moves, so a payload that a third of all
pages share is pre-aggregated.

Archives are written by the tasks to the shared folder under fresh names; the manifest, a table
committed by Spark, names those of the successful attempts, and only these are read, so a lost
executor or a repeated task leaves no record twice. The reader decodes frame by frame (memory is
bounded by one record) and checks the dictionary frame, the version line, the named fields, the
block length, the closing blank lines, one record per frame, the HTTP length and the payload
digest. What fails raises ``ValueError``.

Null html counts as empty. Pages without an id are responses unless an equal payload has one;
repeated rows with the smallest id are responses each. An empty table gives no archive and an empty
result. Null urls are written as empty. Columns other than id, url and html are not read."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import shared_path, smallest, stage, table

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES = 64 << 20
DICT_BYTES, DICT_PAGES, DICT_SAMPLE = 64 << 10, 200, 32 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
               "refers_to long, payload binary")


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'-' if page_id is None else page_id}>"


def _page_of(urn: str | None):
    if urn is None:
        return None
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise ValueError(f"unknown record id {urn}")
    return None if urn[10:-1] == "-" else int(urn[10:-1])


def record(page_id, url: str, payload: bytes, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP head only."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)),
            ("WARC-Date", date), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
            ("WARC-Payload-Digest", "sha1:" + digest32(payload))]
    if revisit:
        head += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """(page id, url, type, payload length, digest, refers to, payload) of one whole record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC version line")
    field = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.strip() != name or not name:
            raise ValueError(f"malformed header line {line!r}")
        field[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in field:
            raise ValueError(f"header {name} is missing")
    size = int(field["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"block of {size} bytes expected, frame has {len(rest) - 4}")
    http, sep, payload = rest[:size].partition(b"\r\n\r\n")
    length = [x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not sep or not length:
        raise ValueError("no HTTP head")
    size, kind = int(length[0].split(b":")[1]), field["warc-type"]
    digest = field.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if len(payload) != size:
            raise ValueError(f"payload of {size} bytes expected, found {len(payload)}")
        if digest32(payload) != digest:
            raise ValueError("payload digest differs")
    elif kind != "revisit" or payload:
        raise ValueError(f"unexpected {kind} record")
    return (_page_of(field["warc-record-id"]), field.get("warc-target-uri"), kind, size, digest,
            _page_of(field.get("warc-refers-to")), payload if kind == "response" else None)


class ArchiveWriter:
    """Appends records to one archive."""

    def __init__(self, out, dictionary: bytes):
        self.out, self.records, self.bytes = out, 0, 0
        out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=given)

    def add(self, data: bytes) -> None:
        self.out.write(self.zstd.compress(data))
        self.records += 1
        self.bytes += len(data)


def read_archive(file, chunk: int = 1 << 20) -> Iterator[tuple]:
    """The records of an open archive, one frame at a time."""
    head = file.read(8)
    if len(head) < 8:
        raise ValueError("no dictionary frame")
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError(f"leading frame has magic {magic:#x}")
    dictionary = file.read(size)
    if len(dictionary) != size:
        raise ValueError("dictionary frame is cut short")
    if dictionary[:4] == b"\x28\xb5\x2f\xfd":
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    data = file.read(chunk)
    while data:
        frame, parts = zstd.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data or file.read(chunk)
                break
            data = file.read(chunk)
            if not data:
                raise ValueError("last frame is cut short")
        yield parse(b"".join(parts))


def train_dictionary(pages: DataFrame, id_col: str, html_col: str) -> bytes:
    """From the heads of at most ``DICT_PAGES`` pages, the smallest by hash: a bounded sample."""
    rows = smallest(pages.where(F.octet_length(html_col) > 0).select(
        F.xxhash64(id_col, html_col).bitwiseAND((1 << 63) - 1).alias("k"), F.substring(html_col, 1, DICT_SAMPLE).alias("h")),
        "k", DICT_PAGES, "h").collect()
    samples = [r["h"].encode() for r in rows]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):          # too little to train on
        return b"".join(samples)[:DICT_BYTES]


def _writer(base: str, dictionary: bytes, date: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(base)
        system.create_dir(root, recursive=True)
        done, out, archive, path = [], None, None, ""
        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(i) for i in range(4)), strict=True):
                if archive is None:
                    path = f"{uuid.uuid4().hex}.warc.zst"
                    out = system.open_output_stream(f"{root}/{path}")
                    archive = ArchiveWriter(out, dictionary)
                p, f = page_id.as_py(), first.as_py()
                archive.add(record(p, url.as_py() or "", html.as_py() or b"", f, f is not None and p != f, date))
                if archive.bytes >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{base}/{path}", archive.records))
                    archive = None
        if archive is not None:
            out.close()
            done.append((f"{base}/{path}", archive.records))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])
    return task


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least: int = 0, date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """Writes one record per page; returns the manifest (path, records)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    first = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.min("page_id").alias("first"))
    task = _writer(shared_path(pages.sparkSession, "archives"), train_dictionary(pages, id_col, html_col), date)
    return stage(rows.join(first, "sha", "left").select("page_id", "url", "html", "first").mapInArrow(
        task, "path string, records long"), "manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                          names=names)

    for batch in batches:
        for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            system, name = open_fs(path)
            rows, held, seen = [], 0, 0
            with system.open_input_stream(name) as file:
                for row in read_archive(file):
                    rows.append(row)
                    held, seen = held + len(row[6] or b"") + 200, seen + 1
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)
            if seen != records:
                raise ValueError(f"{path}: {records} records expected, found {seen}")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives in a manifest, an archive a task."""
    return manifest.repartition(max(1, min(manifest.count(), 100_000))).mapInArrow(_reader, READ_SCHEMA)


def op3_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages give back."""
    return read_archives(write_archives(table(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (1 + ((('0x' || substr(p.h, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31))::INT, 1)), '')
           AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.h = f.h
"""
