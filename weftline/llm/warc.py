"""WARC archives (operator 3): writer, and a sequential reader.

Each record is a gzip member of its own. The reader inflates a file bit by bit, takes a member's header block, frames
the record by Content-Length and verifies the block and payload digests as the bytes pass; it never holds more than
one record. Files are written and read through pyarrow's file systems, so any shared folder will do. Every task
writes files under names of its own, and only files named in the manifest of finished tasks are read: what a lost
task left behind is ignored.

Cases: page ids are whole numbers. Null html is an empty payload; payloads under min_bytes are always responses; of equal
payloads the smallest page_id is the response; rows that repeat this id with the same payload are responses too, under
record ids of their own if their urls differ, and revisits refer to the first by url; a null page_id is never the
smallest, its record bears no id and reads back as null; a null url reads back as null; very long pages are one record
each; no pages give an empty manifest and no rows. Only the id, url and html columns are read, so names of others
can't clash.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import arrow_map, fresh_path, materialise

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to and refers_url (null for responses). Digests with several pages are found by
    a pre-aggregated group over narrow rows and written; the join back has plain scans on both sides, so that AQE
    broadcasts a small side and splits a hot digest otherwise."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    firsts = rows.where(F.octet_length("payload") >= min_bytes).groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n"))
    firsts = materialise(firsts.where("n > 1").select("payload_digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")), "warc-firsts")
    refers = F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first"))
    return rows.join(firsts, "payload_digest", "left").select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"), F.when(refers.isNotNull(), F.col("first_url")).alias("refers_url"))


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, json.dumps([page_id, url, digest]))}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """A response, or a revisit without its payload."""
    head = HTTP_HEAD % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, url, digest)), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))), ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("WARC-Payload-Digest", "sha256:" + digest)]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", url.encode("unicode_escape").decode()))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, refers_url, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, *, most_bytes: int = 256 << 20, level: int = 4) -> DataFrame:
    """Write the records to archives in `folder`; the manifest (file, records, bytes) of the finished tasks, written
    too, so that reading it again never writes archives again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        done, out, name, n, size = [], None, "", 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to", "refers_url"))):
                if out is None:
                    name, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(record(*(x.as_py() for x in row))) + z.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= most_bytes:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield pa.RecordBatch.from_pydict({"file": [x[0] for x in done], "records": [x[1] for x in done], "bytes": [x[2] for x in done]}, pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return materialise(arrow_map(records, run, "file string, records bigint, bytes bigint"), "warc-manifest")


class Reader:
    """Records of one archive, in order, from a stream of gzip members."""

    def __init__(self, stream: BinaryIO, chunk: int = 1 << 16) -> None:
        self.stream, self.chunk = stream, chunk
        self.raw = b""

    def _member(self) -> Iterator[bytes]:
        """The bytes of the next member as they are inflated."""
        z = zlib.decompressobj(31)
        while not z.eof:
            if not self.raw:
                self.raw = self.stream.read(self.chunk)
                if not self.raw:
                    raise ValueError("archive ends within a member")
            out = z.decompress(self.raw)
            self.raw = z.unused_data if z.eof else b""
            if out:
                yield out

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes | None, int, str]]:
        """(header fields, HTTP head and payload as one block, payload bytes, payload digest) of each record."""
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.chunk)
            if not self.raw:
                return
            parts = self._member()
            buffer = b""
            while b"\r\n\r\n" not in buffer:
                buffer += next(parts, None) or _fail("no header block")
            head, _, buffer = buffer.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            if not first.startswith("WARC/"):
                _fail("not a WARC record")
            fields = dict(x.split(": ", 1) for x in lines)
            length = int(fields["Content-Length"])
            whole, pieces, got = hashlib.sha256(), [], 0
            while True:
                piece = buffer[: length - got]
                whole.update(piece)
                pieces.append(piece)
                got += len(piece)
                rest = buffer[len(piece) :]
                if got == length:
                    break
                buffer = next(parts, None) or _fail("record ends early")
            for x in parts:
                rest += x
            if rest != b"\r\n\r\n":
                _fail("record is longer than its Content-Length")
            if fields["WARC-Block-Digest"] != "sha256:" + whole.hexdigest():
                _fail("block digest differs")
            block = b"".join(pieces)
            http, _, payload = block.partition(b"\r\n\r\n")
            told = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != told:
                _fail("payload digest differs")
            size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
            yield fields, payload if fields["WARC-Type"] == "response" else None, size, told


def _fail(why: str):
    raise ValueError(why)


SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the manifest's archives; each file is read by one task, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows: list = []
                held = 0
                with store.open_input_stream(name, compression=None) as f:
                    for fields, payload, size, told in Reader(f):
                        url = fields.get("WARC-Target-URI")
                        rows.append((*(None if x is None else int(x) for x in [fields.get("X-Page-ID")]), None if url is None else url.encode().decode("unicode_escape"), size, told, fields["WARC-Type"], None if (r := fields.get("X-Refers-To-Page-ID")) is None else int(r), *([payload] if payloads else [])))
                        held += len(payload or b"") if payloads else 100
                        if held > 4 << 20:
                            yield _rows(rows, payloads)
                            rows, held = [], 0
                yield _rows(rows, payloads)

    files = max(1, manifest.count())
    return arrow_map(manifest.select("file").repartition(files), run, SCHEMA + ", payload binary" * payloads)


def _rows(rows: list, payloads: bool) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [k for k, _ in kinds])


def round_trip(pages: DataFrame, *, payloads: bool = False, min_bytes: int = 100) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    manifest = write_archives(plan_records(pages, min_bytes=min_bytes), folder)
    return read_archives(spark, manifest, folder, payloads)
