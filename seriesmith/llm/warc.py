"""WARC archives: one gzip member per record, written by tasks and read sequentially.

Writers put files into the folder that all executors share, each attempt under a name of its own;
only files of finished tasks are in the manifest. The reader inflates a member at a time and frames
its record by Content-Length, so it holds one chunk and, if asked for, one payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import join_dealt, materialize, read_table, shared_folder

#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 1000
#: Compressed bytes after which a task starts another file.
FILE_BYTES = 512 << 20
CHUNK = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id) -> str:
    """Names a record by its page; ids of any type stand as text, percent-encoded, and a null one has a name of its own."""
    return "<urn:x-no-page>" if page_id is None else f"<urn:x-page:{quote(str(page_id), safe='')}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None, date: str = DATE) -> bytes:
    """One gzip member. With ``refers_to`` a revisit: HTTP head without payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += [
        f"WARC-Payload-Digest: {_digest(payload)}",
        f"WARC-Block-Digest: {_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Record:
    """Takes a record's bytes as they are inflated."""

    def __init__(self, keep: bool, id_of=int):
        self.keep, self.held, self.id_of = keep, bytearray(), id_of
        self.head = self.http = None
        self.seen, self.payload = 0, bytearray()
        self.block_sha, self.payload_sha, self.payload_bytes = hashlib.sha1(), hashlib.sha1(), 0

    def feed(self, data: bytes) -> None:
        self.held += data
        if self.head is None:
            at = self.held.find(b"\r\n\r\n")
            if at < 0:
                return
            lines = self.held[:at].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("a member does not begin a record")
            self.head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            self.length = int(self.head["content-length"])
            del self.held[: at + 4]
        part = bytes(self.held[: self.length - self.seen])
        if part:
            del self.held[: len(part)]
            self.seen += len(part)
            self.block_sha.update(part)
            self._body(part)

    def _body(self, part: bytes) -> None:
        if self.http is None:
            self.payload += part
            at = self.payload.find(b"\r\n\r\n")
            if at < 0:
                return
            lines = self.payload[:at].decode("latin-1").split("\r\n")
            self.http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            part, self.payload = bytes(self.payload[at + 4 :]), bytearray()
        self.payload_sha.update(part)
        self.payload_bytes += len(part)
        if self.keep:
            self.payload += part

    def close(self) -> dict:
        if self.head is None or self.seen != self.length or bytes(self.held) != b"\r\n\r\n":
            raise ValueError("a record does not fill its member")
        encode = lambda sha: "sha1:" + base64.b32encode(sha.digest()).decode()
        kind, stated = self.head["warc-type"], self.head["warc-payload-digest"]
        if encode(self.block_sha) != self.head["warc-block-digest"]:
            raise ValueError(f"block digest of {self.head['warc-record-id']}")
        if kind == "response" and encode(self.payload_sha) != stated:
            raise ValueError(f"payload digest of {self.head['warc-record-id']}")
        refers = self.head.get("warc-refers-to")
        return {
            "page_id": self._page(self.head["warc-record-id"]),
            "url": self.head.get("warc-target-uri"),
            "record_type": kind,
            "refers_to": None if refers is None else self._page(refers),
            "payload_bytes": self.payload_bytes if kind == "response" else int(self.http["content-length"]),
            "payload_digest": base64.b32decode(stated.removeprefix("sha1:")).hex(),
            "payload": bytes(self.payload) if self.keep and kind == "response" else None,
        }

    def _page(self, record_id: str):
        return self.id_of(unquote(record_id.removeprefix("<urn:x-page:").removesuffix(">"))) if record_id.startswith("<urn:x-page:") else None


def read_records(source, keep_payload: bool = False, id_of=int) -> Iterator[dict]:
    """Records of an open archive in order, ids made of text by ``id_of``; raises ValueError where framing or a digest is wrong."""
    inflate, now, data = None, None, b""
    while True:
        if not data:
            data = source.read(CHUNK)
            if not data:
                break
        if inflate is None:
            inflate, now = zlib.decompressobj(31), _Record(keep_payload, id_of)
        while True:
            now.feed(inflate.decompress(data, CHUNK))
            data = inflate.unconsumed_tail
            if inflate.eof or not data:
                break
        if inflate.eof:
            data = inflate.unused_data
            yield now.close()
            inflate = None
    if inflate is not None:
        raise ValueError("the archive ends inside a member")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One record per row, in gzip archives below ``folder``; returns the manifest: path, records.

    Of rows with equal payloads of at least LEAST_REVISIT bytes the one with the largest id is the
    response and the others revisit it; rows that repeat that id are responses too. Null ids, urls and
    texts are allowed: a null text is an empty payload, a null id is never referred to.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    long = F.octet_length("payload") >= LEAST_REVISIT
    small = rows.where(~long).withColumn("refers_to", F.lit(None).cast(rows.schema["page_id"].dataType))  # never a revisit, and not shuffled
    rows = rows.where(long).withColumn("sha", F.sha2("payload", 256))
    several = rows.groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null")
    dealt = join_dealt(rows, several.select("sha", "last"), ["sha"], "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))
    dealt = dealt.unionByName(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        sink, name, size, n = None, None, 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    name, size, n = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = fs.open_output_stream(name, compression=None)
                data = record(page_id, url, payload, refers_to)
                sink.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    sink.close()
                    done.append((name, n))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((name, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    return materialize(dealt.mapInArrow(run, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, keep_payload: bool = False, id_type: str = "bigint") -> DataFrame:
    """Every record of the manifest's archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    A revisit's payload size and digest are those of the full payload; ``payload`` is null for it, and
    for all unless ``keep_payload``. ``id_type`` is that of the written ids.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        made = lambda some: pa.RecordBatch.from_arrays([pa.array([r[n] for r in some], k) for n, k in zip(names, kinds)], names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None, buffer_size=CHUNK) as source:
                    some, size = [], 0
                    for one in read_records(source, keep_payload, str):
                        some.append(one)
                        size += len(one["payload"] or b"") + 200
                        if size >= 8 << 20:
                            yield made(some)
                            some, size = [], 0
                    if some:
                        yield made(some)

    n = max(1, manifest.count())
    schema = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    found = manifest.select("path").repartition(n, "path").mapInArrow(run, schema)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def op4_warc(spark, sf_dir) -> DataFrame:
    folder = shared_folder(spark, "warc")
    pages = read_table(spark, sf_dir, "pages")
    manifest = write_archives(pages, folder)
    return read_archives(manifest, folder, id_type=pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
s AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
         max(page_id) OVER (PARTITION BY payload) AS last
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM s
"""
