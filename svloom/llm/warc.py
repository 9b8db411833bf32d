"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole WARC records of about FRAME_BYTES, followed by
a seek table in a skippable frame (compressed and decompressed size of each frame, then the number of frames and
a magic number), so that any Zstandard reader can read a bundle from end to end, and one that knows the table can
read one frame. The index maps each record identifier to its bundle, frame and offset in the decompressed frame.

Of records with equal payloads (SHA-1 and length) of at least ``min_bytes``, that with the smallest page_id is a
response with the payload; the others are revisits that refer to it and store headers only. Digests are grouped
with partial aggregation and joined back; a payload shared by very many records is one key with many rows, which
adaptive execution splits, as both sides of the join are exchanges.

Null html is an empty payload. A null url leaves out the target header. A null page_id is a record of its own
(urn:page:), never the smallest. Rows that repeat a page_id and payload all have the type of that id. Line breaks
in a url are percent-encoded. Extra columns are not read. An empty table gives no bundle and no row. A record is held
whole by its task, a few times over, however long its html is.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from svloom.llm.shared import Workspace

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 1 << 28, 3
#: Formats: skippable frame with a seek table, end of a seek table, profile of a revisit.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The tables have no time of retrieval.
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One WARC record; ``payload`` is None for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    block = http + (payload or b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, payload, end) of each record from ``at`` on."""
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        first = stop + 4
        end = first + int(head["Content-Length"])
        body = data.index(b"\r\n\r\n", first, end) + 4
        head |= {f"http:{k}": v for k, _, v in (x.partition(": ") for x in data[first : body - 4].decode().split("\r\n")[1:])}
        yield head, data[body:end], end + 4
        at = end + 4


class BundleWriter:
    """Frames and then the seek table, to any object with write()."""

    def __init__(self, out):
        import zstandard

        self.out, self.zstd = out, zstandard.ZstdCompressor(level=LEVEL)
        self.sizes: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset) at which the record will stand."""
        at = len(self.sizes), self.size
        self.held.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.flush()
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.zstd.compress(b"".join(self.held))
            self.out.write(packed)
            self.sizes.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def _open(uri: str, write: bool = False):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    if not write:
        return where.open_input_file(path)
    if isinstance(where, fs.LocalFileSystem):
        where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(path, compression=None)  # else the name would have it compress once more


class Bundle:
    """Random access to the frames of a bundle."""

    def __init__(self, uri: str):
        self.file = _open(uri)
        total = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, total - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        each = 12 if flags & 0x80 else 8
        table = self.file.read_at(frames * each, total - 9 - frames * each)
        self.sizes = [struct.unpack_from("<II", table, each * k) for k in range(frames)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        import zstandard

        packed, size = self.sizes[k]
        data = zstandard.ZstdDecompressor().decompressobj().decompress(self.file.read_at(packed, self.starts[k]))
        if len(data) != size:
            raise ValueError(f"frame {k} has {len(data)} bytes; the seek table says {size}")
        return data

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        head, payload, _ = next(parse(self.frame(frame), offset))
        return head, payload


def with_revisits(pages: DataFrame, ws: Workspace, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, digest, size, refers_to, html); html is null for revisits."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    # without the text: it is read for the digest and dropped before the shuffle
    shared = rows.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").where(F.col("size") >= min_bytes)
    shared = ws.table(shared.drop("n"), "shared")
    met = rows.join(shared, ["digest", "size"], "left")
    refers_to = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    met = met.withColumn("refers_to", refers_to)
    return met.select("page_id", "url", "digest", "size", "refers_to", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"))


def write_archives(pages: DataFrame, ws: Workspace, min_bytes: int = 0) -> DataFrame:
    """Writes bundles below the workspace and returns their index (INDEX), itself a written table.

    Each attempt of a task writes files of its own, and only the index rows of the attempt that succeeded are
    kept: a repeated task leaves files that nothing refers to, never an index that fits another file.
    """
    root = ws.path("bundles")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, uri, done = None, "", []

        def index() -> pa.RecordBatch:
            cols = list(zip(*done)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, digest, size, refers_to, html = (c[row].as_py() for c in batch.columns)
                if writer is None:
                    uri = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(_open(uri, write=True))
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                data = record(page_id, url, digest, size, None if html is None else html.encode(), refers_to)
                done.append((page_id, uri, *writer.add(data), len(data)))
                if writer.written >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
            yield index()
            done.clear()
        if writer:
            writer.close()

    return ws.table(with_revisits(pages, ws, min_bytes).mapInArrow(apply, INDEX), "index")


def _number(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_archives(spark: SparkSession, bundles: DataFrame) -> DataFrame:
    """All records (RECORDS) of the bundles named in the first column; a response's payload must fit its digest."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                bundle = Bundle(uri)
                for k in range(len(bundle.sizes)):
                    rows = []
                    for head, payload, _ in parse(bundle.frame(k)):
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{uri}, frame {k}: a payload differs from its digest")
                        refers_to = head.get("WARC-Refers-To")
                        rows.append((_number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), int(head["http:Content-Length"]), digest, head["WARC-Type"], refers_to and _number(refers_to)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)

    return bundles.mapInArrow(apply, RECORDS)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as WARC bundles and reads the records back."""
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    index = write_archives(pages, ws, min_bytes)
    names = ws.table(index.select("bundle").distinct(), "names")
    return read_archives(spark, names.repartition(spark.sparkContext.defaultParallelism, "bundle"))
