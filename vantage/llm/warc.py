"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding a few whole records, followed by a skippable
frame with the seek table of the public seekable format (sizes of every frame before and after compression). An
index maps record identifiers to a bundle, a frame and the offset inside the frame, so that a reader fetches one
frame to get one record.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vantage.llm.shared import new_path, small, stored

# Fixed values of the seekable format: skippable frame magic, seek table magic.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

#: Bytes of records before a frame closes, and before a bundle does.
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 27
#: Payloads below this size are never revisits.
REVISIT_BYTES = 100
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "bundle string, frame int, frame_at bigint, frame_size bigint, at bigint, size bigint"
#: Plain bytes of records that one task reads, about; and places that a payload's copies are dealt over.
READ_BYTES = 1 << 26
SALTS = 64


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, with the full payload's length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c for c in url or "about:blank" if c >= " ")
    named = lambda x: f"<urn:page:{'' if x is None else quote(x, '') if isinstance(x, str) else x}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {named(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: {named(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and the offset after it."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    begin, size = end + 4, int(headers["Content-Length"])
    return headers, data[begin : begin + size], begin + size + 4


class Bundle:
    """Frames of records in memory until the bundle is written."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.frames, self.sizes, self.open, self.open_size = frame_bytes, [], [], [], 0
        self.compress = zstandard.ZstdCompressor(level=3)

    def add(self, data: bytes) -> tuple[int, int]:
        """Puts a record in; its frame and its offset there."""
        if self.open and self.open_size + len(data) > self.frame_bytes:
            self.close_frame()
        at = (len(self.frames), self.open_size)
        self.open.append(data)
        self.open_size += len(data)
        return at

    def close_frame(self) -> None:
        if self.open:
            whole = b"".join(self.open)
            packed = self.compress.compress(whole)
            self.frames.append(packed)
            self.sizes.append((len(packed), len(whole)))
            self.open, self.open_size = [], 0

    def seek_table(self) -> bytes:
        entries = b"".join(struct.pack("<II", *x) for x in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """Sizes of the frames, packed and plain, from a bundle's last bytes (the whole table at least)."""
    n, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table")
    return [struct.unpack_from("<II", tail, len(tail) - 9 - 8 * (n - i)) for i in range(n)]


def frame_offsets(sizes: list[tuple[int, int]]) -> list[int]:
    out, at = [], 0
    for packed, _ in sizes:
        out.append(at)
        at += packed
    return out


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a path or URI names."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def marked_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, first_id: the smallest id of the pages with an equal payload (by SHA-256), if there are
    several. Ids and digests alone are shuffled to find these; payloads stay where they are unless very many are repeated, and
    are then dealt by digest and salt, so that no copied page meets in one task."""
    base = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("d", F.unhex(F.sha2("payload", 256)))
    first = base.select("page_id", "d").groupBy("d").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = stored(first.where("n > 1 and first_id is not null").select("d", "first_id"), "repeated")
    if small(first):
        marked = base.join(F.broadcast(first), "d", "left")
    else:
        salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["d", "salt"], "left")
    return marked.select("page_id", "url", "payload", F.lower(F.hex("d")).alias("digest"), "first_id")


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes every page as a record into bundles under folder (shared storage) and returns their index.

    A task writes its bundles under names of its own and a task that runs again writes new ones, so a lost
    executor leaves at most a bundle that no index names. Null html is an empty payload, a null url about:blank,
    a null page_id an empty identifier. Equal payloads of at least REVISIT_BYTES: rows with the smallest id are
    responses, all others revisits; rows of a group without any id are responses. Ids are integers or strings; pages may have
    other columns; without pages the index is empty.
    """
    kind = pages.schema["page_id"].dataType
    arrow_kind = to_arrow_type(kind)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        bundle, rows, held = Bundle(frame_bytes), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal bundle, rows, held
            bundle.close_frame()
            if not rows:
                return
            name = f"bundle-{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                for frame in bundle.frames:
                    out.write(frame)
                out.write(bundle.seek_table())
            begins = frame_offsets(bundle.sizes)
            yield pa.record_batch(
                {
                    "page_id": pa.array([r[0] for r in rows], arrow_kind),
                    "bundle": pa.array([name] * len(rows), pa.string()),
                    "frame": pa.array([r[1] for r in rows], pa.int32()),
                    "frame_at": pa.array([begins[r[1]] for r in rows], pa.int64()),
                    "frame_size": pa.array([bundle.sizes[r[1]][0] for r in rows], pa.int64()),
                    "at": pa.array([r[2] for r in rows], pa.int64()),
                    "size": pa.array([r[3] for r in rows], pa.int64()),
                }
            )
            bundle, rows, held = Bundle(frame_bytes), [], 0

        for part in parts:
            for page_id, url, payload, digest, first in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first_id")), strict=True):
                revisit = first is not None and page_id != first and len(payload) >= REVISIT_BYTES
                data = record(page_id, url, payload, digest, first, revisit)
                rows.append((page_id, *bundle.add(data), len(data)))
                held += len(data)
                if held >= bundle_bytes:
                    yield from flush()
        yield from flush()

    return marked_records(pages).select("page_id", "url", "payload", "digest", "first_id").mapInArrow(write, f"page_id {kind.simpleString()}, {_INDEX}")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Reads back every record that the index names, one frame at a time: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest and payload (null for a revisit). A response whose digest differs is an error.

    Frames are dealt to as many tasks as their bytes need, one for each core at least.
    """
    spark = index.sparkSession
    total = index.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    frames = index.repartition(tasks, "bundle", "frame").groupBy("bundle", "frame", "frame_at", "frame_size").agg(F.sort_array(F.collect_list("at")).alias("offsets"))
    kind = index.schema["page_id"].dataType
    arrow_kind, integral = to_arrow_type(kind), isinstance(kind, T.IntegralType)

    def identity(urn: str):
        text = urn.removeprefix("<urn:page:").removesuffix(">")
        return None if not text else int(text) if integral else unquote(text)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        for part in parts:
            for name, at, size, offsets in zip(*(part.column(c).to_pylist() for c in ("bundle", "frame_at", "frame_size", "offsets")), strict=True):
                with fs.open_input_file(f"{root}/{name}") as file:
                    plain = zstandard.ZstdDecompressor().decompress(file.read_at(size, at))
                out = []
                for offset in offsets:
                    headers, block, _ = parse(plain, offset)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    revisit = headers["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{headers['WARC-Record-ID']}: the payload differs from its digest")
                    length = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
                    refers = identity(headers["WARC-Refers-To"]) if revisit else None
                    out.append((identity(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], headers["WARC-Type"], refers, length, digest, None if revisit else payload))
                columns = zip(*out, strict=True)
                kinds = (arrow_kind, pa.string(), pa.string(), arrow_kind, pa.int64(), pa.string(), pa.binary())
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    return frames.mapInArrow(read, f"page_id {kind.simpleString()}, url string, record_type string, refers_to {kind.simpleString()}, payload_bytes bigint, payload_digest string, payload binary")


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes pages to a new folder of the shared storage; the stored index and the folder."""
    folder = folder or new_path(pages.sparkSession, "warc")
    return stored(write_bundles(pages, folder), "warc-index"), folder


def lookup(index: DataFrame, folder: str, page_ids: list) -> DataFrame:
    """The records of some pages, by reading only their frames."""
    return read_records(index.where(F.col("page_id").isin(page_ids)), folder)
