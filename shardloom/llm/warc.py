"""WARC archives as seekable Zstandard bundles.

A bundle is a series of independent Zstandard frames, each holding some whole WARC
records, and a last skippable frame with the sizes of all frames (the public
"Zstandard seekable format"). The index maps a record to (bundle, frame, offset in
the frame, length), so one record is read by decompressing one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, split_fs, work_root

#: Fixed values of the seekable format: skippable frame magic, seek table magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Frame and bundle sizes in uncompressed and compressed bytes.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
#: Uncompressed bytes that one task reads, where there are more tasks than cores.
READ_BYTES = 512 << 20
#: Payloads of at least so many bytes are revisited rather than repeated.
REVISIT_BYTES = 0
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public URL name space
INDEX_SCHEMA = "record_id string, page_id long, bundle string, frame int, offset long, length long"
READ_SCHEMA = "record_id string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{sha}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[str, bytes]:
    """(record id, WARC 1.1 record). refers_to: page_id of the response that a revisit names."""
    sha = digest(payload)
    name = record_name(page_id, sha)
    target = "".join(c if "\x20" < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or f"urn:page:{page_id}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
    ]
    head += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        head.append("Content-Type: application/http;msgtype=response")
        block = http + payload
    else:
        head += [f"WARC-Refers-To: {record_name(refers_to, sha)}", f"X-Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Content-Type: application/http;msgtype=response"]
        block = http
    head.append(f"Content-Length: {len(block)}")
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Writes records to bundles below one folder; yields index rows when a bundle is complete."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3):
        import zstandard

        self.fs, self.path = split_fs(folder)
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.out, self.rows = None, []
        self.buffer, self.size, self.frames = [], 0, []

    def add(self, name: str, page_id: int | None, data: bytes) -> None:
        if self.out is None:
            self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
            self.fs.create_dir(self.path, recursive=True)
            self.out, self.written = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None), 0
        self.rows.append((name, page_id, f"{self.folder}/{self.name}", len(self.frames), self.size, len(data)))
        self.buffer.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        if self.size:
            done = self.zstd.compress(b"".join(self.buffer))
            self.out.write(done)
            self.frames.append((len(done), self.size))
            self.written += len(done)
            self.buffer, self.size = [], 0

    def take(self, end: bool = False) -> list[tuple]:
        """Rows of the bundle if it is full or this is the end, else nothing."""
        if self.out is None or not end and self.written < self.bundle_bytes:
            return []
        self._frame()
        table = b"".join(struct.pack("<II", a, b) for a, b in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        rows, self.rows, self.out, self.frames = self.rows, [], None, []
        return rows


def seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the footer of an open bundle of that size."""
    source.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    source.seek(size - 9 - 8 * count)
    flat = struct.unpack(f"<{2 * count}I", source.read(8 * count))
    out, start = [], 0
    for a, b in zip(flat[::2], flat[1::2], strict=True):
        out.append((start, a, b))
        start += a
    return out


def parse(data: bytes, start: int = 0):
    """Yields (offset, length, headers, block) of the records in a frame."""
    while start < len(data):
        end = data.index(b"\r\n\r\n", start)
        head = dict(x.split(": ", 1) for x in data[start:end].decode().split("\r\n")[1:])
        stop = end + 4 + int(head["Content-Length"])
        yield start, stop + 4 - start, head, data[end + 4 : stop]
        start = stop + 4


def _bundles(urls, with_payload: bool):
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for url in urls:
        fs, path = split_fs(url)
        with fs.open_input_file(path) as f:
            for start, packed, size in seek_table(f, f.size()):
                f.seek(start)
                for _, _, head, block in parse(unpack.decompress(f.read(packed), max_output_size=size)):
                    payload, back = block.partition(b"\r\n\r\n")[2], head.get("X-Refers-To-Page-Id")
                    sha = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if back is None and (digest(payload) != sha or len(payload) != int(head["X-Payload-Length"])):
                        raise ValueError(f"{head['WARC-Record-ID']}: payload and digest differ")
                    own = head.get("X-Page-Id")
                    yield head["WARC-Record-ID"], own and int(own), head["WARC-Target-URI"], payload if with_payload and back is None else None, int(head["X-Payload-Length"]), sha, head["WARC-Type"], back and int(back)


def _arrow(rows: list[tuple], kinds: list) -> pa.RecordBatch:
    names, types = zip(*kinds, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(types), types, strict=True)], names=list(names))


_INDEX = [("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]
_READ = [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row below folder; returns the index (INDEX_SCHEMA).

    Of rows with equal payloads of at least revisit_bytes, that with the smallest id is
    the response and the others revisit it. Bundles get new names in every task
    attempt, and the index names only those of attempts that ended, so a lost executor
    leaves no wrong records.

    Defined cases: a null payload is the empty payload; a null id is never the one
    referred to (a group with null ids only has responses only); rows that repeat id
    and payload are alike: all of the smallest id are responses; a payload of any length is
    one record in a frame that is as long as it needs; a null url becomes urn:page:<id>; an
    empty table writes no bundle; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("body"))
    keys = rows.select("id", F.sha1("body").alias("sha"), F.octet_length("body").alias("n")).where(F.col("n") >= revisit_bytes)
    groups = keys.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("sha", "first")
    groups = materialise(groups, "warc-groups")  # read again, both sides of the join are plain exchanges, which AQE splits where a group is large
    rows = rows.withColumn("sha", F.sha1("body"))
    joined = rows.join(groups, "sha", "left").select("id", "url", "body", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")).alias("back"))

    def write(batches):
        out = BundleWriter(folder)
        for batch in batches:
            for page_id, url, body, back in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, data = record(page_id, url, body, back, date)
                out.add(name, page_id, data)
                if done := out.take():
                    yield _arrow(done, _INDEX)
        if done := out.take(end=True):
            yield _arrow(done, _INDEX)

    return materialise(joined.mapInArrow(write, INDEX_SCHEMA), "warc-index")


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the bundles that the index names, one row each (READ_SCHEMA); digests are verified.

    Bundles are dealt to a number of tasks that follows from their bytes, whatever the few bytes of
    their names would suggest to adaptive execution.
    """
    named = materialise(index.groupBy("bundle").agg(F.sum("length").alias("bytes")), "warc-bundles")
    n, size = named.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = min(n, max(index.sparkSession.sparkContext.defaultParallelism, -(-int(size) // READ_BYTES)))
    bundles = named.select("bundle").repartition(max(1, tasks))

    def read(batches):
        rows = []
        for batch in batches:
            size = 0
            for row in _bundles(batch.column(0).to_pylist(), with_payload):
                rows.append(row)
                size += len(row[3] or b"") + 200
                if size > 8 << 20:
                    yield _arrow(rows, _READ)
                    rows, size = [], 0
        yield _arrow(rows, _READ)

    return bundles.mapInArrow(read, READ_SCHEMA)


def read_record(bundle: str, frame: int, offset: int) -> tuple[dict, bytes]:
    """(headers, block) of one record; decompresses its frame only."""
    import zstandard

    fs, path = split_fs(bundle)
    with fs.open_input_file(path) as f:
        start, packed, size = seek_table(f, f.size())[frame]
        f.seek(start)
        _, _, head, block = next(parse(zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=size), offset))
    return head, block


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{work_root(spark)}/warc")
    return read_archives(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Base32 of a digest in hexadecimal digits: 40 bits are eight characters.
_BASE32 = f"list_aggregate(list_transform(range(0, 32), lambda i: substr('{_ALPHABET}', ((('0x' || substr(h, (i // 8 * 10 + 1)::INT, 10))::BIGINT >> (35 - i % 8 * 5)::INT) & 31)::INT + 1, 1)), 'string_agg', '')"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p
"""
