"""Web archives inside ZIP packages: written by tasks, read back by ranges.

A package holds ``archive/data.warc.gz``, a stored member in which every WARC record is a gzip member of its own, and
``indexes/index.jsonl``, one line per record with its offset and length in that member. The reader never unpacks: it reads
the end of the file, walks the central directory (ZIP64 records included), skips the local header of the stored members,
reads the index and then ranges of the archive.

Tasks write whole packages of bounded size into a folder that all executors share, under a name of their own that is moved
into place at the end, so repeated tasks overwrite their own work only. Packages are found by Spark's binary file source,
without their content.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regulith.llm.packed import bounded_batches
from regulith.session import scratch_path

# Names within a package, signatures and marks of the ZIP format.
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
WIDE, ZIP64_FIELD, STORED = 0xFFFFFFFF, 0x0001, 0
RESPONSE, REVISIT = "response", "revisit"
PACKAGE_BYTES = 16 << 20
GAP = 64 << 10  # records closer than this are read in one range


class Entry:
    """A member of a package: name, method, sizes and the place of its local header."""

    def __init__(self, name: str, method: int, packed: int, size: int, header: int):
        self.name, self.method, self.packed, self.size, self.header = name, method, packed, size, header


def directory(read: Callable[[int, int], bytes], length: int) -> dict[str, Entry]:
    """Members of a package by name; ``read(offset, n)`` reads a range."""
    tail = read(max(0, length - 65557), min(length, 65557))
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        (place,) = struct.unpack_from("<Q", tail, at - 12)
        record = read(place, 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    raw, out, at = read(start, size), {}, 0
    for _ in range(count):
        if raw[at : at + 4] != ENTRY:
            raise ValueError("broken central directory")
        method, packed, full, n_name, n_extra, n_note = (struct.unpack_from("<H", raw, at + 10) + struct.unpack_from("<IIHHH", raw, at + 20))
        (header,) = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8")
        packed, full, header = widened(raw[at + 46 + n_name : at + 46 + n_name + n_extra], packed, full, header)
        out[name] = Entry(name, method, packed, full, header)
        at += 46 + n_name + n_extra + n_note
    return out


def widened(extra: bytes, packed: int, full: int, header: int) -> tuple[int, int, int]:
    """Sizes and place with the 64-bit values of the extra field where the 32-bit ones are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == ZIP64_FIELD:
            values = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            full = next(values) if full == WIDE else full
            packed = next(values) if packed == WIDE else packed
            header = next(values) if header == WIDE else header
        at += 4 + size
    return packed, full, header


def stored_at(read: Callable[[int, int], bytes], entry: Entry) -> int:
    """Where the bytes of a stored member begin."""
    if entry.method != STORED:
        raise ValueError(f"{entry.name} is compressed; only stored members can be read by range")
    head = read(entry.header, 30)
    if head[:4] != LOCAL:
        raise ValueError("no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return entry.header + 30 + n_name + n_extra


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, kind: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit that refers to one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == RESPONSE else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI: " + " ".join((url or "").split()), "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"X-Payload-Length: {len(payload)}",
    ]
    if kind == REVISIT:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode("utf-8") + b"\r\n\r\n"
    return head + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of one record, checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    if kind == RESPONSE and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("payload does not match its digest")
    own = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    first = fields.get("WARC-Refers-To", "")[len("<urn:page:") : -1]
    return int(own) if own else None, fields["WARC-Target-URI"], size, digest, kind, int(first) if first else None, payload if kind == RESPONSE else None


def package(records: list[tuple[dict, bytes]]) -> bytes:
    out, place, index = io.BytesIO(), 0, []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(DATA, "w", force_zip64=True) as data:
            for about, raw in records:
                data.write(raw)
                index.append(json.dumps({**about, "offset": place, "length": len(raw)}))
                place += len(raw)
        z.writestr(INDEX, "\n".join(index))
    return out.getvalue()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0) -> None:
    """Write one record per row into packages below ``path``, a folder all executors share.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is the response and the
    others revisit it. Null bodies are empty payloads; a null id ranks after all others (equal payloads of null ids only
    are all responses). Rows that repeat the smallest id of a payload are all responses. Other columns are not written.
    An empty table writes an empty package folder.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body")).withColumn("digest", F.sha2("body", 256))
    firsts = rows.where(F.octet_length("body") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"))
    rows = rows.join(firsts, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    out = rows.select("id", "url", "body", "first", again.alias("again"))
    target, root = fs.FileSystem.from_uri(path)
    target.create_dir(root)

    def write(parts: Iterator[pa.RecordBatch]):
        held, size, number = [], 0, 0
        sink, folder = fs.FileSystem.from_uri(path)
        task = TaskContext.get()

        def flush():
            name = f"{folder}/{task.partitionId():06d}-{number:05d}.zip"
            draft = f"{name}.{task.taskAttemptId()}"
            with sink.open_output_stream(draft) as f:
                f.write(package(held))
            sink.move(draft, name)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], names=["path", "records"])

        for part in parts:
            for page, url, body, first, repeat in zip(*(c.to_pylist() for c in part.columns)):
                raw = gzip.compress(record(page, url, body.encode("utf-8"), first, REVISIT if repeat else RESPONSE), 1, mtime=0)
                held.append(({"id": page}, raw))
                size += len(raw)
                if size >= PACKAGE_BYTES:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    out.mapInArrow(write, "path string, records bigint").write.format("noop").mode("overwrite").save()


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of the packages below ``path``: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and, if asked for, payload (null for revisits)."""
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    found = spark.read.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "length")

    def scan(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            for uri, length in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                source, name = fs.FileSystem.from_uri(uri)
                with source.open_input_file(name) as f:
                    yield from records_of(lambda at, n: f.read_at(n, at), length, payloads)

    return found.mapInArrow(scan, schema + (", payload binary" if payloads else ""))


def records_of(read: Callable[[int, int], bytes], length: int, payloads: bool) -> Iterator[pa.RecordBatch]:
    members = directory(read, length)
    index = members[INDEX]
    lines = read(stored_at(read, index), index.size).decode("utf-8").splitlines()
    spots = sorted((x["offset"], x["length"]) for x in map(json.loads, lines))
    base = stored_at(read, members[DATA])
    at = 0
    while at < len(spots):
        to, end = at, spots[at][0]
        while to < len(spots) and spots[to][0] - end <= GAP and (to == at or spots[to][0] + spots[to][1] - spots[at][0] <= 8 << 20):
            end = spots[to][0] + spots[to][1]
            to += 1
        stretch = read(base + spots[at][0], end - spots[at][0])
        rows = [parsed(gzip.decompress(stretch[o - spots[at][0] : o - spots[at][0] + n])) for o, n in spots[at:to]]
        page, url, size, digest, kind, first, payload = zip(*rows)
        columns = [pa.array(page, pa.int64()), pa.array(url, pa.string()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(kind, pa.string()), pa.array(first, pa.int64())]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        yield pa.RecordBatch.from_arrays(columns + ([pa.array(payload, pa.binary())] if payloads else []), names=names + (["payload"] if payloads else []))
        at = to


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the table to packages in the shared folder and read every record back; one row per page."""
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    if "://" not in path and not path.startswith("file:"):
        path = "file://" + path
    write_archives(pages, path)
    return read_archives(spark, path).drop("url")
