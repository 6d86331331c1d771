"""WARC archives: monolithic gzip files, normalised to one member a record with a sidecar offset index.

Three steps, each a Spark job. ``write_monolithic`` writes records the way crawlers often leave them: one gzip
stream for a whole file. ``normalise`` inflates each file once, as a stream, writes every record again as its own
gzip member, and writes the members' offsets to a sidecar file of JSON lines. ``read_archives`` seeks to each
member by that index. Files are named after the task attempt that wrote them and count only when Spark
has committed the attempt's manifest row, so lost executors and repeated tasks leave no doubles.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.keyfilter import key_bitmap, split
from scoreloom.llm.storage import map_batches, materialise, new_path

MIN_REVISIT_BYTES = 100
#: Uncompressed bytes after which a task begins another archive.
ROLL_BYTES = 256 << 20
_CHUNK = 1 << 20
_FIXED_DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID(int=0)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def _one_line(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone, whose length field
    still tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_FIXED_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Plain bytes of a gzip stream of one or many members, a chunk at a time."""
    engine = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            plain = engine.decompress(chunk, _CHUNK)
            if plain:
                yield plain
            if engine.eof:
                chunk, engine = engine.unused_data, zlib.decompressobj(31)
            else:
                chunk = engine.unconsumed_tail
                if not chunk:
                    break
    rest = engine.flush()
    if rest:
        yield rest


def split_records(plain: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, whole record) one after another; holds one record at a time."""
    held = bytearray()
    for chunk in plain:
        held += chunk
        while (at := held.find(b"\r\n\r\n")) >= 0:
            fields = parse_head(bytes(held[:at]))
            end = at + 4 + int(fields["content-length"]) + 4
            if len(held) < end:
                break
            yield fields, bytes(held[:end])
            del held[:end]
    if held.strip():
        raise ValueError("the archive ends within a record")


class _Task:
    """Names and opens the files of one task attempt."""

    def __init__(self, base: str, kind: str):
        self.fs, self.root = pafs.FileSystem.from_uri(base)
        context = TaskContext.get()
        self.stem = f"{self.root}/{kind}/part-{context.partitionId():05d}-{context.taskAttemptId()}"
        self.fs.create_dir(f"{self.root}/{kind}", recursive=True)
        self.count = 0

    def next(self, suffix: str) -> str:
        self.count += 1
        return f"{self.stem}-{self.count:03d}{suffix}"

    def open(self, path: str):
        return self.fs.open_output_stream(path, compression=None)


def _manifest(rows: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["path", "records"])


def _write(base: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, rows = None, None, []
        for batch in batches:
            for page_id, url, html, digest, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    task = task or _Task(base, "monolithic")
                    path = task.next(".warc.gz")
                    out, engine, plain, records = task.open(path), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                record = build_record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, first, revisit)
                out.write(engine.compress(record))
                plain, records = plain + len(record), records + 1
                if plain >= roll_bytes:
                    out.write(engine.flush())
                    out.close()
                    rows.append((path, records))
                    out = None
        if out is not None:
            out.write(engine.flush())
            out.close()
            rows.append((path, records))
        yield _manifest(rows)

    return run


def _normalise(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []
        for batch in batches:
            for source in batch.column("path").to_pylist():
                task = task or _Task(base, "records")
                path = task.next(".warc.gz")
                at = records = 0
                with task.fs.open_input_stream(source, compression=None) as raw, task.open(path) as out, task.open(f"{path}.idx") as index:
                    for fields, record in split_records(inflate(iter(lambda: raw.read(_CHUNK), b""))):
                        engine = zlib.compressobj(5, zlib.DEFLATED, 31)
                        member = engine.compress(record) + engine.flush()
                        out.write(member)
                        entry = {"offset": at, "length": len(member), "id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "digest": fields.get("warc-payload-digest")}
                        index.write(json.dumps(entry).encode() + b"\n")
                        at, records = at + len(member), records + 1
                rows.append((path, records))
        yield _manifest(rows)

    return run


_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_member(member: bytes) -> tuple:
    """One record as ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``; a response's digest
    is computed from its payload."""
    record = zlib.decompress(member, 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = parse_head(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = int(fields["x-page-id"]) if "x-page-id" in fields else None
    if fields["warc-type"] == "response":
        return page, len(payload), hashlib.sha256(payload).hexdigest(), "response", None
    size = int(parse_head(http)["content-length"])
    return page, size, fields["warc-payload-digest"].removeprefix("sha256:"), "revisit", int(fields["x-refers-to-page"])


def _read(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(base)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_stream(f"{path}.idx", compression=None) as index, fs.open_input_file(path) as archive:
                    lines, found = b"", []
                    while chunk := index.read(_CHUNK):
                        *whole, lines = (lines + chunk).split(b"\n")
                        for entry in map(json.loads, whole):
                            archive.seek(entry["offset"])
                            found.append(read_member(archive.read(entry["length"])))
                            if len(found) >= 4096:
                                yield _pages(found)
                                found = []
                    yield _pages(found)

    return run


def _pages(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _PAGES.split(", ")])


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(page_id, url, html, digest, first, revisit)``: of equal payloads of ``min_bytes`` and more the smallest
    page_id is the response and the others revisit it. Rows that repeat that page_id are responses too."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    # Digests alone are shuffled to find the repeated ones; then only the pages that may have one of those.
    large = base.where(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    again = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    again = materialise(again.withColumn("place", F.xxhash64("digest")), "repeated")
    maybe, rest = split(base.withColumn("place", F.xxhash64("digest")), "place", key_bitmap(again, "place"))
    marked = maybe.drop("place").join(again.drop("place"), "digest", "left").withColumn("first", F.when(F.octet_length("html") >= min_bytes, F.col("first")))
    marked = rest.select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("first")).unionByName(marked)
    return marked.select("page_id", "url", "html", "digest", "first", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))


def write_monolithic(pages: DataFrame, base: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Archives of the pages as whole-file gzip streams; returns the manifest ``(path, records)``."""
    return materialise(map_batches(with_revisits(pages), _write(base, roll_bytes), "path string, records long"), "warc-raw")


def normalise(manifest: DataFrame, base: str) -> DataFrame:
    """Each archive again with a gzip member for every record and ``.idx`` beside it; returns its manifest."""
    return materialise(map_batches(_spread(manifest), _normalise(base), "path string, records long"), "warc-members")


def read_archives(manifest: DataFrame, base: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every record, by offset."""
    return map_batches(_spread(manifest), _read(base), _PAGES)


def _spread(manifest: DataFrame) -> DataFrame:
    """One archive or so a task."""
    return manifest.repartition(max(1, manifest.count()), "path")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages(page_id, url, html, ...)`` as archives in the shared folder, normalise them, read them back.

    A null or empty html is an empty payload, a very long one a record of its length, which a task holds; null urls are left
    out; a null page_id comes back null and is never referred to. Repeated rows are records of their own, and rows that tie
    for the smallest page_id are all responses. An empty table writes no archive. Other columns are ignored.
    """
    base = new_path(pages.sparkSession, "warc")
    return read_archives(normalise(write_monolithic(pages, base), base), base)
