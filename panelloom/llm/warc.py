"""WARC archives: one gzip member per record, written by partition and read back sequentially.

Records of one digest share a payload: that with the largest page_id holds it, the others are revisits that name it.
Archives are written and read through the file system that the path's scheme names (pyarrow.fs), under a
temporary name and then renamed, so that a task that runs twice leaves the same files. An archive is closed when it has reached a
size, so their number grows with the pages, and each is read by a task of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import shared_dir, stored

_CHUNK = 1 << 16
_PAGE = "urn:x-page:"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_value(text: str) -> str:
    """One line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", text)


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    """A record as one gzip member; with ``refers_to`` it is a revisit, which leaves the payload out."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_PAGE}{'none' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {_header_value(url)}"] if url else []
    lines += [f"WARC-Refers-To: <{_PAGE}{refers_to}>", f"WARC-Profile: {_REVISIT}"] if refers_to is not None else []
    lines += [f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, inflated one by one as their bytes arrive; a cut member is an error."""
    inflate, parts, left = zlib.decompressobj(31), [], b""
    while True:
        data = left or stream.read(_CHUNK)
        left = b""
        if not data:
            if parts:
                raise ValueError("the archive ends inside a record")
            return
        parts.append(inflate.decompress(bytes(data)))
        if inflate.eof:
            left = inflate.unused_data
            yield b"".join(parts)
            inflate, parts = zlib.decompressobj(31), []


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the block, framed by its content length and checked by its digest."""
    head, mark, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} isn't as long as it says")
    if fields.get("warc-block-digest", _sha1(block)) != _sha1(block):
        raise ValueError(f"record {fields.get('warc-record-id')} has another block digest")
    return fields, block


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(_PAGE)
    return int(number) if re.fullmatch(r"-?[0-9]+", number) else None


def unpack(member: bytes) -> dict:
    """A page record: ids, type, payload (None for a revisit), its full size and digest."""
    fields, block = parse(member)
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length: *([0-9]+)\r?$", head)[1])
    digest = fields["warc-payload-digest"]
    full = fields["warc-type"] == "response"
    if full and (len(payload) != size or _sha1(payload) != digest):
        raise ValueError(f"record {fields['warc-record-id']} has another payload digest")
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload": payload if full else None,
        "payload_bytes": size, "payload_digest": base64.b32decode(digest.removeprefix("sha1:")).hex(), "refers_to": _page(fields.get("warc-refers-to")),
    }


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, url, html, refers_to): who refers to whom, by digest and size of payloads from ``least_bytes``.

    Only ids, digests and sizes meet by digest. The texts are joined by page_id, so that a payload that a third of
    all pages share isn't one task's load; who holds it is written first, so that adaptive execution can split the join
    on a digest that very many pages have. Rows with a null page_id refer to nothing and nothing refers to them.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    light = rows.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size")).where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull())
    many = light.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    many = stored(many, "payloads")
    again = light.join(many, ["digest", "size"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    return rows.withColumn("digest", F.sha1("html")).join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 1 << 30) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html, refers_to), one or more a partition: (path, records, bytes).

    An archive that has reached ``archive_bytes`` is closed and the next one opened; a record is never cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        number = n = size = 0
        out = None

        def closed() -> pa.RecordBatch:
            nonlocal number, n, size, out
            out.close()
            if store.get_file_info(name).type != fs.FileType.NotFound:
                store.delete_file(name)  # of an attempt that was lost after this step
            store.move(draft, name)
            row = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})
            number, n, size, out = number + 1, 0, 0, None
            return row

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    name = f"{base}/part-{context.partitionId():05d}-{number:04d}.warc.gz"
                    draft = f"{name}.{context.taskAttemptId()}.tmp"
                    out = store.open_output_stream(draft, compression=None)
                data = record(*(x.as_py() for x in row))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    yield closed()
        if out is not None:
            yield closed()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long, bytes long")


_READ = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
_READ_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in column path, each read as a stream from front to back, digests verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(place, compression=None) as stream:
                    for member in members(stream):
                        row = unpack(member)
                        held += len(row["payload"] or b"")
                        rows.append(row if payloads else row | {"payload": None})
                        if len(rows) >= 2000 or held > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)

    return paths.select("path").mapInArrow(run, _READ)


def round_trip(pages: DataFrame, least_bytes: int = 1000, payloads: bool = False, archive_bytes: int = 1 << 30) -> DataFrame:
    """``pages`` (page_id, url, html; others are ignored, whatever their names) written to new archives in the shared folder and read back.

    Null html is an empty payload, a null url has no target field. Repeated rows are records of their own; of equal
    payloads under one largest page_id all rows with that id are responses. A very long page is one record, whole in memory on its
    way in and out. An empty table makes no archive and no rows. Archives are read in as many partitions as there are.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    made = stored(write_archives(with_revisits(pages, least_bytes), folder, archive_bytes), "archives")
    # The number is said, as adaptive execution would put a handful of short rows into one partition.
    return read_archives(made.repartitionByRange(max(1, made.count()), "path"), payloads)
