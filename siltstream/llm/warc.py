"""WARC archives with an index that comes first, and coalesced reads by it (operator 6)."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.llm.shared import shared_folder

#: Payloads of fewer bytes are written in full each time.
LEAST_BYTES = 0
#: Bytes that may be read in vain between two records, and bytes of one read at most
#: (a longer record is read alone).
GAP, MOST_READ = 1 << 16, 8 << 20

# The revisit profile of the standard, and a date for pages without one.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
NAME = "urn:page:"
BREAKS = re.compile(r"[\x00-\x20\x7f]")

INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"
INDEX_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("url", pa.string()),
        ("digest", pa.string()),
        ("record_type", pa.string()),
    ]
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to=None) -> bytes:
    """One gzip member: a response, or without ``payload`` a revisit of ``refers_to``. The
    HTTP header of either tells the bytes of the full payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if payload is not None else "revisit"
    fields = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{NAME}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        # Blanks and control characters would end the field.
        fields.append("WARC-Target-URI: " + BREAKS.sub(lambda m: f"%{ord(m[0]):02X}", url))
    fields.append(f"WARC-Payload-Digest: sha1:{digest}")
    if payload is None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{NAME}{refers_to}>"]
    else:
        block += payload
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    head = "WARC/1.1\r\n" + "\r\n".join(fields) + "\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def named(value: str | None) -> int | None:
    number = (value or "").removeprefix(f"<{NAME}").removesuffix(">")
    return int(number) if number else None


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes a record per page to archives in ``folder`` and returns their index.

    Of pages with equal payloads (``html`` in UTF-8, null: empty) of ``least_bytes`` or more,
    the one with the largest ``page_id`` is a response and the others revisit it; smaller
    payloads are all responses. The index, a table in the same folder, holds ``page_id``,
    ``file``, ``offset``, ``length``, ``url``, ``digest`` (base32 SHA-1 of the payload) and
    ``record_type``.

    A task writes one archive under a name of its own attempt, and only the index rows of
    attempts that succeeded count, so a lost executor leaves at worst a file nobody reads.
    Records are compressed before they are joined with their roles; the roles are narrow and
    hold the repeated payloads only.

    Rows that repeat both ``page_id`` and payload are equally large and stay responses, or
    all revisit a larger one. A null ``page_id`` is smaller than any; a null ``url`` has no
    field. An empty table gives an empty index. Other columns are not read.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    keys = pages.select("page_id", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("size"))
    keys = keys.where(F.col("size") >= least_bytes)
    sums = keys.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    roles = keys.join(sums, "sha1").where("refers_to is not null and not page_id <=> refers_to")
    roles = roles.select(F.col("page_id").alias("other"), F.col("sha1").alias("other_sha1"), "refers_to").distinct()

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "digest", "sha1", "size", "member"]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = []
                for page, url, html in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)):
                    data = (html or "").encode()
                    digest = base32_sha1(data)
                    sha1 = hashlib.sha1(data).hexdigest()
                    rows.append((page, url, digest, sha1, len(data), record(page, url, digest, len(data), data)))
                types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, offset = TaskContext.get(), None, 0
        file = f"{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        store, root = fs.FileSystem.from_uri(f"{folder}/archives")
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{file}", compression=None)
            rows = []
            for page, url, digest, size, member, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                kind = "response"
                if refers_to is not None:
                    kind, member = "revisit", record(page, url, digest, size, None, refers_to)
                out.write(member)
                rows.append((page, file, offset, len(member), url, digest, kind))
                offset += len(member)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), INDEX_SCHEMA)], schema=INDEX_SCHEMA
            )
        if out is not None:
            out.close()

    rows = pages.select("page_id", "url", "html").mapInArrow(
        compressed, "page_id long, url string, digest string, sha1 string, size long, member binary"
    )
    same = (rows["sha1"] == roles["other_sha1"]) & rows["page_id"].eqNullSafe(roles["other"])
    rows = rows.join(roles, same, "left").select("page_id", "url", "digest", "size", "member", "refers_to")
    rows.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def ranges(rows: list[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, int, int]]:
    """``(file, start, end, first row, row after the last)`` of reads that cover rows
    ``(file, offset, length)`` sorted by file and offset."""
    first = 0
    for k in range(1, len(rows) + 1):
        file, start, _ = rows[first]
        end = rows[k - 1][1] + rows[k - 1][2]
        if k == len(rows) or rows[k][0] != file or rows[k][1] > end + gap or rows[k][1] + rows[k][2] - start > most:
            yield file, start, end, first, k
            first = k


def read_records(
    index: DataFrame, folder: str, payloads: bool = True, gap: int = GAP, most_read: int = MOST_READ
) -> DataFrame:
    """Reads the records that ``index``, or any selection of its rows, names.

    Rows are sorted by file and offset, and neighbours up to ``gap`` bytes apart are fetched
    by one read of up to ``most_read`` bytes. Returns ``page_id``, ``url``, ``record_type``,
    ``refers_to``, ``payload_bytes`` and ``payload_digest`` of the full payload, and the
    ``payload`` (null for revisits). A response whose payload does not match its digest
    raises an error. An empty selection gives no rows; other columns are not read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(f"{folder}/archives")
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for file, start, end, first, last in ranges(rows, gap, most_read):
                with store.open_input_file(f"{root}/{file}") as source:
                    data = source.read_at(end - start, start)
                found = [one(data[o - start : o - start + n]) for _, o, n in rows[first:last]]
                types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found), types)],
                    ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"],
                )

    def one(member: bytes) -> tuple:
        fields, block = parse(member)
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = fields["WARC-Type"]
        if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
        payload = payload if payloads and kind == "response" else None
        names = named(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI")
        return *names, kind, named(fields.get("WARC-Refers-To")), size, digest, payload

    rows = index.select("file", "offset", "length").repartitionByRange("file", "offset")
    return rows.sortWithinPartitions("file", "offset").mapInArrow(
        read,
        "page_id long, url string, record_type string, refers_to long, payload_bytes long,"
        " payload_digest string, payload binary",
    )
