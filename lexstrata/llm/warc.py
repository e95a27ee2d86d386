"""WARC archives with Zstandard frames and a shared dictionary.

Layout of an archive: one skippable frame (magic 0x184D2A5D) whose content is
the dictionary, then one frame per record.  A payload that occurs more than
once is stored once, in the record of the smallest page_id; the others are
revisit records that name it.

Archives are rows (archive, data BINARY) of a Parquet table in the shared
folder, so that any executor and any file system can read them; ``read_files``
takes real ``.warc.zst`` files through Spark's binaryFile source, whoever wrote
them: the dictionary may be a Zstandard frame itself, frames need not tell the
size of their content, other skippable frames are passed over, and records of
all types are returned (``payload`` is the body of a response, null for a
revisit, and the block for other types).  Ids are text (``record_id``,
``refers_to_id``); page_id and refers_to are the numbers in ids of this writer
and null in others.  Files and records are held whole in a task, so neither may
exceed 2 GB, the most that a value in Spark can have.

Cases: a null html is an empty payload; a null page_id is written as ``-`` and
is never a response to others unless all rows of the payload lack ids; rows
that repeat the smallest page_id of a payload are all responses; the empty
table gives no archive.  Extra columns are ignored.  A damaged archive raises
``WarcError``: bad magic, truncated frame, wrong length, digest or header.
SHA-1 digests of payloads and blocks are checked where a record has them; a
chunked body may be digested with or without its chunk marks.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.llm.memory import tidy
from lexstrata.llm.shared import stored

SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
ARCHIVE_BYTES = 4 << 20  # of payload in an archive
DICTIONARY_BYTES = 16 << 10
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:lexstrata:page:"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, url string, payload binary"
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
#: No record may be longer once it is decompressed.
RECORD_BYTES = (1 << 31) - 1


class WarcError(ValueError):
    pass


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit without a block if refers_to is given."""
    revisit = refers_to is not None
    block = b"" if revisit else HTTP_HEAD + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{RECORD_ID}{'-' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if revisit:
        head += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the archive's first records; raw content where training has too little."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[: DICTIONARY_BYTES // 4]


def write_archive(records: list[bytes]) -> bytes:
    """The archive of some records: dictionary frame first, then a frame for each."""
    samples, size = [], 0
    for r in records:
        if size > 100 * DICTIONARY_BYTES:
            break
        samples.append(r[: 8 * DICTIONARY_BYTES])
        size += len(samples[-1])
    content = trained_dictionary(samples)
    out = [struct.pack("<II", SKIPPABLE_MAGIC, len(content)), content]
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content) if content else None, write_checksum=True, write_content_size=True)
    out += [packer.compress(r) for r in records]
    return b"".join(out)


def frame_end(data: memoryview, at: int) -> int:
    """Offset after the Zstandard frame that starts at ``at``, from its headers alone."""
    if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise WarcError(f"no frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        if at + 3 > len(data):
            raise WarcError("truncated frame")
        head = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise WarcError("truncated frame")
    return at


def skippable_end(data: memoryview, at: int) -> int | None:
    """Offset after a skippable frame, or None if another frame starts at ``at``."""
    if len(data) - at < 8 or struct.unpack_from("<I", data, at)[0] not in SKIPPABLE:
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        raise WarcError("truncated dictionary or skippable frame")
    return end


def decompressed(unpacker: zstandard.ZstdDecompressor, frame: memoryview, most: int) -> bytes:
    """The content of a frame, whether or not its header tells the size."""
    out, size = [], 0
    try:
        with unpacker.stream_reader(frame) as content:
            while part := content.read(min(1 << 20, most + 1 - size)):
                out.append(part)
                size += len(part)
                if size > most:
                    raise WarcError(f"a record has more than {most} bytes")
    except zstandard.ZstdError as e:
        raise WarcError(str(e)) from e
    return b"".join(out)


def read_archive(data: bytes, most: int = RECORD_BYTES) -> Iterator[dict]:
    """The records of an archive, each checked against its headers."""
    view = memoryview(data)
    at, unpacker = 0, zstandard.ZstdDecompressor()
    if (end := skippable_end(view, 0)) and struct.unpack_from("<I", data)[0] == SKIPPABLE_MAGIC:
        content = bytes(view[8:end])
        if content[:4] == struct.pack("<I", FRAME_MAGIC):
            content = decompressed(unpacker, memoryview(content), most)
        if content:
            unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        at = end
    while at < len(data):
        if end := skippable_end(view, at):
            at = end
            continue
        end = frame_end(view, at)
        yield parsed_record(decompressed(unpacker, view[at:end], most))
        at = end


def dechunked(body: bytes) -> bytes | None:
    """The body without the marks of chunked transfer, or None if it has none."""
    out, at = [], 0
    while (line := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:line].partition(b";")[0], 16)
        except ValueError:
            return None
        if not size:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size
    return None


def header_fields(lines: list[str]) -> dict[str, str]:
    """Header lines by lower-case name; a line that starts with white space goes on with the one before."""
    fields: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise WarcError(f"bad header line {line!r}")
        fields[name] = value.strip()
    return fields


def checked_digest(named: str | None, content: bytes, of: str) -> None:
    """Raise if a SHA-1 digest, in base32 or hex, isn't that of the content; other algorithms pass."""
    algorithm, _, digest = (named or "").partition(":")
    if algorithm.lower() != "sha1":
        return
    own = hashlib.sha1(content).digest()
    if digest.upper() not in (base64.b32encode(own).decode(), own.hex().upper()):
        raise WarcError(f"the {of}'s digest is not the header's")


def response_payload(block: bytes, fields: dict[str, str]) -> bytes:
    """The body after an HTTP head, or the whole block of another protocol."""
    kind = fields.get("content-type", "application/http")
    return block.partition(b"\r\n\r\n")[2] if kind.lower().startswith("application/http") else block


def page_number(record_id: str | None) -> int | None:
    number = (record_id or "").removeprefix(RECORD_ID) if (record_id or "").startswith(RECORD_ID) else ""
    return int(number) if number.removeprefix("-").isdecimal() else None


def parsed_record(record: bytes) -> dict:
    head, mark, block = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    fields = header_fields(lines[1:])
    for name in ("warc-type", "warc-record-id", "content-length"):
        if name not in fields:
            raise WarcError(f"{name} is missing")
    length = fields["content-length"]
    if not length.isdecimal() or len(block) != int(length) + 4 or block[-4:] != b"\r\n\r\n":
        raise WarcError("the block's length is not its Content-Length")
    block, kind = block[:-4], fields["warc-type"].lower()
    checked_digest(fields.get("warc-block-digest"), block, "block")
    named = fields.get("warc-payload-digest")
    payload = None if kind == "revisit" else response_payload(block, fields) if kind == "response" else block
    if kind == "response":
        try:
            checked_digest(named, payload, "payload")
        except WarcError:
            if (plain := dechunked(payload)) is None:
                raise
            checked_digest(named, plain, "payload")
    size = fields.get("warc-payload-length")
    if size is not None and (not size.isdecimal() or payload is not None and int(size) != len(payload)):
        raise WarcError("the payload's length is not the header's")
    record_id, refers_to = (fields[n].strip("<>") if n in fields else None for n in ("warc-record-id", "warc-refers-to"))
    return {
        "page_id": page_number(record_id),
        "payload_bytes": int(size) if size is not None else None if payload is None else len(payload),
        "payload_digest": None if named is None else named.removeprefix("sha1:"),
        "record_type": kind,
        "refers_to": page_number(refers_to),
        "record_id": record_id,
        "refers_to_id": refers_to,
        "url": fields.get("warc-target-uri"),
        "payload": payload,
    }


def write_pages(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page; returns the stored table (archive, data) of archives.

    Equal payloads are found by SHA-256 and length: one row per payload after
    partial aggregation, joined back, so a payload of any number of copies is
    never gathered in a task (adaptive execution splits its side of the join).
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("same", F.when(F.octet_length("html") >= min_bytes, F.unhex(F.sha2("html", 256))))
    firsts = rows.where("same is not null").groupBy("same").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = rows.join(firsts, "same", "left").select("page_id", "url", F.encode("html", "UTF-8").alias("payload"), F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{n:06d}"]), pa.array([write_archive(held)], pa.binary())], ["archive", "data"])

        for b in batches:
            for page_id, url, payload, refers_to in zip(*(b.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                payload = payload.as_py()
                held.append(record_bytes(page_id.as_py(), url.as_py(), payload, refers_to.as_py()))
                size += len(payload)
                if size >= archive_bytes:
                    yield flush()
                    n, held, size = n + 1, [], 0
        if held:
            yield flush()

    return stored(rows.mapInArrow(tidy(archives), "archive string, data binary"), "warc")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of rows (data BINARY), checked; columns as in RECORDS."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kept = names if with_payload else names[:-1]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"payload": pa.binary()} | dict.fromkeys(("url", "payload_digest", "record_type", "record_id", "refers_to_id"), pa.string())
        schema = pa.schema([(c, types.get(c, pa.int64())) for c in kept])
        for b in batches:
            for data in b.column(0):
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in kept} for r in read_archive(data.as_py())], schema)

    return archives.select("data").mapInArrow(tidy(records), RECORDS if with_payload else RECORDS.rpartition(",")[0])


def read_files(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Read ``.warc.zst`` files."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("content").alias("data")), with_payload)
