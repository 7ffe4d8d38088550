"""WARC archives compressed with Zstandard: a dictionary in a leading skippable frame, then one frame for
each record.

write() turns rows into archives of bounded size; read() finds the dictionary, cuts the frames by their
block headers, decodes each, and validates the version line, the required header fields, the lengths and
the digests. Archives travel as rows (name, content), which any store that Spark writes can hold; save() and
load() exchange them with .warc.zst files.

Of records with equal payloads of at least LEAST_REVISIT bytes the one with the largest id is a response and
the others are revisits of it, without the payload.

Defined results: a null payload is empty; a null id is written and read back as null, and never is the
largest; rows that share the largest id of their payload are all responses; a null target is left out;
control characters and blanks in a target are percent-encoded; a record of any length is one frame; equal
rows give equal records; an empty table gives no archives; only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import BROADCAST_IDS, bounded_sample, join_hot, limit_batches

#: Fixed values of the formats.
DICTIONARY_FRAME, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_REVISIT = 1000
#: Compressed bytes of an archive, about; payloads that the dictionary is trained on, and their bytes, at most.
ARCHIVE_BYTES, SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 4 << 20, 1000, 4096, 32 << 10
LEVEL, DATE = 6, "2024-01-01T00:00:00Z"
ID = "urn:textloom:record:"


def train(rows: DataFrame, id_col: str, payload_col: str) -> bytes:
    """A dictionary from the beginnings of a bounded sample of the payloads."""
    start = F.substring(F.coalesce(F.col(payload_col), F.lit("")), 1, SAMPLE_BYTES)
    sample = bounded_sample(rows.select(F.col(id_col).alias("id"), start.alias("start")), SAMPLE_ROWS).orderBy("id", "start")
    texts = [_record(f"<{ID}{r.id}>", "response", "http://example.com/", r.start.encode(), "", None, DATE) for r in sample.limit(2 * SAMPLE_ROWS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:  # too few samples: the headers alone help
        return _record(f"<{ID}0>", "response", "http://example.com/", b"", "", None, DATE)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(record_id: str, kind: str, target: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A record; a revisit's block has the HTTP header but not the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date)]
    if target is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", target)))
    fields += [("WARC-Payload-Digest", digest or _sha1(payload)), ("WARC-Block-Digest", _sha1(block))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", refers_to), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def with_types(rows: DataFrame, id_col: str, payload_col: str, target_col: str, least: int = LEAST_REVISIT) -> DataFrame:
    """(id, target, payload, digest, refers_to): refers_to is the id that a revisit points to, else null."""
    own = rows.select(F.col(id_col).alias("id"), F.col(target_col).alias("target"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    own = own.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = own.where(F.octet_length("payload") >= least).select("id", "digest")
    groups = large.groupBy("digest").agg(F.max("id").alias("largest"), F.count("*").alias("count")).where("count > 1")
    n = groups.count()
    if n <= BROADCAST_IDS // 8:
        joined = own.join(F.broadcast(groups.select("digest", "largest")), "digest", "left")
    else:
        joined = join_hot(own, groups.select("digest", "largest"), "digest", own.count(), "left", counts=groups.select("digest", "count"))
    revisit = F.col("largest").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("largest")))
    return joined.select("id", "target", "payload", "digest", F.when(revisit, F.col("largest")).alias("refers_to"))


def write(typed: DataFrame, dictionary: bytes, date: str = DATE) -> DataFrame:
    """(name, content): archives of the rows that with_types() gives."""
    limit_batches(typed.sparkSession)

    def run(batches):
        trained = zstandard.ZstdCompressionDict(dictionary, zstandard.DICT_TYPE_AUTO)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
        # The dictionary itself may be compressed in its frame.
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
        head = struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
        task, n, parts, size = TaskContext.get().partitionId(), 0, [head], len(head)

        def archive():
            return pa.RecordBatch.from_pydict({"name": [f"part-{task:06d}-{n:06d}.warc.zst"], "content": [b"".join(parts)]})

        for batch in batches:
            for own, target, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("id", "target", "payload", "digest", "refers_to")), strict=True):
                to = None if refers is None else f"<{ID}{refers}>"
                hashed = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
                record = _record(f"<{ID}{'' if own is None else own}>", "response" if to is None else "revisit", target, payload.encode(), hashed, to, date)
                parts.append(packer.compress(record))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    n, parts, size = n + 1, [head], len(head)
        if len(parts) > 1:
            yield archive()

    return typed.mapInArrow(run, "name string, content binary")


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends, by its header and block headers."""
    if struct.unpack_from("<I", data, at)[0] != FRAME:
        raise ValueError(f"no Zstandard frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        block = int.from_bytes(data[at : at + 3], "little")
        kind = block >> 1 & 3
        if kind == 3:
            raise ValueError(f"a bad block at byte {at}")
        at += 3 + (1 if kind == 1 else block >> 3)
        if block & 1:
            at += 4 * (flags >> 2 & 1)
            if at > len(data):
                raise ValueError("a frame is cut off")
            return at


def records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields (names in lower case) and block of each record of an archive."""
    data = memoryview(content)
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        at = 8 + size
        if at > len(data):
            raise ValueError("the dictionary is cut off")
        raw = bytes(data[8:at])
        if size >= 4 and struct.unpack_from("<I", raw)[0] == FRAME:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw, zstandard.DICT_TYPE_AUTO)
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError(f"bytes that are no frame at byte {at}")
        if struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == 0x184D2A50:  # other skippable frames
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        end = _frame_end(data, at)
        unpacked = unpacker.decompressobj()
        try:
            record = unpacked.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise ValueError(f"the frame at byte {at} is broken: {e}") from e
        yield at, *_parsed(record, at)
        at = end


def _parsed(record: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record, both validated."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError(f"the record at byte {at} has no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"the record at byte {at} has a bad header line")
        fields[name.lower()] = value.strip()
    if missing := [f for f in REQUIRED if f not in fields]:
        raise ValueError(f"the record at byte {at} lacks {', '.join(missing)}")
    if not fields["content-length"].isdecimal() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"the record at byte {at} does not have its stated length")
    block = rest[:-4]
    if fields.get("warc-block-digest", _sha1(block)) != _sha1(block):
        raise ValueError(f"the record at byte {at} does not have its stated digest")
    return fields, block


def read(archives: DataFrame, name_col: str = "name", content_col: str = "content") -> DataFrame:
    """A row for each response and revisit: (archive, byte_offset, record_type, record_id, target, date,
    refers_to, payload_digest, payload_bytes, payload). Digest (bare hex SHA-1) and length of a response
    are those of the payload read; a revisit, whose payload is null, states them. A broken archive is an error."""
    limit_batches(archives.sparkSession)

    def row(archive, at, fields, block):
        head, _, payload = block.partition(b"\r\n\r\n")
        kind = fields["warc-type"]
        stated = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
        digest = base64.b32decode(fields.get("warc-payload-digest", "sha1:").removeprefix("sha1:")).hex()
        if kind == "response":
            own = hashlib.sha1(payload).hexdigest()
            if (digest and own != digest) or (stated and int(stated[1]) != len(payload)):
                raise ValueError(f"the payload at byte {at} of {archive} does not have its stated digest and length")
            digest, size = own, len(payload)
        else:
            payload, size = None, int(stated[1]) if stated else None
        return archive, at, kind, fields["warc-record-id"], fields.get("warc-target-uri"), fields["warc-date"], fields.get("warc-refers-to"), digest, size, payload

    names = ["archive", "byte_offset", "record_type", "record_id", "target", "date", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for at, fields, block in records(content.as_py()):
                    if fields["warc-type"] in ("response", "revisit"):
                        rows.append(row(archive, at, fields, block))
                        size += len(block)
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "archive string, byte_offset long, record_type string, record_id string, target string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
    return archives.select(name_col, content_col).mapInArrow(run, schema)


def record_key(column: str) -> F.Column:
    """The id that write() put into a record id."""
    return F.regexp_extract(column, f"<{ID}(.*)>", 1)


def save(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file of its name into a folder that all executors reach by a URI.
    A task that is run again writes the same files."""

    def run(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with store.open_output_stream(f"{path}/.{name}.part") as f:
                    f.write(content.as_py())
                store.move(f"{path}/.{name}.part", f"{path}/{name}")
        return
        yield

    limit_batches(archives.sparkSession)
    archives.select("name", "content").mapInArrow(run, "name string").count()


def load(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the .warc.zst files under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
