"""WARC archives in Zstandard: a writer and a reader.

An archive is one dictionary, in a leading skippable frame, and one frame a record. The reader
loads the dictionary, decodes frame by frame, and validates each record: version line, header
syntax, the mandatory headers, block length, the closing line ends, that the frame ends there,
and both digests. A record that fails carries what is wrong in ``error``; a broken frame, after
which no further record can be found, fails the read.

The writer makes a response of each page, or a revisit if a page with a smaller id has the
same payload of at least ``min_bytes`` bytes. The zstd dictionary is fitted on at most
``SAMPLES`` payloads of ``SAMPLE_BYTES`` bytes each; it changes sizes of files, no result.

Defined results: a null payload is empty; a null url is left out of the record and read back
as null; rows with equal page_id and payload are all responses if that id is the smallest;
a null page_id is never the smallest, and is read back as null; a payload of any length is one
record; an empty table makes no archive and reads back as an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.llm.common import new_folder, open_input, open_output, prepared, sampled, staged

DICTIONARY_FRAME, ANY_FRAME = 0x184D2A5D, 0xFD2FB528
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 256, 16_384, 65_536, 3
SMALL = 500_000
#: Records or bytes of payload that a batch of the reader holds at most, but for one record.
READ_ROWS, READ_BYTES, READ_AT_ONCE = 256, 8 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:page:"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record with a whole HTTP response, or with its head alone for a revisit."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head += [f"WARC-Record-ID: <{_PAGE}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='/:?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_PAGE}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    else:
        block += payload
    head += [f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The fields of a record; ``error`` says what is wrong with it, if anything."""
    out: dict = {"record_type": None, "page_id": None, "url": None, "refers_to": None, "payload": None, "payload_bytes": None, "payload_digest": None, "error": None}

    def fails(why: str) -> dict:
        return out | {"error": why}

    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return fails("no WARC version line or no end of the header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip() or name.lower() in fields:
            return fails(f"bad header line: {line[:80]!r}")
        fields[name.lower()] = value.strip()
    if missing := [n for n in ("warc-type", "warc-record-id", "warc-date", "content-length") if n not in fields]:
        return fails(f"missing {', '.join(missing)}")
    out["record_type"], out["url"] = fields["warc-type"], fields.get("warc-target-uri")
    ids = {k: fields.get(h, "").removeprefix(f"<{_PAGE}").removesuffix(">") for k, h in (("page_id", "warc-record-id"), ("refers_to", "warc-refers-to"))}
    out |= {k: int(v) for k, v in ids.items() if v.removeprefix("-").isdigit()}
    if not fields["content-length"].isdigit():
        return fails("Content-Length is no number")
    n = int(fields["content-length"])
    if len(rest) < n:
        return fails(f"the block has {len(rest)} of {n} bytes")
    if rest[n:] != b"\r\n\r\n":
        return fails("the block is not followed by two line ends and the end of the frame")
    block = rest[:n]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        return fails("the block digest differs")
    out["payload_digest"] = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if "http" in fields.get("content-type", ""):
        http, _, body = block.partition(b"\r\n\r\n")
        length = next((x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), b"")
        out["payload_bytes"] = int(length) if length.isdigit() else len(body)
    else:
        body = block
        out["payload_bytes"] = len(body)
    if out["record_type"] == "response":
        if len(body) != out["payload_bytes"]:
            return fails("the payload is not as long as its own header says")
        if out["payload_digest"] not in (None, digest(body)):
            return fails("the payload digest differs")
        out["payload"] = body
    elif out["record_type"] == "revisit" and "warc-refers-to" not in fields:
        return fails("a revisit without WARC-Refers-To")
    return out


def frames(f) -> Iterator[tuple[int, bytes]]:
    """(place, record) of each frame of an archive, decoded with the dictionary at its start."""
    data, at, end = b"", 0, False

    def more() -> bool:
        nonlocal data, end
        got = f.read(READ_AT_ONCE)
        data, end = data + got, not got
        return bool(got)

    while len(data) < 8 and more():
        pass
    options = {}
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", data[4:8])[0]
        while len(data) < 8 + size:
            if not more():
                raise ValueError("the dictionary frame is cut short")
        raw = data[8 : 8 + size]
        if raw[:4] == struct.pack("<I", ANY_FRAME):  # the dictionary itself may be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
        options["dict_data"] = zstandard.ZstdCompressionDict(raw)
        data, at = data[8 + size :], 8 + size
    reader = zstandard.ZstdDecompressor(**options)
    while data or more():
        while len(data) < 8 and more():
            pass
        if len(data) >= 8 and struct.unpack("<I", data[:4])[0] & 0xFFFFFFF0 == 0x184D2A50:  # skippable: no record
            size = 8 + struct.unpack("<I", data[4:8])[0]
            while len(data) < size:
                if not more():
                    raise ValueError(f"the frame at {at} is cut short")
            data, at = data[size:], at + size
            continue
        one, parts, fed = reader.decompressobj(), [], 0
        while True:
            parts.append(one.decompress(data))
            fed += len(data)
            if one.eof:
                break
            data = b""
            if not more():
                raise ValueError(f"the frame at {at} is cut short")
        data = one.unused_data
        yield at, b"".join(parts)
        at += fed - len(data)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload`` and ``refers_to`` (null for a response) of each page.

    Only payload digests travel; digests that repeat are broadcast while they are few.
    """
    own = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    key = F.when(F.length("payload") >= min_bytes, F.concat_ws("-", F.sha1("payload"), F.length("payload").cast("string")))
    twice = own.select("page_id", key.alias("key")).where("key is not null").groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    twice = staged(twice.select("key", "first"), "payloads")
    side = F.broadcast(twice) if twice.count() <= SMALL else twice
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return own.withColumn("key", key).join(side, "key", "left").select("page_id", "url", "payload", F.when(other, F.col("first")).alias("refers_to"))


def dictionary(pages: DataFrame) -> bytes:
    """A zstd dictionary from a bounded sample of payloads."""
    heads = pages.where("html is not null").select("page_id", F.substring(F.col("html").cast("binary"), 1, SAMPLE_BYTES).alias("head"))
    rows = [bytes(r["head"]) for r in sampled(heads, "page_id", SAMPLES).collect()]
    rows = sorted(r for r in rows if len(r) >= 8)
    if len(rows) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, rows).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(rows)[-DICTIONARY_BYTES:]


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html), one a task; returns a staged table (path, records, bytes).

    A task names its file by itself and only files of tasks that ended are in the table, so
    attempts that fail or run twice leave nothing that is read.
    """
    raw = dictionary(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, records, size = f"{folder}/{uuid.uuid4().hex}.warc.zst", None, 0, 0
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **({"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}))
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = open_output(path)
                    if raw:
                        size += out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
                size += out.write(packer.compress(record(page_id, url, payload, refers_to)))
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

    rows = with_revisits(pages, min_bytes).select("page_id", "url", "payload", "refers_to")
    return staged(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


RECORD = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType()),
    ]
)


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives in column ``path``; without ``payloads`` they are checked but not returned."""
    schema = to_arrow_schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_input(path) as f:
                    for at, data in frames(f):
                        row = parsed(data) | {"path": path, "offset": at}
                        size += len(data)
                        rows.append(row if payloads else row | {"payload": None})
                        if len(rows) >= READ_ROWS or size >= READ_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    files = archives.select("path")
    n = max(1, min(files.count(), 100_000))
    return files.repartition(n).mapInArrow(run, RECORD)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = prepared(spark).read.parquet(f"{sf_dir}/pages.parquet")
    records = read(write(pages, new_folder(spark, "warc")), payloads=False)
    bad = F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("error"))).cast("string")
    return records.select(
        "page_id", "payload_bytes", "payload_digest", F.when(F.col("error").isNull(), F.col("record_type")).otherwise(bad).alias("record_type"), "refers_to"
    )
