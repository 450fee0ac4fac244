"""Zstandard-compressed WARC archives: a writer with revisit records and a reader."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import materialize

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = 0xFD2FB528
#: An empty skippable frame; Spark's text writer puts it after each record, and readers pass over it.
SEPARATOR = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A dictionary is trained on an archive's first records, up to so many bytes of them.
TRAIN_BYTES, DICTIONARY_BYTES = 1 << 20, 16 << 10
#: Compressed bytes at which a new archive begins; a reader holds one archive at a time.
ARCHIVE_BYTES = 32 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(x: object) -> str:
    """Control characters would end a header early, so they are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(x))


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit carries the HTTP header only; the payload is in the record that it refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Target-URI": _header_value("" if url is None else url),
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    headers |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block; raises ValueError unless version, headers and lengths are right."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError(f"not a {VERSION.decode()} record: {raw[:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"bad header line {line[:80]!r}")
        headers[name.decode().lower()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name}")
    if not re.fullmatch(r"\d+", headers["content-length"]):
        raise ValueError(f"bad content-length {headers['content-length']!r}")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"content-length {n}, but {len(rest)} bytes follow the headers")
    return headers, rest[:n]


def parse_http(headers: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """The payload in a response's block and the length of the full payload, both checked."""
    head, found, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", head)
    if not found or not head.startswith(b"HTTP/") or not length:
        raise ValueError("the block is no HTTP response with a length")
    n = int(length[1])
    if headers["warc-type"] == "response":
        if len(payload) != n:
            raise ValueError(f"HTTP content-length {n}, payload {len(payload)}")
        if headers.get("warc-payload-digest") != f"sha1:{payload_digest(payload)}":
            raise ValueError("the payload doesn't match its digest")
    elif payload:
        raise ValueError("a revisit carries a payload")
    return payload, n


def _frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its block headers."""
    parameters = zstandard.get_frame_parameters(data[at : at + 18])
    at += zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        word = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = word & 1, word >> 1 & 3, word >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * parameters.has_checksum


def read_frames(data: bytes) -> Iterator[bytes]:
    """The content of each frame of an archive. A leading skippable frame holds the dictionary, itself compressed or not."""
    view, at, reader = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic in SKIPPABLE:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            body = bytes(view[at + 8 : at + 8 + size])
            if len(body) != size:
                raise ValueError("a skippable frame is cut off")
            if magic == DICTIONARY_FRAME and not at:
                if body[:4] == FRAME.to_bytes(4, "little"):
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
            continue
        if magic != FRAME:
            raise ValueError(f"no frame at byte {at}")
        end = _frame_end(view, at)
        if end > len(view):
            raise ValueError("a frame is cut off")
        yield reader.decompressobj().decompress(view[at:end])
        at = end


def _compress(records: Iterator[bytes], level: int, most: float = float("inf")) -> Iterator[bytes]:
    """A dictionary frame, then one frame for each record, until the frames have ``most`` bytes; what it trains on is always written."""
    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if size >= TRAIN_BYTES:
            break
    if not first:
        return
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, first)
    except zstandard.ZstdError:  # too few or too small records to train on: their bytes serve as they are
        dictionary = zstandard.ZstdCompressionDict(b"".join(first)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    body = dictionary.as_bytes()
    yield DICTIONARY_FRAME.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body
    writer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    size = len(body)
    for r in first:
        frame = writer.compress(r)
        size += len(frame)
        yield frame
    while size < most and (r := next(records, None)) is not None:
        frame = writer.compress(r)
        size += len(frame)
        yield frame


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 6, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a WARC record for each page into Zstandard archives under ``path``; a new one begins at ``archive_bytes`` bytes.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest id becomes a response and the
    others revisit it. Digests are computed in one narrow pass and pre-aggregated, so a payload that fills a third of
    the table is one row per partition; the pages themselves are shuffled once, by digest, in a join whose hot
    partitions adaptive execution splits. Spark's own text writer stores each archive as a file of one row, so any file system that Spark knows
    will do and a lost task leaves no half archive.

    Null html is an empty payload, a null url an empty one; null ids rank below all others. Rows that share id and
    payload are all responses if that id is the largest. Other columns are ignored. An empty table writes no records.
    """
    payload = F.coalesce(pages[f"`{html_col}`"], F.lit("")).cast("binary")
    keyed = pages.select(pages[f"`{id_col}`"].alias("page_id"), pages[f"`{url_col}`"].alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    first = materialize(keyed.groupBy("sha1").agg(F.max("page_id").alias("first")), "payloads")
    joined = keyed.join(first, "sha1").select("page_id", "url", "payload", "first")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for page_id, url, body, first_id in zip(*(batch.column(k) for k in range(4)), strict=True):
                    page_id, body, first_id = page_id.as_py(), body.as_py(), first_id.as_py()
                    revisit = len(body) >= min_bytes and page_id != first_id
                    yield make_record(page_id, url.as_py(), body, payload_digest(body), revisit, first_id, date)

        rest = records()
        while whole := b"".join(_compress(rest, level, archive_bytes)):
            yield pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], ["frames"])

    joined.mapInArrow(archive, "frames binary").select(F.col("frames").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Reads archives: one frame per record, with headers, lengths and digests checked; a bad one raises ValueError.

    Returns ``record_id, record_type, target_uri, date, payload_digest, payload_bytes, refers_to, payload``; the
    payload of a revisit is null. Archives without records give no rows.
    """
    schema = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for raw in read_frames(content.as_py()):
                    headers, block = parse_record(raw)
                    payload, n = parse_http(headers, block)
                    revisit = headers["warc-type"] == "revisit"
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    rows.append((headers["warc-record-id"], headers["warc-type"], headers.get("warc-target-uri"), headers["warc-date"], digest, n, headers.get("warc-refers-to"), None if revisit else payload))
                    size += len(raw)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, schema)
