"""WARC derivatives: metadata and plain-text conversion records from responses.

A record is a row: record_id, record_type, target_uri, date, content_type,
refers_to, refers_to_target_uri, refers_to_date, source_headers (the source's WARC
header fields), source_payload_digest, block_digest, payload_digest and block
(bytes).  Derivatives name the response they come from (WARC-Refers-To), keep its
identifier, date, URI, header fields and digests, and get identifiers that follow
from the source's, so reruns agree.

Records are read from WARC files with ``read`` (whole files through Spark's binary
source, cut by Content-Length; gzip members of any number) and written with ``write``
through Spark's text sink, whose line separator is the blank lines that end a record.
A derivative's ``source_headers`` are written too, and read back.

Defined results: a null page or block is empty; a null URI is left out of the header;
blocks that are not HTML convert to an empty text; rows that repeat give equal records;
an empty table gives an empty result; a broken record is a row of type ``unreadable``;
of other columns ``derive`` keeps ``key`` and ``responses`` none.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import common
from quillgraph.llm.htmlmain import plain_text, tokens

#: Stated crawl time of records that are built from a page table.
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, refers_to string, refers_to_target_uri string, refers_to_date string, source_headers map<string,string>, source_payload_digest string, block_digest string, payload_digest string, block binary"
NAMES = [x.split()[0] for x in re.split(r", (?=\w+ )", SCHEMA)]
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace for URLs
#: Elements whose attributes are links out of a page (fixed values).
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src"}
#: A source's header field ``F`` is written as ``Source-F``.
_SOURCE = "Source-"
#: Record type of what ``read`` finds to be no record.
UNREADABLE = "unreadable"
_HEADER_BYTES = 1 << 20
_PIECE = 1 << 20


def digest(block: bytes) -> str:
    """SHA-1 in base 32, as WARC files write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block, usedforsecurity=False).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(31).join(parts))}>"


def _payload(block: bytes, content_type: str) -> tuple[dict[str, str], bytes]:
    """HTTP header fields and body of a block."""
    if not content_type.startswith("application/http"):
        return {}, block
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    return fields, body


def _row(**given) -> dict:
    return dict.fromkeys(NAMES) | given


def responses(pages: DataFrame, date: str = DATE, *, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a page table, with the key as first column ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), *_ARROW])
        for batch in batches:
            rows = []
            for key, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (html or "").encode("utf-8", "surrogatepass")
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                rows.append({"key": key} | _row(record_id=record_id("response", str(key), url or "", date), record_type="response", target_uri=url, date=date, content_type="application/http; msgtype=response", source_headers=[], block_digest=digest(block), payload_digest=digest(body), block=block))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    common.bound_batches(pages.sparkSession)
    picked = pages.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return picked.mapInArrow(run, f"key long, {SCHEMA}")


_ARROW = [(n, pa.map_(pa.string(), pa.string()) if n == "source_headers" else pa.binary() if n == "block" else pa.string()) for n in NAMES]


def header_fields(row: dict) -> dict[str, str]:
    """The WARC header fields of a record row."""
    pairs = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row["date"], "WARC-Target-URI": row["target_uri"],
        "WARC-Refers-To": row["refers_to"], "WARC-Refers-To-Target-URI": row["refers_to_target_uri"], "WARC-Refers-To-Date": row["refers_to_date"],
        "WARC-Block-Digest": row["block_digest"], "WARC-Payload-Digest": row["payload_digest"], "WARC-Source-Payload-Digest": row["source_payload_digest"],
        "Content-Type": row["content_type"], "Content-Length": str(len(row["block"] or b"")),
    }
    return {k: v for k, v in pairs.items() if v is not None}


def _derive(row: dict) -> list[dict]:
    block, kind = row["block"] or b"", row["content_type"] or ""
    http, body = _payload(block, kind)
    is_html = "html" in http.get("content-type", kind)
    html = body.decode("utf-8", "replace") if is_html else ""
    titles, languages, links = [], [], []
    for _, tag, closing, attrs in tokens(html):
        if "#text" in attrs:
            titles.append(("title", " ".join(unescape(attrs["#text"]).split())))
        if tag == "html" and attrs.get("lang"):
            languages.append(("language", attrs["lang"]))
        if tag in _LINKS and not closing and _LINKS[tag] in attrs:
            links.append(("outlink", f"{unescape(attrs[_LINKS[tag]])} {tag}/@{_LINKS[tag]}"))
    fields = [*titles[:1], *languages[:1], *((f"http-{k}", v) for k, v in http.items()), *links]
    meta = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode("utf-8", "replace")
    text = plain_text(html).encode("utf-8", "replace")
    kept = {
        "target_uri": row["target_uri"], "date": row["date"], "refers_to": row["record_id"], "refers_to_target_uri": row["target_uri"], "refers_to_date": row["date"],
        "source_headers": list(header_fields(row | {"block": block}).items()), "source_payload_digest": row["payload_digest"] or digest(body),
    }
    return [
        _row(record_id=record_id(name, row["record_id"] or ""), record_type=name, content_type=content, block=data, block_digest=digest(data), **kept)
        for name, content, data in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text))
    ]


def derive(records: DataFrame) -> DataFrame:
    """Two derivatives of each response; other record types give none.  A column ``key`` of any type comes first; other columns are left out."""
    common.bound_batches(records.sparkSession)
    key = ["key"] if "key" in records.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(k) for k in key), *_ARROW])
            for at in range(0, batch.num_rows, 256):  # derivatives of a slice are in memory together
                rows = [{k: row[k] for k in key} | x for row in batch.slice(at, 256).to_pylist() for x in _derive(row)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    made = "".join(f"key {records.schema[k].dataType.simpleString()}, " for k in key)
    return records.where("record_type = 'response'").select(*key, *NAMES).mapInArrow(run, made + SCHEMA)


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records as WARC files, one a partition; a source's header fields become ``Source-`` fields.

    Blocks are UTF-8 (others: use ``errors='replace'`` upstream).  A compressed file is one gzip stream, as Spark's sink writes it.
    """
    pairs = {
        "WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Date": "date", "WARC-Target-URI": "target_uri", "WARC-Refers-To": "refers_to",
        "WARC-Refers-To-Target-URI": "refers_to_target_uri", "WARC-Refers-To-Date": "refers_to_date", "WARC-Block-Digest": "block_digest",
        "WARC-Payload-Digest": "payload_digest", "WARC-Source-Payload-Digest": "source_payload_digest", "Content-Type": "content_type",
    }
    block = F.coalesce(F.col("block"), F.lit(b""))
    one_line = lambda v: F.regexp_replace(v, "[\r\n]+", " ")
    kept = F.transform(F.map_entries("source_headers"), lambda e: F.concat(F.lit(_SOURCE), one_line(e["key"]), F.lit(": "), one_line(e["value"])))
    kept = F.when(F.size("source_headers") > 0, F.array_join(kept, "\r\n"))
    lines = [F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), one_line(F.col(c))) for k, c in pairs.items()], kept, F.concat(F.lit("Content-Length: "), F.octet_length(block))]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block.cast("string"))
    records.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _pieces(data: bytes) -> Iterator[bytes]:
    """The unzipped bytes of a file, piece by piece; after a broken member it goes on at the next one, with ``None`` between."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + _PIECE] for i in range(0, len(data), _PIECE))
        return
    at = 0
    while at >= 0 and at < len(data):
        member, rest = zlib.decompressobj(31), at
        try:
            while not member.eof and rest < len(data):
                given = data[rest : rest + _PIECE]
                rest += len(given)
                while given:
                    out = member.decompress(given, 4 * _PIECE)
                    given = member.unconsumed_tail
                    if out:
                        yield out
            if not member.eof:
                raise zlib.error("the file ends inside a member")
            rest -= len(member.unused_data)
            at = rest if data[rest : rest + 2] == b"\x1f\x8b" else data.find(b"\x1f\x8b\x08", rest)
        except zlib.error:
            yield None
            at = data.find(b"\x1f\x8b\x08", at + 3)


_FIELD_OF = {
    "warc-type": "record_type", "warc-record-id": "record_id", "warc-date": "date", "warc-target-uri": "target_uri", "content-type": "content_type",
    "warc-refers-to": "refers_to", "warc-refers-to-target-uri": "refers_to_target_uri", "warc-refers-to-date": "refers_to_date",
    "warc-block-digest": "block_digest", "warc-payload-digest": "payload_digest", "warc-source-payload-digest": "source_payload_digest",
}


def _fields(head: bytes) -> tuple[dict, int | None]:
    """A record row of header lines, and the block's length if it is a number."""
    row, length, kept = _row(), None, []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        low, value = name.strip().lower(), value.strip()
        if low == "content-length":
            length = int(value) if value.isascii() and value.isdigit() else None
        elif low in _FIELD_OF:
            row[_FIELD_OF[low]] = value
        elif low.startswith(_SOURCE.lower()):
            kept.append((name.strip()[len(_SOURCE) :], value))
    row["source_headers"] = list(dict(kept).items())
    return row, length


def parse(data: bytes) -> Iterator[dict]:
    """The record rows of a WARC file's bytes.

    What is no record (a broken header, no length, bytes between records, a broken
    gzip member, a block that the file's end cuts) is a row of type ``unreadable`` that
    holds its bytes, and reading goes on behind it.
    """
    buffer, pieces = bytearray(), _pieces(data)
    broken = False

    def more() -> bool:
        nonlocal broken
        piece = next(pieces, b"")
        if piece is None:
            broken = True
            return False
        buffer.extend(piece)
        return bool(piece)

    def unreadable(size: int) -> dict:
        found = bytes(buffer[:size])
        del buffer[:size]
        return _row(record_type=UNREADABLE, source_headers=[], block=found)

    while True:
        if broken:
            # What came before the break is no whole record; what comes after begins anew.
            broken = False
            yield unreadable(len(buffer))
        blank = len(buffer) - len(buffer.lstrip(b"\r\n"))
        del buffer[:blank]
        if len(buffer) < 7:
            if more() or broken:
                continue
            if buffer:
                yield unreadable(len(buffer))
            return
        if not buffer.startswith(b"WARC/1."):
            start = buffer.find(b"\nWARC/1.")
            if start < 0 and (more() or broken):
                continue
            yield unreadable(start + 1 if start >= 0 else len(buffer))
            continue
        end = buffer.find(b"\r\n\r\n", 0, _HEADER_BYTES)
        if end < 0:
            if len(buffer) < _HEADER_BYTES and (more() or broken):
                continue
            yield unreadable(7)
            continue
        row, length = _fields(bytes(buffer[:end]))
        if length is None:
            yield unreadable(end + 4)
            continue
        while len(buffer) < end + 4 + length and more():
            pass
        if broken:
            continue
        if len(buffer) < end + 4 + length:
            yield unreadable(len(buffer))
            continue
        row["block"] = bytes(buffer[end + 4 : end + 4 + length])
        del buffer[: end + 4 + length]
        yield row


def read(spark: SparkSession, path: str) -> DataFrame:
    """Record rows of WARC files below a path (plain or gzip), unreadable parts included as rows of that type.

    A file is one value of Spark's binary source, 2 GB at most, and is unzipped piece by piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for row in parse(data.as_py()):
                    rows.append(row)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_ARROW))
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_ARROW))

    common.bound_batches(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)
