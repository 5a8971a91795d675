"""WARC derivatives: responses become linked metadata and plain-text conversion records.

``derive`` parses each response record (WARC and HTTP headers) and writes a ``metadata`` record (JSON:
source headers, title, links) and a ``conversion`` record (plain text), each with WARC-Refers-To of the
response, WARC-Concurrent-To of the other, the target URI, date and payload digest of the response, all its
WARC headers as ``X-Source-`` fields, and a block digest of its own. The digest that a response states is compared
with its payload; ``source_digest`` and the field X-Source-Digest-Check tell the outcome: verified, mismatch,
unknown (an algorithm not known here) or absent. The payload digest written is always that of the payload. A record that is not a
well-formed response, or null, gives nulls and the status ``malformed``; an empty body gives empty text. Chunked and gzip
bodies are decoded for text and links; digests are those of the payload as it was sent. Pages of any length are read in linear time.
Repeated records give equal derivatives: identifiers are made from content. Columns named as a result are replaced; an
empty table gives none.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

FIELDS = [("status", "string"), ("response_id", "string"), ("target_uri", "string"), ("warc_date", "string"), ("payload_digest", "string"), ("metadata_id", "string"), ("conversion_id", "string"), ("metadata_record", "binary"), ("conversion_record", "binary"), ("title", "string"), ("plain_text", "string"), ("n_links", "long"), ("source_digest", "string")]


def response_record(url: Column, body: Column, date: str) -> Column:
    """A response record (binary) for a page, as a crawler would have written it."""
    body = F.coalesce(body, F.lit("")).cast("binary")
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n").cast("binary"), body)
    h = F.sha2(F.concat(F.coalesce(url, F.lit("")).cast("binary"), F.lit("\n").cast("binary"), body), 256)
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.sha1(body), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), block, F.lit("\r\n\r\n").cast("binary"))


# Every pattern takes what it has begun up to the end of the page where its end is missing, so none is tried again from
# the next place and a page is read in time linear in its length.
_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!doctype[^>]*(?:>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|title|pre|blockquote|hr)\b[^>]*(?:>|\Z)", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*(?:>|\Z)")
_TITLE = re.compile(r"<title[^>]*(?:>|\Z)(.*?)(?:</title|\Z)", re.S | re.I)
_ANCHOR = re.compile(r"<a\b([^>]*)(?:>|\Z)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


#: A numeric reference of more digits than any character has.
_NUMBER = re.compile(r"&#([0-9]{8,})(;?)")
#: Bytes up to which a compressed body is inflated.
MOST_INFLATED = 1 << 27


def unescaped(text: str) -> str:
    """``text`` without references; numbers that are no character, of any length, become U+FFFD as in a browser."""

    def short(m: re.Match) -> str:
        digits = m[1].lstrip("0") or "0"
        return "\ufffd" if len(digits) > 7 else f"&#{digits}{m[2]}"

    return html.unescape(_NUMBER.sub(short, text))


def plain_text(page: str) -> str:
    """The lines of a page without markup; what an unclosed comment, script or tag begins is left out to the end."""
    text = unescaped(_TAG.sub("", _BREAK.sub("\n", _SKIP.sub(" ", page))))
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def references(page: str) -> list[str]:
    """The href of each anchor, unescaped, in order."""
    found = (_HREF.search(a[1]) for a in _ANCHOR.finditer(page))
    return [unescaped(m[1] or m[2] or m[3] or "") for m in found if m]


def decoded_body(fields: list[tuple[str, str]], body: bytes) -> bytes:
    """A body without its transfer and content encoding; one that cannot be undone, or not within ``MOST_INFLATED`` bytes, is left as it is."""
    named = {name.lower(): value.lower() for name, value in fields}
    if "chunked" in named.get("transfer-encoding", ""):
        body = _unchunked(body)
    kind = named.get("content-encoding", "").strip()
    if kind in ("gzip", "x-gzip", "deflate"):
        inflater = zlib.decompressobj(31 if "gzip" in kind else 15)
        try:
            plain = inflater.decompress(body, MOST_INFLATED)
        except zlib.error:
            return body
        return body if inflater.unconsumed_tail else plain
    return body


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        digits = body[at:end].split(b";")[0].strip() if 0 <= end - at <= 1024 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,12}", digits):
            return b"".join(out) if out and at >= len(body) else body
        size = int(digits, 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def parse_record(record: bytes) -> tuple[list, list, bytes] | None:
    """(WARC headers, HTTP headers, payload) of a response record, or None; headers as they stand, repeated ones too."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        return None
    fields = _fields(lines[1:])
    headers = _last(fields)
    size = headers.get("content-length", "")
    if headers.get("warc-type") != "response" or not size.isdecimal() or len(rest) < int(size) or "warc-record-id" not in headers:
        return None
    first, gap, payload = rest[: int(size)].partition(b"\r\n\r\n")
    if not gap or not first.startswith(b"HTTP/"):
        return None
    return fields, _fields(first.decode("latin-1").split("\r\n")[1:]), payload


def _fields(lines: list[str]) -> list[tuple[str, str]]:
    """Names and values in order, repeated ones too."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:  # a folded line
            out[-1] = (out[-1][0], out[-1][1] + " " + line.strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def _last(fields: list[tuple[str, str]]) -> dict[str, str]:
    """By lower-case name; of repeated ones the last."""
    return {name.lower(): value for name, value in fields}


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def digest_check(stated: str | None, payload: bytes) -> str:
    """Whether a stated digest (hex or base32) is that of the payload."""
    if not stated:
        return "absent"
    name, _, value = stated.partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return "unknown"
    digest = hashlib.new(name, payload).digest()
    good = value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")
    return "verified" if good else "mismatch"


def _urn(*parts: str) -> str:
    h = hashlib.sha256("\n".join(parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def write_record(kind: str, record_id: str, other_id: str, source: dict, fields: list[tuple[str, str]], digest: str, check: str, content_type: str, block: bytes) -> bytes:
    """A derivative, beside ``other_id``, of the response whose headers are ``source`` and, as they stand, ``fields``."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Refers-To: {source['warc-record-id']}", f"WARC-Refers-To-Target-URI: {source.get('warc-target-uri', '')}",
        f"WARC-Refers-To-Date: {source.get('warc-date', '')}", f"WARC-Target-URI: {source.get('warc-target-uri', '')}", f"WARC-Date: {source.get('warc-date', '')}",
        f"WARC-Concurrent-To: {other_id}", f"WARC-Payload-Digest: {digest}", f"X-Source-Digest-Check: {check}", *(f"X-Source-{name}: {value}" for name, value in fields),
        f"WARC-Block-Digest: {sha1(block)}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def derivatives(record: bytes | None) -> tuple:
    """The values of FIELDS for one record."""
    parsed = parse_record(record) if record is not None else None
    if parsed is None:
        return ("malformed", *[None] * (len(FIELDS) - 1))
    fields, sent, payload = parsed
    source, http = _last(fields), _last(sent)
    charset = re.search(r"charset=\"?([\w-]+)", http.get("content-type", ""))
    try:
        page = decoded_body(sent, payload).decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = decoded_body(sent, payload).decode("utf-8", "replace")
    kept = _SKIP.sub(" ", page)
    title = _TITLE.search(kept)
    title = " ".join(unescaped(title[1]).split()) if title else ""
    base, links = source.get("warc-target-uri", ""), []
    for link in references(kept):
        try:
            links.append(urljoin(base, link))
        except ValueError:
            links.append(link)
    text = plain_text(page)
    own, uri = source["warc-record-id"], source.get("warc-target-uri")
    digest, check = sha1(payload), digest_check(source.get("warc-payload-digest"), payload)
    meta = json.dumps({"warc": source, "http": http, "warc_headers": fields, "http_headers": sent, "payload_digest": digest, "source_digest": check, "title": title, "links": links}, sort_keys=True, ensure_ascii=False).encode()
    meta_id, text_id = _urn("metadata", own, digest), _urn("conversion", own, digest)
    meta_record = write_record("metadata", meta_id, text_id, source, fields, digest, check, "application/json", meta)
    text_record = write_record("conversion", text_id, meta_id, source, fields, digest, check, "text/plain; charset=utf-8", text.encode())
    return ("ok", own, uri, source.get("warc-date"), digest, meta_id, text_id, meta_record, text_record, title, text, len(links), check)


def derive(records: DataFrame, *, record: str = "record") -> DataFrame:
    """``records`` with the columns of FIELDS."""

    def make():
        def function(column):
            rows = [derivatives(r) for r in column.to_pylist()]
            return [[r[i] for r in rows] for i in range(len(FIELDS))]

        return function

    kinds = {"string": T.StringType(), "binary": T.BinaryType(), "long": T.LongType()}
    return append_columns(records, record, [record], [(n, kinds[k]) for n, k in FIELDS], make)


def records(derived: DataFrame) -> DataFrame:
    """The derivative records themselves: (record_id, kind, refers_to, record), to be written out."""
    kinds = F.array(
        F.struct(F.col("metadata_id").alias("record_id"), F.lit("metadata").alias("kind"), F.col("metadata_record").alias("record")),
        F.struct(F.col("conversion_id").alias("record_id"), F.lit("conversion").alias("kind"), F.col("conversion_record").alias("record")),
    )
    return derived.filter("status = 'ok'").select("response_id", F.explode(kinds).alias("r")).select("r.record_id", "r.kind", F.col("response_id").alias("refers_to"), "r.record")


def split_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the records of a WARC file's bytes, each with the two line breaks that end it."""
    at = 0
    while (head := data.find(b"\r\n\r\n", at)) >= 0:
        size = _last(_fields(data[at:head].decode("utf-8", "replace").split("\r\n")[1:])).get("content-length", "")
        if not data.startswith(b"WARC/", at) or not size.isdecimal():
            raise ValueError(f"no WARC record at byte {at}")
        end = head + 4 + int(size) + 4
        yield at, data[at:end]
        at = end


def members(data: bytes) -> Iterator[bytes]:
    """The contents of the gzip members of a file one after the other; a file that is not compressed is one."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data[:2] == b"\x1f\x8b":
        part = zlib.decompressobj(31)
        yield part.decompress(data) + part.flush()
        data = part.unused_data


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, record) of ``.warc`` and ``.warc.gz`` files; a file is read by one task, a member at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                number = 0
                for part in members(content.as_py()):
                    for _, record in split_records(part):
                        yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([number], pa.int64()), pa.array([record], pa.binary())], names=["path", "number", "record"])
                        number += 1

    return files.mapInArrow(run, "path string, number long, record binary")


def as_members(rows: DataFrame, *, record: str = "record") -> DataFrame:
    """``rows`` with ``member``, the record as a gzip member of its own: a ``.warc.gz`` file is such members one after the other."""

    def make():
        def function(column):
            return [[None if r is None else gzip.compress(r, mtime=0) for r in column.to_pylist()]]

        return function

    return append_columns(rows, record, [record], [("member", T.BinaryType())], make)
