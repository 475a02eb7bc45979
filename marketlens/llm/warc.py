"""WARC derivative builder.

Takes ``response`` records and makes, for each, a ``metadata`` record (JSON:
the source's headers, title, links and counts) and a ``conversion`` record
(plain text).  Both name the response in WARC-Refers-To and keep its target,
date and payload digest; every record has its own identifier and digests.

Records are rows; WARC files (one gzip member per record) are written and read
as streams, a record at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices, written
from .token_scan import opened

RECORD = ("warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
          "block_digest string, payload_digest string, headers string, block binary")
_SCHEMA = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.string()) for c in RECORD.split(", ")])
_COLUMNS = _SCHEMA.names
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")          # the URL name space of RFC 4122

# A tag that doesn't end runs to the page's end, as in browsers; so no pattern looks twice for an end that isn't there.
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*+(?:>|\Z).*?(?:</\1\s*+>|\Z)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*+(?:>|\Z)(.*?)(</title\s*+>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|tr|table|section|article|header|footer|nav|main|aside|"
                    r"blockquote|pre|form|title|head|body|html|figure|figcaption|td|th)\b[^>]*+(?:>|\Z)", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*+(?:>|\Z)")
_ANCHOR = re.compile(r"<a\b([^>]*+)", re.I)
_HREF = re.compile(r"""\bhref\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s"']++))""", re.I)
_CHARSET = re.compile(rb"""<meta\b[^>]{0,200}?\bcharset\s*=\s*["']?\s*([A-Za-z0-9_:.-]{1,40})""", re.I)
_LINE_END = re.compile(r"[\r\n]+")
_BLANK = re.compile(r"[ \t\r\f\v ]+")


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, json.dumps(parts))}>"


def split_http(block: bytes) -> tuple[str, list[list[str]], bytes]:
    """Status line, header fields and payload of an HTTP response; a block that
    is none is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, body = block.partition(b"\r\n\r\n")
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    return first, [[a.strip() for a in x.split(":", 1)] for x in rest if ":" in x], body


def plain_text(page: str) -> str:
    """Text of a page: hidden parts and tags go, block tags end lines, runs of
    blanks are one, empty lines go."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page)))
    lines = (_BLANK.sub(" ", x).strip() for x in entities.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def page_facts(page: str, base: str) -> tuple[str, list[str]]:
    """Title and the links (absolute, in order, each once)."""
    seen = _HIDDEN.sub(" ", page)
    m = _TITLE.search(seen)
    links = {}
    for tag in _ANCHOR.finditer(seen):
        found = _HREF.search(tag[1])
        if not found:
            continue
        href = entities.unescape(found[1] or found[2] or found[3] or "").strip()
        try:
            href = urljoin(base, href)
        except ValueError:
            pass
        if href:
            links[href] = None
    return (_BLANK.sub(" ", entities.unescape(m[1]).replace("\n", " ")).strip() if m and m[2] else ""), list(links)


def dechunked(body: bytes) -> bytes:
    """The data of a chunked body; from a malformed chunk on, nothing."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at, at + 1026)) >= 0:
        try:
            size = int(body[at:end].partition(b";")[0], 16)
        except ValueError:
            break
        if size <= 0:
            break
        out.append(body[end + 2:end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def decoded(fields: list[list[str]], payload: bytes, limit: int = 64 << 20) -> str:
    """The page's text: transfer and content encodings undone, then read in the
    charset that the header or the page names, UTF-8 where there is none or none
    that is known.  A body that isn't what its header says is taken as it is; at
    most ``limit`` bytes come out of a compressed one."""
    last = {name.lower(): value.lower() for name, value in fields}
    if "chunked" in last.get("transfer-encoding", ""):
        payload = dechunked(payload) or payload
    for coding in reversed([c.strip() for c in last.get("content-encoding", "").split(",")]):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
            try:
                payload = zlib.decompressobj(bits).decompress(payload, limit)
                break
            except zlib.error:
                continue
    named = re.search(r"charset\s*=\s*[\"']?([a-z0-9_:.-]+)", last.get("content-type", ""))
    inside = None if named else _CHARSET.search(payload[:4096])
    charset = named[1] if named else inside[1].decode() if inside else "utf-8"
    try:
        return payload.decode(charset, "replace")
    except (LookupError, ValueError):
        return payload.decode("utf-8", "replace")


def derivatives(row: dict) -> list[dict]:
    """The metadata and the conversion record of one response row.  Digests and
    sizes are those of the payload as it came, text and links those of the
    decoded page."""
    first, fields, payload = split_http(row["block"] or b"")
    page = decoded(fields, payload)
    target, source = row["target_uri"] or "", row["record_id"]
    title, links = page_facts(page, target)
    text = plain_text(page)
    facts = {"status": first, "headers": fields, "title": title, "links": links, "payload_bytes": len(payload),
             "text_chars": len(text), "payload_digest": row["payload_digest"] or sha1(payload)}
    out = []
    for kind, content, block in (("metadata", "application/json", json.dumps(facts, ensure_ascii=False).encode("utf-8", "surrogatepass")),
                                 ("conversion", "text/plain", text.encode("utf-8", "replace"))):
        digest = sha1(block)
        out.append({"warc_type": kind, "record_id": record_id(kind, source, digest), "refers_to": source,
                    "target_uri": row["target_uri"], "date": row["date"], "content_type": content,
                    "block_digest": digest, "payload_digest": row["payload_digest"] or sha1(payload),
                    "headers": row["headers"], "block": block})
    return out


def build_derivatives(responses: DataFrame) -> DataFrame:
    """Two rows (``RECORD`` columns) per response row.  ``headers`` (JSON of the
    source's WARC fields) and ``payload_digest`` are the response's.  Rows of
    other types pass no derivative on; a null block is an empty page; repeated
    rows get equal identifiers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, _COLUMNS.index("block")):
                rows = [x for r in part.to_pylist() for x in derivatives(r)]
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return responses.where("warc_type = 'response'").select(*_COLUMNS).mapInArrow(run, RECORD)


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of ``pages(page_id, url, html)``.  A null url or html is
    empty; rows that repeat url, page_id and html get equal identifiers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, 2)):
            rows = []
            for page, url, body in zip(*(b.column(i).to_pylist() for i in range(3))):
                payload = (body or "").encode("utf-8", "replace")
                block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"
                         "\r\n\r\n").encode() + payload
                digest = sha1(payload)
                own = record_id("response", page, url, digest)
                fields = {"WARC-Type": "response", "WARC-Record-ID": own, "WARC-Target-URI": url or "", "WARC-Date": date,
                          "WARC-Payload-Digest": digest, "Content-Type": "application/http; msgtype=response",
                          "Content-Length": str(len(block))}
                rows.append({"warc_type": "response", "record_id": own, "refers_to": None, "target_uri": url, "date": date,
                             "content_type": fields["Content-Type"], "block_digest": sha1(block), "payload_digest": digest,
                             "headers": json.dumps(fields), "block": block, "page_id": page})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA.append(pa.field("page_id", pa.int64())))

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, RECORD + ", page_id long")


# --------------------------------------------------------------------------
# files

_FIELDS = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"),
           ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("Content-Type", "content_type"),
           ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest")]


def pack(row: dict) -> bytes:
    """One gzip member holding one WARC/1.1 record; line ends inside a field's
    value become blanks."""
    block = row["block"] or b""
    lines = ["WARC/1.1"] + [f"{name}: {_LINE_END.sub(' ', row[c])}" for name, c in _FIELDS if row[c] is not None]
    if row["warc_type"] != "response" and row["headers"]:
        lines.append("X-Source-Headers: " + _LINE_END.sub(" ", row["headers"]))
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""])
    return gzip.compress(head.encode() + block + b"\r\n\r\n", mtime=0)


def unpack(stream) -> Iterator[dict]:
    """Records of a decompressed WARC stream, one at a time."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name, value = name.strip(), value.strip()
            fields[name] = f"{fields[name]}, {value}" if name in fields else value           # a field may come again
        block = stream.read(int(fields.get("Content-Length", 0)))
        row = {c: fields.get(name) for name, c in _FIELDS}
        source = fields.pop("X-Source-Headers", None)
        yield row | {"headers": source if source is not None else json.dumps(fields), "block": block}


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` as WARC files, one per task, in ``folder`` (shared
    storage); the written table (file, records) names the files that count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        name, n, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for b in batches:
            for row in (r for part in slices(b, _COLUMNS.index("block")) for r in part.to_pylist()):
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(pack(row))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["file", "records"])

    return written(records.select(*_COLUMNS).mapInArrow(run, "file string, records long"), "warc_files")


def read_warc(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``RECORD`` rows of the WARC files (gzipped or plain) in ``files(file)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                fs, path = opened(file)
                with fs.open_input_stream(path, compression=None) as raw:
                    stream = gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(raw)
                    rows, size = [], 0
                    for row in unpack(stream):
                        rows.append(row)
                        size += len(row["block"])
                        if size > 8_000_000 or len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return files.select("file").repartition("file").mapInArrow(run, RECORD)
