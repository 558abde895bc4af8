"""Derivatives of WARC responses: a metadata record and a plain-text conversion record for each.

A record is its bytes: a version line, named fields, an empty line, the block, two line ends. Every derived record names the
response in WARC-Refers-To and keeps its target, date and payload digest; its own id follows from these,
so a task that runs again writes the same record. All work is per record, without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
#: Fixed values of the format: field names as they are written, and the profile of text conversions.
HTTP_RESPONSE, FIELDS, TEXT = "application/http; msgtype=response", "application/warc-fields", "text/plain; charset=utf-8"
DATE = "2024-01-01T00:00:00Z"
BATCH = 500
FIELD = re.compile(r"^([^:\s][^:]*):[ \t]*(.*?)[ \t]*$")
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|head)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
TITLE, TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|pre|blockquote|hr|dd|dt|td|th|title)\b[^>]*>", re.I)
TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
ANCHOR, HREF, VALUE = re.compile(r"<a\b", re.I), re.compile(r"\bhref\s*=\s*", re.I), re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>]+)")
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def write_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """Bytes of a record; line ends inside values become spaces, so no value can add a field."""
    head = "".join(f"{name}: {' '.join(value.split())}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").splitlines():
        if line[:1] in " \t" and out:  # a folded value
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif found := FIELD.match(line):
            out.append((found[1], found[2]))
    return out


def read_record(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Fields (names in lower case) and block of a record; None for bytes that are no record."""
    first, _, rest = data.partition(b"\r\n")
    head, gap, block = rest.partition(b"\r\n\r\n")
    if not first.startswith(b"WARC/") or not gap:
        return None
    fields = {name.lower(): value for name, value in _fields(head)}
    length = fields.get("content-length", "")
    if not length.isdigit() or len(block) < int(length):
        return None
    return fields, block[:int(length)]


def response(page_id: str, url: str, page: str, date: str = DATE) -> bytes:
    body = page.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    return write_record([
        ("WARC-Type", "response"), ("WARC-Record-ID", identifier("response", page_id, url, digest(body))), ("WARC-Target-URI", url), ("WARC-Date", date),
        ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(http)), ("Content-Type", HTTP_RESPONSE),
    ], http)


def titles(page: str) -> tuple[str, str]:
    """Content of the first title, and the page with a space for each. Behind an opening that no end follows there is none."""
    first, parts, at, last = None, [], 0, page.rfind(">") + 1
    while (start := TITLE.search(page, at, last)) and (end := TITLE_END.search(page, start.end())):
        first = page[start.end():end.start()] if first is None else first
        parts += [page[at:start.start()], " "]
        at = end.end()
    return first or "", "".join(parts) + page[at:]


def links(page: str) -> list[str]:
    """Values of the first ``href`` of each anchor, up to the next ``>``; no place is read twice."""
    out, at, end = [], 0, -1
    while start := ANCHOR.search(page, at):
        if end < start.end():
            end = page.find(">", start.end())
            end = len(page) if end < 0 else end
        at = end
        for name in HREF.finditer(page, start.end(), end):
            if value := VALUE.match(page, name.end()):
                out.append(html.unescape(value[1] or value[2] or value[3] or ""))
                at = value.end()
                break
    return list(dict.fromkeys(out))


def plain(page: str) -> str:
    """Visible text of a page: without hidden parts and tags, entities resolved, a line for each block, no empty lines.

    The time is in proportion to the page, whatever is left open in it.
    """
    title = titles(page)[0]
    page = titles(HIDDEN.sub(" ", page))[1]
    last = page.rfind(">") + 1  # behind it there is no tag to look for
    page = TAG.sub("", BLOCK.sub("\n", page[:last])) + page[last:]
    lines = [title, *page.split("\n")]
    return "\n".join(line for line in (" ".join(html.unescape(x).split()) for x in lines) if line)


def derive(data: bytes | None) -> list[dict]:
    """The metadata and conversion records of a response record; none for other bytes or other types."""
    read = read_record(data or b"")
    if read is None or read[0].get("warc-type", "").lower() != "response":
        return []
    fields, block = read
    head, _, body = block.partition(b"\r\n\r\n")
    status, _, rest = head.partition(b"\r\n")
    http = _fields(rest)
    kind = next((v for n, v in http if n.lower() == "content-type"), "")
    found = CHARSET.search(kind)
    try:
        page = body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    source, payload = fields.get("warc-record-id", ""), fields.get("warc-payload-digest") or digest(body)
    found_links = links(page)
    notes = [("sourceStatus", status.decode("utf-8", "replace")), *[(f"sourceHeader-{n}", v) for n, v in http], ("sourceBlockDigest", fields.get("warc-block-digest") or digest(block)),
             ("charset", found[1].lower() if found else "utf-8"), ("title", " ".join(html.unescape(titles(page)[0]).split())), *[("outlink", x) for x in found_links]]
    out = []
    for record, content, own in (
        ("metadata", "".join(f"{n}: {' '.join(v.split())}\r\n" for n, v in notes).encode(), FIELDS),
        ("conversion", plain(page).encode(), TEXT),
    ):
        name = identifier(record, source, payload)
        kept = [("WARC-Type", record), ("WARC-Record-ID", name), ("WARC-Refers-To", source), ("WARC-Target-URI", fields.get("warc-target-uri", "")), ("WARC-Date", fields.get("warc-date", "")),
                ("WARC-Source-Payload-Digest", payload), ("WARC-Block-Digest", digest(content)), ("Content-Type", own)]
        out.append({"kind": record, "record_id": name, "refers_to": source, "target_uri": fields.get("warc-target-uri", ""), "date": fields.get("warc-date", ""), "payload_digest": payload,
                    "block_digest": digest(content), "n_links": len(found_links), "n_bytes": len(content), "record": write_record([x for x in kept if x[1]], content)})
    return out


def responses(pages: DataFrame) -> DataFrame:
    """``page_id, response``: a response record for each row of ``pages``; a null page is empty, a null address ''."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                part = batch.slice(first, BATCH)
                ids, urls, texts = (part.column(k) for k in range(3))
                made = [response(str(i), u or "", t or "") for i, u, t in zip(ids.to_pylist(), urls.to_pylist(), texts.to_pylist())]
                yield pa.RecordBatch.from_arrays([ids, pa.array(made, pa.binary())], names=["page_id", "response"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, response binary")


def derivatives(records: DataFrame, key: str = "page_id", column: str = "response") -> DataFrame:
    """Two rows for each response in ``column``: ``key``, the fields that link the record, and its bytes in ``record``.

    A null, cut or foreign record gives no row. Records that repeat give the same derivatives again, under the
    same ids. Pages are read whole, in the character set of their header (UTF-8 without one), bytes that do not
    fit replaced.
    """
    names = {"kind": "string", "record_id": "string", "refers_to": "string", "target_uri": "string", "date": "string", "payload_digest": "string", "block_digest": "string", "n_links": "long", "n_bytes": "long", "record": "binary"}
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                part = batch.slice(first, BATCH)
                rows = [(i, d) for i, data in enumerate(part.column(1).to_pylist()) for d in derive(data)]
                ids = part.column(0).take(pa.array([i for i, _ in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([d[n] for _, d in rows], types[t]) for n, t in names.items()]], names=[key, *names])

    kind = records.schema[key].dataType.simpleString()
    return records.select(key, column).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} {t}" for n, t in names.items()))


def digests(pages: DataFrame) -> DataFrame:
    out = derivatives(responses(pages))
    return out.select("page_id", "kind", "record_id", "refers_to", "target_uri", "date", "payload_digest", "block_digest", "n_links", "n_bytes", F.sha2("record", 256).alias("record_sha256"))
