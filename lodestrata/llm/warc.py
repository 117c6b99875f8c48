"""WARC derivatives: from each response a metadata record and a plain-text conversion record.

Both point back to the response by WARC-Refers-To, keep its target URI and date, and carry
digests of their own block; the metadata block also preserves the source's HTTP headers and
payload digest, and lists title, declared language and charset, and outgoing links.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator
from functools import partial
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.llm.common import small_batches

DATE = "2024-01-01T00:00:00Z"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

# Tags end at the next ``<`` at the latest, and what is left open runs to the end of the page: so no text is scanned twice.
DROP = re.compile(r"(?is)<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|iframe)\b.*?(?:</\1\s*>|$)|<!doctype[^<>]*>")
TAG = re.compile(r"(?s)<(?:/?([A-Za-z][A-Za-z0-9]*)|[A-Za-z/!?])[^>]*(?:>|$)")
#: Elements that start a line.
BLOCKS = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td th thead title tr ul".split()
)
BLANKS = re.compile(r"[^\S\n]+")
LINES = re.compile(r" ?\n\s*")
TITLE, TITLE_END = re.compile(r"(?i)<title\b[^<>]*>"), re.compile(r"(?i)</title\s*>")
LANG = re.compile(r"""(?is)<html\b[^<>]*?\blang\s*=\s*["']?([A-Za-z0-9-]+)""")
CHARSET = re.compile(r"""(?is)<meta\b[^<>]*?charset\s*=\s*["']?([A-Za-z0-9_-]+)""")
LINK = re.compile(r"""(?is)<a\b[^<>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")

FIELDS = ["record_type", "record_id", "refers_to", "target_uri", "record_date", "content_type", "content_length", "block_digest", "payload_digest", "header", "content"]
RECORD = "record_type string, record_id string, refers_to string, target_uri string, record_date string, content_type string, content_length long, block_digest string, payload_digest string, header string, content string"


def digest_of(block: bytes) -> str:
    """A digest as WARC writes it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    """A record identifier that repeats for the same parts."""
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, chr(31).join(map(str, parts)))}>"


def plain_text(page: str) -> str:
    """The visible text of a page: one line a block, entities resolved, blanks squeezed."""
    text = TAG.sub(lambda m: "\n" if (m[1] or "").lower() in BLOCKS else "", DROP.sub(" ", page))
    return LINES.sub("\n", BLANKS.sub(" ", entities.unescape(text))).strip()


def title_of(page: str) -> str | None:
    """The first title, without tags and on one line."""
    begin = TITLE.search(page)
    end = begin and TITLE_END.search(page, begin.end())
    return BLANKS.sub(" ", entities.unescape(TAG.sub("", page[begin.end() : end.start()]))).replace("\n", " ").strip() if end else None


def links(page: str, base: str) -> list[str]:
    """Absolute http(s) targets of the anchors outside dropped parts, first occurrence first."""
    out: dict[str, None] = {}
    for m in LINK.finditer(DROP.sub(" ", page)):
        href = entities.unescape(m[1] if m[1] is not None else m[2] if m[2] is not None else m[3]).strip()
        try:
            full = urljoin(base, href)
            if urlsplit(full).scheme in ("http", "https"):
                out[full] = None
        except ValueError:
            continue
    return list(out)


def split_http(payload: str) -> tuple[list[str], str]:
    """HTTP header lines, if the payload starts with a status line, and the body."""
    if payload.startswith("HTTP/"):
        head, _, body = payload.partition("\r\n\r\n") if "\r\n\r\n" in payload else payload.partition("\n\n")
        return head.splitlines(), body
    return [], payload


def _record(kind: str, rid: str, refers: str, uri: str, date: str, ctype: str, block: str, payload: str | None = None) -> dict:
    data = block.encode("utf-8", "replace")
    digest = digest_of(data)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Refers-To: {refers}", f"WARC-Target-URI: {uri}",
             f"WARC-Date: {date}", f"WARC-Block-Digest: {digest}", *([f"WARC-Payload-Digest: {payload}"] if payload else []),
             f"Content-Type: {ctype}", f"Content-Length: {len(data)}"]
    return {
        "record_type": kind, "record_id": rid, "refers_to": refers, "target_uri": uri, "record_date": date, "content_type": ctype,
        "content_length": len(data), "block_digest": digest, "payload_digest": payload, "header": "\r\n".join(lines) + "\r\n\r\n", "content": block,
    }


def target_of(url: str | None) -> str:
    """The target URI: the url without outer white space, inner white space escaped."""
    return re.sub(r"\s+", "%20", (url or "").strip()) or "urn:unknown"


def derive(page_id: object, url: str | None, payload: str | None, date: str) -> list[dict]:
    """The metadata and the conversion record of one response."""
    uri = target_of(url)
    source = payload or ""
    headers, body = split_http(source)
    refers = record_id("response", page_id, uri)
    held = digest_of(body.encode("utf-8", "replace"))
    title = title_of(body)
    fields = [("source-record-id", refers), ("source-payload-digest", held), ("source-length", len(source.encode("utf-8", "replace")))]
    fields += [("source-header", h) for h in headers]
    if title is not None:
        fields.append(("title", title))
    for name, pattern in (("language", LANG), ("charset", CHARSET)):
        if m := pattern.search(body):
            fields.append((name, m[1].lower()))
    fields += [("outlink", x) for x in links(body, uri)]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields)
    text = plain_text(body)
    return [
        _record("metadata", record_id("metadata", page_id, uri), refers, uri, date, "application/warc-fields", meta),
        _record("conversion", record_id("conversion", page_id, uri), refers, uri, date, "text/plain; charset=utf-8", text, held),
    ]


def _derive(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    """Two rows a page; ids of pages pass through untouched."""
    for batch in batches:
        for at in range(0, len(batch), 500):
            some = batch.slice(at, 500)
            rows = [r for p, u, h in zip(*(some[c].to_pylist() for c in ("page_id", "url", "html")), strict=True) for r in derive(p, u, h, date)]
            ids = some["page_id"].take(pa.array([i for i in range(len(some)) for _ in range(2)]))
            made = [pa.array([r[c] for r in rows], pa.int64() if c == "content_length" else pa.string()) for c in FIELDS]
            yield pa.RecordBatch.from_arrays([ids, *made], ["page_id", *FIELDS])


def derivatives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Two rows a page: page_id and the fields of a metadata and a conversion record; header + content is the record.

    ``pages`` has page_id, url and html; the html may begin with an HTTP status line and
    headers, which the metadata preserves. Record identifiers are a function of page_id and
    url, so a repeated row repeats its records and a rerun gives the same ones. A null or
    empty page gives an empty conversion; a null url the target ``urn:unknown``. Row by row,
    no shuffle; an empty table gives no rows; further columns are not read.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(partial(_derive, date=date), f"page_id {kind}, {RECORD}")


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """The response records that the derivatives refer to: page_id, record_id, target_uri, payload."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uris = [target_of(u) for u in batch["url"].to_pylist()]
            ids = [record_id("response", p, u) for p, u in zip(batch["page_id"].to_pylist(), uris, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array(ids, pa.string()), pa.array(uris, pa.string()), batch["html"]], ["page_id", "record_id", "target_uri", "payload"])

    return pages.select("page_id", "url", "html").mapInArrow(rows, f"page_id {kind}, record_id string, target_uri string, payload string")


def write_records(records: DataFrame, path: str) -> None:
    """Write records as WARC text files, gzip-compressed, one a partition: header, block, two line ends."""
    from pyspark.sql import functions as F

    records.select(F.concat("header", "content").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
