"""Operator 6: WARC derivative builder.

A page becomes a response record, and from the response two derived records that refer to it:

* metadata: what was found in the payload (title, language, charset, links), as `application/warc-fields`;
* conversion: the visible text, as `text/plain`.

Record ids are name-based (RFC 4122, version 5) on the page's id, address and payload, so a page built again, after an
executor was lost or in another run, gets the same records, and equal rows get equal ones. A derived record carries the
response's id in WARC-Refers-To, and its target, date and payload digest; digests are SHA-1 in base 32. Each row is
built from its page alone: one pass, no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id bigint, record_id string, record_type string, refers_to string, target_uri string, source_headers string, content_type string, block_digest string, payload_digest string, content_length bigint, record binary"
COLUMNS = [c.split(" ")[0] for c in SCHEMA.split(", ")]
ARROW = pa.schema([(c, pa.int64() if c in ("page_id", "content_length") else pa.binary() if c == "record" else pa.string()) for c in COLUMNS])
#: Fixed value: name space of the record ids.
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_hidden = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|head)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_break = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
_tag = re.compile(r"</?[a-zA-Z][^<>]*>|<![^<>]*>")
_blank = re.compile(r"[ \t\r\f\v\xa0]+")
_title = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_lang = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
_charset = re.compile(r"<meta\b[^>]*?\bcharset\s*=\s*[\"']?([\w-]+)", re.I)
_link = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def clean(value: str) -> str:
    """A header value: no line ends, which would begin another header."""
    return re.sub(r"[\r\n\t]+", " ", value).strip()


def visible(page: str) -> str:
    """The text of a page: without scripts, styles, comments and the head; block elements end lines; entities resolved."""
    text = _tag.sub("", _break.sub("\n", _hidden.sub(" ", page)))
    lines = (_blank.sub(" ", line).strip() for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def links(page: str, base: str) -> list[str]:
    out = []
    for found in _link.findall(page):
        try:
            out.append(clean(urljoin(base, html.unescape("".join(found).strip()))))
        except ValueError:  # an address that can't be read is kept as it stands
            out.append(clean("".join(found)))
    return list(dict.fromkeys(out))


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def build(page_id: int | None, url: str | None, page: str | None, date: str, source: list[tuple[str, str]]) -> list[dict]:
    """The response, metadata and conversion records of a page, in this order."""
    payload = (page or "").encode("utf-8", "replace")
    target = clean(url or "")
    found = _charset.search(page or "")
    headers = [*source, ("Content-Length", str(len(payload)))]
    http = "HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in headers) + "\r\n"
    name = f"{page_id}\n{target}\n{digest(payload)}"
    ids = {kind: f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}\n{name}')}>" for kind in ("response", "metadata", "conversion")}
    title, lang = _title.search(page or ""), _lang.search(page or "")
    fields = [("title", html.unescape(title[1]) if title else ""), ("language", lang[1] if lang else ""), ("charset", found[1] if found else ""), *(("outlink", x) for x in links(page or "", target))]
    blocks = {
        "response": (http.encode() + payload, "application/http; msgtype=response", digest(payload)),
        "metadata": ("".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v).encode("utf-8", "replace"), "application/warc-fields", digest(payload)),
        "conversion": (visible(page or "").encode("utf-8", "replace"), "text/plain; charset=utf-8", digest(payload)),
    }
    out = []
    for kind, (block, media, payload_digest) in blocks.items():
        derived = kind != "response"
        warc = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", target)]
        warc += [("WARC-Refers-To", ids["response"])] * derived + [("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date)] * derived
        warc += [("WARC-Payload-Digest" if not derived else "WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(block)), ("Content-Type", media)]
        warc += [(f"WARC-Source-{k}", clean(v)) for k, v in headers] * derived + [("Content-Length", str(len(block)))]
        out.append({"page_id": page_id, "record_id": ids[kind], "record_type": kind, "refers_to": ids["response"] if derived else None, "target_uri": target, "source_headers": http.strip() if derived else None, "content_type": media, "block_digest": digest(block), "payload_digest": payload_digest, "content_length": len(block), "record": record(warc, block)})
    return out


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, block and rest of the first record in `data`."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record begins here")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("the record doesn't end where its length says")
    return headers, rest[:n], rest[n + 4 :]


def derivatives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", source: tuple[tuple[str, str], ...] = (("Content-Type", "text/html; charset=utf-8"),), responses: bool = True) -> DataFrame:
    """A row for each record of `pages(page_id, url, html, ...)`: with `responses`, three for a page, else the two derived.

    `record` is the record as bytes; concatenated, records are a WARC file. A null page or address counts as empty: the
    payload and the conversion are then empty, the metadata holds no fields. `date` and `source` (the HTTP headers kept
    with the pages) are the crawl's. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = [r for p in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True) for r in build(*p, date, list(source))[not responses :]]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], ARROW.field(c).type) for c in COLUMNS], schema=ARROW)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, SCHEMA)
