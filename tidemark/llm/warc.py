"""WARC derivatives: metadata and plain-text conversion records of captured responses.

Each response record (built here from a page's url and html) gives two linked records: ``metadata``,
a JSON description of the response (its headers, HTTP headers, title, language, links), and
``conversion``, the page's visible text. Both name the response in WARC-Refers-To, carry its target
uri and date over, and keep its block and payload digests beside their own. Identifiers are made
from content, so a task that runs again writes the same records. A head ends at </head> or at the first
text or element that cannot stand in one; its link elements are listed with the links.

Edge cases: null html is an empty payload, null url an empty target; repeated rows give repeated
records with equal identifiers; null ids are kept; line breaks in a url are percent-encoded; an empty
table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import text_rows
from tidemark.llm.html_tokens import BLOCK, RAW, Lines, Tag, tokens

#: Capture time of pages that come without one.
DATE = "2024-01-01T00:00:00Z"
#: Elements that are never visible text.
HIDDEN = frozenset({"script", "style", "template", "noscript", "iframe", "xmp", "noembed", "noframes", "textarea"})
#: Elements that may stand in a head; any other ends it.
HEAD = frozenset({"title", "meta", "link", "base", "style", "script", "noscript", "template", "noframes", "basefont", "bgsound"})

Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A uuid (version 5) of the record's content."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def record_text(headers: Headers, block: str) -> str:
    """A record without the two line ends that close it."""
    return "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n" + block


def response(page_id, url: str | None, html: str | None, date: str = DATE) -> tuple[Headers, str, str]:
    """Headers, block (HTTP message) and payload of a page's response record."""
    payload = html or ""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    body = payload.encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n{payload}"
    data = block.encode("utf-8", "surrogatepass")
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), target, date, digest(data))),
               ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest(body)),
               ("WARC-Block-Digest", digest(data)), ("Content-Type", "application/http; msgtype=response"),
               ("Content-Length", str(len(data)))]
    return headers, block, payload


def describe(html: str) -> tuple[str, dict]:
    """Visible text of a page (its title first), and title, language and links."""
    lines, title, links, lang, skip, in_title, in_head = Lines(), [], [], "", "", False, False
    flat = list(tokens(html))
    closes: dict[str, int] = {}
    for t in flat:
        if isinstance(t, Tag) and t.closing and t.name in HIDDEN:
            closes[t.name] = closes.get(t.name, 0) + 1
    for t in flat:
        if isinstance(t, str):
            if in_title:
                title.append(t)
            elif not skip and (not in_head or t.strip()):
                in_head = False
                lines.text(t)
            continue
        if t.closing and t.name in HIDDEN:
            closes[t.name] -= 1
        if t.name == "title":
            in_title = not t.closing
            continue
        if t.name == "body":
            skip = ""
        if skip:
            if t.closing and t.name == skip:
                skip = ""
            continue
        if not t.closing:
            in_head = t.name == "head" or (in_head and t.name in HEAD)
            if t.name in HIDDEN and (t.name in RAW or closes.get(t.name, 0) > 0):  # one never closed hides nothing
                lines.cut()
                skip = t.name
                continue
            if t.name == "html" and not lang:
                lang = t.attributes.get("lang", "")
            if t.name in ("a", "img", "link", "area"):
                a = t.attributes
                if to := a.get("href") or a.get("src"):
                    links.append({"path": f"{t.name.upper()}@/{'href' if 'href' in a else 'src'}", "url": to})
        elif t.name == "head":
            in_head = False
        if t.name in BLOCK:
            lines.cut()
        elif t.name == "br":
            lines.text(" ")
    head = " ".join("".join(title).split())
    body = lines.result()
    return "\n".join(x for x in (head, body) if x), {"title": head, "lang": lang, "links": links}


def derive(source: Headers, block: str, payload: str) -> list[tuple[Headers, str]]:
    """The metadata and the conversion record of a response."""
    known = dict(source)
    text, about = describe(payload)
    status, *http = block.split("\r\n\r\n", 1)[0].split("\r\n")
    meta = json.dumps({
        "Envelope": {"WARC-Header-Metadata": known, "Payload-Metadata": {
            "HTTP-Response-Metadata": {"Response-Message": status, "Headers": dict(h.split(": ", 1) for h in http),
                                       "HTML-Metadata": about}}}}, ensure_ascii=False, separators=(",", ":"))
    out = []
    for kind, mime, content in (("metadata", "application/json", meta), ("conversion", "text/plain", text)):
        data = content.encode("utf-8", "surrogatepass")
        out.append(([("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, known["WARC-Record-ID"], digest(data))),
                     ("WARC-Refers-To", known["WARC-Record-ID"]), ("WARC-Date", known["WARC-Date"]),
                     ("WARC-Target-URI", known["WARC-Target-URI"]),
                     ("WARC-Source-Block-Digest", known["WARC-Block-Digest"]),
                     ("WARC-Source-Payload-Digest", known["WARC-Payload-Digest"]),
                     ("WARC-Block-Digest", digest(data)), ("Content-Type", mime), ("Content-Length", str(len(data)))], content))
    return out


_FIELDS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "warc_date": "WARC-Date",
           "target_uri": "WARC-Target-URI", "source_block_digest": "WARC-Source-Block-Digest",
           "source_payload_digest": "WARC-Source-Payload-Digest", "block_digest": "WARC-Block-Digest",
           "content_type": "Content-Type", "content_length": "Content-Length"}


def derivatives(pages: DataFrame, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                with_response: bool = False) -> DataFrame:
    """One row per record: page_id, its header fields, content and the whole record.

    With ``with_response`` the response records come too (first of each page).
    """
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"page_id {kind}, " + ", ".join(f"{k} string" for k in _FIELDS) + ", content string, record string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, columns, contents, records, size = [], {k: [] for k in _FIELDS}, [], [], 0

            def out():
                return pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field("page_id").type), *(pa.array(v, pa.string()) for v in columns.values()),
                     pa.array(contents, pa.string()), pa.array(records, pa.string())],
                    names=["page_id", *columns, "content", "record"])

            for page_id, url, html in text_rows(batch, "page_id", "url", "html"):
                source, block, payload = response(page_id, url, html, date)
                made = derive(source, block, payload)
                for headers, content in ([(source, block)] if with_response else []) + made:
                    known = dict(headers)
                    ids.append(page_id)
                    for k, name in _FIELDS.items():
                        columns[k].append(known.get(name))
                    contents.append(content)
                    records.append(record_text(headers, content))
                    size += 2 * len(content)
                if size > 8 << 20:
                    yield out()
                    ids, columns, contents, records, size = [], {k: [] for k in _FIELDS}, [], [], 0
            if ids:
                yield out()

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, schema)


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """WARC files, one per partition: Spark's text writer closes each record with two line ends."""
    records.select("record").write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def read_records(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Headers and block of every record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != "WARC/1.0":
            raise ValueError(f"no record at byte {at}")
        headers = [tuple(x.split(": ", 1)) if ": " in x else (x.rstrip(":"), "") for x in lines]
        size = int(dict(headers)["Content-Length"])
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def derivatives_digest(pages: DataFrame) -> DataFrame:
    """The registered query: the derived records' fields and content."""
    out = derivatives(pages)
    return out.select("page_id", *_FIELDS, "content").withColumn("content_length", F.col("content_length").cast("long"))
