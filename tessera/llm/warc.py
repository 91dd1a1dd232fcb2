"""WARC derivatives: response records to linked metadata and plain-text conversion records.

Each response gives two records that name it in WARC-Refers-To: a metadata record (the source's HTTP headers,
its digests, language and title) and a conversion record (the text of its HTML). Records are serialised as WARC/1.1,
one gzip member each, so concatenated members are a valid file; ``read_records`` reads them back exactly.

A derived record has the digest of its own block; the source's digests are in the metadata record and in the column ``source_payload_digest``.

Defined results: a null url, date or body is empty; ids are name-based UUIDs of type, url, date and payload digest, so
rows that repeat get equal records, which come with each row. A page is read whole, however long, in time that grows with its length. Empty tables give none. Columns of
the input that aren't named aren't read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A comment's beginning, a tag as far as its quotes are closed, or the beginning of something else. Whatever it meets it matches, so it never goes back.
_OPEN = re.compile(r"""<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)(>)?|[!?/])""")
_STOP = re.compile("[>\"']")
_LANG = re.compile(r"(?:^|[\s/\"'])lang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
#: Elements whose content is no part of the text.
_DROPPED = frozenset("script style noscript template svg title".split())
_CLOSING = {name: re.compile("</" + name, re.I | re.A) for name in _DROPPED}
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_META_BYTES = 1024  # as far as a page's own charset is looked for, as HTML has it

RECORD = "id_of_source long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, source_payload_digest string, block_digest string, source_headers string, record binary"


class _Finder:
    """``find`` that looks only once for what isn't there, so that a scan is linear."""

    def __init__(self, text: str):
        self.text = text
        self.absent: set[str] = set()

    def after(self, what: str, at: int) -> int:
        """The place behind the next ``what``, or -1."""
        if what in self.absent:
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.absent.add(what)
            return -1
        return found + len(what)

    def closing(self, name: str, at: int) -> int:
        """The place of the next ``</name``, in any case, or -1."""
        if name in self.absent:
            return -1
        found = _CLOSING[name].search(self.text, at)
        if found is None:
            self.absent.add(name)
            return -1
        return found.start()


def _tag_end(page: str, at: int, find: _Finder) -> int:
    """Behind the tag that goes on at ``at``; quoted values may hold ``>``, a quote that isn't closed is no quote."""
    while (m := _STOP.search(page, at)) is not None:
        at = m.end()
        if m[0] == ">":
            return at
        closed = find.after(m[0], at)
        at = closed if closed > 0 else at
    return len(page)


def scan(page: str) -> tuple[str, str | None, str | None]:
    """(visible text, title, language) in one pass over the page, in time that grows with its length.

    Blocks are on lines of their own, entities resolved, white space collapsed. A tag, comment or dropped element that isn't closed goes to the end.
    """
    find = _Finder(page)
    out: list[str] = []
    title = lang = None
    at, n = 0, len(page)
    while at < n and (m := _OPEN.search(page, at)) is not None:
        out.append(page[at : m.start()])
        if m[1]:
            end = find.after("-->", m.end())
            at = end if end > 0 else n
            out.append(" ")
            continue
        name = m[3].lower() if m[3] else ""
        at = m.end() if m[5] else _tag_end(page, m.end(), find)
        if name == "html" and not m[2] and lang is None and (found := _LANG.search(m[4])):
            lang = found[1]
        if name in _DROPPED and not m[2]:
            close = find.closing(name, at)
            if name == "title" and title is None:
                title = " ".join(entities.unescape(page[at : close if close >= 0 else n]).split())
            at = n if close < 0 else _tag_end(page, close + 2 + len(name), find)
            out.append(" ")
        elif name in _BLOCK:
            out.append("\n")
    out.append(page[at:])
    lines = (" ".join(x.split()) for x in entities.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), title, lang


def plain_text(page: str) -> str:
    return scan(page)[0]


def decoded(headers: str, payload: bytes) -> str:
    """The payload by the charset of its HTTP headers, else by that of its first bytes, else as UTF-8; what can't be read is replaced."""
    kind = next((x for x in headers.split("\r\n") if x.lower().startswith("content-type:")), "")
    found = _CHARSET.search(kind.encode("utf-8", "replace")) or _CHARSET.search(payload[:_META_BYTES])
    try:
        return payload.decode(found[1].decode("ascii") if found else "utf-8", "replace")
    except (LookupError, UnicodeError, ValueError):  # no charset that is known, or none of text
        return payload.decode("utf-8", "replace")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, uri: str, date: str, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {date} {payload_digest} {uri}')}>"


def serialise(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member; Content-Length is added."""
    head = "".join(f"{k}: {one_line(v)}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a file, gzipped by member or plain."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        top = data.index(b"\r\n\r\n", at)
        lines = data[at:top].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        yield fields, data[top + 4 : top + 4 + n]
        at = top + 4 + n + 4


def split_http(block: bytes) -> tuple[str, bytes]:
    """(header lines, payload) of an HTTP response."""
    head, found, body = block.partition(b"\r\n\r\n")
    return (head.decode("utf-8", "replace"), body) if found else ("", block)


def http_response(body: bytes, content_type: str = "text/html; charset=utf-8") -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body


def derive(uri: str, date: str, block: bytes) -> Iterator[tuple]:
    """The derived records of one response block, as tuples after RECORD (without the source's id)."""
    headers, payload = split_http(block)
    payload_digest = digest(payload)
    source = record_id("response", uri, date, payload_digest)
    text, title, lang = scan(decoded(headers, payload))
    about = [("source-payload-digest", payload_digest), ("source-block-digest", digest(block)), ("source-length", str(len(block)))]
    about += [("language", lang)] if lang else []
    about += [("title", title)] if title is not None else []
    about += [("http-" + k.lower(), v) for k, _, v in (x.partition(": ") for x in headers.split("\r\n")[1:])]
    about_block = "".join(f"{k}: {one_line(v)}\r\n" for k, v in about).encode("utf-8", "replace")
    for kind, content_type, body in (("metadata", "application/warc-fields", about_block), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        own, block_digest = record_id(kind, uri, date, payload_digest), digest(body)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", block_digest), ("Content-Type", content_type)]
        yield kind, own, source, uri, date, content_type, len(body), payload_digest, block_digest, headers, serialise(fields, body)


def responses(pages: DataFrame, date: Column) -> DataFrame:
    """Response records (source_id, target_uri, warc_date, body) of a table of raw pages."""
    return pages.select(F.col("page_id").cast("long").alias("source_id"), F.col("url").alias("target_uri"), date.alias("warc_date"), F.col("html").cast("binary").alias("body"))


def derivatives(found: DataFrame, http: bool = False) -> DataFrame:
    """Two rows for each row of ``found`` (source_id, target_uri, warc_date, body), as RECORD says.

    ``http``: bodies start with HTTP headers; else plain ones are put before them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64(), *[pa.string()] * 6, pa.int64(), *[pa.string()] * 3, pa.binary()]
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                rows = []
                for key, uri, date, body in zip(*(c.slice(lo, 256).to_pylist() for c in b.columns)):
                    block = body or b"" if http else http_response(body or b"")
                    rows += [(key, *x) for x in derive(uri or "", date or "", block)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return found.select("source_id", "target_uri", "warc_date", "body").mapInArrow(run, RECORD)
