"""WARC: records, files, and the derivatives of responses."""

from __future__ import annotations

import base64
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table
from tessella.llm.words import slices

VERSION = "WARC/1.1"
#: The date of records made from a table that has none.
DATE = "1970-01-01T00:00:00Z"
# What a text ends in the middle of goes on to its end, so that every character is read once.
_TAG_REST = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>)))?+)*+(?:>|\Z)"""
_BLOCKS = "p div br li ul ol h1 h2 h3 h4 h5 h6 tr td th table article section header footer nav blockquote pre title body head html form hr dl dt dd".split()
_MARKUP = re.compile(
    r"(?is)(?P<gone><!--(?:-?>|.*?(?:-->|\Z))|<(?P<raw>script|style|template|noscript)(?=[\s/>])" + _TAG_REST + r".*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z))"
    r"|</?(?P<block>" + "|".join(sorted(_BLOCKS, key=len, reverse=True)) + r")(?=[\s/>])" + _TAG_REST + r"|</?[a-z][^\s/>]*+" + _TAG_REST + r"|<[!?][^>]*+(?:>|\Z)"
)
_SPACE = re.compile(r"[^\S\n]+")
_TITLE = re.compile(r"(?is)<title(?=[\s/>])" + _TAG_REST + r"(.*?)(?:</title\s*+>|\Z)")
_OPENING = re.compile(r"(?is)<(html|a)(?=[\s/>])(" + _TAG_REST + ")")
_ATTRIBUTE = re.compile(r"""(?is)(?<=[\s/"'])(lang|href)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)""")
#: Bytes of a body once its encodings are undone; a longer one is refused.
LONGEST_BODY = 1 << 30


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    """The same identifier whenever a task makes the record."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256('\x1f'.join(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=4)}>"


def plain_text(markup: str) -> str:
    """Text of a page: no scripts, styles or comments; blocks on lines of their own, entities resolved."""
    text = _MARKUP.sub(lambda m: "\n" if m["block"] else " " if m["gone"] else "", markup)
    lines = (_SPACE.sub(" ", line).strip() for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def page_facts(markup: str) -> tuple[str, str, list[str]]:
    """Title, language and targets of links."""
    title, lang, links = _TITLE.search(markup), "", []
    for m in _OPENING.finditer(markup):
        found = next((x[2] for x in _ATTRIBUTE.finditer(m[2]) if x[1].lower() == ("lang" if m[1].lower() == "html" else "href")), None)
        if found is not None:
            value = html.unescape(found[1:-1] if found[0] in "\"'" else found)
            if m[1].lower() == "a":
                links.append(value)
            elif not lang:
                lang = value
    return html.unescape(title[1]) if title else "", lang, links


def http_response(page: bytes, kind: str = "text/html; charset=utf-8") -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: " + kind.encode() + b"\r\nContent-Length: " + str(len(page)).encode() + b"\r\n\r\n" + page


def write_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if k != "Content-Length")
    return f"{VERSION}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


# The fields' names as the WARC standard writes them; they may come in any case.
_FIELDS = {x.lower(): x for x in """WARC-Type WARC-Record-ID WARC-Date WARC-Target-URI WARC-Payload-Digest WARC-Block-Digest WARC-Refers-To
WARC-Refers-To-Target-URI WARC-Refers-To-Date WARC-Warcinfo-ID WARC-Concurrent-To WARC-IP-Address WARC-Truncated WARC-Profile
WARC-Identified-Payload-Type WARC-Segment-Number WARC-Filename Content-Type Content-Length""".split()}


class _Stream(io.RawIOBase):
    """The bytes of a file, plain or gzipped (by record or whole), unpacked as they are read."""

    def __init__(self, data: bytes):
        self.data, self.at, self.packed, self.left = memoryview(data), 0, data[:2] == b"\x1f\x8b", b""
        self.unpack = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        if not self.packed:
            got = self.data[self.at : self.at + len(out)]
            self.at += len(got)
        else:
            got = b""
            while not got:
                if self.unpack.eof:
                    left = self.unpack.unused_data.lstrip(b"\0")
                    if not left and self.at >= len(self.data):
                        return 0
                    if not left:
                        left, self.at = bytes(self.data[self.at : self.at + (1 << 16)]), self.at + (1 << 16)
                    self.unpack, self.left = zlib.decompressobj(31), left
                if not self.left:
                    self.left, self.at = bytes(self.data[self.at : self.at + (1 << 16)]), self.at + (1 << 16)
                    if not self.left:
                        raise ValueError("the file ends within a gzip member")
                got = self.unpack.decompress(self.left, len(out))
                self.left = self.unpack.unconsumed_tail
        out[: len(got)] = got
        return len(got)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file, plain or gzipped (by record or whole), one at a time.

    Field names come in the standard's case.  A record that is cut off is an error.
    """
    f = io.BufferedReader(_Stream(data), 1 << 16)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers, last = {}, ""
        while (line := f.readline()).strip():
            text = line.decode("utf-8", "surrogatepass").rstrip("\r\n")
            if text[0] in " \t" and last:
                headers[last] += " " + text.strip()
            else:
                name, _, value = text.partition(":")
                last = _FIELDS.get(name.strip().lower(), name.strip())
                headers[last] = f"{headers[last]}, {value.strip()}" if last in headers else value.strip()
        n = int(headers.get("Content-Length", -1))
        block = f.read(n) if n >= 0 else b""
        if len(block) != n:
            raise ValueError(f"{headers.get('WARC-Record-ID')}: {len(block)} bytes of {n}")
        yield headers, block


def _http_parts(block: bytes) -> tuple[list[list[str]], bytes]:
    found = re.search(rb"\r?\n\r?\n", block)
    if not block.startswith(b"HTTP/") or not found:
        return [], block
    lines = re.split(r"\r?\n", block[: found.start()].decode("latin-1"))[1:]
    return [[k.strip(), v.strip()] for k, _, v in (x.partition(":") for x in lines)], block[found.end() :]


def _unchunked(body: bytes) -> bytes:
    """A body in chunks put together; what does not follow the form stays as it is from there on."""
    out, at = [], 0
    while m := re.compile(rb"([0-9a-fA-F]{1,15})[^\r\n]*\r?\n").match(body, at):
        n = int(m[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[m.end() : m.end() + n])
        at = m.end() + n
        at += 2 if body[at : at + 2] == b"\r\n" else 1 if body[at : at + 1] == b"\n" else 0
    return b"".join([*out, body[at:]])


def decoded_body(http: list[list[str]], body: bytes) -> tuple[bytes, str]:
    """The body without its transfer and content encodings, and the name of one that could not be undone."""
    said = lambda name: [x.strip().lower() for k, v in http if k.lower() == name for x in v.split(",") if x.strip()]
    codes = said("content-encoding") + said("transfer-encoding")
    for code in reversed(codes):
        try:
            if code == "chunked":
                body = _unchunked(body)
            elif code in ("gzip", "x-gzip", "deflate"):
                raw = code == "deflate" and (len(body) < 2 or (body[0] * 256 + body[1]) % 31)
                unpack = zlib.decompressobj(-15 if raw else 47)
                body = unpack.decompress(body, LONGEST_BODY)
                if unpack.unconsumed_tail:
                    return b"", code
            elif code == "zstd":
                import zstandard

                body = zstandard.ZstdDecompressor().stream_reader(body).read(LONGEST_BODY)
            elif code not in ("identity", ""):
                return b"", code
        except Exception:  # a damaged body is noted, not fatal
            return b"", code
    return body, ""


def derive(headers: dict[str, str], block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The metadata and conversion records of a response; of other records none.

    Both refer to the response by WARC-Refers-To and keep its target, date, source headers and
    payload digest (of the bytes as sent); each has a digest of its own block.  A digest that the
    response states and its bytes contradict is noted in the metadata, and so is an encoding that
    could not be undone (the text is empty then).
    """
    if headers.get("WARC-Type") != "response":
        return []
    http, sent = _http_parts(block)
    body, failed = decoded_body(http, sent)
    own, uri = headers.get("WARC-Record-ID", ""), headers.get("WARC-Target-URI", "")
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = re.search(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", kind) or re.search(rb"(?i)<meta[^>]{0,200}charset\s*=\s*[\"']?([\w.:-]+)", body[:2048])
    try:
        name = charset[1] if charset else "utf-8"
        page = body.decode(name.decode() if isinstance(name, bytes) else name, "replace")
    except (LookupError, ValueError):
        page = body.decode("utf-8", "replace")
    payload, text = digest(sent), plain_text(page)
    title, lang, links = page_facts(page)
    one = lambda x: re.sub(r"\s+", " ", x).strip()
    fields = [("fetched-payload-digest", payload), ("title", one(title)), ("languages", one(lang)), ("text-length", str(len(text)))]
    if failed:
        fields.append(("encoding-not-undone", failed))
    stated = headers.get("WARC-Payload-Digest", payload)
    if stated != payload:
        fields.append(("stated-payload-digest", stated))
    fields += [("http-header", f"{k}: {v}") for k, v in http] + [("outlink", one(x)) for x in links]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    conv = text.encode("utf-8", "surrogatepass")
    common = {"WARC-Target-URI": uri, "WARC-Date": headers.get("WARC-Date", DATE), "WARC-Refers-To": own, "WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": headers.get("WARC-Date", DATE), "WARC-Source-Payload-Digest": payload}
    if "WARC-Warcinfo-ID" in headers:
        common["WARC-Warcinfo-ID"] = headers["WARC-Warcinfo-ID"]
    out = []
    for what, mime, data in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", conv)):
        out.append(({"WARC-Type": what, "WARC-Record-ID": record_id(what, own), **common, "Content-Type": mime, "WARC-Block-Digest": digest(data), "Content-Length": str(len(data))}, data))
    return out


def page_response(key: str, uri: str, page: str) -> tuple[dict[str, str], bytes]:
    body = page.encode("utf-8", "surrogatepass")
    block = http_response(body)
    headers = {"WARC-Type": "response", "WARC-Record-ID": record_id("response", key, uri, digest(body)), "WARC-Target-URI": uri, "WARC-Date": DATE, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest(body), "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    return headers, block


_COLUMNS = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, content_type string, payload_digest string, block_digest string, content_length long, headers string, block binary"


def _row(page_id, headers: dict[str, str], block: bytes) -> tuple:
    h = headers.get
    return page_id, h("WARC-Type"), h("WARC-Record-ID"), h("WARC-Refers-To"), h("WARC-Target-URI"), h("Content-Type"), h("WARC-Source-Payload-Digest"), h("WARC-Block-Digest"), len(block), json.dumps(headers, ensure_ascii=False), block


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), *[pa.string()] * 7, pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 11, types)], [x.split()[0] for x in _COLUMNS.split(", ")])


def derivatives(pages: DataFrame) -> DataFrame:
    """Two rows, metadata and conversion, for each page (page_id, url, html).

    A page with a null html was not fetched and has none; an empty one has both, with an empty
    text; a null url or page_id counts as empty in the identifiers; repeated rows give repeated rows,
    an empty table none; other columns, whatever their names, are not looked at.  Time and memory are
    in proportion to the page.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            rows = [_row(i, *r) for i, url, page in zip(*(c.to_pylist() for c in b.columns)) if page is not None for r in derive(*page_response("" if i is None else str(i), url or "", page))]
            yield _batch(rows)

    return pages.mapInArrow(run, _COLUMNS)


_RECORDS = pa.schema([("path", pa.string()), ("headers", pa.string()), ("block", pa.binary())])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, headers as JSON, block) of the records of WARC files; one task reads a file at a time.

    Spark brings the file's own bytes; records are unpacked and passed on one after another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                held, size = [], 0
                for h, x in read_records(data.as_py()):
                    held.append((name, json.dumps(h, ensure_ascii=False), x))
                    size += len(x)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _RECORDS)], schema=_RECORDS)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _RECORDS)], schema=_RECORDS)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, headers string, block binary")


def derive_records(records: DataFrame) -> DataFrame:
    """The derivatives of records as ``read_warc`` gives them, page_id null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([_row(None, *r) for h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in derive(json.loads(h), x or b"")])

    return records.select("headers", "block").mapInArrow(run, _COLUMNS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(table(spark, sf_dir, "pages"))
