"""WARC derivatives: from response records to linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html as entities
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.wrapper import _TOKEN, _in_order, parse

#: Namespace of the record ids that are derived from content, so that a rerun gives the same ids.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lathe:warc")
SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, headers array<struct<key:string,value:string>>, block binary"
_ARROW = pa.schema(
    [*[(n, pa.string()) for n in ("record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "payload_digest")], ("headers", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))), ("block", pa.binary())]
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
#: Elements whose content is no markup.
_RAW = {name: re.compile(f"</{name}", re.I) for name in ("title", "script", "style", "textarea", "xmp", "iframe", "noembed", "noframes")}
#: Type of a record whose block can't be told from what follows it.
UNREADABLE = "unreadable"
_CHUNK = re.compile(rb"([0-9A-Fa-f]{1,15})[^\r\n]*\r?\n")
#: Bytes of blocks after which a task hands on a batch of records, and bytes of a file that are read at once.
BATCH, READ = 4 << 20, 1 << 20
#: Records of a file that write_warc() makes; a reader holds a file packed as it is.
PER_FILE = 1000
_CHARSET = re.compile(r"charset=[\"']?([A-Za-z0-9_.:-]+)", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(map(str, parts)))}>"


def plain_text(page: str) -> str:
    """All text of a page, a line for each block: what a reader without styles sees, menus included."""
    return "\n".join(block.text for block, _ in _in_order(parse(page, judge=False)))


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in their order (repeated ones too, folded lines joined) and body of an HTTP response; without a blank line all is body."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    headers: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        else:
            key, _, value = line.partition(":")
            headers += [(key.strip(), value.strip())] if key.strip() else []
    return status, headers, body


def _value(headers: list[tuple[str, str]], name: str) -> str:
    return ", ".join(v for k, v in headers if k.lower() == name)


def _joined(chunks: bytes) -> bytes:
    """The body of a chunked message; what doesn't follow the chunks' form is taken as it is."""
    out, at = [], 0
    while found := _CHUNK.match(chunks, at):
        size = int(found[1], 16)
        if not size:
            return b"".join(out)
        out.append(chunks[found.end() : found.end() + size])
        at = found.end() + size
        at += 2 * (chunks[at : at + 2] == b"\r\n")
    return b"".join(out) if out and at >= len(chunks) else chunks


def _inflated(data: bytes, bits: int) -> bytes:
    """All members of a gzip stream, or one deflate stream; what follows the last isn't part of it. Raises zlib.error where one is cut or broken."""
    out = []
    while True:
        member = zlib.decompressobj(bits)
        out.append(member.decompress(data) + member.flush())
        if not member.eof:
            raise zlib.error("cut off")
        data = member.unused_data
        if not data.startswith(b"\x1f\x8b"):
            return b"".join(out)


def payload_of(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The payload of a response: transfer and content codings that are known (chunked, gzip with any number of members, deflate) undone; a cut or broken one stays as it is."""
    payload = _joined(body) if "chunked" in _value(headers, "transfer-encoding").lower() else body
    for coding in reversed([c.strip().lower() for c in _value(headers, "content-encoding").split(",")]):
        if coding in ("gzip", "x-gzip", "deflate"):
            for bits in (47, -15):
                try:
                    payload = _inflated(payload, bits)
                    break
                except zlib.error:
                    continue
    return payload


def title_and_links(page: str) -> tuple[str, list[str]]:
    """The first closed title and the targets of all links, as the page's tags give them: comments, scripts and other raw text have none. One pass, linear in the page."""
    title, links, at, closed = "", [], 0, True
    while found := _TOKEN.search(page, at):
        at, name = found.end(), (found[2] or "").lower()
        if found[1] or not name:
            continue
        if name == "a":
            targets = (a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(found[3]) if a[1].lower() == "href" and a[0] != a[1])
            links += [entities.unescape(t) for t in (next(targets, None),) if t is not None]
        elif name == "title":
            end = _RAW[name].search(page, at) if closed else None
            closed = end is not None
            if end and not title:
                title = " ".join(entities.unescape(page[at : end.start()]).split())
            at = end.start() if end else at
        elif name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.start() if end else len(page)
    return title, links


def decoded(payload: bytes, content_type: str) -> str:
    """Text by the byte order mark, the header's charset or the page's own, else UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if payload.startswith(mark):
            return payload[len(mark) :].decode(name, "replace")
    named = _CHARSET.search(content_type) or _CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def _batch(rows: list[tuple], own: list[pa.Array] | None = None, names: list[str] | None = None) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)]
    return pa.RecordBatch.from_arrays([*(own or []), *columns], names=[*(names or []), *_ARROW.names])


def _bounded(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows in lists of up to BATCH bytes of blocks, one at least."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"") + 1000
        if size >= BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def responses(pages: DataFrame, captured: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages (url, html), with any other columns of pages kept. Null html is an empty payload, null url no target."""
    kept = [c for c in pages.columns if c not in {f.name for f in _ARROW}]

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:

            def rows() -> Iterator[tuple]:
                for i, (url, page) in enumerate(zip(batch.column("url"), batch.column("html"), strict=True)):  # noqa: B023
                    url, payload = url.as_py(), (page.as_py() or "").encode("utf-8", "surrogatepass")
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                    own = digest(block)
                    yield i, "response", record_id("response", url, own), None, url, captured, "application/http; msgtype=response", own, digest(payload), [], block

            for held in _bounded(rows()):
                yield _batch([r[1:] for r in held], [batch.column(c).take(pa.array([r[0] for r in held])) for c in kept], kept)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in kept)
    return pages.mapInArrow(built, f"{fields}, {SCHEMA}" if kept else SCHEMA)


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response record: metadata and conversion, with the extra columns of records.

    Both refer to the response by its id, keep its target, date and headers, and name its payload digest; conversion blocks are the
    plain text in UTF-8, metadata blocks WARC fields: HTTP status and the source's headers, all in their order and repeated ones too, title,
    digests and outlinks. Text is taken from the payload with its codings undone; the digest of a record that has none is that of the payload as it
    was sent. Ids derive from the response's id and the content, so that reruns and repeated rows agree; the two link to each other by
    WARC-Concurrent-To, in place of one of the source's. Records of other types and null blocks give none. Null targets or dates stay null. A null
    record_id is derived from the block. Empty input: empty result. A task holds one batch of input and BATCH bytes of output.
    """
    kept = [c for c in records.columns if c not in set(_ARROW.names)]

    def derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:

            def rows() -> Iterator[tuple]:
                columns = (batch.column(c) for c in ("record_id", "target_uri", "date", "payload_digest", "headers", "block"))  # noqa: B023
                for i, row in enumerate(zip(*columns, strict=True)):
                    source, target, date, payload_digest, given, block = (x.as_py() for x in row)
                    source = source or record_id("response", target, digest(block))
                    status, http, body = split_http(block)
                    page = decoded(payload_of(http, body), _value(http, "content-type"))
                    payload_digest = payload_digest or digest(body)
                    text = plain_text(page).encode("utf-8", "replace")
                    title, links = title_and_links(page)
                    carried = [(h["key"], h["value"]) for h in given or [] if (h["key"] or "").lower() != "warc-concurrent-to"]
                    fields = [("source-status", status), *((f"source-{k.lower()}", v) for k, v in [*http, *carried])]
                    fields += [("source-payload-digest", payload_digest), ("title", title), ("text-length", str(len(text)))]
                    fields += [("outlink", f"{link} L a/@href") for link in links]
                    about = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v).encode("utf-8", "replace")
                    ids = [record_id(kind_of, source, digest(b)) for kind_of, b in (("metadata", about), ("conversion", text))]
                    for j, (kind_of, mime, b) in enumerate((("metadata", "application/warc-fields", about), ("conversion", "text/plain", text))):
                        yield i, kind_of, ids[j], source, target, date, mime, digest(b), payload_digest, [*carried, ("WARC-Concurrent-To", ids[1 - j])], b

            for held in _bounded(rows()):
                yield _batch([(*r[1:9], [{"key": k, "value": v} for k, v in r[9]], r[10]) for r in held], [batch.column(c).take(pa.array([r[0] for r in held])) for c in kept], kept)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema if f.name in kept)
    return records.where("record_type = 'response' AND block IS NOT NULL").mapInArrow(derived, f"{fields}, {SCHEMA}" if kept else SCHEMA)


def write_warc(records: DataFrame, path: str, compression: str = "gzip", per_file: int = PER_FILE) -> None:
    """Writes records as WARC/1.1 files of up to per_file records, so that files don't grow with the input, by Spark's own writer (lines that end as records do)."""
    named = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest"}
    line = lambda key, value: F.when(value.isNotNull(), F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))).otherwise("")
    others = F.coalesce(F.array_join(F.transform("headers", lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")), F.lit("\r\n"))), ""), F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\n"), *[line(key, F.col(c)) for c, key in named.items()], others, F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"))
    records.select(F.concat(head.cast("binary"), F.col("block")).cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


class _Chunks(io.RawIOBase):
    """The decompressed bytes of a file that is gzipped, one member after another, or not: a part at a time. Bytes that aren't gzip end it."""

    def __init__(self, data: pa.Buffer):
        self.data, self.at, self.member = memoryview(data), 0, None
        self.plain = bytes(self.data[:2]) != b"\x1f\x8b"

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        while self.at < len(self.data) or (self.member and self.member.unconsumed_tail):
            if self.plain:
                part = bytes(self.data[self.at : self.at + len(into)])
                self.at += len(part)
            else:
                tail = self.member.unconsumed_tail if self.member else b""
                if not tail:
                    tail = bytes(self.data[self.at : self.at + READ])
                    self.at += len(tail)
                self.member = self.member or zlib.decompressobj(31)
                try:
                    part = self.member.decompress(tail, len(into))
                except zlib.error:
                    self.at, self.member = len(self.data), None
                    return 0
                if self.member.eof:
                    self.at -= len(self.member.unused_data)
                    self.member = None
            if part:
                into[: len(part)] = part
                return len(part)
        return 0


def parse_warc(data: bytes | pa.Buffer, onward: bool = False) -> Iterator[tuple]:
    """The records of a WARC file, gzipped or not, as tuples of SCHEMA's columns, unpacked as they are read.

    A record whose Content-Length is no number ends the file, as its block can't be told from what follows; with onward it is given as UNREADABLE, with its headers and
    without a block, so that what is lost can be counted, and reading goes on at the next line that starts a record. One that the file's end cuts is left out.
    """
    stream = io.BufferedReader(_Chunks(data), READ)
    known = {"warc-type": 0, "warc-record-id": 1, "warc-refers-to": 2, "warc-target-uri": 3, "warc-date": 4, "content-type": 5, "warc-block-digest": 6, "warc-payload-digest": 7}
    while line := stream.readline(READ):
        if not line.startswith(b"WARC/"):
            continue
        row, headers, length = [None] * 8, [], "0"
        while (line := stream.readline()).strip():
            key, _, value = (part.strip() for part in line.decode("utf-8", "replace").partition(":"))
            if key.lower() == "content-length":
                length = value
            elif key.lower() in known and row[known[key.lower()]] is None:
                row[known[key.lower()]] = value
            else:
                headers.append({"key": key, "value": value})
        if not (length.isascii() and length.isdigit()):
            if not onward:
                return
            yield (UNREADABLE, *row[1:], headers, None)
            continue
        block = stream.read(int(length))
        if len(block) < int(length):
            return
        yield (*row, headers, block)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under a path, read by Spark's binary file source: one task a file, which it holds packed as it
    is, unpacking one record at a time and handing on BATCH bytes of them."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                for held in _bounded(parse_warc(data.as_buffer(), onward=True)):
                    yield _batch(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parsed, SCHEMA)
