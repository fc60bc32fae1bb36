"""WARC derivatives: metadata and plain-text conversion records that refer to their response records."""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSE = "record_id string, headers map<string,string>, block binary"
DERIVED = "source_id string, warc_type string, record_id string, headers map<string,string>, block string, record string"

_MARK = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9]*)|[!?/])")
_RAW = frozenset(("script", "style", "noscript", "template"))
_BREAKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article nav header footer aside main pre blockquote form dl dt dd hr body html".split())
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in (*_RAW, "title")}
_HEAD_END = re.compile(r"</head\s*>|<body\b", re.IGNORECASE)
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.IGNORECASE)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9._:-]+)", re.IGNORECASE)


def sha1_digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_uri(*parts: str) -> str:
    """A record id that depends on its parts alone, so that a task run again makes the same one."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def read_page(page: str) -> tuple[str, list[tuple[str, str]]]:
    """The visible text of a page, a line for each block, and its title, language and outgoing links in order.

    One pass from mark to mark: what a missing end would hide is looked for once for each kind of end, so that the time is
    in proportion to the length, whatever is left open.
    """
    out, title, lang, links = [], None, None, []
    missing: set = set()
    at, hidden_to = 0, 0  # text before hidden_to is in the head

    def text(start: int, stop: int) -> None:
        start = max(start, hidden_to)
        if start < stop:
            out.append(page[start:stop])

    def end_of(pattern: re.Pattern, start: int) -> re.Match | None:
        found = None if pattern in missing else pattern.search(page, start)
        if found is None:
            missing.add(pattern)
        return found

    while (m := _MARK.search(page, at)) is not None:
        text(at, m.start())
        if m[1]:
            stop = page.find("-->", m.end())
            at = len(page) if stop < 0 else stop + 3
            continue
        close = page.find(">", m.end())
        if close < 0:  # not a tag, and nothing behind it is
            at = m.start()
            break
        name, at = (m[3] or "").lower(), close + 1
        if name in _BREAKS:
            if m.start() >= hidden_to:
                out.append("\n")
            if name == "html" and lang is None and (said := _LANG.search(page, m.end(), close)):
                lang = said[1]
        elif m[2]:
            continue
        elif name in _RAW:
            found = end_of(_CLOSE[name], at)
            at = found.end() if found else len(page)
        elif name == "head" and at > hidden_to:  # a head within a head ends with it
            found = end_of(_HEAD_END, at)
            hidden_to = max(hidden_to, found.start()) if found else hidden_to
        elif name == "title" and title is None:
            found = end_of(_CLOSE[name], at)
            title = page[at : found.start()] if found else None
        elif name == "a" and (to := _HREF.search(page, m.end(), close + 1)):
            links.append(to[1] or to[2] or to[3] or "")
    text(at, len(page))
    one = lambda s: " ".join(html.unescape(s).split())
    fields = [("title", one(title))] if title is not None else []
    fields += [("language", lang)] if lang is not None else []
    fields += [("outlink", one(x)) for x in links]
    lines = (_BLANKS.sub(" ", x).strip() for x in html.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), fields


def plain_text(page: str) -> str:
    return read_page(page)[0]


def http_headers(head: bytes) -> dict[str, str]:
    """Header fields of a response by small name; of those that repeat the last counts."""
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}


def unchunked(body: bytes) -> bytes:
    """The body without its chunk sizes; a body that breaks the format is left as it is."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = body[at:line].split(b";")[0].strip() if line >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return body
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + n])
        at = line + 4 + n


#: Bytes that a body may become when it is unpacked; what is beyond is cut, as one small body can name terabytes.
LARGEST_BODY = 1 << 28


def _inflated(body: bytes, bits: int, largest: int) -> bytes:
    """All members of a packed body, one behind the other; bytes behind the last that are no member are left out."""
    out, size = [], 0
    while body and size < largest:
        unpack = zlib.decompressobj(bits)
        try:
            out.append(unpack.decompress(body, largest - size))
        except zlib.error:
            if not out:
                raise
            break
        size += len(out[-1])
        if not unpack.eof or bits < 31:
            break
        body = unpack.unused_data
    return b"".join(out)


def unpacked(body: bytes, encoding: str, largest: int = LARGEST_BODY) -> bytes:
    """The body without its content encodings (gzip, deflate), applied last first.

    A body of several gzip members is all of them. What can't be read, or is packed otherwise (br, zstd), is left as it is.
    """
    for name in reversed([x.strip().lower() for x in encoding.split(",")]):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(name, ()):
            try:
                body = _inflated(body, bits, largest)
                break
            except zlib.error:
                continue
    return body


def decoded(body: bytes, content_type: str) -> str:
    """The body as text: by byte order mark, the header's charset, the page's own, or UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if body.startswith(mark):
            return body.decode(name, "replace")
    said = _CHARSET.search(content_type) or _CHARSET.search(body[:2048].decode("latin-1"))
    try:
        return body.decode(codecs.lookup(said[1]).name if said else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


def serialise(headers: dict[str, str], block: str) -> str:
    """One record as it stands in a file, up to its last line end."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}\r\n{block}\r\n"


def derive(source_id: str, headers: dict[str, str], block: bytes) -> list[dict]:
    """The metadata and the conversion record of one response, whose body may be chunked, packed and in any charset."""
    head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    http = http_headers(head)
    if "chunked" in http.get("transfer-encoding", "").lower():
        payload = unchunked(payload)
    text, found = read_page(decoded(unpacked(payload, http.get("content-encoding", "")), http.get("content-type", "")))
    payload_digest = headers.get("WARC-Payload-Digest") or sha1_digest(payload)
    shared = {k: headers[k] for k in ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Warcinfo-ID") if headers.get(k)}
    status = head.split(b"\r\n", 1)[0].decode("latin-1")
    fields = [("http-status", status)] * bool(status) + [("source-payload-digest", payload_digest), ("source-block-digest", headers.get("WARC-Block-Digest") or sha1_digest(block)), *found]
    out = []
    for kind, content_type, said in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)),
        ("conversion", "text/plain; charset=utf-8", text),
    ):
        said = said.encode("utf-8", "replace").decode()
        raw = said.encode()
        own = {"WARC-Type": kind, "WARC-Record-ID": record_uri(source_id, kind), "WARC-Refers-To": source_id, **shared}
        own |= {f"X-Source-{k}": v for k, v in headers.items() if v is not None and k not in shared}
        own |= {"WARC-Block-Digest": sha1_digest(raw), "Content-Type": content_type, "Content-Length": str(len(raw))}
        out.append({"source_id": source_id, "warc_type": kind, "record_id": own["WARC-Record-ID"], "headers": list(own.items()), "block": said, "record": serialise(own, said)})
    return out


_DERIVED_ARROW = pa.schema([("source_id", pa.string()), ("warc_type", pa.string()), ("record_id", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.string()), ("record", pa.string())])


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, heads, blocks = batch.columns
        for at in range(0, len(ids), 64):  # records of a few pages at a time
            rows = []
            for i in range(at, min(at + 64, len(ids))):
                headers, block = dict(heads[i].as_py() or []), blocks[i].as_py() or b""
                rows += derive(ids[i].as_py() or record_uri(headers.get("WARC-Target-URI") or "", sha1_digest(block)), headers, block)
            yield pa.RecordBatch.from_pylist(rows, _DERIVED_ARROW)


def warc_derivatives(responses: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every response record (record_id, headers, block).

    Both name their response in WARC-Refers-To, keep its target, date and address, carry its other headers as X-Source-*
    and have block digests of their own; the metadata record states the response's payload and block digests, which are
    computed where its headers lack them. Null or empty blocks give records with an empty page, a null record_id an
    id made of target and block, null headers none. Repeated rows are derived each, with the same ids; an empty table gives an empty table; other
    columns are ignored. One scan, no shuffle; every record is made whole, in the task that holds its response.
    Result: source_id, warc_type, record_id, headers, block, record (serialised, without its last line end).
    """
    return responses.select("record_id", "headers", "block").mapInArrow(_derive, DERIVED)


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages (page_id, url, html), with page_id kept beside them."""
    html_bytes = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html_bytes).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    hexed = F.sha2(F.concat_ws("\0", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))).cast("binary"), 256)
    part = lambda a, n: F.substring(hexed, a, n)
    record_id = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))
    names = F.array(F.lit("WARC-Type"), F.lit("WARC-Record-ID"), F.lit("WARC-Date"), F.lit("Content-Type"), F.lit("WARC-Target-URI"))
    values = F.array(F.lit("response"), record_id, F.lit(date), F.lit("application/http; msgtype=response"), F.col("url"))
    headers = F.map_filter(F.map_from_arrays(names, values), lambda k, v: v.isNotNull())
    return pages.select("page_id", record_id.alias("record_id"), headers.alias("headers"), F.concat(head, html_bytes).alias("block"))


def write_warc(derived: DataFrame, path: str) -> None:
    """Write serialised records as gzip-compressed WARC files, one for each partition."""
    derived.select("record").write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


class _Damage(Exception):
    """A gzip member that can't be unpacked; the offset of its start in the file."""

    def __init__(self, at: int):
        super().__init__(f"damaged gzip member at byte {at}")
        self.at = at


_MEMBER = b"\x1f\x8b\x08"


def _pieces(raw: bytes, size: int = 1 << 16) -> Iterator[bytes | _Damage]:
    """The bytes of a file, plain or of gzip members, a piece at a time; a damaged member ends with a note of it.

    Behind a damaged member, and behind padding, the next mark of a member is looked for.
    """
    if raw[:3] != _MEMBER:
        yield from (raw[i : i + size] for i in range(0, len(raw), size))
        return
    start, view = 0, memoryview(raw)
    while (start := raw.find(_MEMBER, start)) >= 0:
        at, unpack = start, zlib.decompressobj(31)
        while not unpack.eof and at < len(raw):
            given = view[at : at + size]
            try:
                piece = unpack.decompress(given)
            except zlib.error:
                break
            at += len(given) - len(unpack.unused_data)
            if piece:
                yield piece
        if not unpack.eof and at < len(raw):
            yield _Damage(start)
            start += len(_MEMBER)
        else:
            start = at


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file, plain or of gzip members; a record and a piece are held at a time.

    Records follow each other by their Content-Length. Where none starts, the next line that does is looked for. A record in a
    damaged gzip member is lost; in its place stands one of type "damage" with the member's X-Offset in the file. A file
    that is cut short gives what there is of its last record.
    """
    pieces, held = _pieces(raw), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if isinstance(piece, _Damage):
            raise piece
        held.extend(piece or b"")
        return piece is not None

    while True:
        try:
            record = _next_record(held, more)
        except _Damage as damage:
            held.clear()
            yield {"WARC-Type": "damage", "X-Offset": str(damage.at)}, b""
            continue
        if record is None:
            return
        yield record


def _next_record(held: bytearray, more) -> tuple[dict[str, str], bytes] | None:
    """The next record of what is held, which grows by `more`; None at the end."""
    while True:
        blank = len(held) - len(held.lstrip(b"\r\n"))
        del held[:blank]
        if len(held) < 7:
            if not more():
                return None
            continue
        if not held.startswith(b"WARC/1."):
            at = held.find(b"\nWARC/1.")
            if at < 0:
                del held[:-8]
                if not more():
                    return None
            else:
                del held[: at + 1]
            continue
        looked = 0
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            if not more():
                return None
        lines = held[:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = headers.get("Content-Length", "0")
        stop = end + 4 + (int(length) if length.isdigit() else 0)
        while len(held) < stop and more():
            pass
        block = bytes(held[end + 4 : stop])
        del held[:stop]
        return headers, block


def read_warc(spark: SparkSession, path: str, warc_type: str | None = "response") -> DataFrame:
    """Records (record_id, headers, block) of WARC files; of all types where warc_type is None.

    Damaged members don't stop a file: see parse_warc, and ask for the type "damage" to list them. Empty files have no records.
    A file comes to one task whole, as it is stored (2 GB at most, and held several times over on its way to Python); unpacked
    it is record by record.
    """

    def run(batches):
        arrow = pa.schema([("record_id", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
        for batch in batches:
            for raw in batch.column(0):
                rows, size = [], 0
                for h, b in parse_warc(raw.as_py()):
                    if warc_type is None or h.get("WARC-Type") == warc_type:
                        rows.append({"record_id": h.get("WARC-Record-ID"), "headers": list(h.items()), "block": b})
                        size += len(b)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RESPONSE)
