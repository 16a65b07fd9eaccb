"""Legacy web archives (ARC, both versions) converted to WARC, with duplicates as revisits.

Pages are first put into ARC containers, versions 1 and 2 in turn.  The converter reads a
container's version block, takes each record's header line by that version's fields and exactly the
declared number of bytes after it, and synthesises what WARC asks for: a record id from the record's
place and content, a date from the 14 digits, a type, and a payload digest.  Of records with equal
payloads of ``least`` bytes or more the one with the largest key stays a response; the others
become revisits that name it and carry no payload.

Containers are rows of a table (``name``, ``content``), written by Spark, so that any store will do:
plain ARC, which the table compresses, and WARC with one gzip member per record.  Fixed values are those of the formats: ARC's URL records have
five fields in version 1 and ten in version 2.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

LEAST = 0
PER_CONTAINER = 8 << 20
#: The header lines' fields by version.
FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length".split(),
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
_STAMP = "20200101000000"
_SPACE = bytes(range(33)) + b"\x7f"


def _gz(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(content: bytes) -> Iterator[bytes]:
    """The gzip members of a container, one after another."""
    at = 0
    while at < len(content):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            piece = content[at : at + 65536]
            if not piece:
                raise ValueError("container cut short")
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(out)


def url_field(url: str | None) -> bytes:
    """A URL as a header line can hold it: white space and controls escaped, never empty."""
    raw = (url or "").encode()
    if any(c in _SPACE for c in raw):
        raw = b"".join(b"%%%02X" % c if c in _SPACE else bytes([c]) for c in raw)
    return raw or b"-"


#: Stands for a null key: no key is written so, since ``%`` itself is escaped.
NO_KEY = "%"


def key_field(key: str | None) -> str:
    """A key as a header line can hold it; ``key_of`` gives it back."""
    return NO_KEY if key is None else "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in key)


def key_of(field: str | None) -> str | None:
    return None if field in (None, NO_KEY) else unquote(field)


def record_id(place: str, key: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{place} {key} {digest}'.encode()).digest())}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_head(version: int, name: str) -> bytes:
    names = b" ".join(FIELDS[version])
    block = b"%d 0 local\n%s\n" % (version, names)
    more = b"" if version == 1 else b" 200 - - 0 " + name.encode()
    return b"filedesc://%s 0.0.0.0 %s text/plain%s %d\n%s\n" % (name.encode(), _STAMP.encode(), more, len(block), block)


def arc_record(version: int, name: str, offset: int, key: str, url: str | None, payload: bytes) -> bytes:
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Key: %s\r\nContent-Length: %d\r\n\r\n%s" % (key.encode(), len(payload), payload)
    more = b"" if version == 1 else b" 200 %08x - %d %s" % (zlib.crc32(payload), offset, name.encode())
    return b"%s 0.0.0.0 %s text/html%s %d\n%s\n" % (url_field(url), _STAMP.encode(), more, len(body), body)


def _line(content: bytes, at: int) -> tuple[bytes, int]:
    end = content.find(b"\n", at)
    if end < 0:
        raise ValueError("container cut short")
    return content[at:end], end + 1


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records of a container: key, url, date (ISO), mime, place, http (header block), payload."""
    line, at = _line(content, 0)
    if not line.startswith(b"filedesc://"):
        raise ValueError("no version block")
    n = int(line.rsplit(b" ", 1)[1])
    block = content[at : at + n]
    at += n + 1
    version = int(block.split(b" ", 1)[0])
    fields = block.split(b"\n")[1].split()
    if fields != FIELDS.get(version):
        raise ValueError(f"unknown header line of version {version}")
    name = line.split(b" ", 1)[0].removeprefix(b"filedesc://").decode()
    url, when, kind, length = (fields.index(x) for x in (b"URL", b"Archive-date", b"Content-type", b"Archive-length"))
    place = 0
    while at < len(content):
        line, at = _line(content, at)
        values = line.split(b" ")
        if len(values) != len(fields):
            raise ValueError("header line with other fields than its version has")
        n = int(values[length])
        end = at + n
        if content[end : end + 1] != b"\n":
            raise ValueError("declared length differs")
        cut = content.find(b"\r\n\r\n", at, end)
        http, payload = (content[at:cut], content[cut + 4 : end]) if cut >= 0 else (b"", content[at:end])
        d = values[when].decode()
        key = http.find(b"\r\nX-Key: ")
        key = http[key + 9 :].split(b"\r\n", 1)[0].decode() if key >= 0 else NO_KEY
        yield {"key": key, "url": values[url].decode(), "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", "mime": values[kind].decode(), "place": f"{name}#{place}", "http": http, "payload": payload}
        at, place = end + 1, place + 1


def warc_record(r: dict, refers_to: str | None, response: str | None = None) -> bytes:
    """A response, or a revisit without payload that names the response it repeats: its key and place."""
    body = r["http"] + b"\r\n\r\n" + (b"" if refers_to is not None else r["payload"])
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(r['place'], r['key'], r['digest'])}",
        f"WARC-Date: {r['date']}",
        f"WARC-Target-URI: {r['url']}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{r['digest']}",
        f"WARC-Identified-Payload-Type: {r['mime']}",
        f"X-Key: {r['key']}",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(response, refers_to, r['digest'])}", f"X-Refers-To-Key: {refers_to}"]
    else:
        head.insert(4, f"WARC-Block-Digest: sha1:{digest_of(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_warc(raw: bytes) -> dict:
    """Header fields of one record, and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("declared length differs")
    fields["block"] = rest[:n]
    return fields


def _containers(rows: Iterator[tuple[bytes, int]]) -> Iterator[tuple[str, bytes]]:
    """Close a container when it is full; its name is taken from what it holds."""
    held, size, seen, n = [], 0, hashlib.sha1(), 0
    for data, weight in rows:
        held.append(data)
        seen.update(zlib.crc32(data).to_bytes(4, "little"))
        size += weight
        n += 1
        if size >= PER_CONTAINER:
            yield seen.hexdigest(), b"".join(held)
            held, size, seen, n = [], 0, hashlib.sha1(), 0
    if held:
        yield seen.hexdigest(), b"".join(held)


CONTAINERS = "name string, content binary"


def _table(pairs: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n for n, _ in pairs], pa.string()), pa.array([c for _, c in pairs], pa.binary())], names=["name", "content"])


def write_arc(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as ARC containers of about ``PER_CONTAINER`` bytes; versions 1 and 2 alternate."""
    pages = pages.select(F.col(key).cast("string").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").cast("binary").alias("html"))

    def run(batches):
        part = TaskContext.get().partitionId()
        held, size, made, name, version = [], 0, 0, "", 1
        for b in batches:
            for k, u, h in zip(b.column("key").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist()):
                if not held:
                    version = 1 + made % 2
                    # a retried task names its containers as before
                    name = f"{hashlib.sha1(f'{k} {u}'.encode()).hexdigest()[:16]}-{part}-{made}.arc"
                    held.append(arc_head(version, name))
                held.append(arc_record(version, name, size, key_field(k), u, h or b""))
                size += len(held[-1])
                if size >= PER_CONTAINER:
                    yield _table([(name, b"".join(held))])
                    held, size, made = [], 0, made + 1
        if held:
            yield _table([(name, b"".join(held))])

    return pages.mapInArrow(run, CONTAINERS)


def read_arc(containers: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of ARC containers, with the digest and length of their payloads."""
    names = ["key", "place", "payload_bytes", "digest"] + ["url", "date", "mime", "http", "payload"] * with_payload
    kinds = {"payload_bytes": pa.int64(), "http": pa.binary(), "payload": pa.binary()}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    def run(batches):
        for b in batches:
            for content in b.column("content").to_pylist():
                rows, size = [], 0
                for r in parse_arc(content):
                    r |= {"payload_bytes": len(r["payload"]), "digest": digest_of(r["payload"])}
                    rows.append(r)
                    size += len(r["payload"])
                    if size >= PER_CONTAINER:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    schema = ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'binary' if n in kinds else 'string'}" for n in names)
    return containers.mapInArrow(run, schema)


def revisits(index: DataFrame, key_type: str = "long", least: int = LEAST) -> DataFrame:
    """``place``, ``refers_to``, ``response`` (its place) of the records that repeat another one's payload.

    The response of a digest is the record with the largest key (null keys below all); records that
    share that key are all responses.
    """
    index = index.filter(F.col("payload_bytes") >= least).withColumn("k", F.expr(f"case when key <> '{NO_KEY}' then try_cast(url_decode(replace(key, '+', '%2B')) as {key_type}) end"))
    best = F.max(F.when(F.col("k").isNotNull(), F.struct("k", "key", "place"))).alias("best")
    top = index.groupBy("digest", "payload_bytes").agg(best, F.count(F.lit(1)).alias("n")).filter("n > 1 and best is not null")
    top = top.select("digest", "payload_bytes", F.col("best.k").alias("top"), F.col("best.key").alias("refers_to"), F.col("best.place").alias("response"))
    joined = index.join(top, ["digest", "payload_bytes"]).filter(~F.col("k").eqNullSafe(F.col("top")))
    return joined.select("place", "refers_to", "response")


def convert(arcs: DataFrame, key_type: str = "long", least: int = LEAST) -> DataFrame:
    """WARC containers for ARC containers: every record once, as response or revisit."""
    index = shared.materialise(read_arc(arcs, with_payload=False), "index")
    found = shared.materialise(revisits(index, key_type, least), "revisits")
    joined = read_arc(arcs).join(found, "place", "left")

    def run(batches):
        def rows():
            for b in batches:
                cols = {n: b.column(n).to_pylist() for n in b.schema.names}
                for i in range(b.num_rows):
                    r = {n: c[i] for n, c in cols.items()}
                    data = _gz(warc_record(r, r["refers_to"], r["response"]))
                    yield data, len(data)

        for name, content in _containers(rows()):
            yield _table([(f"{name}.warc.gz", content)])

    return joined.mapInArrow(run, CONTAINERS)


def read_warc(containers: DataFrame, key_type: str = "long") -> DataFrame:
    """Per record: key, payload_bytes, payload_digest, record_type, refers_to, url, record_id, date,
    refers_to_record (the response's record id).

    Of a response the digest is computed from the payload read back and must equal the header's; a
    revisit has those of the payload that it stands for.
    """
    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "date", "refers_to_record"]

    def run(batches):
        for b in batches:
            for content in b.column("content").to_pylist():
                rows = []
                for raw in members(content):
                    f = parse_warc(raw)
                    http, _, payload = f["block"].partition(b"\r\n\r\n")
                    declared = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f["WARC-Type"] == "response" and (len(payload) != declared or digest_of(payload) != digest):
                        raise ValueError("payload differs from its digest")
                    rows.append((key_of(f.get("X-Key")), declared, digest, f["WARC-Type"], key_of(f.get("X-Refers-To-Key")), f["WARC-Target-URI"], f["WARC-Record-ID"], f["WARC-Date"], f.get("WARC-Refers-To")))
                cols = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "payload_bytes" else pa.string()) for n, c in zip(names, cols)], names=names)

    out = containers.mapInArrow(run, ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'string'}" for n in names))
    return out.withColumns({c: F.expr(f"try_cast({c} as {key_type})") for c in ("key", "refers_to")})


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """WARC containers (a table in the shared folder) of ``pages``, by way of ARC.

    A null or empty html is an empty payload, and such pages repeat one another.  A null key is kept
    as null and never becomes the response while its payload has a row with a key.  Null urls become
    ``-``, white space in urls is escaped.  Repeated rows of the top key are all responses.  Other
    columns, whatever their names, are not read.  A page of any length is one record; keys of text may
    hold any characters, or none.  An empty table gives no container.
    """
    kind = pages.schema[key].dataType.simpleString()
    arcs = shared.materialise(write_arc(pages, key, url, html), "arc")
    made = shared.materialise(convert(arcs, kind, least), "warc")
    shared.drop_table(arcs)
    return made
