"""Ogg media columns: texts as 8-bit samples in two multiplexed logical streams, and their features.

Writing: a *samples* stream (header packet, then packets of ``PACKET`` samples, granule position =
samples up to the end of the last packet that a page completes) and an *about* stream (header
packet, then one packet with the payload's lengths), their pages interleaved.

Reading: every page's checksum is verified, packets are put together from lacing values (a value of
255 goes on, also over a page's end), pages go to their streams by serial number, sequence numbers
must be gapless, and times come from granule positions over the rate in the stream's header.

Fixed values of the container format: capture pattern ``OggS``, version 0, a header of 27 bytes,
flags 1 (continued), 2 (begin), 4 (end), generator polynomial 0x04c11db7.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 8000
PACKET = 4096
_HEADER = struct.Struct("<4sBBqIIIB")
_CRC_AT = 22
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """The container's CRC: no reflection, zero start.  The library's reflected CRC of the bits in
    opposite order gives the same polynomial's remainder, mirrored."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def payload_of(text: bytes | None) -> bytes:
    raw = text or b""
    return raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    page = bytearray(head + lacing + body)
    struct.pack_into("<I", page, _CRC_AT, checksum(bytes(page)))
    return bytes(page)


def _lace(packet: bytes) -> bytes:
    return b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])


def pages_of(packets: list[tuple[bytes, int]], serial: int, full: int = 255) -> list[bytes]:
    """Pages of one stream; a packet comes with the granule position at its end.

    The first packet has the first page to itself.  A packet that doesn't fit goes on in the next
    page; a page that completes no packet has granule position -1.
    """
    out: list[bytes] = []
    lacing, body, granule, going_on = bytearray(), bytearray(), -1, False

    def close(last: bool) -> None:
        nonlocal lacing, body, granule, going_on
        flags = going_on * 1 | (not out) * 2 | last * 4
        out.append(_page(flags, granule, serial, len(out), bytes(lacing), bytes(body)))
        going_on = bool(lacing) and lacing[-1] == 255
        lacing, body, granule = bytearray(), bytearray(), -1

    for i, (packet, position) in enumerate(packets):
        values, at = _lace(packet), 0
        while values:
            if len(lacing) == full:
                close(False)
            part, values = values[: full - len(lacing)], values[full - len(lacing) :]
            n = sum(part)
            lacing += part
            body += packet[at : at + n]
            at += n
        granule = position
        if i == 0 and len(packets) > 1:
            close(False)
    close(True)
    return out


def encode(payload: bytes, n_bytes: int, rate: int = RATE, packet: int = PACKET) -> bytes:
    """The physical stream of a payload; it depends on the payload and its length alone."""
    serial = zlib.crc32(payload)
    other = serial ^ 0x5A5A5A5A
    samples = [(b"\x01pcm8" + struct.pack("<IB", rate, 1), 0)]
    samples += [(payload[a : a + packet], min(a + packet, len(payload))) for a in range(0, len(payload), packet)]
    about = [(b"\x01about" + struct.pack("<B", 1), 0), (struct.pack("<QQ", n_bytes, len(payload)), 1)]
    a, b = pages_of(samples, serial), pages_of(about, other)
    # begin pages of all streams come first; then the about page goes between the samples' pages
    return b"".join([a[0], b[0], *a[1:2], *b[1:], *a[2:]])


def demultiplex(stored: bytes) -> tuple[dict[int, list[tuple[bytes, int]]], int]:
    """Packets by serial number, each with the granule position of the page that completes it."""
    view, at, count = memoryview(stored), 0, 0
    packets: dict[int, list[tuple[bytes, int]]] = {}
    open_: dict[int, list[bytes]] = {}
    numbers: dict[int, int] = {}
    ended: set[int] = set()
    while at < len(stored):
        if len(stored) - at < _HEADER.size:
            raise OggError("header cut short")
        magic, version, flags, granule, serial, number, crc, segments = _HEADER.unpack_from(stored, at)
        if magic != b"OggS" or version:
            raise OggError("no page where one was expected")
        lacing = stored[at + 27 : at + 27 + segments]
        start = at + 27 + segments
        end = start + sum(lacing)
        if len(lacing) < segments or end > len(stored):
            raise OggError("page cut short")
        if checksum(b"".join((view[at : at + _CRC_AT], b"\0\0\0\0", view[at + _CRC_AT + 4 : end]))) != crc:
            raise OggError("checksum differs")
        if (serial not in numbers) != bool(flags & 2) or numbers.get(serial, 0) != number or serial in ended:
            raise OggError("pages of a stream out of order")
        numbers[serial] = number + 1
        held = open_.setdefault(serial, [])
        if bool(held) != bool(flags & 1):
            raise OggError("continued packet without its start, or the reverse")
        done = packets.setdefault(serial, [])
        first_done = len(done)
        pos = start
        run = 0
        for value in lacing:
            run += value
            if value < 255:
                held.append(stored[pos : pos + run])
                done.append((b"".join(held) if len(held) > 1 else held[0], -1))
                held.clear()
                pos += run
                run = 0
        if run:
            held.append(stored[pos : pos + run])
        if len(done) > first_done:
            done[-1] = (done[-1][0], granule)
        if flags & 4:
            ended.add(serial)
            if held:
                raise OggError("last packet not completed")
        at, count = end, count + 1
    if ended != set(numbers):
        raise OggError("stream without its end")
    return packets, count


def decode(stored: bytes) -> dict:
    """Payload, lengths, rate, and times of the samples stream's pages in seconds."""
    streams, pages = demultiplex(stored)
    samples = about = None
    for packets in streams.values():
        if packets and packets[0][0].startswith(b"\x01pcm8"):
            samples = packets
        elif packets and packets[0][0].startswith(b"\x01about"):
            about = packets
    if samples is None or about is None or len(about) != 2:
        raise OggError("streams missing")
    rate, channels = struct.unpack_from("<IB", samples[0][0], 5)
    n_bytes, length = struct.unpack("<QQ", about[1][0])
    payload = b"".join(p for p, _ in samples[1:])
    marks = [g for _, g in samples[1:] if g >= 0]
    if len(payload) != length or not marks or marks[-1] != length:
        raise OggError("granule positions don't meet the samples")
    return {"payload": payload, "n_bytes": n_bytes, "rate": rate, "channels": channels, "pages": pages, "packets": sum(map(len, streams.values())), "streams": len(streams), "times": [g / rate for g in marks]}


def feature_of(media: dict) -> str:
    """Counts, duration and simple statistics of the samples, as one string."""
    x = np.frombuffer(media["payload"], np.uint8)
    level = x.astype(np.int64) - 128
    crossings = int(np.count_nonzero((level[1:] < 0) != (level[:-1] < 0)))
    rms = float(np.sqrt(np.mean(level * level)))
    return f"streams={media['streams']};pages={media['pages']};packets={media['packets']};seconds={media['times'][-1]:.6f};marks={len(media['times'])};mean={x.mean():.6f};rms={rms:.6f};crossings={crossings};distinct={len(np.unique(x))}"


def to_media(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Id and ``media`` (binary Ogg) of each text; null and empty texts are 64 zero samples."""
    docs = docs.select(F.col(id_col), F.col(text).cast("string").cast("binary").alias("_raw"))

    def run(batches):
        for b in batches:
            media = [encode(payload_of(t), len(t or b"")) for t in b.column("_raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(media, pa.binary())], names=[id_col, "media"])

    return docs.mapInArrow(run, docs.select(id_col).schema.add("media", "binary"))


def from_media(media: DataFrame, id_col: str = "doc_id", column: str = "media") -> DataFrame:
    """Digests and features of a media column, from its stored bytes; broken media raise OggError.

    Columns: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature.  Repeated rows give repeated rows; an empty table gives an empty one.
    """
    media = media.select(F.col(id_col), F.col(column).alias("_media"))
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = media.select(id_col).schema
    for n, k in zip(names, kinds):
        schema = schema.add(n, "long" if k == pa.int64() else "string")

    def run(batches):
        for b in batches:
            rows = []
            for stored in b.column("_media").to_pylist():
                m = decode(stored)
                p = m["payload"]
                rows.append((m["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(m)))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(id_col)] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=[id_col, *names])

    return media.mapInArrow(run, schema)
