"""Ogg media columns: write texts as Ogg files, read them back with full verification, describe them.

A file has two logical streams, interleaved by page: samples (8-bit, mono, one byte a sample) and
an index of its packets. Reading verifies each page's checksum, version and sequence number,
reassembles packets from lacing values across pages, separates the streams by serial number and
derives times from granule positions.

One pass of Arrow batches, no shuffle; a task holds a few documents' bytes. Defined results: a null
text is empty and gives 192 spaces; equal texts give equal files; repeated rows and extra columns
make no difference; rows of a null id are described like others; an empty table gives no rows; texts of any
length are written whole. A damaged file raises `OggError`. A packet's end is the granule position of its
page, less the samples of later packets that end there too.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the container format.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
HEAD = struct.Struct("<4sBBqIIIB")
UNFINISHED = -1

UNIT = 192
RATE = 8000
PACKET = 9600
SEGMENTS = 255
SAMPLES, INDEX = 1, 2  # serial numbers

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """The container's CRC-32: polynomial 04C11DB7, bits not reflected, zero start and end.

    It is the mirror image of the common CRC over mirrored bytes, which zlib computes.
    """
    common = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{common:032b}"[::-1], 2)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


@dataclass
class Stream:
    """Writes one logical stream page by page."""

    serial: int
    number: int = 0
    lacing: bytearray = field(default_factory=bytearray)
    body: bytearray = field(default_factory=bytearray)
    granule: int = UNFINISHED
    open_packet: bool = False

    def flush(self, last: bool = False, open_after: bool = False) -> bytes:
        flags = CONTINUED * self.open_packet | FIRST * (self.number == 0) | LAST * last
        page = _page(flags, self.granule, self.serial, self.number, bytes(self.lacing), bytes(self.body))
        self.number, self.granule, self.open_packet = self.number + 1, UNFINISHED, open_after
        self.lacing.clear()
        self.body.clear()
        return page

    def add(self, packet: bytes, granule: int) -> list[bytes]:
        """Laces a packet into pages; gives those that became full."""
        pages, at = [], 0
        values = [255] * (len(packet) // 255) + [len(packet) % 255]
        while values:
            if len(self.lacing) == SEGMENTS:
                pages.append(self.flush(open_after=at > 0))
            take = values[: SEGMENTS - len(self.lacing)]
            values = values[len(take) :]
            self.lacing += bytes(take)
            self.body += packet[at : at + sum(take)]
            at += sum(take)
        self.granule = granule
        return pages


def write(payload: bytes) -> bytes:
    """An Ogg file of two streams that holds payload."""
    samples, index = Stream(SAMPLES), Stream(INDEX)
    samples.add(b"\x7fSAMPLES" + struct.pack("<BBIQ", 8, 1, RATE, len(payload)), 0)
    index.add(b"\x7fINDEX" + struct.pack("<I", PACKET), 0)
    out = [samples.flush(), index.flush()]
    for at in range(0, len(payload), PACKET):
        packet = payload[at : at + PACKET]
        out += samples.add(packet, at + len(packet))
        out += index.add(struct.pack("<QI", at, len(packet)), at + len(packet))
    return b"".join([*out, samples.flush(last=True), index.flush(last=True)])


def read(media: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Packets of each logical stream, with the granule position at which each is known to have ended (or -1)."""
    packets: dict[int, list[tuple[bytes, int]]] = {}
    numbers: dict[int, int] = {}
    parts: dict[int, list[bytes]] = {}
    ended: set[int] = set()
    at = 0
    while at < len(media):
        if len(media) - at < HEAD.size:
            raise OggError(f"a page is cut short at {at}")
        capture, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        if capture != CAPTURE or version:
            raise OggError(f"no page at {at}")
        lacing = media[at + HEAD.size : at + HEAD.size + n]
        begin = at + HEAD.size + n
        end = begin + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise OggError(f"a page is cut short at {at}")
        page = media[at:end]
        if checksum(page[:22] + bytes(4) + page[26:]) != crc:
            raise OggError(f"wrong checksum at {at}")
        if bool(flags & FIRST) != (serial not in numbers) or serial in ended:
            raise OggError(f"stream {serial} has its pages out of place")
        if number != numbers.get(serial, -1) + 1:
            raise OggError(f"stream {serial} lacks page {numbers.get(serial, -1) + 1}")
        numbers[serial] = number
        held = parts.setdefault(serial, [])
        if bool(flags & CONTINUED) != bool(held):
            raise OggError(f"stream {serial} has a packet without its beginning or end")
        got = packets.setdefault(serial, [])
        at, last_packet = begin, None
        run = 0
        for i, value in enumerate(lacing):
            run += value
            if value < 255:
                held.append(media[at : at + run])
                got.append((b"".join(held), UNFINISHED))
                held.clear()
                at, run, last_packet = at + run, 0, i
        if run or (n and last_packet != n - 1):
            held.append(media[at : at + run])
        if last_packet is not None:  # the position is that of the last packet that ends on the page
            got[-1] = (got[-1][0], granule)
        at = end
        if flags & LAST:
            ended.add(serial)
    if set(numbers) != ended or any(parts.values()):
        raise OggError("a stream has no end")
    return packets


def payload(media: bytes) -> tuple[bytes, list[tuple[float, float]]]:
    """The samples, read back and held against the index stream, and each packet's begin and end in seconds."""
    streams = read(media)
    (head, _), *body = streams[SAMPLES]
    bits, channels, rate, n = struct.unpack_from("<BBIQ", head, 8)
    if (bits, channels) != (8, 1):
        raise OggError("unknown sample form")
    data = b"".join(x for x, _ in body)
    times, to = [], UNFINISHED
    for packet, granule in reversed(body):
        # a granule position is the end of the last packet that ends on its page; packets before it end where the next begins
        if granule != UNFINISHED and to not in (UNFINISHED, granule):
            raise OggError("a granule position disagrees with the samples after it")
        to = granule if granule != UNFINISHED else to
        times.append((to - len(packet), to))
        to -= len(packet)
    times.reverse()
    index = [struct.unpack("<QI", x) for x, _ in streams[INDEX][1:]]
    if (times[0][0], times[-1][1], len(data)) != (0, n, n) or index != [(a, b - a) for a, b in times]:
        raise OggError("samples are missing, or the index or a granule position disagrees with them")
    return data, [(a / rate, b / rate) for a, b in times]


def features(data: bytes, times: list[tuple[float, float]]) -> str:
    """Packets, duration in ms, mean, deviation and mid-line crossings of the samples, and the peak packet's begin in ms."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    n, total = len(x), int(x.sum())
    deviation = (n * int((x * x).sum()) - total * total) ** 0.5 / n
    crossings = int(((x[1:] > 96) != (x[:-1] > 96)).sum())
    energy = [int(x[i : i + PACKET].sum()) for i in range(0, n, PACKET)]
    peak = max(range(len(energy)), key=lambda i: (energy[i], -i))
    return f"{len(times)};{times[-1][1] * 1000:.3f};{total / n:.3f};{deviation:.3f};{crossings};{times[peak][0] * 1000:.0f}"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def describe(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """One row per row of docs: sizes, hashes of the samples as read back and of the stored file, features; the file if asked."""
    fields = [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ] + ([("media", pa.binary())] if with_media else [])
    out = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    n, data = padded(text)
                    media = write(data)
                    back, times = payload(media)
                    row = (
                        doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media),
                        hashlib.sha256(media).hexdigest(), features(back, times),
                    )
                    rows.append((*row, media) if with_media else row)
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    ddl = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string" + (", media binary" if with_media else "")
    )
    return d.mapInArrow(run, ddl)
