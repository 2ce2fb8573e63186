"""Media column: samples in an Ogg bitstream.

``mux`` interleaves logical streams into pages (lacing values, granule positions, checksums), ``demux``
verifies every page checksum, reassembles packets from the lacing values, separates the logical streams
and derives each packet's time from the granule positions. ``store`` and ``load`` apply them to columns.

Null and empty texts give one packet of fill bytes; a very long text is one bitstream of many pages, built and
read in memory one row at a time. Rows are independent: repeated rows give repeated results, an empty table
none. ``demux`` leaves a damaged page out and reports it, with the packets that it cuts; ``load`` gives such a
bitstream, and a null one, a row with the reason and null results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainloom.llm.common import map_texts, narrow

RATE = 8000
BLOCK = 576
FILL = 255
CONTINUED, FIRST, LAST = 1, 2, 4
_PAGE = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """Ogg's CRC (polynomial 0x04c11db7, most significant bit first, no inversions).

    It is the mirror image of zlib's CRC with both inversions taken back, over mirrored bytes.
    """
    mirrored = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Packet:
    data: bytes
    end: int | None = None  # granule position after the packet
    seconds: float | None = None  # start time


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    ended: bool = False


@dataclass
class Physical:
    streams: dict[int, Stream] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    pages: int = 0


def _page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def pages(serial: int, packets: list[tuple[bytes, int]], header: int = 1) -> list[tuple[int, bytes]]:
    """Pages of one logical stream as (granule position, bytes); each of the first ``header`` packets has its own page."""
    out: list[tuple[int, bytes]] = []
    lacing, body, granule, continued = bytearray(), [], -1, 0

    def flush(last: bool = False):
        nonlocal granule, continued
        flags = continued | (FIRST if not out else 0) | (LAST if last else 0)
        out.append((granule, _page(serial, len(out), flags, granule, bytes(lacing), b"".join(body))))
        lacing.clear(), body.clear()
        granule, continued = -1, 0

    for k, (data, end) in enumerate(packets):
        values, at = b"\xff" * (len(data) // 255) + bytes([len(data) % 255]), 0
        while values:
            room = 255 - len(lacing)
            if not room:
                flush()
                continued = CONTINUED if at else 0
                continue
            take, values = values[:room], values[room:]
            n = sum(take)
            lacing += take
            body.append(data[at : at + n])
            at += n
        granule = end
        if k == len(packets) - 1 or k < header:
            flush(last=k == len(packets) - 1)
    return out


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """One physical bitstream: first pages first, then the rest in turn, by granule position within a stream."""
    own = [pages(serial, packets) for serial, packets in streams.items() if packets]
    out = [p[0][1] for p in own]
    for k in range(1, max(map(len, own), default=0)):
        out += [p[k][1] for p in own if k < len(p)]
    return b"".join(out)


def demux(data: bytes, rate: int = RATE, length=len) -> Physical:
    """The logical streams of a physical bitstream; ``length(packet)`` gives a packet's duration in granules.

    A page's granule position belongs to the last packet that ends on it; earlier packets of the page
    count back from there by their durations. Headers (granule 0) get the time 0.
    """
    out, at, pending, expected = Physical(), 0, {}, {}
    while at < len(data):
        if data[at : at + 4] != b"OggS":
            found = data.find(b"OggS", at + 1)
            out.errors.append(f"no page at {at}")
            if found < 0:
                break
            at = found
        if at + 27 > len(data):
            out.errors.append(f"cut page at {at}")
            break
        _, version, flags, granule, serial, sequence, crc, count = _PAGE.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + count]
        size = sum(lacing)
        stop = at + 27 + count + size
        if stop > len(data) or version or len(lacing) < count:
            out.errors.append(f"cut page at {at}")
            at += 4
            continue
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : stop]) != crc:
            out.errors.append(f"bad checksum at {at}")
            at += 4
            continue
        out.pages += 1
        s = out.streams.setdefault(serial, Stream(serial))
        s.pages += 1
        if sequence != expected.get(serial, 0):
            out.errors.append(f"stream {serial}: page {sequence} instead of {expected.get(serial, 0)}")
            pending.pop(serial, None)
        expected[serial] = sequence + 1
        body, done = at + 27 + count, []
        open_ = pending.pop(serial, None)
        skip = bool(flags & CONTINUED) and open_ is None  # its beginning is lost
        if not flags & CONTINUED and open_ is not None:
            out.errors.append(f"stream {serial}: packet without an end")
            open_ = None
        run, ended = 0, True
        for v in lacing:
            run += v
            ended = v < 255
            if ended:
                piece = data[body : body + run]
                if skip:
                    skip = False
                else:
                    done.append(Packet((open_ or b"") + piece))
                open_, body, run = None, body + run, 0
        if not ended and not skip:
            pending[serial] = (open_ or b"") + data[body : body + run]
        if granule >= 0:
            end = granule
            for p in reversed(done):
                p.end = end
                end = max(0, end - (length(p.data) if granule else 0))
                p.seconds = end / rate
        s.packets += done
        s.ended |= bool(flags & LAST)
        at = stop
    for serial in pending:
        out.errors.append(f"stream {serial}: packet without an end")
    return out


# --- samples of a text -----------------------------------------------------------

SAMPLES, NOTES = 1, 2  # serial numbers
_NOTE = struct.Struct("<8sq")


def encode(raw: bytes) -> bytes:
    """Unsigned 8-bit samples, one packet a block, beside a second stream that notes how many of them are data."""
    padded = raw + bytes([FILL]) * (-len(raw) % BLOCK or (0 if raw else BLOCK))
    header = b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, RATE, 8, 1, BLOCK, 0)
    blocks = [(padded[i : i + BLOCK], i + BLOCK) for i in range(0, len(padded), BLOCK)]
    return mux({SAMPLES: [(header, 0), *blocks], NOTES: [(b"NOTES   ", 0), (_NOTE.pack(b"LENGTH  ", len(raw)), len(padded))]})


def decode(media: bytes) -> tuple[int, bytes, Physical]:
    """Bytes of data, padded samples in the order of their times, and what was read."""
    found = demux(media)
    if found.errors:
        raise ValueError("; ".join(found.errors[:3]))
    header, *blocks = found.streams[SAMPLES].packets
    rate = struct.unpack_from(">I", header.data, 16)[0]
    if rate != RATE or any(p.seconds is None for p in blocks):
        raise ValueError("not this operator's samples")
    blocks.sort(key=lambda p: p.seconds)
    return _NOTE.unpack(found.streams[NOTES].packets[1].data)[1], b"".join(p.data for p in blocks), found


def feature(payload: bytes, found: Physical) -> str:
    """Loudness, zero crossings and length of the samples as read, all from whole-number sums."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    power, crossings = int((x * x).sum()), int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    last = found.streams[SAMPLES].packets[-1]
    return f"seconds={last.end / RATE:.4f};packets={len(found.streams[SAMPLES].packets) - 1};pages={found.pages};power={power / len(x):.4f};crossings={crossings};peak={int(np.abs(x).max())}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``media``, the Ogg bitstream that holds the text's UTF-8 bytes as samples."""

    def run(batch):
        return {"doc_id": batch.column("doc_id"), "media": [encode(t.as_buffer().to_pybytes()) for t in batch.column("text")]}

    return map_texts(narrow(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text")), run, "doc_id long, media binary")


_READ = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "payload", "errors")


def _read(media: bytes | None) -> tuple:
    """The values of _READ for one bitstream; what can't be read is null, and ``errors`` says why."""
    if media is None:
        return (*[None] * 8, "no media")
    own = len(media), hashlib.sha256(media).hexdigest()
    try:
        n, data, found = decode(media)
        return n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), *own, feature(data, found), data, None
    except (ValueError, LookupError, struct.error) as e:
        return None, None, None, None, *own, None, None, f"{type(e).__name__}: {e}"


def load(media: DataFrame, payload: bool = False) -> DataFrame:
    """What the bitstreams of ``media`` hold; with ``payload`` also the samples themselves.

    A null or damaged bitstream gives a row with its own size and digest only and the reason in ``errors``.
    """

    def run(batch):
        rows = [_read(m.as_buffer().to_pybytes() if m.is_valid else None) for m in batch.column("media")]
        return {"doc_id": batch.column("doc_id")} | dict(zip(_READ, zip(*rows)))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, errors string"
    return map_texts(media, run, schema + ", payload binary" * payload, "media")
