"""Ogg media columns: writing and reading the Ogg page format over binary columns.

The reader verifies each page's checksum, demultiplexes logical streams by serial number, reassembles packets from
lacing values (a value of 255 continues, also over page borders) and derives timestamps from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import map_column, text_or_empty

CAPTURE = b"OggS"
#: Samples a second of the payload streams, and samples a packet.
RATE, PACKET = 8000, 960
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_NO_POSITION = 2**64 - 1


class OggError(ValueError):
    pass


def page_crc(data: bytes) -> int:
    """Ogg's checksum: polynomial 0x04c11db7, most significant bit first, no initial or final inversion. It is zlib's
    CRC of the bit-reversed bytes, bit-reversed, without zlib's inversions."""
    raw = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def write_page(serial: int, sequence: int, granule: int, lacing: bytes, body: bytes, flags: int) -> bytes:
    head = struct.pack("<4sBBQIII", CAPTURE, 0, flags, granule, serial, sequence, 0) + bytes([len(lacing)]) + lacing
    page = bytearray(head + body)
    page[22:26] = page_crc(bytes(page)).to_bytes(4, "little")
    return bytes(page)


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """serial -> [(packet, granule position at its end)] to Ogg bytes. Pages of all streams take turns; a page holds at
    most 255 lacing values; all first pages come first, as the format asks."""
    pages: dict[int, list[bytes]] = {}
    for serial, packets in streams.items():
        out, lacing, body, granule, continued, bos = [], bytearray(), bytearray(), _NO_POSITION, False, True

        def flush(last: bool, serial=serial, out=out):
            nonlocal lacing, body, granule, continued, bos
            starts_inside = continued
            continued = bool(lacing) and lacing[-1] == 255
            flags = (1 if starts_inside else 0) | (2 if bos else 0) | (4 if last else 0)
            out.append(write_page(serial, len(out), granule, bytes(lacing), bytes(body), flags))
            lacing, body, granule, bos = bytearray(), bytearray(), _NO_POSITION, False

        for n, (packet, end) in enumerate(packets):
            values = [255] * (len(packet) // 255) + [len(packet) % 255]
            at = 0
            for v in values:
                if len(lacing) == 255:
                    flush(False)
                lacing.append(v)
                body += packet[at : at + v]
                at += v
            granule = end
            if n == 0 and len(packets) > 1:
                flush(False)  # the first packet has its page to itself
        flush(True)
        pages[serial] = out
    queues = [list(reversed(p)) for p in pages.values()]
    result = []
    while any(queues):
        for q in queues:
            if q:
                result.append(q.pop())
    return b"".join(result)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int | None] = field(default_factory=list)  #: granule position at a packet's end, where a page states it
    pages: int = 0
    ended: bool = False
    _partial: bytearray | None = None
    _next: int = 0


def demux(data: bytes) -> dict[int, Stream]:
    """Read all pages. Raises OggError for a damaged page, a lost page or a packet left open."""
    streams: dict[int, Stream] = {}
    at, size = 0, len(data)
    while at < size:
        if data[at : at + 4] != CAPTURE or size - at < 27:
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, sequence, crc, n = struct.unpack_from("<4sBBQIIIB", data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > size:
            raise OggError(f"cut page at byte {at}")
        page = data[at:end]
        if page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        if flags & 2:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial] = Stream(serial)
        s = streams.get(serial)
        if s is None or sequence != s._next or s.ended:
            raise OggError(f"page {sequence} of stream {serial} out of order")
        if bool(flags & 1) != (s._partial is not None):
            raise OggError(f"packet broken at page {sequence} of stream {serial}")
        s._next, s.pages = sequence + 1, s.pages + 1
        pos, first = at + 27 + n, len(s.packets)
        for v in lacing:
            if s._partial is None:
                s._partial = bytearray()
            s._partial += data[pos : pos + v]
            pos += v
            if v < 255:
                s.packets.append(bytes(s._partial))
                s.ends.append(None)
                s._partial = None
        if granule != _NO_POSITION and len(s.packets) > first:
            s.ends[-1] = granule
        s.ended = bool(flags & 4)
        at = end
    for s in streams.values():
        if s._partial is not None or not s.ended:
            raise OggError(f"stream {s.serial} isn't closed")
    return streams


def timestamps(stream: Stream, rate: int = RATE, packet_samples: int = PACKET) -> list[float]:
    """Seconds at the end of each data packet: from granule positions where pages state them, counted back by a
    packet's samples elsewhere."""
    out: list[float] = [0.0] * len(stream.ends)
    nxt: int | None = None
    for i in range(len(stream.ends) - 1, -1, -1):
        g = stream.ends[i] if stream.ends[i] is not None else max(0, (nxt or 0) - packet_samples)
        nxt = g
        out[i] = g / rate
    return out


HEAD = struct.Struct("<8sIIQI")
MAGIC = b"PCM8-MUX"


def encode_payload(payload: bytes, packet: int = PACKET) -> bytes:
    """8-bit samples as two logical streams: even packets in one, odd ones in the other. Serial numbers come from the
    payload, so equal payloads give equal bytes."""
    seed = zlib.crc32(payload) & 0xFFFFFFFE
    streams: dict[int, list[tuple[bytes, int]]] = {}
    chunks = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    for k in (0, 1):
        own = chunks[k::2]
        packets = [(HEAD.pack(MAGIC, k, RATE, len(payload), packet), 0)]
        total = 0
        for c in own:
            total += len(c)
            packets.append((c, total))
        streams[seed + k] = packets
    return mux(streams)


def decode_payload(media: bytes) -> tuple[bytes, dict[int, Stream]]:
    streams = demux(media)
    if not streams:
        raise OggError("no page at byte 0")
    parts: dict[int, list[bytes]] = {}
    total = 0
    for s in streams.values():
        if not s.packets:
            raise OggError("stream without a header")
        magic, k, _, total, _ = HEAD.unpack(s.packets[0])
        if magic != MAGIC:
            raise OggError("unknown stream")
        parts[k] = s.packets[1:]
    a, b = parts.get(0, []), parts.get(1, [])
    woven: list[bytes] = [b""] * (len(a) + len(b))
    woven[::2], woven[1::2] = a, b
    payload = b"".join(woven)
    if len(payload) != total:
        raise OggError(f"{len(payload)} samples, {total} announced")
    return payload, streams


def feature(payload: bytes, streams: dict[int, Stream]) -> str:
    """Counts and sample statistics of the decoded media; integers only, so every platform gives the same string."""
    import numpy as np

    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    last = max(round(1000 * t) for s in streams.values() for t in timestamps(s)[-1:])
    return (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};"
        f"last_ms={last};sum={int(x.sum())};energy={int((x * x).sum())};crossings={int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())};peak={int(abs(x).max())}"
    )


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 192) -> DataFrame:
    """id, n_bytes, media (Ogg bytes): each text (null: empty) as UTF-8, padded with spaces to a positive multiple of
    `unit`, stored as 8-bit samples. Row by row and lossless: repeated rows give repeated results, an empty table an
    empty one; extra columns are ignored, null ids carried."""

    def encode(texts: list[str]) -> dict[str, list]:
        raw = [t.encode() for t in texts]
        return {"n_bytes": [len(r) for r in raw], "media": [encode_payload(r + b" " * (max(unit, -(-len(r) // unit) * unit) - len(r))) for r in raw]}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return map_column(rows, "text", encode, "id long, n_bytes long, media binary", keep=["id"])


def media_features(media: DataFrame) -> DataFrame:
    """id, n_bytes, media of media_column() to digests and features of the decoded payload. A row whose media are missing or damaged
    has null in their place, and in `status` what is wrong; that of other rows is `ok`. Of damaged media only media_bytes and
    media_sha256 are known. Empty tables give empty ones."""
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "status")

    def one(m: bytes | None) -> tuple:
        if m is None:
            return (None,) * 6 + ("no media",)
        stored = (len(m), hashlib.sha256(m).hexdigest())
        try:
            payload, streams = decode_payload(m)
            return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored, feature(payload, streams), "ok")
        except (OggError, struct.error) as wrong:
            return (None, None, None, *stored, None, str(wrong))

    def decode(all_media: list) -> dict[str, list]:
        return dict(zip(names, map(list, zip(*map(one, all_media), strict=True)), strict=True)) if all_media else {n: [] for n in names}

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, status string"
    return map_column(media.select("id", "n_bytes", "media"), "media", decode, schema, keep=["id", "n_bytes"])
