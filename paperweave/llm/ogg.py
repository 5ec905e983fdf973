"""Media columns: texts as Ogg streams of 8-bit samples, written, read back and described.

A text's UTF-8 bytes, padded with spaces to a multiple of 192, are unsigned 8-bit samples at 8000 Hz. They
are cut into packets, dealt in turn to two logical streams and multiplexed page by page. Reading
verifies every page's checksum, demultiplexes the pages by serial number, reassembles packets from lacing values
across pages, and puts the packets in order by the time that their granule positions give.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from paperweave.llm.arrow import map_rows, texts_of

RATE = 8000
FRAME = 192
PACKET = 24_000  # samples; 95 lacing values, so two packets fill most of a page
STREAMS = 2
_HEAD = struct.Struct("<4sBBqIIIB")
_ID = struct.Struct("<8sBBII")
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(data: bytes) -> int:
    """CRC of polynomial 0x04C11DB7, most significant bit first, from 0 and not inverted. zlib has the same polynomial
    with the bits of each byte mirrored, so mirrored bytes go in and a mirrored sum comes out."""
    mirrored = zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_FLIP), "big")


def _lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + checksum(head + body).to_bytes(4, "little") + head[26:] + body


def _stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream. packets: data and the granule position at its end. The first is
    alone on its page; later ones are laid out in runs of 255 lacing values and may continue on the next page."""
    first, end = packets[0]
    out = [_page(2 | 4 * (len(packets) == 1), end, serial, 0, _lacing(len(first)), first)]
    segments: list[tuple[int, bytes, int]] = []
    for data, granule in packets[1:]:
        lacing = _lacing(len(data))
        for i, v in enumerate(lacing):
            segments.append((v, data[255 * i : 255 * i + v], granule if i == len(lacing) - 1 else -1))
    for at in range(0, len(segments), 255):
        part = segments[at : at + 255]
        ends = [g for _, _, g in part if g >= 0]
        continued = 1 if at and segments[at - 1][0] == 255 else 0
        last = 4 if at + 255 >= len(segments) else 0
        out.append(_page(continued | last, ends[-1] if ends else -1, serial, len(out), bytes(v for v, _, _ in part), b"".join(d for _, d, _ in part)))
    return out


def write(samples: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """samples as one physical stream of STREAMS logical ones. A stream's granule position counts the samples of the
    whole signal up to the end of its packet."""
    parts = [(samples[i : i + packet], min(i + packet, len(samples))) for i in range(0, len(samples), packet)]
    pages = []
    for s in range(STREAMS):
        head = _ID.pack(b"u8sample", 1, STREAMS, rate, packet)
        pages.append(_stream_pages(0x5A00 + s, [(head, 0), *parts[s::STREAMS]]))
    firsts = [p[0] for p in pages]
    rest = [p[i] for i in range(1, max(map(len, pages))) for p in pages if i < len(p)]
    return b"".join(firsts + rest)


def pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, number, lacing, body) of each page; a damaged one is an error."""
    at = 0
    while at < len(media):
        if len(media) - at < _HEAD.size or media[at : at + 4] != b"OggS":
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = media[at:end]
        if version or len(lacing) < n or end > len(media) or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError(f"damaged page at byte {at}")
        yield flags, granule, serial, number, lacing, page[27 + n :]
        at = end


def packets(media: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Each logical stream's packets, with the granule position of the page on which they end (-1 if it has none to say)."""
    out: dict[int, list[tuple[bytes, int]]] = {}
    open_parts: dict[int, list[bytes]] = {}
    numbers: dict[int, int] = {}
    for flags, granule, serial, number, lacing, body in pages(media):
        if (flags & 2) == (serial in out) or number != numbers.get(serial, -1) + 1:
            raise ValueError(f"stream {serial}: page {number} is out of place")
        numbers[serial] = number
        done, part = out.setdefault(serial, []), open_parts.setdefault(serial, [])
        if bool(flags & 1) != bool(part):
            raise ValueError(f"stream {serial}: page {number} breaks a packet")
        at, ended = 0, []
        for v in lacing:
            part.append(body[at : at + v])
            at += v
            if v < 255:
                ended.append(b"".join(part))
                part.clear()
        done += [(p, granule if i == len(ended) - 1 else -1) for i, p in enumerate(ended)]
    if any(open_parts.values()):
        raise ValueError("a packet has no end")
    return out


def read(media: bytes) -> tuple[bytes, int, int, list[int]]:
    """Samples, rate, number of streams, and each packet's end in samples. A packet that ends on a page before others has the time
    that the packet size in its stream's header gives."""
    timed: list[tuple[int, bytes]] = []
    streams = packets(media)
    rate = 0
    for (head, _), *rest in streams.values():
        magic, _, n, rate, size = _ID.unpack(head)
        if magic != b"u8sample":
            raise ValueError("not a stream of samples")
        upto = None
        for data, granule in reversed(rest):  # back from the page's last packet
            upto = granule if granule >= 0 else upto - n * size + (size - last if last < size else 0)
            timed.append((upto, data))
            last = len(data)
    timed.sort(key=lambda x: x[0])
    at = 0
    for upto, data in timed:
        at += len(data)
        if at != upto:
            raise ValueError("samples are missing")
    return b"".join(d for _, d in timed), rate, len(streams), [u for u, _ in timed]


def payload_of(text: bytes, frame: int = FRAME) -> bytes:
    size = max(1, -(-len(text) // frame)) * frame
    return text.ljust(size, b" ")


def features(samples: bytes, rate: int, streams: int, ends: list[int]) -> str:
    """Duration in milliseconds from the granule positions, streams, packets, and mean, energy, peak and crossings of the samples, in whole numbers."""
    x = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    n = len(x)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"ms={ends[-1] * 1000 // rate};streams={streams};packets={len(ends)};mean={int(x.sum()) * 1000 // n};energy={int((x * x).sum(dtype=np.int64)) // n};peak={int(np.abs(x).max())};crossings={crossings}"


def _described(texts: list[bytes], keep_media: bool) -> dict[str, list]:
    out: dict[str, list] = {n: [] for n in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media")}
    for text in texts:
        media = write(payload_of(text))
        back, rate, streams, ends = read(media)
        made = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(back, rate, streams, ends), media if keep_media else b"")
        for name, value in zip(out, made, strict=True):
            out[name].append(value)
    return out


def store_media(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Rows of docs (doc_id, text; other columns are ignored) as doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature and, if asked for, media (binary).

    Rows are independent: no shuffle, and a task holds one batch of at most 64 texts. A null text is an empty one, whose payload is one frame of
    spaces; equal texts, and so repeated rows, give equal values; an empty table gives no rows; null doc_ids stay. A very long text is stored whole: its payload, packets, pages, stream and what is read back are held at once, some six
    times its bytes, before the next text is looked at.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(
        docs.selectExpr("cast(doc_id as long) doc_id", "text"),
        lambda batch: {"doc_id": batch.column("doc_id"), **_described(texts_of(batch), keep_media)},
        schema + ", media binary" * keep_media,
        rows=64,
    )
