"""Ogg pages and Opus packets (inventory S14, K8)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from tideline.functions.audio import opus_head, opus_packet
from tideline.sources.ts import TURNED, turned


def crc(data: bytes) -> int:
    """CRC-32 with the polynomial of transport streams, from 0."""
    return turned(zlib.crc32(data.translate(TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF)


def pages(data: bytes) -> Iterator[dict]:
    """Pages in order; serial and sequence must go on, the checksum must hold."""
    at, serial, number, ended = 0, None, 0, False
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + 27 > len(data):
            raise ValueError(f"no page at byte {at}")
        flags, granule, own, seq, check, count = struct.unpack_from("<BqIIIB", data, at + 5)
        table = data[at + 27 : at + 27 + count]
        size = 27 + count + sum(table)
        page = data[at : at + size]
        if len(page) < size or crc(page[:22] + b"\x00\x00\x00\x00" + page[26:]) != check:
            raise ValueError(f"page at byte {at} is damaged")
        if ended or (serial is not None and (own != serial or seq != number)) or bool(flags & 2) != (serial is None):
            raise ValueError(f"page at byte {at} does not follow")
        serial, number, ended = own, seq + 1, bool(flags & 4)
        yield {"flags": flags, "granule": granule, "table": table, "body": page[27 + count :]}
        at += size


def packets(data: bytes) -> Iterator[tuple[bytes, int, bool, bool]]:
    """(packet, granule of its page, last of its page, last of the stream)."""
    open_packet = b""
    for page in pages(data):
        if bool(page["flags"] & 1) != bool(open_packet):
            raise ValueError("continued packet does not match")
        at, done = 0, []
        for n in page["table"]:
            open_packet += page["body"][at : at + n]
            at += n
            if n < 255:
                done.append(open_packet)
                open_packet = b""
        for i, p in enumerate(done):
            last = i == len(done) - 1
            yield p, page["granule"], last, last and bool(page["flags"] & 4)


def opus_packets(data: bytes) -> list[dict]:
    """Data, granule, duration_samples, trim_start, trim_end of the audio
    packets; the first pre-skip samples and what the last page's granule leaves
    out are trimmed."""
    found = list(packets(data))
    if len(found) < 2:
        raise ValueError("header packets are missing")
    skip = opus_head(found[0][0])["pre_skip"]
    if found[1][0][:8] != b"OpusTags":
        raise ValueError("no OpusTags packet")
    out, total = [], 0
    for packet, granule, last, final in found[2:]:
        n = opus_packet(packet)["samples"]
        start = min(n, max(0, skip - total))
        total += n
        end = max(0, min(n - start, total - granule)) if final and last else 0
        out.append({"data": packet, "granule": granule, "duration_samples": n, "trim_start": start, "trim_end": end})
    return out


def page_bytes(body: list[bytes], granule: int, serial: int, number: int, flags: int = 0) -> bytes:
    """K8: one page of whole packets (255 lacing values at most)."""
    table = b"".join([b"\xff" * (len(p) // 255) + bytes((len(p) % 255,)) for p in body])
    if len(table) > 255:
        raise ValueError("too much for one page")
    head = b"OggS" + struct.pack("<BBqII", 0, flags, granule, serial, number)
    rest = b"".join((bytes((len(table),)), table, *body))
    return b"".join((head, crc(b"".join((head, b"\x00\x00\x00\x00", rest))).to_bytes(4, "little"), rest))


def opus_file(found: list[bytes], channels: int, pre_skip: int, end: int | None = None, serial: int = 1) -> bytes:
    """K8: an Ogg file of Opus packets; ``end`` is the last granule."""
    head = b"OpusHead" + struct.pack("<BBHIhB", 1, channels, pre_skip, 48000, 0, 0)
    tags = b"OpusTags" + struct.pack("<I", 8) + b"tideline" + struct.pack("<I", 0)
    out = page_bytes([head], 0, serial, 0, 2) + page_bytes([tags], 0, serial, 1)
    total = 0
    for i, p in enumerate(found):
        total += opus_packet(p)["samples"]
        last = i == len(found) - 1
        out += page_bytes([p], end if last and end is not None else total, serial, i + 2, 4 if last else 0)
    return out
