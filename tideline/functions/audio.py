"""Audio headers and frames: AAC, MP3, Opus, WAV (inventory S13-S18, P13, P16)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from tideline.functions.bits import Bits

#: AAC sampling rates by index.
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
#: MP3 rates and layer III bit rates (kbit/s) of MPEG-1 and MPEG-2.
MP3_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
MP3_BITS = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}


def audio_config(data: bytes) -> dict:
    """An AudioSpecificConfig: object type, rate, channels, and the rate of a
    spectral band replication extension if it says so."""
    b = Bits(data)

    def kind() -> int:
        k = b.u(5)
        return 32 + b.u(6) if k == 31 else k

    def rate() -> int:
        k = b.u(4)
        if k == 15:
            return b.u(24)
        if k >= len(AAC_RATES):
            raise ValueError("reserved sampling rate")
        return AAC_RATES[k]

    out = {"object_type": kind(), "rate": rate(), "channels": b.u(4), "extension_rate": None}
    if out["object_type"] in (5, 29):
        out["extension_rate"] = rate()
        out["object_type"] = kind()
    return out


def audio_config_bytes(object_type: int, rate: int, channels: int) -> bytes:
    return struct.pack(">H", object_type << 11 | AAC_RATES.index(rate) << 7 | channels << 3)


def adts_frames(data: bytes) -> Iterator[dict]:
    """Frames of an ADTS stream: offset, object type, rate, channels, payload."""
    at = 0
    while at < len(data):
        if at + 7 > len(data) or data[at] != 0xFF or data[at + 1] & 0xF6 != 0xF0:
            raise ValueError(f"no ADTS frame at byte {at}")
        word = int.from_bytes(data[at : at + 7], "big")
        bare, object_type, k, channels, size = word >> 40 & 1, (word >> 38 & 3) + 1, word >> 34 & 15, word >> 30 & 7, word >> 13 & 0x1FFF
        head = 7 if bare else 9
        if size < head or at + size > len(data) or k >= len(AAC_RATES):
            raise ValueError(f"bad ADTS frame at byte {at}")
        yield {"offset": at, "object_type": object_type, "rate": AAC_RATES[k], "channels": channels, "payload": data[at + head : at + size]}
        at += size


def adts_frame(payload: bytes, rate: int, channels: int, object_type: int = 2) -> bytes:
    size = len(payload) + 7
    word = 0xFFF << 44 | 1 << 40 | (object_type - 1) << 38 | AAC_RATES.index(rate) << 34 | channels << 30 | size << 13 | 0x7FF << 2
    return word.to_bytes(7, "big") + payload


def mp3_header(head: bytes) -> dict:
    """An MPEG audio layer III frame header: rate, channels, bytes, samples."""
    word = int.from_bytes(head[:4], "big")
    version, layer, bits, rate = word >> 19 & 3, word >> 17 & 3, word >> 12 & 15, word >> 10 & 3
    if len(head) < 4 or word >> 21 != 0x7FF or version == 1 or layer != 1 or bits in (0, 15) or rate == 3:
        raise ValueError("not a layer III header")
    first = version == 3
    kbits, hertz = MP3_BITS[1 if first else 2][bits], MP3_RATES[version][rate]
    samples = 1152 if first else 576
    return {"version": {3: 1.0, 2: 2.0, 0: 2.5}[version], "bitrate": 1000 * kbits, "rate": hertz, "channels": 1 if word >> 6 & 3 == 3 else 2, "samples": samples, "size": samples // 8 * 1000 * kbits // hertz + (word >> 9 & 1)}


def mp3_frames(data: bytes) -> Iterator[dict]:
    """Frames of an MP3 stream, after an ID3v2 tag if there is one; bytes that
    start no frame are skipped, a cut last frame ends the stream."""
    at = 0
    if data[:3] == b"ID3" and len(data) >= 10:
        at = 10 + sum((x & 127) << s for x, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    while at + 4 <= len(data):
        try:
            head = mp3_header(data[at : at + 4])
        except ValueError:
            at += 1
            continue
        if at + head["size"] > len(data):
            return
        yield head | {"offset": at, "payload": data[at : at + head["size"]]}
        at += head["size"]


def opus_packet(packet: bytes) -> dict:
    """Table of contents and frames of an Opus packet."""
    if not packet:
        raise ValueError("empty packet")
    toc = packet[0]
    config, code, at = toc >> 3, toc & 3, 1
    mode = "silk" if config < 12 else "hybrid" if config < 16 else "celt"
    us = (10000, 20000, 40000, 60000)[config & 3] if config < 12 else (10000, 20000)[config & 1] if config < 16 else (2500, 5000, 10000, 20000)[config & 3]

    def length(at: int) -> tuple[int, int]:
        n = packet[at]
        return (n, at + 1) if n < 252 else (n + 4 * packet[at + 1], at + 2)

    try:
        if code == 0:
            sizes = [len(packet) - 1]
        elif code == 1:
            if (len(packet) - 1) % 2:
                raise ValueError("two equal frames need an even length")
            sizes = [(len(packet) - 1) // 2] * 2
        elif code == 2:
            n, at = length(at)
            sizes = [n, len(packet) - at - n]
        else:
            head, at = packet[1], 2
            count, pad = head & 63, 0
            if not count or count * us > 120_000:
                raise ValueError("bad frame count")
            if head & 64:
                while True:
                    x = packet[at]
                    at += 1
                    pad += 254 if x == 255 else x
                    if x < 255:
                        break
            if head & 128:
                sizes = []
                for _ in range(count - 1):
                    n, at = length(at)
                    sizes.append(n)
                sizes.append(len(packet) - pad - at - sum(sizes))
            else:
                rest = len(packet) - pad - at
                if rest % count:
                    raise ValueError("equal frames do not divide the packet")
                sizes = [rest // count] * count
    except IndexError:
        raise ValueError("packet is cut") from None
    if min(sizes) < 0 or max(sizes) > 1275:
        raise ValueError("bad frame size")
    frames = []
    for n in sizes:
        frames.append(packet[at : at + n])
        at += n
    return {"mode": mode, "config": config, "stereo": bool(toc & 4), "frame_us": us, "frames": frames, "samples": len(frames) * us * 48 // 1000}


def opus_head(data: bytes) -> dict:
    """An OpusHead identification header."""
    if data[:8] != b"OpusHead" or len(data) < 19 or data[8] >> 4:
        raise ValueError("not an OpusHead")
    channels, skip, rate, gain = struct.unpack_from("<BHIh", data, 9)
    return {"channels": channels, "pre_skip": skip, "rate": rate, "gain": gain, "mapping": data[18]}


def wav_header(data: bytes) -> dict:
    """Format and data range of a RIFF/WAVE file; chunks are padded to even sizes."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    out, at = {}, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if kind == 0xFFFE and size >= 40:
                kind = struct.unpack_from("<H", data, at + 32)[0]
            out |= {"format": kind, "channels": channels, "rate": rate, "align": align, "bits": bits}
        elif name == b"data":
            out |= {"data_offset": at + 8, "data_size": min(size, len(data) - at - 8)}
            break
        at += 8 + size + size % 2
    if "rate" not in out or "data_offset" not in out:
        raise ValueError("format or data chunk is missing")
    return out


def wav_bytes(pcm: bytes, rate: int, channels: int, bits: int = 16) -> bytes:
    align = channels * bits // 8
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * align, align, bits) + b"data" + struct.pack("<I", len(pcm))
    return b"RIFF" + struct.pack("<I", len(head) + len(pcm)) + head + pcm


def sniffed(data: bytes) -> str:
    """Container of an audio file by its first bytes."""
    if data[:3] == b"FLV":
        return "flv"
    if data[4:8] == b"ftyp":
        return "mp4"
    if data[:4] == b"OggS":
        return "ogg"
    if data[:4] == b"RIFF":
        return "wav"
    if len(data) > 1 and data[0] == 0xFF and data[1] & 0xF6 == 0xF0:
        return "adts"
    if data[:3] == b"ID3" or (len(data) > 1 and data[0] == 0xFF and data[1] & 0xE6 == 0xE2):
        return "mp3"
    return "unknown"
