"""H.264 network abstraction layer: units, parameter sets, configuration records
(inventory S21, P4, P12-P15)."""

from __future__ import annotations

import re
import struct

from tideline.functions.bits import Bits, BitsOut

START = re.compile(rb"\x00\x00\x01")
#: Two zero bytes before a byte of 3 or less.
RISKY = re.compile(rb"\x00\x00(?=[\x00-\x03])")
#: Profiles whose sequence parameter sets carry chroma fields.
CHROMA_PROFILES = {44, 83, 86, 100, 110, 118, 122, 128, 134, 135, 138, 139, 244}
#: Sample aspect ratios by their index, from 1.
ASPECTS = ((1, 1), (12, 11), (10, 11), (16, 11), (40, 33), (24, 11), (20, 11), (32, 11), (80, 33), (18, 11), (15, 11), (64, 33), (160, 99), (4, 3), (3, 2), (2, 1))


def without_prevention(data: bytes) -> bytes:
    """Payload bytes of a unit: the 3 in every 00 00 03 goes."""
    return re.sub(rb"\x00\x00\x03", b"\x00\x00", data)


def with_prevention(data: bytes) -> bytes:
    """A 3 goes between two zero bytes and a byte of 3 or less."""
    return RISKY.sub(b"\x00\x00\x03", data)


def from_annexb(stream: bytes) -> list[bytes]:
    """Units between start codes; zero bytes before a start code go."""
    marks = [m.start() for m in START.finditer(stream)]
    out = []
    for a, b in zip(marks, [*marks[1:], len(stream)], strict=True):
        unit = stream[a + 3 : b].rstrip(b"\x00") if b < len(stream) else stream[a + 3 : b]
        if unit:
            out.append(unit)
    return out


def to_annexb(units: list[bytes]) -> bytes:
    return b"".join(b"\x00\x00\x00\x01" + u for u in units)


def from_lengths(data: bytes, size: int = 4) -> list[bytes]:
    """Units with ``size``-byte lengths before them; a cut last unit raises."""
    out, at = [], 0
    while at + size <= len(data):
        n = int.from_bytes(data[at : at + size], "big")
        at += size
        if at + n > len(data):
            raise ValueError("unit exceeds the sample")
        if n:
            out.append(data[at : at + n])
        at += n
    return out


def to_lengths(units: list[bytes], size: int = 4) -> bytes:
    return b"".join(len(u).to_bytes(size, "big") + u for u in units)


def unit_type(unit: bytes) -> int:
    return unit[0] & 31


def has_idr(units: list[bytes]) -> bool:
    return any(unit_type(u) == 5 for u in units)


def _scaling(b: Bits, size: int) -> None:
    last = now = 8
    for _ in range(size):
        if now:
            now = (last + b.se()) % 256
        last = now or last


def sps(unit: bytes) -> dict:
    """Fields of a sequence parameter set (its header byte included)."""
    b = Bits(without_prevention(unit)[1:])
    out = {"profile": b.u(8), "constraints": b.u(8), "level": b.u(8), "id": b.ue(), "chroma_format": 1, "bit_depth": 8}
    if out["profile"] in CHROMA_PROFILES:
        out["chroma_format"] = b.ue()
        if out["chroma_format"] == 3:
            b.u(1)
        out["bit_depth"] = b.ue() + 8
        b.ue()
        b.u(1)
        if b.u(1):
            for i in range(12 if out["chroma_format"] == 3 else 8):
                if b.u(1):
                    _scaling(b, 16 if i < 6 else 64)
    out["frame_num_bits"] = b.ue() + 4
    out["poc_type"] = b.ue()
    if out["poc_type"] == 0:
        out["poc_bits"] = b.ue() + 4
    elif out["poc_type"] == 1:
        b.u(1), b.se(), b.se()
        for _ in range(b.ue()):
            b.se()
    out["ref_frames"] = b.ue()
    b.u(1)
    wide, high = b.ue() + 1, b.ue() + 1
    out["frame_only"] = b.flag()
    if not out["frame_only"]:
        b.u(1)
    b.u(1)
    crop = [0, 0, 0, 0]
    if b.u(1):
        crop = [b.ue() for _ in range(4)]
    unit_x = 2 if out["chroma_format"] in (1, 2) else 1
    unit_y = (2 if out["chroma_format"] == 1 else 1) * (1 if out["frame_only"] else 2)
    out["width"] = 16 * wide - unit_x * (crop[0] + crop[1])
    out["height"] = 16 * high * (1 if out["frame_only"] else 2) - unit_y * (crop[2] + crop[3])
    out |= {"sar": (1, 1), "fps": None, "fixed_rate": False}
    if b.left() and b.u(1):
        if b.u(1):
            k = b.u(8)
            out["sar"] = (b.u(16), b.u(16)) if k == 255 else ASPECTS[k - 1] if 0 < k <= len(ASPECTS) else (1, 1)
        if b.u(1):
            b.u(1)
        if b.u(1):
            b.u(4)
            if b.u(1):
                b.u(24)
        if b.u(1):
            b.ue(), b.ue()
        if b.u(1):
            tick, scale = b.u(32), b.u(32)
            out["fixed_rate"] = b.flag()
            out["fps"] = scale / (2 * tick) if tick else None
    return out


def sps_unit(width: int, height: int, profile: int = 66, level: int = 30, fps: tuple[int, int] | None = None) -> bytes:
    """A sequence parameter set for progressive 4:2:0 frames."""
    b = BitsOut().u(profile, 8).u(0, 8).u(level, 8).ue(0)
    if profile in CHROMA_PROFILES:
        b.ue(1).ue(0).ue(0).u(0, 2)
    wide, high = -(-width // 16), -(-height // 16)
    b.ue(0).ue(2).ue(1).u(0, 1).ue(wide - 1).ue(high - 1).u(1, 1).u(1, 1)
    right, bottom = (16 * wide - width) // 2, (16 * high - height) // 2
    b.u(int(bool(right or bottom)), 1)
    if right or bottom:
        b.ue(0).ue(right).ue(0).ue(bottom)
    b.u(int(fps is not None), 1)
    if fps is not None:
        b.u(0, 4).u(1, 1).u(fps[1], 32).u(2 * fps[0], 32).u(1, 1).u(0, 4)
    return b"\x67" + with_prevention(b.trailing().bytes())


def pps(unit: bytes) -> dict:
    """Leading fields of a picture parameter set."""
    b = Bits(without_prevention(unit)[1:])
    out = {"id": b.ue(), "sps": b.ue(), "cabac": b.flag(), "pic_order": b.flag(), "slice_groups": b.ue() + 1}
    if out["slice_groups"] == 1:
        out |= {"ref_l0": b.ue() + 1, "ref_l1": b.ue() + 1, "weighted": b.flag(), "weighted_b": b.u(2), "qp": b.se() + 26}
    return out


def configuration(record: bytes) -> dict:
    """A decoder configuration record: profile, level, length size, parameter sets."""
    if len(record) < 7 or record[0] != 1:
        raise ValueError("not a configuration record")
    out = {"profile": record[1], "compatibility": record[2], "level": record[3], "length_size": (record[4] & 3) + 1, "sps": [], "pps": []}
    at = 5
    for name, mask in (("sps", 31), ("pps", 255)):
        count = record[at] & mask
        at += 1
        for _ in range(count):
            n = struct.unpack_from(">H", record, at)[0]
            out[name].append(record[at + 2 : at + 2 + n])
            if len(out[name][-1]) < n:
                raise ValueError("configuration record is cut")
            at += 2 + n
    return out


def configuration_record(sps_units: list[bytes], pps_units: list[bytes], length_size: int = 4) -> bytes:
    first = sps_units[0]
    out = bytes([1, first[1], first[2], first[3], 0xFC | (length_size - 1), 0xE0 | len(sps_units)])
    out += b"".join(struct.pack(">H", len(u)) + u for u in sps_units)
    return out + bytes([len(pps_units)]) + b"".join(struct.pack(">H", len(u)) + u for u in pps_units)
