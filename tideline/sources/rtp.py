"""RTP packets and H.264 depacketising (inventory S19, T11)."""

from __future__ import annotations

import struct

DDL = "marker boolean, pt int, seq int, ts bigint, ssrc bigint, payload binary"


def packet(data: bytes) -> dict:
    """Header fields and payload; contributing sources, an extension and
    padding are left out."""
    if len(data) < 12 or data[0] >> 6 != 2:
        raise ValueError("not an RTP packet")
    seq, ts, ssrc = struct.unpack_from(">HII", data, 2)
    at, end = 12 + 4 * (data[0] & 15), len(data)
    if data[0] & 16:
        if at + 4 > end:
            raise ValueError("extension is cut")
        at += 4 + 4 * struct.unpack_from(">H", data, at + 2)[0]
    if data[0] & 32:
        end -= data[-1]
    if at > end:
        raise ValueError("packet is cut")
    return {"marker": bool(data[1] & 128), "pt": data[1] & 127, "seq": seq, "ts": ts, "ssrc": ssrc, "payload": data[at:end]}


def packet_bytes(pt: int, seq: int, ts: int, ssrc: int, payload: bytes, marker: bool = False) -> bytes:
    return struct.pack(">BBHII", 0x80, 128 * marker | pt, seq & 0xFFFF, ts & 0xFFFFFFFF, ssrc) + payload


class Depacketizer:
    """Access units from H.264 payloads: single units, aggregates (24) and
    fragments (28).  A gap in the sequence, or a fragment without its start,
    spoils the access unit; spoiled units are not given out."""

    def __init__(self) -> None:
        self.seq: int | None = None
        self.ts: int | None = None
        self.units: list[bytes] = []
        self.part: bytearray | None = None
        self.spoiled = False

    def push(self, p: dict) -> list[dict]:
        out = []
        if self.ts is not None and p["ts"] != self.ts:
            out += self.flush()
        if self.seq is not None and p["seq"] != (self.seq + 1) & 0xFFFF:
            self.spoiled, self.part = True, None
        self.seq, self.ts = p["seq"], p["ts"]
        data = p["payload"]
        kind = data[0] & 31 if data else 0
        if 1 <= kind <= 23:
            self.units.append(data)
        elif kind == 24:
            at = 1
            while at + 2 <= len(data):
                n = int.from_bytes(data[at : at + 2], "big")
                if not n or at + 2 + n > len(data):
                    self.spoiled = True
                    break
                self.units.append(data[at + 2 : at + 2 + n])
                at += 2 + n
        elif kind == 28 and len(data) > 2:
            first, last = bool(data[1] & 128), bool(data[1] & 64)
            if first:
                self.part = bytearray([data[0] & 0xE0 | data[1] & 31])
            if self.part is None:
                self.spoiled = True
            else:
                self.part += data[2:]
                if last:
                    self.units.append(bytes(self.part))
                    self.part = None
        else:
            self.spoiled = True
        if p["marker"]:
            out += self.flush()
        return out

    def flush(self) -> list[dict]:
        good = self.units and not self.spoiled and self.part is None
        out = [{"ts": self.ts, "units": self.units, "is_key": any(u[0] & 31 == 5 for u in self.units)}] if good else []
        self.units, self.part, self.spoiled, self.ts = [], None, False, None
        return out
