"""MPEG transport streams (inventory S12, T10, K5)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, SYNC = 188, 0x47
#: Stream kinds of a program map.
KINDS = {0x1B: "h264", 0x0F: "aac", 0x03: "mp3", 0x04: "mp3"}


def packets(data: bytes) -> Iterator[dict]:
    """Packets in order; a wrong sync byte or a partial packet raises."""
    if len(data) % PACKET:
        raise ValueError("partial packet at the end")
    for idx, at in enumerate(range(0, len(data), PACKET)):
        p = data[at : at + PACKET]
        if p[0] != SYNC:
            raise ValueError(f"no sync byte at {at}")
        pid, kind = (p[1] & 31) << 8 | p[2], p[3] >> 4 & 3
        start = 4 + (1 + p[4] if kind & 2 else 0)
        yield {"idx": idx, "pid": pid, "cc": p[3] & 15, "pusi": bool(p[1] & 64), "payload": p[start:] if kind & 1 else b""}


DDL = "file string, idx bigint, pid int, cc int, pusi boolean, payload binary"


def scanned(files: DataFrame) -> DataFrame:
    """Packets of ``binaryFile`` rows, by built-in functions: fixed-length
    records need no parser."""
    n = (F.length("content") / PACKET).cast("long")
    p = F.substring("content", (F.col("idx") * PACKET + 1).cast("int"), F.lit(PACKET))
    byte = lambda at: F.conv(F.hex(F.substring("p", at + 1, 1)), 16, 10).cast("int")
    rows = files.select(F.col("path").alias("file"), "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx")).withColumn("p", p)
    kind = F.shiftright(byte(3), 4).bitwiseAND(F.lit(3))
    start = F.when(kind >= 2, byte(4) + 5).otherwise(F.lit(4))
    payload = F.when(kind.bitwiseAND(F.lit(1)) == 1, F.substring("p", start + 1, F.lit(PACKET))).otherwise(F.lit(b""))
    checked = F.when(byte(0) != SYNC, F.raise_error(F.concat(F.lit("no sync byte in packet "), F.col("idx").cast("string")))).otherwise(byte(1).bitwiseAND(F.lit(31)) * 256 + byte(2))
    return rows.select("file", "idx", checked.cast("int").alias("pid"), byte(3).bitwiseAND(F.lit(15)).alias("cc"), (byte(1).bitwiseAND(F.lit(64)) != 0).alias("pusi"), payload.alias("payload"))


class Assembler:
    """Program tables and elementary packets from packets of one file.  A
    repeated continuity counter is dropped; a skipped one discards what was
    gathered; an elementary packet ends where the next begins."""

    def __init__(self) -> None:
        self.programs: dict[int, None] = {}
        self.streams: dict[int, int] = {}
        self.last: dict[int, int] = {}
        self.open: dict[int, bytearray] = {}

    def push(self, pid: int, cc: int, pusi: bool, payload: bytes) -> list[dict]:
        if not payload:
            return []
        if pid in self.last:
            if cc == self.last[pid]:
                return []
            if cc != (self.last[pid] + 1) & 15:
                self.open.pop(pid, None)
        self.last[pid] = cc
        if pid == 0 and pusi:
            s = payload[1 + payload[0] :]
            end = 3 + ((s[1] & 15) << 8 | s[2]) - 4
            for a in range(8, end, 4):
                number, where = struct.unpack_from(">HH", s, a)
                if number:
                    self.programs[where & 0x1FFF] = None
        elif pid in self.programs and pusi:
            s = payload[1 + payload[0] :]
            end, a = 3 + ((s[1] & 15) << 8 | s[2]) - 4, 12 + ((s[10] & 15) << 8 | s[11])
            while a < end:
                self.streams[(s[a + 1] & 31) << 8 | s[a + 2]] = s[a]
                a += 5 + ((s[a + 3] & 15) << 8 | s[a + 4])
        elif pid in self.streams:
            out = self.done(pid) if pusi else []
            if pusi:
                self.open[pid] = bytearray(payload)
            elif pid in self.open:
                self.open[pid] += payload
            return out
        return []

    def done(self, pid: int) -> list[dict]:
        data = bytes(self.open.pop(pid, b""))
        if len(data) < 9 or data[:3] != b"\x00\x00\x01":
            return []
        flags, at = data[7] >> 6, 9 + data[8]
        size = int.from_bytes(data[4:6], "big")
        pts = stamp(data[9:14]) if flags & 2 else None
        dts = stamp(data[14:19]) if flags == 3 else pts
        return [{"pid": pid, "stream_kind": self.streams[pid], "pts": pts, "dts": dts, "data": data[at : 6 + size] if size else data[at:]}]

    def finish(self) -> list[dict]:
        return [x for pid in list(self.open) for x in self.done(pid)]


def stamp(b: bytes) -> int:
    """A 33-bit time of 90 kHz."""
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def stamp_bytes(t: int, mark: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([mark << 4 | t >> 30 << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def elementary(packets: DataFrame) -> DataFrame:
    """T10 over packets of many files: elementary packets in order."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = "file string, seq bigint, pid int, stream_kind int, pts bigint, dts bigint, data binary"
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    names = schema.names

    def run(batches):
        file, made, n = None, None, 0

        def rows(found):
            nonlocal n
            for x in found:
                yield {"file": file, "seq": n} | x
                n += 1

        for batch in batches:
            out = []
            for own, pid, cc, pusi, payload in zip(*[batch.column(c).to_pylist() for c in ("file", "pid", "cc", "pusi", "payload")], strict=True):
                if own != file:
                    if made is not None:
                        out += rows(made.finish())
                    file, made, n = own, Assembler(), 0
                out += rows(made.push(pid, cc, pusi, payload))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if made is not None and (out := list(rows(made.finish()))):
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    del names
    return packets.repartition("file").sortWithinPartitions("file", "idx").mapInArrow(run, ddl)


#: Each byte with its bits turned round: zlib has the reflected form of this polynomial.
TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def turned(c: int) -> int:
    return int.from_bytes(c.to_bytes(4, "little").translate(TURNED), "big")


def crc(data: bytes) -> int:
    """CRC-32 of MPEG-2: polynomial 0x04C11DB7, no reflection."""
    return turned(zlib.crc32(data.translate(TURNED)) ^ 0xFFFFFFFF)


class Writer:
    """K5: packets of a segment; counters go on from segment to segment."""

    PMT, VIDEO, AUDIO = 0x1000, 0x100, 0x101

    def __init__(self, has_video: bool = True, audio_kind: int | None = 0x0F):
        self.cc: dict[int, int] = {}
        self.streams = ([(0x1B, self.VIDEO)] if has_video else []) + ([(audio_kind, self.AUDIO)] if audio_kind else [])

    def packets(self, pid: int, payload: bytes, pcr: int | None = None) -> bytes:
        out, first, at = bytearray(), True, 0
        while at < len(payload) or first:
            field = b""
            if first and pcr is not None:
                base = pcr & ((1 << 33) - 1)
                field = b"\x10" + (base << 15 | 0x7E00).to_bytes(6, "big")
            room = 184 - (1 + len(field) if field else 0)
            part = payload[at : at + room]
            at += room
            missing = room - len(part)
            if missing or field:
                if not field:
                    size = missing - 1
                    adaptation = bytes([size]) + (b"\x00" + b"\xff" * (size - 1) if size else b"")
                else:
                    adaptation = bytes([len(field) + missing]) + field + b"\xff" * missing
            else:
                adaptation = b""
            cc = self.cc.get(pid, 0)
            self.cc[pid] = (cc + 1) & 15
            out += bytes([SYNC, (0x40 if first else 0) | pid >> 8, pid & 255, (0x30 if adaptation else 0x10) | cc]) + adaptation + part
            first = False
        return bytes(out)

    def section(self, pid: int, body: bytes) -> bytes:
        data = body + crc(body).to_bytes(4, "big")
        return self.packets(pid, b"\x00" + data + b"\xff" * (183 - len(data)))

    def tables(self) -> bytes:
        pat = b"\x00\xb0\x0d\x00\x01\xc1\x00\x00\x00\x01" + (0xE000 | self.PMT).to_bytes(2, "big")
        rows = b"".join(bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\x00" for kind, pid in self.streams)
        pmt = b"\x02" + (0xB000 | (13 + len(rows))).to_bytes(2, "big") + b"\x00\x01\xc1\x00\x00" + (0xE000 | self.streams[0][1]).to_bytes(2, "big") + b"\xf0\x00" + rows
        return self.section(0, pat) + self.section(self.PMT, pmt)

    def media(self, pid: int, data: bytes, pts: int, dts: int | None = None, pcr: int | None = None) -> bytes:
        two = dts is not None and dts != pts
        times = stamp_bytes(pts, 3 if two else 2) + (stamp_bytes(dts, 1) if two else b"")
        video = pid == self.VIDEO
        size = len(data) + 3 + len(times)
        head = b"\x00\x00\x01" + bytes([0xE0 if video else 0xC0]) + (0 if video or size > 65535 else size).to_bytes(2, "big") + bytes([0x80, 0xC0 if two else 0x80, len(times)])
        return self.packets(pid, head + times + data, pcr)
