"""ISO base media files: boxes, sample tables, fragments (inventory S7-S10, K3, K4)."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

#: Boxes that hold boxes.
HEAD = struct.Struct(">I4s")
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"}


def boxes(data: bytes, start: int = 0, end: int | None = None, path: str = "") -> list[dict]:
    """(path, type, offset, header, size) of all boxes, parents first.  Size
    0 reaches to the end, 1 means a 64-bit size follows; a box that leaves its
    parent raises."""
    out: list[dict] = []
    _boxes(data, start, len(data) if end is None else end, path, out)
    return out


def _one(data: bytes, start: int, end: int) -> tuple[int, bytes, int]:
    """End, type and start of the body of the box at ``start``."""
    (size, kind), head = HEAD.unpack_from(data, start), 8
    if size == 1:
        size, head = int.from_bytes(data[start + 8 : start + 16], "big"), 16
    elif size == 0:
        size = end - start
    if size < head or start + size > end:
        raise ValueError(f"bad box size at byte {start}")
    return start + size, kind, start + head


def _boxes(data: bytes, start: int, end: int, path: str, out: list[dict]) -> None:
    while start + 8 <= end:
        stop, kind, head = _one(data, start, end)
        plain = kind.decode("latin-1")
        name = f"{path}/{plain}"
        out.append({"path": name, "type": plain, "offset": start, "header": head - start, "size": stop - start})
        if kind in CONTAINERS:
            _boxes(data, head, stop, name, out)
        start = stop


def _inside(found: list[dict], i: int) -> list[dict]:
    """The boxes inside the one at ``i``, which follow it."""
    end, j = found[i]["offset"] + found[i]["size"], i + 1
    while j < len(found) and found[j]["offset"] < end:
        j += 1
    return found[i + 1 : j]


def box(kind: str, *parts: bytes) -> bytes:
    return b"".join(((8 + sum(map(len, parts))).to_bytes(4, "big"), kind.encode("latin-1"), *parts))


def full(kind: str, version: int, flags: int, *parts: bytes) -> bytes:
    return b"".join(((12 + sum(map(len, parts))).to_bytes(4, "big"), kind.encode("latin-1"), (version << 24 | flags).to_bytes(4, "big"), *parts))


def _entries(body: bytes, form: str) -> list[tuple]:
    n = int.from_bytes(body[4:8], "big")
    return list(struct.iter_unpack(form, body[8 : 8 + n * struct.calcsize(form)]))


#: Boxes of a track that ``sample_table`` reads.
READ = {k.encode(): k for k in ("tkhd", "mdhd", "hdlr", "stsd", "stsz", "stsc", "stco", "co64", "stts", "ctts", "stss")}


def sample_table(own: dict[str, bytes]) -> dict:
    """The tables of one track by its boxes, as columns of the mp4_stbl schema."""
    tkhd, mdhd, hdlr = own["tkhd"], own["mdhd"], own["hdlr"]
    out = {"track_id": int.from_bytes(tkhd[20:24] if tkhd[0] else tkhd[12:16], "big"), "handler": hdlr[8:12].decode("latin-1"), "timescale": int.from_bytes(mdhd[20:24] if mdhd[0] else mdhd[12:16], "big")}
    fixed, n = struct.unpack_from(">II", own["stsz"], 4)
    out["sample_sizes"] = [fixed] * n if fixed else list(struct.unpack_from(f">{n}I", own["stsz"], 12))
    out["stsc"] = [{"first_chunk": a, "spc": b} for a, b, _ in _entries(own["stsc"], ">III")]
    out["chunk_offsets"] = [x for (x,) in (_entries(own["co64"], ">Q") if "co64" in own else _entries(own["stco"], ">I"))]
    out["stts"] = [{"count": a, "delta": b} for a, b in _entries(own["stts"], ">II")]
    out["ctts"] = [{"count": a, "offset": b} for a, b in _entries(own["ctts"], ">Ii")] if "ctts" in own else []
    out["stss"] = [x for (x,) in _entries(own["stss"], ">I")] if "stss" in own else None
    out["config"] = configuration_of(own.get("stsd", b""))
    return out


def configuration_of(stsd: bytes) -> dict:
    """Codec of the first sample entry and its configuration bytes."""
    if len(stsd) < 16:
        return {"codec": None, "data": None}
    codec = stsd[12:16].decode("latin-1")
    for kind in (b"avcC", b"esds", b"dOps"):
        at = stsd.find(kind)
        if at >= 4:
            return {"codec": codec, "data": stsd[at + 4 : at - 4 + int.from_bytes(stsd[at - 4 : at], "big")]}
    return {"codec": codec, "data": None}


def tracks(data: bytes) -> list[dict]:
    out: list[dict[str, bytes]] = []
    _tracks(data, 0, len(data), {}, out)
    return [sample_table(own) for own in out]


def _tracks(data: bytes, start: int, end: int, own: dict[str, bytes], out: list[dict[str, bytes]]) -> None:
    """The boxes of each track, by one walk that checks all boxes."""
    while start + 8 <= end:
        stop, kind, head = _one(data, start, end)
        if kind == b"trak":
            out.append({})
            _tracks(data, head, stop, out[-1], out)
        elif kind in CONTAINERS:
            _tracks(data, head, stop, own, out)
        elif kind in READ:
            own[READ[kind]] = data[head:stop]
        start = stop


STBL = (
    "file string, track_id int, handler string, timescale int, sample_sizes array<bigint>, stsc array<struct<first_chunk:int,spc:int>>, chunk_offsets array<bigint>, "
    "stts array<struct<count:int,delta:int>>, ctts array<struct<count:int,offset:int>>, stss array<int>"
)


#: Samples that are expanded at a time, about.
EXPANDED = 1 << 16


def _flat(column) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row, number from 1 and value (or fields) of all entries of a list column."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    values = column.flatten()
    fields = values.flatten() if pa.types.is_struct(values.type) else [values]
    return owner, np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner] + 1, [f.to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]


#: Rows and numbers in one sorted key: numbers are below it.
WIDE = np.int64(1 << 32)


def _before(owner: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of ``n`` over the entries before each of its row."""
    total = np.cumsum(n) - n
    return total - total[np.searchsorted(owner, owner)] if len(n) else total


def _at(owner: np.ndarray, number: np.ndarray, of: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last entry of row ``of`` at or before ``wanted``, and whether there is one."""
    i = np.searchsorted(owner * WIDE + np.minimum(number, WIDE - 1), of * WIDE + wanted, "right") - 1
    found = i >= 0
    found[found] = owner[i[found]] == of[found]
    return np.where(found, i, 0), found


def _chosen(values: np.ndarray, i: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.where(found, values[i], 0) if len(values) else np.zeros(len(i), np.int64)


def _samples(batch: pa.RecordBatch, by: list[str], content: str | None) -> list[pa.Array]:
    """Columns of ``samples`` for the rows of the mp4_stbl schema in a batch."""
    row, number, (size,) = _flat(batch.column("sample_sizes"))
    # The last entry at or before a chunk gives its samples, and the sums of those give its first.
    entry, _, (first, each) = _flat(batch.column("stsc"))
    order = np.lexsort((each, first, entry))
    of, chunk, (start,) = _flat(batch.column("chunk_offsets"))
    n = np.maximum(_chosen(each[order], *_at(entry[order], first[order], of, chunk)), 0)
    before = _before(of, n)
    of, chunk, start, n, before = (x[n > 0] for x in (of, chunk, start, n, before))
    i, found = _at(of, before, row, number - 1)
    found &= number - 1 < _chosen(before + n, i, found)
    row, number, size, i = (x[found] for x in (row, number, size, i))
    total = np.cumsum(size) - size
    offset = start[i] + total - total[np.searchsorted(row * WIDE + number, row * WIDE + before[i] + 1)]

    def run(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        of, _, (n, value) = _flat(batch.column(name))
        of, n, value = of[n > 0], n[n > 0], value[n > 0]
        before = _before(of, n)
        i, found = _at(of, before, row, number - 1)
        gone = number - 1 - _chosen(before, i, found)
        return _chosen(_before(of, n * value), i, found), np.minimum(gone, _chosen(n, i, found)), _chosen(value, i, found), gone < _chosen(n, i, found)

    ticks, gone, delta, _ = run("stts")
    _, _, shift, within = run("ctts")
    scale = batch.column("timescale").to_numpy(zero_copy_only=False).astype(np.int64)[row]
    if (scale < 1).any():
        raise ValueError("timescale is not positive")
    ms = lambda x: (2000 * x + scale) // (2 * scale)
    listed, _, (sync,) = _flat(batch.column("stss"))
    key = ~np.isin(row, listed) | np.isin(row * WIDE + number, listed * WIDE + sync)
    out = [batch.column(k).take(pa.array(row)) for k in by]
    out += [pa.array(number, pa.int32()), pa.array(chunk[i], pa.int32()), pa.array(offset), pa.array(size), pa.array(ms(ticks + gone * delta)), pa.array(ms(np.where(within, shift, 0))), pa.array(key)]
    if content is not None:
        data = batch.column(content).to_pylist()
        out.append(pa.array([data[r][a : a + n] for r, a, n in zip(row.tolist(), offset.tolist(), size.tolist(), strict=True)], pa.binary()))
    return out


def samples(tables: DataFrame, by: list[str], content: str | None = None) -> DataFrame:
    """One row per sample (number, chunk, offset, size, dts_ms,
    cts_ms, is_key) from rows of the mp4_stbl schema; with ``content``, a column
    that holds the file, also its bytes (``data``).

    A row has all that its samples need, so nothing is shuffled: runs are sorted
    arrays of the rows of a batch together, in which samples find theirs;
    offsets and times are running sums.
    """
    names = [*by, "timescale", "sample_sizes", "stsc", "chunk_offsets", "stts", "ctts", "stss"] + ([content] if content else [])
    schema = tables.select(*by).schema
    for name, kind in [("sample_no", "integer"), ("chunk", "integer"), ("offset", "long"), ("size", "long"), ("dts_ms", "long"), ("cts_ms", "long"), ("is_key", "boolean")] + ([("data", "binary")] if content else []):
        schema = schema.add(name, kind)
    arrow = to_arrow_schema(schema)

    def run(found):
        for batch in found:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("sample_sizes")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED, "right")))
                made = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(_samples(batch.slice(at, end - at), by, content), arrow, strict=True)], schema=arrow)
                yield from (made.slice(k, EXPANDED) for k in range(0, made.num_rows, EXPANDED))
                at = end

    return tables.select(*names).mapInArrow(run, schema)


def stbl(sizes: list[int], deltas: list[int], ctts: list[int], keys: list[int] | None, chunk_sizes: list[int], chunk_offsets: list[int], entry: bytes) -> bytes:
    """K3: a sample table box; runs are run-length coded, offsets are 64-bit
    only where they must be."""

    def coded(values: list[int]) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for v in values:
            if out and out[-1][1] == v:
                out[-1][0] += 1
            else:
                out.append([1, v])
        return [tuple(x) for x in out]

    def table(kind: str, rows: list[tuple], form: str, version: int = 0) -> bytes:
        return full(kind, version, 0, struct.pack(">I" + form[1:] * len(rows), len(rows), *[x for r in rows for x in r]))

    stsc: list[tuple[int, int, int]] = []
    for i, n in enumerate(chunk_sizes, 1):
        if not stsc or stsc[-1][1] != n:
            stsc.append((i, n, 1))
    wide = any(x >> 32 for x in chunk_offsets)
    return box(
        "stbl",
        full("stsd", 0, 0, struct.pack(">I", 1), entry),
        table("stts", coded(deltas), ">II"),
        table("ctts", coded(ctts), ">Ii", 1) if any(ctts) else b"",
        table("stss", [(k,) for k in keys], ">I") if keys is not None else b"",
        table("stsc", stsc, ">III"),
        full("stsz", 0, 0, struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes)),
        table("co64" if wide else "stco", [(x,) for x in chunk_offsets], ">Q" if wide else ">I"),
    )


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


@lru_cache(maxsize=2)
def _kind(handler: str) -> bytes:
    """Media header and data reference of a track."""
    head = full("smhd", 0, 0, b"\x00" * 4) if handler == "soun" else full("vmhd", 0, 1, b"\x00" * 8)
    return head + box("dinf", full("dref", 0, 0, struct.pack(">I", 1), full("url ", 0, 1)))


def track(track_id: int, handler: str, timescale: int, duration: int, table: bytes, width: int = 0, height: int = 0) -> bytes:
    audio = handler == "soun"
    tkhd = full("tkhd", 0, 3, struct.pack(">IIIII8xHHHH", 0, 0, track_id, 0, duration, 0, 0, 0x100 if audio else 0, 0), MATRIX, struct.pack(">II", width << 16, height << 16))
    mdhd = full("mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, timescale, duration, 0x55C4, 0))
    hdlr = full("hdlr", 0, 0, struct.pack(">I4s12x", 0, handler.encode()), b"track\x00")
    return box("trak", tkhd, box("mdia", mdhd, hdlr, box("minf", _kind(handler), table)))


def file_bytes(found: list[dict], timescale: int = 1000) -> bytes:
    """K3: a file of tracks (track_id, handler, timescale, entry, samples as
    (data, delta, cts, key)), one chunk per track, index before the media."""

    lengths = [sum(len(x[0]) for x in t["samples"]) for t in found]
    durations = [sum(x[1] for x in t["samples"]) for t in found]
    longest = max((d * timescale // t["timescale"] for t, d in zip(found, durations, strict=True)), default=0)
    mvhd = full("mvhd", 0, 0, struct.pack(">IIIIIH10x", 0, 0, timescale, longest, 0x10000, 0x100), MATRIX, b"\x00" * 24, struct.pack(">I", len(found) + 1))
    ftyp = box("ftyp", b"isom\x00\x00\x02\x00isomiso2avc1mp41")

    def tracks_at(base: int) -> list[bytes]:
        parts, at = [], base
        for t, length, duration in zip(found, lengths, durations, strict=True):
            s = t["samples"]
            keys = None if all(x[3] for x in s) else [i for i, x in enumerate(s, 1) if x[3]]
            table = stbl([len(x[0]) for x in s], [x[1] for x in s], [x[2] for x in s], keys, [len(s)], [at], t["entry"])
            parts.append(track(t["track_id"], t["handler"], t["timescale"], duration, table, t.get("width", 0), t.get("height", 0)))
            at += length
        return parts

    parts = tracks_at(0)
    base = at = len(ftyp) + 8 + len(mvhd) + sum(map(len, parts)) + 8
    if base + sum(lengths) >> 32:
        parts = tracks_at(base)
    else:  # a track ends with the offset of its one chunk
        for i, length in enumerate(lengths):
            parts[i] = parts[i][:-4] + at.to_bytes(4, "big")
            at += length
    return b"".join((ftyp, box("moov", mvhd, *parts), box("mdat", *[x[0] for t in found for x in t["samples"]])))


def fragment(sequence: int, track_id: int, decode_time: int, rows: list[tuple[bytes, int, int, bool]]) -> bytes:
    """K4: moof and mdat of one track's samples (data, duration, cts, key)."""

    n = len(rows)
    run = struct.pack(">" + "IIIi" * n, *[v for x, d, cts, key in rows for v in (d, len(x), 0x02000000 if key else 0x01010000, cts)])
    # Headers of 8 bytes, versions and flags of 4: the media starts 8 bytes behind the moof.
    trun = full("trun", 1, 0xF01, struct.pack(">Ii", n, 88 + len(run) + 8), run)
    moof = box("moof", full("mfhd", 0, 0, struct.pack(">I", sequence)), box("traf", full("tfhd", 0, 0x20000, struct.pack(">I", track_id)), full("tfdt", 1, 0, struct.pack(">Q", decode_time)), trun))
    return moof + box("mdat", *[r[0] for r in rows])


def fragment_samples(data: bytes) -> list[dict]:
    """Samples of all fragments: track_id, dts, cts, duration, size, is_key,
    offset.  Every track run of a fragment counts."""
    found, out = boxes(data), []
    for m, moof in enumerate(found):
        inside = _inside(found, m) if moof["type"] == "moof" else []
        for own in (_inside(inside, i) for i, b in enumerate(inside) if b["type"] == "traf"):
            body = lambda b: data[b["offset"] + b["header"] : b["offset"] + b["size"]]
            tfhd = body(next(b for b in own if b["type"] == "tfhd"))
            flags, at = int.from_bytes(tfhd[1:4], "big"), 8
            head = {"track_id": int.from_bytes(tfhd[4:8], "big"), "base": moof["offset"], "duration": 0, "size": 0, "flags": 0}
            for bit, name, n in ((1, "base", 8), (2, None, 4), (8, "duration", 4), (16, "size", 4), (32, "flags", 4)):
                if flags & bit:
                    if name:
                        head[name] = int.from_bytes(tfhd[at : at + n], "big")
                    at += n
            tfdt = next((body(b) for b in own if b["type"] == "tfdt"), None)
            dts = 0 if tfdt is None else int.from_bytes(tfdt[4 : 12 if tfdt[0] else 8], "big")
            offset = head["base"]
            for trun in (body(b) for b in own if b["type"] == "trun"):
                flags, n, at = int.from_bytes(trun[1:4], "big"), int.from_bytes(trun[4:8], "big"), 8
                if flags & 1:
                    offset, at = head["base"] + struct.unpack_from(">i", trun, at)[0], at + 4
                first = head["flags"]
                if flags & 4:
                    first, at = int.from_bytes(trun[at : at + 4], "big"), at + 4
                # What a sample does not carry is the fragment's.
                bits = [bool(flags & bit) for bit in (0x100, 0x200, 0x400, 0x800)]
                width = sum(bits)
                values = struct.unpack_from(f">{n * width}I", trun, at)
                columns = iter([values[k::width] for k in range(width)])
                durations, sizes, marks, shifts = (next(columns) if own else [other] * n for own, other in zip(bits, (head["duration"], head["size"], head["flags"], 0), strict=True))
                for i, duration, size, mark, shift in zip(range(n), durations, sizes, marks, shifts, strict=True):
                    mark = first if i == 0 and not bits[2] else mark
                    cts = shift - (1 << 32) if trun[0] and shift >> 31 else shift
                    out.append({"track_id": head["track_id"], "dts": dts, "cts": cts, "duration": duration, "size": size, "is_key": not mark & 0x10000, "offset": offset})
                    dts, offset = dts + duration, offset + size
    return out


def with_duration(init: bytes, duration: int) -> bytes:
    """An init segment whose movie header has this duration."""
    head = next(b for b in boxes(init) if b["type"] == "mvhd")
    at = head["offset"] + head["header"]
    wide = init[at] == 1
    at += 24 if wide else 16
    return init[:at] + duration.to_bytes(8 if wide else 4, "big") + init[at + (8 if wide else 4) :]
