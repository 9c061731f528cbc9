"""Tag container files (inventory S1-S6, P1-P8)."""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AUDIO, VIDEO, SCRIPT = 8, 9, 18


def kept(tags: DataFrame, by: Sequence[str], order: Sequence[str], has_audio: bool = True, has_video: bool = True) -> DataFrame:
    """Audio and video tags that the header announces; script tags only
    before anything was kept."""
    media = ((F.col("tag_type") == AUDIO) & F.lit(has_audio)) | ((F.col("tag_type") == VIDEO) & F.lit(has_video))
    before = F.coalesce(F.count(F.when(media, 1)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = tags.withColumn("__before", before)
    return marked.where(media | ((F.col("tag_type") == SCRIPT) & (F.col("__before") == 0))).drop("__before")


HEADER = b"FLV\x01"
#: A tag's type and size, its time with the high byte last, and three zero bytes.
TAG = struct.Struct(">II3x")
#: Bytes after which ``files_of`` ends a part.
PART = 4 << 20
DDL = "stream_id string, seq bigint, tag_type int, ts_ms bigint, data_size int, body binary, byte_offset bigint"


def probe(data: bytes) -> dict | None:
    """Tracks that the header announces; null if it is no tag container."""
    if len(data) < 9 or data[:4] != HEADER or not data[4] & 5:
        return None
    return {"has_audio": bool(data[4] & 4), "has_video": bool(data[4] & 1), "header_size": int.from_bytes(data[5:9], "big")}


def probed(files: DataFrame, content: str = "content") -> DataFrame:
    """S2 as columns over a binary column: has_audio, has_video (null: no container)."""
    from tideline.functions.bits import u_be

    flags = u_be(F.col(content), 4, 1)
    good = (F.substring(content, 1, 4) == F.lit(HEADER)) & (flags.bitwiseAND(F.lit(5)) != 0)
    return files.withColumn("has_audio", F.when(good, flags.bitwiseAND(F.lit(4)) != 0)).withColumn("has_video", F.when(good, flags.bitwiseAND(F.lit(1)) != 0))


def read_tags(stream, payload: bool = True, strict: bool = False):
    """(tag_type, ts_ms, data_size, body, byte_offset) of a binary
    stream, in bounded memory.  Without ``payload`` bodies are skipped (their
    first two bytes stay, enough for frame and codec flags).  A cut tag ends
    the scan, or raises if ``strict``."""
    head = stream.read(9)
    found = probe(head)
    if found is None:
        raise ValueError("not a tag container")
    at = found["header_size"] + 4
    stream.seek(at)
    while True:
        tag = stream.read(11)
        if len(tag) < 11:
            if tag and strict:
                raise ValueError(f"tag header is cut at byte {at}")
            return
        size = int.from_bytes(tag[1:4], "big")
        ts = tag[7] << 24 | int.from_bytes(tag[4:7], "big")
        body = stream.read(size if payload else min(2, size))
        if not payload and size > 2:
            stream.seek(size - 2, 1)
        if payload and len(body) < size:
            if strict:
                raise ValueError(f"tag body is cut at byte {at}")
            return
        yield tag[0] & 31, ts, size, body, at
        stream.seek(4, 1)
        at += 11 + size + 4


def tags_of(data: bytes):
    """(tag_type, ts_ms, body) of a container in memory; a cut tag ends it."""
    found = probe(data)
    if found is None:
        raise ValueError("not a tag container")
    at, end = found["header_size"] + 4, len(data)
    while at + 11 <= end:
        size, time = TAG.unpack_from(data, at)
        stop = at + 11 + (size & 0xFFFFFF)
        if stop > end:
            return
        yield size >> 24 & 31, (time & 255) << 24 | time >> 8, data[at + 11 : stop]
        at = stop + 4


def complete_tags(buffer: bytes, at: int = 0) -> tuple[list[tuple[int, int, bytes]], int]:
    """Complete tags of a live buffer and the offset behind the last one."""
    out = []
    while at + 11 <= len(buffer):
        size = int.from_bytes(buffer[at + 1 : at + 4], "big")
        if at + 11 + size + 4 > len(buffer):
            break
        out.append((buffer[at] & 31, buffer[at + 7] << 24 | int.from_bytes(buffer[at + 4 : at + 7], "big"), buffer[at + 11 : at + 11 + size]))
        at += 11 + size + 4
    return out, at


class StrictScan:
    """Counts the tags of a container that comes in parts; one part and an
    unfinished tag are held.  ``finish(n)`` ends it without its last ``n`` bytes
    (fewer than 15, a tag's least size); a cut last tag is an error."""

    def __init__(self) -> None:
        self.rest, self.started, self.count = b"", False, 0
        self.held = b""

    def push(self, data: bytes) -> None:
        # The last 15 bytes wait, since they may not belong to the file.
        data = self.held + data
        self.held = data[-15:]
        self._take(data[:-15])

    def _take(self, data: bytes) -> None:
        self.rest += data
        if not self.started:
            if len(self.rest) < 9:
                return
            found = probe(self.rest)
            if found is None:
                raise ValueError("not a tag container")
            if len(self.rest) < found["header_size"] + 4:
                return
            self.rest, self.started = self.rest[found["header_size"] + 4 :], True
        at, end = 0, len(self.rest)
        while at + 11 <= end:
            stop = at + 15 + int.from_bytes(self.rest[at + 1 : at + 4], "big")
            if stop > end:
                break
            self.count, at = self.count + 1, stop
        self.rest = self.rest[at:]

    def finish(self, without: int = 0) -> None:
        self._take(self.held[: len(self.held) - without])
        if not self.started and probe(self.rest) is None:
            raise ValueError("not a tag container")
        if not self.started or not self.rest:
            return
        size = int.from_bytes(self.rest[1:4], "big")
        if len(self.rest) < 11 + size:
            raise ValueError("tag is cut")
        self.count += 1  # only its size field is cut


def tag_bytes(tag_type: int, ts_ms: int, body: bytes) -> bytes:
    """K1: a tag and the size field behind it."""
    n = len(body)
    if n >> 24:
        raise OverflowError("body is too long for a tag")
    return b"".join((TAG.pack(tag_type << 24 | n, (ts_ms & 0xFFFFFF) << 8 | ts_ms >> 24 & 255), body, (11 + n).to_bytes(4, "big")))


def file_header(has_audio: bool = True, has_video: bool = True) -> bytes:
    return HEADER + bytes([4 * has_audio + has_video]) + b"\x00\x00\x00\x09" + b"\x00\x00\x00\x00"


def files_of(tags: DataFrame, by: str = "stream_id", order: Sequence[str] = ("ts_ms", "seq")) -> DataFrame:
    """K1: (by, part, content): each stream's container bytes in parts, in order.
    Parts are cut by an ordered scan, so no stream is held in memory whole."""
    import pyarrow as pa

    rows = tags.select(by, *order, "tag_type", "body").repartition(by).sortWithinPartitions(by, *order)

    def run(batches):
        key, part, buffer = None, 0, bytearray()
        for batch in batches:
            out = []
            for own, ts, kind, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(1 + len(order)).to_pylist(), batch.column(2 + len(order)).to_pylist(), strict=True):
                if own != key:
                    if buffer:
                        out.append((key, part, bytes(buffer)))
                    key, part, buffer = own, 0, bytearray(file_header())
                buffer += tag_bytes(kind, ts, body)
                if len(buffer) >= PART:
                    out.append((key, part, bytes(buffer)))
                    part, buffer = part + 1, bytearray()
            if out:
                yield pa.RecordBatch.from_pydict({by: [o[0] for o in out], "part": [o[1] for o in out], "content": [o[2] for o in out]}, schema=schema)
        if buffer:
            yield pa.RecordBatch.from_pydict({by: [key], "part": [part], "content": [bytes(buffer)]}, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = tags.select(by).schema.add("part", "integer").add("content", "binary")
    schema = to_arrow_schema(spark_schema)
    return rows.mapInArrow(run, spark_schema)


def video_packet(body: bytes) -> dict:
    """Frame type, codec, packet type and composition time of a video body."""
    if len(body) < 5:
        raise ValueError("video packet is cut")
    cts = int.from_bytes(body[2:5], "big")
    return {"frame_type": body[0] >> 4, "codec": body[0] & 15, "packet_type": body[1], "cts": cts - 0x1000000 if cts & 0x800000 else cts, "data": body[5:]}


def with_packets(tags: DataFrame, body: str = "body") -> DataFrame:
    """P3-P6 as columns: frame type, codec, packet type, cts, and the keyframe,
    sequence header and media flags of each tag."""
    from tideline.functions.bits import i24, u_be

    first, second = u_be(F.col(body), 0, 1), u_be(F.col(body), 1, 1)
    is_video, is_audio = F.col("tag_type") == VIDEO, F.col("tag_type") == AUDIO
    avc = is_video & (first.bitwiseAND(F.lit(15)) == 7)
    aac = is_audio & (F.shiftright(first, 4) == 10)
    out = tags.withColumn("frame_type", F.when(is_video, F.shiftright(first, 4)).cast("int")).withColumn("codec", F.when(is_video, first.bitwiseAND(F.lit(15))).when(is_audio, F.shiftright(first, 4)).cast("int"))
    out = out.withColumn("packet_type", F.when(avc | aac, second).cast("int")).withColumn("cts", F.when(avc, i24(F.col(body), 2)))
    header = (avc | aac) & (second == 0)
    end = avc & (second == 2)
    return (
        out.withColumn("is_key", F.coalesce(is_video & (F.shiftright(first, 4) == 1) & ~header, F.lit(False)))
        .withColumn("is_sequence_header", F.coalesce(header, F.lit(False)))
        .withColumn("is_media", F.coalesce((is_video | is_audio) & ~header & ~end, F.lit(False)))
    )


def source():
    """The Python data source ``tag_container``: one partition per file.

    Options: path (a file or folder), payload (false: skip bodies), mode
    (FAILFAST: a cut tag is an error).  Executors open the files themselves, in
    bounded memory: the path is a mounted folder or a URI of a store that Arrow
    reads (file, hdfs, s3, gs); ``scanned`` takes any path that Spark can read, a
    whole file at a time.
    """
    import os

    from pyarrow import fs
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class One(InputPartition):
        def __init__(self, path: str):
            self.path = path

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = dict(options)

        def store(self):
            path = self.options["path"]
            return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))

        def partitions(self):
            store, path = self.store()
            if store.get_file_info(path).is_file:
                return [One(path)]
            found = store.get_file_info(fs.FileSelector(path, recursive=True))
            return [One(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.path.endswith(".flv")]

        def read(self, partition):
            with self.store()[0].open_input_file(partition.path) as f:
                payload = self.options.get("payload", "true").lower() != "false"
                strict = self.options.get("mode", "").upper() == "FAILFAST"
                for seq, (kind, ts, size, body, at) in enumerate(read_tags(f, payload, strict)):
                    yield partition.path, seq, kind, ts, size, body if payload else None, at

    class TagContainer(DataSource):
        @classmethod
        def name(cls):
            return "tag_container"

        def schema(self):
            return DDL

        def reader(self, schema):
            return Reader(self.options)

    return TagContainer


def scanned_parts(parts: DataFrame, payload: bool = True, strict: bool = False) -> DataFrame:
    """Tags of the streams of (path, part, content), cut into parts
    anywhere.  Numbers and offsets run on from part to part; one part and an
    unfinished tag are held at a time."""
    import io

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(DDL))
    rows = parts.select("path", "part", "content").repartition("path").sortWithinPartitions("path", "part")

    def run(batches):
        path, rest, seq, base = None, b"", 0, None
        out = []

        def full():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        def take(last):
            # Tags of ``rest``; all but the last part's end is held back until more bytes come.
            nonlocal rest, seq, base
            if base is None:
                found = probe(rest)
                if found is None or len(rest) < found["header_size"] + 4:
                    if last:
                        raise ValueError("not a tag container")
                    return
                base, rest = found["header_size"] + 4, rest[found["header_size"] + 4 :]
            done, at = complete_tags(rest)
            for kind, ts, body in done:
                yield path, seq, kind, ts, len(body), body if payload else None, base
                seq, base = seq + 1, base + 11 + len(body) + 4
            rest = rest[at:]
            if last and rest:
                for kind, ts, size, body, _ in read_tags(io.BytesIO(file_header() + rest), True, strict):  # its size field may be cut
                    yield path, seq, kind, ts, size, body if payload else None, base

        for batch in batches:
            for own, content in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = []
                if own != path:
                    if path is not None:
                        found += take(True)
                    path, rest, seq, base = own, b"", 0, None
                rest += content
                found += take(False)
                for a in range(0, len(found), 4096):
                    out = found[a : a + 4096]
                    yield full()
        if path is not None and (out := list(take(True))):
            yield full()

    return rows.mapInArrow(run, DDL)


def scanned(files: DataFrame, payload: bool = True, strict: bool = False) -> DataFrame:
    """Tags of the files of ``spark.read.format("binaryFile")``."""
    import io

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(DDL))

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(path, seq, kind, ts, size, body if payload else None, at) for seq, (kind, ts, size, body, at) in enumerate(read_tags(io.BytesIO(content), payload, strict))]
                for a in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 4096], strict=True), schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, DDL)
