"""Work by group of pictures (inventory D1, E1, R7, R8, R24): a group decodes on
its own, so groups are the unit of parallel codec work.

Decoding, scaling, marking and encoding run in one function per group, frame by
frame: pictures never cross a shuffle, and memory holds one frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.functions import h264, nal, pcm
from tideline.operators.scan import batches, taken, tasks
from tideline.operators.timeline import decimate, groups_of_pictures

OUT = "stream_id string, gop bigint, seq bigint, ts_ms bigint, is_key boolean, data binary"


def recoded(frames: DataFrame, width: int, height: int, to_width: int, to_height: int, fps: int | None = None, mark: tuple[bytes, int, int] | None = None, decode: Callable | None = None, encode: Callable | None = None) -> DataFrame:
    """Re-encode (stream_id, seq, ts_ms, is_key, data): decimated to ``fps``,
    scaled and marked.  ``decode(data, state)`` and ``encode(frame, state)`` are
    the codec, with a fresh ``state`` dict for each group; the default is the
    PCM corner of H.264, with its own parameter sets."""
    if to_width > width or to_height > height:
        raise ValueError("output exceeds the source")
    rows = groups_of_pictures(frames, ["stream_id"], ["ts_ms", "seq"], F.col("is_key")).where("gop > 0")
    rows = decimate(rows, ["stream_id"], ["ts_ms", "seq"], "ts_ms", "is_key", fps).where("kept").drop("kept") if fps else rows
    sps = nal.sps(h264.parameter_sets(width, height)[0])

    def default_decode(data: bytes, state: dict) -> bytes:
        return h264.decode(data, sps)

    def default_encode(frame: bytes, state: dict) -> bytes:
        state["n"] = state.get("n", -1) + 1
        return h264.encode(frame, to_width, to_height, state["n"])

    decoded, encoded = decode or default_decode, encode or default_encode

    def made(found):
        key, back, forth = None, {}, {}
        for stream, gop, seq, ts, is_key, data in taken(found):
            if key != (stream, gop):
                key, back, forth = (stream, gop), {}, {}
            picture = pcm.scaled(decoded(data, back), width, height, to_width, to_height)
            yield stream, gop, seq, ts, is_key, encoded(pcm.watermarked(picture, to_width, to_height, *mark) if mark else picture, forth)

    # Groups are dealt and follow one another; a call for each would cost more than its pictures.
    names = ["stream_id", "gop", "ts_ms", "seq"]
    dealt = rows.repartition(tasks(rows.sparkSession), "stream_id", "gop").sortWithinPartitions(*names).select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(OUT)])
    schema = to_arrow_schema(T._parse_datatype_string(OUT))
    return dealt.mapInArrow(lambda found: batches(made(found), schema), OUT)
