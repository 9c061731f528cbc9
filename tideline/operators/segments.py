"""Greedy segmentation (inventory W10-W13, A6, A7, K6).

Cuts depend on the last cut, so segment numbers come from ordered scans; the
segments themselves are plain aggregates over those numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.scan import ordered_scan


def at_keyframes(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, key: str, target: int) -> DataFrame:
    """A keyframe at least ``target`` after the segment's start opens the
    next segment; the first segment starts at the stream's first row."""

    def make():
        start, n = None, 1

        def step(t, is_key):
            nonlocal start, n
            start = t if start is None else start
            if is_key and t - start >= target:
                start, n = t, n + 1
            return (n,)

        return step

    return ordered_scan(df, by, order, [ts, key], "segment int", make)


def mixed(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, key: str, target: int, most: int) -> DataFrame:
    """Once a segment has reached ``target`` it is ready; it is cut before
    the next keyframe if it is ready or has reached ``most``."""

    def make():
        start, ready, n = None, False, 1

        def step(t, is_key):
            nonlocal start, ready, n
            start = t if start is None else start
            if is_key and (ready or t - start >= most):
                start, ready, n = t, False, n + 1
            if t - start >= target:
                ready = True
            return (n,)

        return step

    return ordered_scan(df, by, order, [ts, key], "segment int", make)


def separate(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, key: str, video: str, target: int, most: int) -> DataFrame:
    """W12, for separate tracks (``by`` holds the track): a row first joins its
    segment; then an audio segment ends at ``target``, a video segment at a
    keyframe once it is ready, or at ``most`` in any case."""

    def make():
        start, ready, n = None, False, 1

        def step(t, is_key, is_video):
            nonlocal start, ready, n
            own = n
            start = t if start is None else start
            long = t - start
            if is_video:
                end = long >= most or (ready and is_key)
                ready = ready or long >= target
            else:
                end = long >= target
            if end:
                start, ready, n = None, False, n + 1
            return (own,)

        return step

    return ordered_scan(df, by, order, [ts, key, video], "segment int", make)


def chunks(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, length: int) -> DataFrame:
    """A chunk ends with the first row ``length`` or more after its start."""

    def make():
        start, n = None, 1

        def step(t):
            nonlocal start, n
            own = n
            start = t if start is None else start
            if t - start >= length:
                start, n = None, n + 1
            return (own,)

        return step

    return ordered_scan(df, by, order, [ts], "chunk int", make)


def segment_table(df: DataFrame, by: Sequence[str], ts: str, size: str, segment: str = "segment") -> DataFrame:
    """Start, end, duration, rows and bytes of each segment."""
    return df.groupBy(*by, segment).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), (F.max(ts) - F.min(ts)).alias("duration"), F.count("*").alias("rows"), F.sum(size).alias("bytes"))


def target_duration(segments: DataFrame, by: Sequence[str], duration: str, unit: int, least: int | None = None) -> DataFrame:
    """Longest segment in whole units, rounded up, ``least`` at least."""
    whole = F.ceil(F.max(duration) / unit).cast("long")
    return segments.groupBy(*by).agg((whole if least is None else F.greatest(whole, F.lit(least))).alias("target"))


def playlist(segments: DataFrame, by: Sequence[str], duration: str, unit: int, uri: Column, version: int = 3, least: int | None = None, segment: str = "segment", init: str | None = None) -> DataFrame:
    """K6: the playlist text of each stream, segments in order."""
    entry = F.concat(F.lit("#EXTINF:"), F.format_string("%d.%03d", F.floor(F.col(duration) / unit).cast("long"), F.floor(F.pmod(F.col(duration), F.lit(unit)) * 1000 / unit).cast("long")), F.lit(",\n"), uri)
    whole = F.ceil(F.max(duration) / unit).cast("long")
    head = F.concat_ws(
        "\n",
        F.lit("#EXTM3U"),
        F.lit(f"#EXT-X-VERSION:{version}"),
        F.concat(F.lit("#EXT-X-TARGETDURATION:"), (whole if least is None else F.greatest(whole, F.lit(least))).cast("string")),
        F.lit("#EXT-X-MEDIA-SEQUENCE:1"),
        F.lit("#EXT-X-PLAYLIST-TYPE:VOD"),
        *([F.lit(f'#EXT-X-MAP:URI="{init}"')] if init else []),
    )
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(segment).alias("n"), entry.alias("e")))), lambda x: x["e"]), "\n")
    return segments.groupBy(*by).agg(F.concat_ws("\n", head, body, F.lit("#EXT-X-ENDLIST")).alias("playlist"))
