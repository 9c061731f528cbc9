"""Work that grew faster than its input, or byte by byte, and no longer does.  Bounds are ten times what it takes."""

import random
import time

import pytest

from tideline.functions import nal
from tideline.plans import conversions as C
from tideline.plans import format_queries, registry
from tideline.sources import mp4, ogg, ts


def seconds(f, *args):
    began = time.process_time()
    f(*args)
    return time.process_time() - began


def by_bits(data, c):
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
    return c


def test_checksums_and_emulation_bytes():
    rng = random.Random(5)
    for n in (0, 1, 7, 300):
        data = rng.randbytes(n)
        assert ogg.crc(data) == by_bits(data, 0) and ts.crc(data) == by_bits(data, 0xFFFFFFFF)
    for f in (ogg.crc, ts.crc, nal.with_prevention):
        assert seconds(f, bytes(range(1, 255)) * 64000) < 0.5
    assert nal.with_prevention(b"\0\0\0\0\0\1\0\0\3\4\0\0\4") == b"\0\0\3\0\0\3\0\1\0\0\3\3\4\0\0\4"


def test_fragments_packets_and_tags_are_linear():
    sample = (b"abcd", 40, 0, True)
    data = b"".join(mp4.fragment(i, 1, 40 * i, [sample]) for i in range(4000))
    assert seconds(mp4.fragment_samples, data) < 1.5 and [data[s["offset"]] for s in mp4.fragment_samples(data)] == [97] * 4000
    assert seconds(ts.Writer().media, ts.Writer.VIDEO, bytes(12 << 20), 0) < 2
    tracks = {"avc": b"\1" * 7, "aac": None, "video": [(bytes(3000), 40 * i, 0, True) for i in range(8000)], "audio": []}
    assert seconds(C.muxed_flv, tracks) < 1.5


@pytest.mark.parametrize("name", ["display_order", "rtmp_messages", "rtp_access_units", "socket_messages", "wav_round_trip", "conversion_wav", "strict_scan"])
def test_rows_of_a_key_are_not_collected(spark, sf, name):
    assert "collect_list" not in registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert format_queries.tasks(spark) == 4 * spark.sparkContext.defaultParallelism
