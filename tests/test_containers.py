"""Writers and readers are inverse; damage is seen."""

import io
import random

import pytest

from tideline.functions import amf, audio, bits, nal, pcm
from tideline.sources import flv, hls, mp4, ogg, rtp, ts


def test_exp_golomb():
    for x in [0, 1, 2, 7, 8, 255, 70000]:
        assert bits.Bits(bits.BitsOut().ue(x).bytes()).ue() == x
    for x in [0, 1, -1, 5, -300]:
        assert bits.Bits(bits.BitsOut().se(x).trailing().bytes()).se() == x
    with pytest.raises(EOFError):
        bits.Bits(b"\x00").ue()


def test_nal_units():
    rng = random.Random(1)
    for _ in range(200):
        raw = bytes(rng.choice([0, 0, 1, 2, 3, 9]) for _ in range(rng.randint(0, 40)))
        assert nal.without_prevention(nal.with_prevention(raw)) == raw
    units = [b"\x67abc", b"\x68d", b"\x65" + b"x" * 300]
    assert nal.from_annexb(nal.to_annexb(units)) == units
    assert nal.from_lengths(nal.to_lengths(units)) == units and nal.has_idr(units)
    with pytest.raises(ValueError):
        nal.from_lengths(nal.to_lengths(units)[:-1])
    found = nal.sps(nal.sps_unit(960, 540, 100, 31, (30000, 1001)))
    assert (found["width"], found["height"], found["profile"]) == (960, 540, 100) and abs(found["fps"] - 29.97) < 0.001
    record = nal.configuration_record([nal.sps_unit(320, 240)], [b"\x68\xce\x38\x80"])
    assert nal.configuration(record)["pps"] == [b"\x68\xce\x38\x80"]


def test_tags(spark, tmp_path):
    rows = [(18, 0, amf.metadata({"duration": 1.0})), (9, 0, b"\x17\x00\x00\x00\x00cfg"), (9, 40, b"\x27\x01\xff\xff\xfedata"), (8, 1 << 31, b"\xaf\x01aac")]
    data = flv.file_header() + b"".join(flv.tag_bytes(*r) for r in rows)
    read = list(flv.read_tags(io.BytesIO(data)))
    assert [(k, t, b) for k, t, _, b, _ in read] == rows
    assert [len(b) for *_, b, _ in flv.read_tags(io.BytesIO(data), payload=False)] == [2] * 4
    assert len(list(flv.read_tags(io.BytesIO(data[:-6])))) == 3
    with pytest.raises(ValueError):
        list(flv.read_tags(io.BytesIO(data[:-6]), strict=True))
    done, at = flv.complete_tags(data[13:-1])
    assert len(done) == 3 and flv.probe(b"FLV\x01\x00") is None
    assert flv.video_packet(rows[2][2])["cts"] == -2
    (tmp_path / "a.flv").write_bytes(data)
    (tmp_path / "b.flv").write_bytes(flv.file_header() + flv.tag_bytes(9, 5, b"\x17\x02\x00\x00\x00"))
    spark.dataSource.register(flv.source())
    mine = spark.read.format("tag_container").load(str(tmp_path))
    assert mine.count() == 5 and spark.read.format("tag_container").load(f"file://{tmp_path}").count() == 5
    scanned = flv.scanned(spark.read.format("binaryFile").load(str(tmp_path)))
    flags = {(r.tag_type, r.ts_ms): (r.is_key, r.is_sequence_header, r.is_media, r.cts) for r in flv.with_packets(scanned).collect()}
    assert flags[9, 0] == (False, True, False, 0) and flags[9, 40] == (False, False, True, -2) and flags[8, 1 << 31][2] and not flags[9, 5][2]
    back = b"".join(r.content for r in flv.files_of(scanned.where("stream_id like '%a.flv'")).orderBy("part").collect())
    assert sorted(b for *_, b, _ in flv.read_tags(io.BytesIO(back))) == sorted(r[2] for r in rows)


def test_tags_of_a_long_stream(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from tideline.plans import registry

    n = 230_000  # of one user: more than one part
    e = spark.read.parquet(f"{sf}/events.parquet").limit(1)
    kinds = F.array(*[F.lit(k) for k in ("purchase", "view", "error")])
    long = e.crossJoin(spark.range(n)).withColumn("event_id", F.col("id")).withColumn("user_id", F.lit(7).cast(e.schema["user_id"].dataType)).withColumn("ts", F.col("ts") + F.make_interval(secs=F.col("id"))).withColumn("event_type", F.get(kinds, (F.col("id") % 3).cast("int"))).select(e.columns)
    long.write.parquet(f"{tmp_path}/events.parquet")
    out = registry.QUERIES["tag_round_trip"](spark, str(tmp_path))
    assert out.agg(F.count("*"), F.count_distinct("number"), F.max("number")).first()[:] == (n, n, n - 1)
    r = registry.QUERIES["tag_probe"](spark, str(tmp_path)).collect()
    audio = n // 3
    assert [(x.stream_id, x.tags, x.bytes) for x in r] == [(7, n, 9 * (n - audio) + 6 * audio)]
    # Parts cut inside a header and a body; offsets and numbers are the whole file's.
    data = flv.file_header() + b"".join(flv.tag_bytes(9, i, b"x" * i) for i in range(9))
    cut = spark.createDataFrame([("a", 0, data[:5]), ("a", 1, data[5:60]), ("a", 2, data[60:61]), ("a", 3, data[61:-4]), ("b", 0, data)], "path string, part int, content binary")
    for payload in (True, False):
        got = flv.scanned_parts(cut, payload).orderBy("stream_id", "seq").collect()
        assert [(g.seq, g.ts_ms, g.data_size, g.byte_offset) for g in got] == 2 * [(i, t, s, at) for i, (_, t, s, _, at) in enumerate(flv.read_tags(io.BytesIO(data)))]


def test_sample_tables(spark):
    video = [(b"v" * (i + 1), 3000, 100 * (i % 2), i % 3 == 0) for i in range(9)]
    sound = [(b"a" * 4, 1024, 0, True) for _ in range(5)]
    data = mp4.file_bytes([{"track_id": 1, "handler": "vide", "timescale": 90000, "entry": mp4.box("avc1", b"\0" * 78), "samples": video}, {"track_id": 2, "handler": "soun", "timescale": 44100, "entry": mp4.box("mp4a", b"\0" * 28), "samples": sound}])
    rows = [("f", *[t[c] for c in ("track_id", "handler", "timescale", "sample_sizes", "stsc", "chunk_offsets", "stts", "ctts", "stss")]) for t in mp4.tracks(data)]
    found = mp4.samples(spark.createDataFrame(rows, mp4.STBL), ["file", "track_id"]).orderBy("track_id", "sample_no").collect()
    assert [data[r.offset : r.offset + r["size"]] for r in found] == [x[0] for x in video + sound]
    assert [r.is_key for r in found] == [x[3] for x in video + sound]
    assert [r.dts_ms for r in found if r.track_id == 2] == [int(i * 1024 * 1000 / 44100 + 0.5) for i in range(5)]
    # Several chunks, with the last run of samples per chunk going on.
    table = [("g", 1, "vide", 1000, [1, 2, 3, 4, 5], [(1, 2), (3, 1)], [100, 200, 300], [(5, 10)], [], None)]
    found = mp4.samples(spark.createDataFrame(table, mp4.STBL), ["file", "track_id"]).orderBy("sample_no").collect()
    assert [(r.chunk, r.offset) for r in found] == [(1, 100), (1, 101), (2, 200), (2, 203), (3, 300)] and all(r.is_key for r in found)
    with pytest.raises(ValueError):
        mp4.boxes(data[:-1])
    assert mp4.with_duration(data, 77) != data


def test_samples_of_all_orders(spark, sf):
    import duckdb

    from tideline.plans import registry
    from tideline.plans.container_queries import samples_of

    path = f"{sf}/lineitem.parquet"
    sql = registry.SQL["sample_table"].replace(" WHERE l_orderkey % 4 = 0", "").replace("FROM lineitem", f"FROM '{path}'")
    found = duckdb.sql(sql)
    want = found.fetchall()
    mine = samples_of(spark.read.parquet(path)).select(*[f"`{c}`" for c in found.columns])
    assert len(want) > 4000 and sorted(map(tuple, mine.collect())) == sorted(want)


def test_first_of_equal_numbers_is_the_tables(spark, tmp_path):
    from tideline.plans.container_queries import samples_of

    # Spark reads the larger file first.
    row = "l_orderkey long, l_linenumber int, l_quantity double, l_suppkey long"
    for name, rows in (("a", [(1, 1, 5.0, 3), (1, 2, None, 4), (1, 2, 8.0, 5)]), ("b", [(1, 1, 9.0, 1), (1, 2, 7.0, 1)] + [(k, 1, 1.0, k) for k in range(2, 3000)])):
        spark.createDataFrame(rows, row).coalesce(1).toPandas().astype({"l_linenumber": "int32"}).to_parquet(tmp_path / f"{name}.parquet")
    found = samples_of(spark.read.parquet(str(tmp_path))).where("l_orderkey = 1").orderBy("sample_no").collect()
    assert [(r.sample_no, r.size, r.dts_ms) for r in found] == [(1, 5, 0), (2, 8, 44)]


def test_samples_need_no_shuffle_and_take_their_bytes(spark):
    one = {"file": "a", "track_id": 1, "handler": "vide", "timescale": 90, "sample_sizes": [3, 2, 4, 1, 9], "stsc": [{"first_chunk": 1, "spc": 1}, {"first_chunk": 2, "spc": 2}, {"first_chunk": 4, "spc": 0}], "chunk_offsets": [10, 20, 2, 50], "stts": [{"count": 1, "delta": 90}, {"count": 2, "delta": 45}], "ctts": [{"count": 2, "offset": -1}], "stss": [2], "content": bytes(range(60))}
    two = one | {"file": "b", "sample_sizes": [1], "chunk_offsets": [7], "stts": [], "ctts": [], "stss": None}
    df = mp4.samples(spark.createDataFrame([one, two], mp4.STBL + ", content binary"), ["file"], "content")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in df.orderBy("file", "sample_no").collect()] == [
        ("a", 1, 1, 10, 3, 0, -11, False, bytes([10, 11, 12])),
        ("a", 2, 2, 20, 2, 1000, -11, True, bytes([20, 21])),
        ("a", 3, 2, 22, 4, 1500, 0, False, bytes([22, 23, 24, 25])),
        ("a", 4, 3, 2, 1, 2000, 0, False, bytes([2])),
        ("a", 5, 3, 3, 9, 2000, 0, False, bytes(range(3, 12))),
        ("b", 1, 1, 7, 1, 0, 0, True, bytes([7])),
    ]


def test_fragments():
    one = mp4.fragment(1, 1, 9000, [(b"ab", 10, 0, True), (b"c", 11, -2, False)])
    data = one + mp4.fragment(2, 2, 5, [(b"xyz", 3, 0, True)])
    found = mp4.fragment_samples(data)
    assert [data[r["offset"] : r["offset"] + r["size"]] for r in found] == [b"ab", b"c", b"xyz"]
    assert [(r["dts"], r["cts"], r["is_key"]) for r in found] == [(9000, 0, True), (9010, -2, False), (5, 0, True)]


def test_transport_stream(spark, tmp_path):
    w = ts.Writer()
    data = w.tables()
    for i in range(4):
        data += w.media(w.VIDEO, bytes([i]) * (500 * i + 1), (1 << 33) - 2 + i, (1 << 33) - 3 + i, pcr=i)
        data += w.media(w.AUDIO, b"s" * 300, 100 + i)
    found = []
    a = ts.Assembler()
    for p in ts.packets(data):
        found += a.push(p["pid"], p["cc"], p["pusi"], p["payload"])
    found += a.finish()
    video = [x for x in found if x["pid"] == w.VIDEO]
    assert [x["data"] for x in video] == [bytes([i]) * (500 * i + 1) for i in range(4)]
    assert video[3]["pts"] == 1 and video[0]["dts"] == (1 << 33) - 3 and ts.crc(b"123456789") == 0x0376E6E7
    with pytest.raises(ValueError):
        list(ts.packets(data[:-1]))
    (tmp_path / "x.ts").write_bytes(data)
    scanned = ts.scanned(spark.read.format("binaryFile").load(str(tmp_path)))
    assert [tuple(r)[1:] for r in scanned.orderBy("idx").collect()] == [(p["idx"], p["pid"], p["cc"], p["pusi"], p["payload"]) for p in ts.packets(data)]
    rows = ts.elementary(scanned).orderBy("seq").collect()
    assert sorted(bytes(r.data) for r in rows) == sorted(x["data"] for x in found)
    # A repeated packet is dropped; a lost one discards its elementary packet.
    lost = [p for p in ts.packets(data) if not (p["pid"] == w.VIDEO and p["idx"] == max(q["idx"] for q in ts.packets(data) if q["pid"] == w.VIDEO))]
    a = ts.Assembler()
    out = [x for p in [q for p in lost for q in (p, p)] for x in a.push(p["pid"], p["cc"], p["pusi"], p["payload"])] + a.finish()
    assert len([x for x in out if x["pid"] == w.AUDIO]) == 4


def test_ogg_and_opus():
    found = [bytes([0xFC]) + bytes([i]) * 20 for i in range(5)]
    data = ogg.opus_file(found, 2, 312, end=4000)
    rows = ogg.opus_packets(data)
    assert [r["data"] for r in rows] == found and rows[0]["trim_start"] == 312 and rows[-1]["trim_end"] == 800
    with pytest.raises(ValueError):
        ogg.opus_packets(data[:100] + b"\x00" + data[101:])
    assert audio.opus_packet(bytes([0x03, 0x82, 3]) + b"abcdefg")["frames"] == [b"abc", b"defg"]
    for bad in (b"", bytes([1, 2, 3, 4, 5, 6])[:2] + b"xx", bytes([3, 0])):
        with pytest.raises(ValueError):
            audio.opus_packet(bad if bad != b"\x01\x02xx" else b"\x01ab" + b"c")


def test_audio_headers():
    frames = list(audio.adts_frames(b"".join(audio.adts_frame(b"x" * n, 48000, 2) for n in (1, 50))))
    assert [len(f["payload"]) for f in frames] == [1, 50] and frames[0]["rate"] == 48000
    with pytest.raises(ValueError):
        list(audio.adts_frames(audio.adts_frame(b"abc", 48000, 2)[:-1]))
    assert audio.audio_config(audio.audio_config_bytes(2, 44100, 2)) == {"object_type": 2, "rate": 44100, "channels": 2, "extension_rate": None}
    head = audio.mp3_header(bytes([0xFF, 0xFB, 0x90, 0x00]))
    assert (head["bitrate"], head["rate"], head["size"], head["channels"]) == (128000, 44100, 417, 2)
    frame = bytes([0xFF, 0xFB, 0x90, 0x00]) + b"\x00" * 413
    assert [f["offset"] for f in audio.mp3_frames(b"ID3\x04\x00\x00\x00\x00\x00\x02zz" + frame * 2 + frame[:50])] == [12, 429]
    wav = audio.wav_bytes(b"\x01\x00\x02\x00", 8000, 1)
    assert audio.wav_header(wav)["data_size"] == 4 and audio.sniffed(wav) == "wav"


def test_playlists(spark):
    master = "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1\na%20b.m3u8\n"
    child = '#EXTM3U\n#EXT-X-MAP:URI="i.mp4"\n#EXTINF:4.0,\ns1.m4s\n#EXTINF:3.5,\ns2.m4s\n#EXTINF:1,\ns1.m4s\n#EXT-X-ENDLIST\n'
    found = hls.collected("d/m.m3u8", {"d/m.m3u8": master, "d/a b.m3u8": child}.__getitem__)
    assert [(s["uri"], s["duration"], s["init"]) for s in found] == [("d/s1.m4s", 4.0, "d/i.mp4"), ("d/s2.m4s", 3.5, "d/i.mp4")]
    rows = hls.scanned(spark.createDataFrame([("p", child)], "path string, value string")).orderBy("seq").collect()
    assert [(r.uri, r.duration) for r in rows] == [("s1.m4s", 4.0), ("s2.m4s", 3.5), ("s1.m4s", 1.0)]


def test_rtp():
    d = rtp.Depacketizer()
    agg = b"\x18" + b"".join(len(u).to_bytes(2, "big") + u for u in (b"\x67aa", b"\x68b"))
    idr = b"\x65" + bytes(range(100))
    sent = [(1, agg, False), (2, bytes([0x7C, 0x85]) + idr[1:50], False), (3, bytes([0x7C, 0x45]) + idr[50:], True)]
    out = [x for s, p, m in sent for x in d.push(rtp.packet(rtp.packet_bytes(96, s, 900, 7, p, m)))]
    assert out == [{"ts": 900, "units": [b"\x67aa", b"\x68b", idr], "is_key": True}]
    # A lost fragment spoils its access unit, the next one is whole again.
    sent = [(5, b"\x41x", True), (65535, b"\x41y", True), (0, b"\x41z", True)]
    assert [x["units"] for s, p, m in sent for x in d.push(rtp.packet(rtp.packet_bytes(96, s, s, 7, p, m)))] == [[b"\x41z"]]


def test_values():
    v = {"a": 1.5, "n": None, "l": [True, "é"], "o": {"d": ("date", 3.0)}, "big": "x" * 70000}
    assert amf.Reader0(amf.write0(v)).value() == v
    assert amf.script(amf.metadata({"width": 320.0}))["value"] == {"width": 320.0}
    v = {"i": -7, "f": 0.5, "b": b"\x00\x01", "l": [1, {"x": "y"}], "t": ("date", 1.0)}
    assert amf.Reader3(amf.write3(v)).value() == v
    with pytest.raises(EOFError):
        amf.Reader0(amf.write0("abc")[:-1]).value()


def test_pixels_and_samples():
    frame = bytes(range(16)) * 16 + bytes([128]) * 128
    assert pcm.scaled(frame, 16, 16, 16, 16) == frame
    half = pcm.scaled(frame, 16, 16, 8, 8)
    assert len(half) == 96 and half[0] == (0 + 1 + 0 + 1 + 2) >> 2
    marked = pcm.watermarked(frame, 16, 16, bytes([9]) * 24, 4, 4)
    assert marked[0] == 9 and marked[4] == 4 and pcm.psnr(frame, frame) == float("inf")
    with pytest.raises(ValueError):
        pcm.watermarked(frame, 16, 16, bytes(600), 20, 20)
    assert pcm.from_float([0.0, 1.0, -2.0]) == b"\x00\x00\xff\x7f\x00\x80"
    assert pcm.downmixed(b"\x01\x00\x04\x00") == b"\x02\x00"


def test_frames_and_policy():
    import numpy as np

    from tideline.functions import audio_policy, frames

    order = [(0, True, "I0"), (6, False, "P6"), (2, False, "B2"), (4, False, "B4"), (0, True, "I0'"), (2, False, "P2'")]
    assert list(frames.display_order(order)) == ["I0", "B2", "B4", "P6", "I0'", "P2'"]
    assert [(i, k) for i, k, _ in frames.coding_order("IBBPBB")] == [(0, "I"), (3, "P"), (1, "B"), (2, "B"), (4, "P"), (5, "P")]
    a = np.zeros((32, 32), np.uint8)
    assert frames.scene_change(a, a)["changed"] == 0 and frames.scene_change(a, a + 100)["changed"] == 1 and frames.sad(a, a + 1) == 1024
    assert audio_policy.classified(b"\xaf\x00cfg") == {"codec": "aac", "header": True, "payload": b"cfg", "track": None}
    assert audio_policy.classified(b"\x95\x01Opus\x03xyz") == {"codec": "opus", "header": False, "payload": b"xyz", "track": 3}
    assert audio_policy.transcodable("opus", "mp3", 48000, 2) is None and audio_policy.transcodable("flac", "aac", 48000, 2)


def test_playlists_nest_without_limit():
    from tideline.sources import hls

    texts = {f"p{i}": f"#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1\np{i + 1}\n#EXT-X-STREAM-INF:BANDWIDTH=1\np0\n" for i in range(2000)}
    texts["p2000"] = "#EXTM3U\n#EXTINF:1.5,\na.ts\n"
    assert [(s["uri"], s["duration"]) for s in hls.collected("p0", texts.__getitem__)] == [("a.ts", 1.5)]


def test_groups_of_pictures_are_not_called_one_by_one(spark):
    from tideline.functions import h264
    from tideline.operators import gop

    frames = [(f"s{k}", i, 40 * i, i % 4 == 1, bytearray(h264.encode(bytes([10 * k + i]) * 384, 16, 16))) for k in range(2) for i in range(12)]
    seen = lambda picture, state: bytes([state.setdefault("n", 0), state.update(n=state["n"] + 1) or picture[0]])
    df = gop.recoded(spark.createDataFrame(frames, "stream_id string, seq long, ts_ms long, is_key boolean, data binary"), 16, 16, 16, 16, encode=seen)
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
    found = {(r.stream_id, r.seq): (r.gop, bytes(r.data)) for r in df.collect()}
    assert found == {(f"s{k}", i): ((i + 3) // 4, bytes([(i - 1) % 4, 10 * k + i])) for k in range(2) for i in range(1, 12)}


def test_strict_scan_of_parts_is_that_of_the_file():
    data = flv.file_header() + b"".join(flv.tag_bytes(k, 40 * i, bytes(n)) for i, (k, n) in enumerate([(9, 30), (8, 0), (18, 3), (8, 5000)]))
    for end in [*range(14, 120, 5), *range(120, len(data), 970), *range(len(data) - 6, len(data) + 1)]:
        for without in (0, 5):
            cut = data[: end - without] if end - without >= 13 else data[:13]
            if len(cut) < end - without or end - without < 13:
                continue
            want = len(list(flv.read_tags(io.BytesIO(cut))))
            try:
                list(flv.read_tags(io.BytesIO(cut), strict=True))
                refused = False
            except ValueError:
                refused = True
            for step in (7, 16, 999):
                scan = flv.StrictScan()
                for a in range(0, end, step):
                    scan.push(data[a : min(end, a + step)])
                    assert len(scan.rest) < 5015 + step  # an unfinished tag and a part
                try:
                    scan.finish(without)
                    assert not refused
                except ValueError:
                    assert refused
                assert scan.count == want
    assert [(k, t, b) for k, t, b in flv.tags_of(data)] == [(k, t, b) for k, t, _, b, _ in flv.read_tags(io.BytesIO(data))]
    assert len(list(flv.tags_of(data[:-6]))) == 3 and len(list(flv.tags_of(data[:-3]))) == 4
