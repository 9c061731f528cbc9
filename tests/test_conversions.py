"""Conversions keep the media of a file, whatever container it passes through."""

import http.server
import threading

import pytest

from tideline.functions import audio, nal
from tideline.plans import conversions as C
from tideline.sources import flv, live


def movie(n=60):
    avc = nal.configuration_record([nal.sps_unit(320, 240, 66, 30, (25, 1))], [b"\x68\xce\x38\x80"])
    aac = audio.audio_config_bytes(2, 44100, 2)
    video = [(nal.to_lengths([bytes([0x65 if i % 25 == 0 else 0x41]) + bytes([i + 1]) * (20 + i)]), 40 * i, 40 if i % 3 else 0, i % 25 == 0) for i in range(n)]
    sound = [(bytes([i + 1]) * 30, int(i * 1024 / 44.1), 0, True) for i in range(n)]
    return {"avc": avc, "aac": aac, "video": video, "audio": sound, "metadata": {"duration": 2.4}}


def media(tracks):
    return [(d, t, c, k) for d, t, c, k in tracks["video"]], [d for d, *_ in tracks["audio"]]


def test_round_trips():
    m = movie()
    data = C.muxed_flv(m)
    assert media(C.demuxed(data)) == media(m)
    for name in ("flv_to_mp4",):
        back = C.demuxed_mp4(C.CONVERSIONS[name](data)["output.mp4"])
        assert media(back) == media(m) and (back["avc"], back["aac"]) == (m["avc"], m["aac"])
    files = C.CONVERSIONS["flv_to_hls"](data)
    back = C.from_playlist(files["index.m3u8"], files)
    assert media(back) == media(m) and back["avc"] == m["avc"]
    assert sorted(files) == ["index.m3u8", "segment_1.ts"]
    files = C.to_fmp4(m, 1000)
    back = C.from_playlist(files["index.m3u8"], files)
    assert media(back) == media(m) and back["aac"] == m["aac"] and len([f for f in files if f.endswith(".m4s")]) == 3
    assert media(C.demuxed(C.muxed_flv(C.demuxed_mp4(C.muxed_mp4(m))))) == media(m)
    with pytest.raises(ValueError):
        C.muxed_mp4({"avc": None, "aac": None, "video": [], "audio": []})


def test_over_files(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.flv").write_bytes(C.muxed_flv(movie(30 + i)))
    rows = C.converted(spark.read.format("binaryFile").load(str(tmp_path)), "flv_to_fmp4").collect()
    assert len({r.path for r in rows}) == 2 and all(r.content for r in rows)


def test_many_files_share_batches_and_folders_need_no_groups(spark):
    import pyarrow as pa

    from tideline.operators.scan import batches

    schema = pa.schema([("k", pa.int64()), ("content", pa.binary())])
    assert [b.num_rows for b in batches(((i, b"x") for i in range(10000)), schema)] == [4096, 4096, 1808]
    assert [b.num_rows for b in batches(((i, bytes(1 << 20)) for i in range(10)), schema)] == [4, 4, 2]
    files = spark.createDataFrame([(str(i), bytearray(C.muxed_flv(movie(30 + i)))) for i in range(3)], "path string, content binary")
    for there, back in (("flv_to_hls", "hls_to_flv"), ("flv_to_split_fmp4", "fmp4_to_flv")):
        parts = C.converted(files, there).withColumnRenamed("path", "folder")
        near, far = C.converted_folders(parts, back, together=True), C.converted_folders(parts, back)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (near, far)]
        assert "Exchange" not in plans[0] and "Exchange" in plans[1] and "FlatMapGroups" not in plans[1]
        made = [sorted((r.folder, r.name, bytes(r.content)) for r in df.collect()) for df in (near, far)]
        assert made[0] == made[1] and [media(C.demuxed(c)) for _, _, c in made[0]] == [media(movie(30 + i)) for i in range(3)]


def test_protocol_pieces():
    chunked = live.Chunked()
    wire = b"5\r\nhello\r\n6;x=1\r\n world\r\n0\r\n\r\n"
    assert b"".join(chunked.push(wire[i : i + 1]) for i in range(len(wire))) == b"hello world" and chunked.done
    ws = live.WebSocket()
    wire = live.frame(b"ping", 9) + bytes([2, 3]) + b"abc" + live.frame(b"d" * 70000, 0, b"mask") + live.frame(b"", 8)
    out = [m for i in range(0, len(wire), 999) for m in ws.push(wire[i : i + 999])]
    assert out == [b"abc" + b"d" * 70000] and ws.replies == [live.frame(b"ping", 10)] and ws.closed
    rtmp = live.RtmpChunks()
    wire = live.rtmp_message(2, 1, 0, 0, (4096).to_bytes(4, "big")) + live.rtmp_message(4, 9, 1 << 24, 1, b"v" * 9000, 4096) + live.rtmp_message(5, 8, 7, 1, b"a" * 10, 4096)
    out = [m for i in range(0, len(wire), 700) for m in rtmp.push(wire[i : i + 700])]
    assert live.rtmp_tags(out) == [(9, 1 << 24, b"v" * 9000), (8, 7, b"a" * 10)]
    assert live.route("WSS://x/y") == "websocket"
    with pytest.raises(ValueError):
        live.route("ftp://x")


def test_live_source(spark, tmp_path):
    data = C.muxed_flv(movie(20))

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/live.flv"
    tags = list(live.pull_http(url))
    assert len(tags) == 43
    spark.dataSource.register(live.source())
    q = spark.readStream.format("live_tags").option("url", url).load().writeStream.format("memory").queryName("live_out").option("checkpointLocation", str(tmp_path)).start()
    try:
        q.processAllAvailable()
        assert spark.table("live_out").count() >= len(tags)
    finally:
        q.stop()
        server.shutdown()
    assert flv.probe(data)["has_video"]


def test_recoding_by_group(spark):
    import numpy as np

    from tideline.functions import h264, pcm
    from tideline.operators import gop

    rng = np.random.default_rng(0)
    frames = [rng.integers(0, 256, 40 * 24 * 3 // 2, dtype=np.uint8).tobytes() for _ in range(9)]
    frames[3] = bytes(40 * 24 * 3 // 2)  # zeros need emulation prevention
    sps = nal.sps(h264.parameter_sets(40, 24)[0])
    assert (sps["width"], sps["height"]) == (40, 24)
    units = [h264.encode(f, 40, 24, i) for i, f in enumerate(frames)]
    assert [h264.decode(u, sps) for u in units] == frames
    with pytest.raises(ValueError):
        h264.decode(units[0][:200], sps)
    with pytest.raises(ValueError):
        h264.decode(b"\x65\x88\x84\x00\x33", sps)
    rows = [("a", i, 40 * i, i % 3 == 0, u) for i, u in enumerate(units)]
    mark = (bytes([7]) * 6, 2, 2)
    out = gop.recoded(spark.createDataFrame(rows, "stream_id string, seq long, ts_ms long, is_key boolean, data binary"), 40, 24, 20, 12, mark=mark).orderBy("seq").collect()
    small = nal.sps(h264.parameter_sets(20, 12)[0])
    assert [h264.decode(bytes(r.data), small) for r in out] == [pcm.watermarked(pcm.scaled(f, 40, 24, 20, 12), 20, 12, *mark) for f in frames]
    slow = gop.recoded(spark.createDataFrame(rows, "stream_id string, seq long, ts_ms long, is_key boolean, data binary"), 40, 24, 20, 12, fps=5).count()
    assert 3 <= slow < 9
