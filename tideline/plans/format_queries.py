"""Queries that write table rows in a media format and read them again: what
comes out of the parsers must be what SQL sees in the tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.functions import amf, audio, audio_policy, frames, h264, nal, pcm
from tideline.operators.scan import batches, plain, taken, tasks
from tideline.plans import conversions
from tideline.sources import flv, hls, live, mp4, ogg, rtp
from tideline.sources.events import TAGS_SQL, tags

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def each(df: DataFrame, make: Callable[..., Iterable[tuple]], ddl: str) -> DataFrame:
    """Rows that ``make`` gives for the values of each row, in Arrow batches."""
    schema = to_arrow_schema(T._parse_datatype_string(ddl))

    def run(found):
        return batches((r for values in taken(found) for r in make(*values)), schema)

    return df.mapInArrow(run, ddl)


def each_dealt(df: DataFrame, make: Callable[..., Iterable[tuple]], ddl: str) -> DataFrame:
    """As ``each`` over a table as it is stored: its rows are dealt first, since
    a file of one row group is read by one task, whatever its rows cost."""
    return each(df.repartition(tasks(df.sparkSession), df.columns[0], *df.columns[1:2]), make, ddl)


def orders(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def each_order(spark, sf_dir, make: Callable[..., Iterable[tuple]], ddl: str) -> DataFrame:
    """Rows that ``make(l_orderkey, rows)`` gives for each order; ``rows`` are its
    lines, by their values.  Lines come dealt by order and sorted, so an order is
    gathered only where it is used."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("q", F.col("l_quantity").cast("int"))
    names = ["l_orderkey", "l_partkey", "l_suppkey", "q"]
    schema = to_arrow_schema(T._parse_datatype_string(ddl))

    def gathered(found):
        key, rows = None, []
        for batch in found:
            keys, parts, supps, qs = (plain(c) for c in batch.columns)
            own = [{"l_partkey": p, "l_suppkey": s, "q": q} for p, s, q in zip(parts, supps, qs, strict=True)]
            starts = [0] + [i for i, (a, b) in enumerate(zip(keys, keys[1:], strict=False), 1) if a != b] if keys else []
            for a, b in zip(starts, [*starts[1:], len(own)], strict=True):
                if rows and keys[a] != key:
                    yield key, rows
                    rows = []
                key = keys[a]
                rows += own[a:b]
        if rows:
            yield key, rows

    def run(found):
        return batches((r for key, rows in gathered(found) for r in make(key, rows)), schema)

    dealt = li.select("l_linenumber", *names).repartition(tasks(spark), "l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber", *names[1:])
    return dealt.select(*names).mapInArrow(run, ddl)


LINES_SQL = """l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT AS q,
 ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"""


@query(f"WITH {TAGS_SQL} SELECT stream_id, seq, 2 AS units, is_key, seq AS first, size AS second FROM tags")
def nal_units(spark, sf_dir):  # S21, P4, P14, P15
    def make(stream, seq, size, key):
        units = [bytes([0x65 if key else 0x41]) + nal.with_prevention(seq.to_bytes(8, "big") + b"\x80"), b"\x06" + nal.with_prevention(size.to_bytes(8, "big") + b"\x80")]
        back = nal.from_lengths(nal.to_lengths(nal.from_annexb(nal.to_annexb(units))))
        yield stream, seq, len(back), nal.has_idr(back), *[int.from_bytes(nal.without_prevention(u)[1:9], "big") for u in back]

    return each_dealt(tags(spark, sf_dir).select("stream_id", "seq", "size", "is_key"), make, "stream_id bigint, seq bigint, units int, is_key boolean, first bigint, second bigint")


@query(
    """SELECT o_orderkey, (16 + 2 * (o_orderkey % 500))::INT AS width, (16 + 2 * (o_custkey % 300))::INT AS height, [66, 77, 100][(o_orderkey % 3 + 1)::INT] AS profile, (24 + o_orderkey % 7)::DOUBLE AS fps,
 CASE o_custkey % 3 WHEN 2 THEN 4 ELSE 2 END AS length_size, false AS cabac FROM orders"""
)
def parameter_sets(spark, sf_dir):  # P12, P13: configuration records
    def make(key, cust):
        w, h, fps = 16 + 2 * (key % 500), 16 + 2 * (cust % 300), (24 + key % 7, 1)
        size = (2, 2, 4)[cust % 3]
        record = nal.configuration_record([nal.sps_unit(w, h, (66, 77, 100)[key % 3], 30, fps)], [h264.parameter_sets(16, 16)[1]], size)
        c = nal.configuration(record)
        s, p = nal.sps(c["sps"][0]), nal.pps(c["pps"][0])
        yield key, s["width"], s["height"], s["profile"], s["fps"], c["length_size"], p["cabac"]

    return each_dealt(orders(spark, sf_dir).select("o_orderkey", "o_custkey"), make, "o_orderkey bigint, width int, height int, profile int, fps double, length_size int, cabac boolean")


_RATES = "[96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]"


@query(f"SELECT c_custkey, 2 AS object_type, {_RATES}[(c_custkey % 13 + 1)::INT] AS rate, (1 + c_custkey % 2)::INT AS channels FROM customer")
def audio_configs(spark, sf_dir):  # P13
    def make(key):
        c = audio.audio_config(audio.audio_config_bytes(2, audio.AAC_RATES[key % 13], 1 + key % 2))
        yield key, c["object_type"], c["rate"], c["channels"]

    return each_dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), make, "c_custkey bigint, object_type int, rate int, channels int")


@query(
    f"""WITH {TAGS_SQL} SELECT stream_id, seq, i::INT AS frame, (i * (7 + length((seq + 1)::VARCHAR)))::INT AS "offset", {_RATES}[(seq % 13 + 1)::INT] AS rate, (1 + seq % 2)::INT AS channels, seq + 1 AS number
 FROM tags, LATERAL (SELECT unnest(range(0, 1 + seq % 3)) AS i)"""
)
def adts_round_trip(spark, sf_dir):  # S13, K8
    def make(stream, seq):
        data = b"".join(audio.adts_frame(str(seq + 1).encode(), audio.AAC_RATES[seq % 13], 1 + seq % 2) for _ in range(1 + seq % 3))
        for i, f in enumerate(audio.adts_frames(data)):
            yield stream, seq, i, f["offset"], f["rate"], f["channels"], int(f["payload"])

    return each_dealt(tags(spark, sf_dir).select("stream_id", "seq"), make, "stream_id bigint, seq bigint, frame int, offset int, rate int, channels int, number bigint")


@query(
    f"""WITH {TAGS_SQL}, m AS (SELECT stream_id, seq, [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320][(seq % 14 + 1)::INT] AS k, [44100, 48000, 32000][(seq % 3 + 1)::INT] AS rate, (seq % 2)::INT AS pad, CASE WHEN seq % 5 = 0 THEN 1 ELSE 2 END AS channels FROM tags),
 z AS (SELECT *, (144000 * k // rate + pad)::INT AS size FROM m)
 SELECT stream_id, seq, i::INT AS frame, (2 + i * size)::INT AS "offset", k * 1000 AS bitrate, rate, channels, size FROM z, (VALUES (0), (1)) v(i)"""
)
def mp3_frames(spark, sf_dir):  # S16
    def make(stream, seq):
        word = 0x7FF << 21 | 3 << 19 | 1 << 17 | 1 << 16 | (1 + seq % 14) << 12 | (seq % 3) << 10 | (seq % 2) << 9 | (3 if seq % 5 == 0 else 0) << 6
        head = word.to_bytes(4, "big")
        one = head + b"\x00" * (audio.mp3_header(head)["size"] - 4)
        for i, f in enumerate(audio.mp3_frames(b"\x00\x01" + 2 * one)):
            yield stream, seq, i, f["offset"], f["bitrate"], f["rate"], f["channels"], f["size"]

    return each_dealt(tags(spark, sf_dir).select("stream_id", "seq"), make, "stream_id bigint, seq bigint, frame int, offset int, bitrate int, rate int, channels int, size int")


@query(
    f"""WITH {TAGS_SQL}, p AS (SELECT stream_id, seq, (seq % 32)::INT AS config, seq // 32 % 4 AS code, (10 + seq % 50)::INT AS n FROM tags),
 u AS (SELECT *, CASE WHEN config < 12 THEN [10000, 20000, 40000, 60000][config % 4 + 1] WHEN config < 16 THEN [10000, 20000][config % 2 + 1] ELSE [2500, 5000, 10000, 20000][config % 4 + 1] END AS us, CASE code WHEN 0 THEN 1 ELSE 2 END AS k FROM p)
 SELECT stream_id, seq, CASE WHEN config < 12 THEN 'silk' WHEN config < 16 THEN 'hybrid' ELSE 'celt' END AS mode, us AS frame_us, seq % 3 = 0 AS stereo, k AS frames, (k * us * 48 // 1000)::INT AS samples, CASE code WHEN 0 THEN n WHEN 2 THEN 2 * n + 1 ELSE 2 * n END AS bytes FROM u"""
)
def opus_packets(spark, sf_dir):  # S15, P16
    def make(stream, seq):
        code, n = seq // 32 % 4, 10 + seq % 50
        toc = bytes([seq % 32 << 3 | 4 * (seq % 3 == 0) | code])
        body = (b"a" * n, b"a" * 2 * n, bytes([n]) + b"a" * (2 * n + 1), b"\x02" + b"a" * 2 * n)[code]
        p = audio.opus_packet(toc + body)
        yield stream, seq, p["mode"], p["frame_us"], p["stereo"], len(p["frames"]), p["samples"], sum(map(len, p["frames"]))

    return each_dealt(tags(spark, sf_dir).select("stream_id", "seq"), make, "stream_id bigint, seq bigint, mode string, frame_us int, stereo boolean, frames int, samples int, bytes int")


@query(f"WITH {LINES_SQL} SELECT l_orderkey, rn::INT AS packet, 960 AS duration_samples, CASE rn WHEN 1 THEN 312 ELSE 0 END AS trim_start, CASE rn WHEN n THEN 100 ELSE 0 END AS trim_end, q AS size FROM l")
def ogg_round_trip(spark, sf_dir):  # S14, K8, P16
    def make(key, rows):
        found = [bytes([31 << 3]) + bytes(r["q"] - 1) for r in rows]
        for i, p in enumerate(ogg.opus_packets(ogg.opus_file(found, 2, 312, 960 * len(found) - 100)), 1):
            yield key, i, p["duration_samples"], p["trim_start"], p["trim_end"], len(p["data"])

    return each_order(spark, sf_dir, make, "l_orderkey bigint, packet int, duration_samples int, trim_start int, trim_end int, size int")


@query(f"WITH {LINES_SQL} SELECT l_orderkey, (8000 + l_orderkey % 4 * 8000)::INT AS rate, 2 AS channels, (4 * count(*))::INT AS data_size, sum(97 * q // 2)::BIGINT AS mono, sum(100 * q)::BIGINT AS floats FROM l GROUP BY l_orderkey")
def wav_round_trip(spark, sf_dir):  # S17, X6, K8
    import numpy as np

    def make(key, rows):
        planes = [np.array([k * r["q"] for r in rows], "<i2").tobytes() for k in (100, -3)]
        data = audio.wav_bytes(pcm.interleaved(planes), 8000 + key % 4 * 8000, 2)
        w = audio.wav_header(data)
        stereo = data[w["data_offset"] : w["data_offset"] + w["data_size"]]
        # 16-bit values over 32768 times 32767 lose at most one step, away from zero and back.
        back = np.frombuffer(pcm.from_float(pcm.to_float(planes[0]) * 32768 / 32767), "<i2")
        yield key, w["rate"], w["channels"], w["data_size"], int(np.frombuffer(pcm.downmixed(stereo), "<i2").astype(int).sum()), int(back.astype(int).sum())

    return each_order(spark, sf_dir, make, "l_orderkey bigint, rate int, channels int, data_size int, mono bigint, floats bigint")


@query(f"WITH {TAGS_SQL} SELECT stream_id, seq, ['flv', 'mp4', 'ogg', 'wav', 'adts', 'mp3', 'unknown'][(seq % 7 + 1)::INT] AS container FROM tags")
def sniffed_containers(spark, sf_dir):  # S18
    def make(stream, seq):
        heads = (flv.file_header, lambda: mp4.file_bytes([]), lambda: ogg.opus_file([b"\xf8a"], 1, 0), lambda: audio.wav_bytes(b"", 8000, 1), lambda: audio.adts_frame(b"a", 48000, 2), lambda: b"ID3\x04", lambda: b"none of these")
        yield stream, seq, audio.sniffed(heads[seq % 7]())

    return each_dealt(tags(spark, sf_dir).select("stream_id", "seq"), make, "stream_id bigint, seq bigint, container string")


@query(
    f"""WITH {LINES_SQL} SELECT l_orderkey, (3000 * (rn - 1))::BIGINT AS ts, CASE (rn - 1) % 3 WHEN 1 THEN 2 ELSE 1 END AS units, rn = 1 AS is_key, q AS number
 FROM l WHERE NOT (l_orderkey % 5 = 0 AND n > 1 AND rn IN (2, 3))"""
)
def rtp_access_units(spark, sf_dir):  # S19, T11: single, aggregated and fragmented units; a lost packet spoils the one behind it too
    def make(key, rows):
        sent, seq = [], 65530
        for i, r in enumerate(rows):
            unit = bytes([0x65 if i == 0 else 0x41]) + bytes(40) + bytes([r["q"]])
            if i % 3 == 0:
                parts = [unit]
            elif i % 3 == 1:
                parts = [b"\x18" + b"".join(len(u).to_bytes(2, "big") + u for u in (b"\x06ab", unit))]
            else:
                cut = [unit[1:15], unit[15:30], unit[30:]]
                parts = [bytes([0x5C, 0x80 * (k == 0) | 0x40 * (k == 2) | 1]) + x for k, x in enumerate(cut)]
            for k, x in enumerate(parts):
                sent.append((i, rtp.packet_bytes(96, seq, 3000 * i, 7, x, k == len(parts) - 1)))
                seq += 1
        d = rtp.Depacketizer()
        lost = 1 if key % 5 == 0 and len(rows) > 1 else None
        for u in [u for i, p in sent if i != lost for u in d.push(rtp.packet(p))] + d.flush():
            yield key, u["ts"], len(u["units"]), u["is_key"], u["units"][-1][-1]

    return each_order(spark, sf_dir, make, "l_orderkey bigint, ts bigint, units int, is_key boolean, number int")


@query("SELECT c_custkey, 'onMetaData' AS event, c_name AS name, c_acctbal AS balance, c_nationkey::DOUBLE AS nation, c_name AS name3, c_acctbal AS balance3, c_nationkey::BIGINT AS nation3, 3 AS listed FROM customer")
def amf_round_trip(spark, sf_dir):  # S20, K2, R17
    def make(key, name, balance, nation):
        values = {"name": name, "balance": balance, "nation": nation, "ok": True, "nothing": None, "list": [1, "a", None]}
        s = amf.script(amf.metadata(values))
        three = amf.Reader3(amf.write3(values)).value()
        yield key, s["name"], s["value"]["name"], s["value"]["balance"], s["value"]["nation"], three["name"], three["balance"], three["nation"], len(s["value"]["list"])

    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    return each_dealt(rows, make, "c_custkey bigint, event string, name string, balance double, nation double, name3 string, balance3 double, nation3 bigint, listed int")


@query(f"WITH {LINES_SQL} SELECT l_orderkey, (rn + 4)::INT AS seq, 'a/part_' || rn || '.ts' AS uri, (q / 8.0)::DOUBLE AS duration FROM l")
def playlist_entries(spark, sf_dir):  # S11: a playlist that names another one
    def make(key, rows):
        inner = "#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:5\n" + "".join(f"#EXTINF:{r['q'] / 8:.3f},\npart_{i}.ts\n" for i, r in enumerate(rows, 1)) + "#EXT-X-ENDLIST"
        texts = {"top.m3u8": "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1\na/list.m3u8\n", "a/list.m3u8": inner}
        for s in hls.collected("top.m3u8", texts.__getitem__):
            yield key, s["seq"], s["uri"], s["duration"]

    return each_order(spark, sf_dir, make, "l_orderkey bigint, seq int, uri string, duration double")


_SAMPLES = f"""{LINES_SQL}, s AS (SELECT l_orderkey, rn, n, q, l_partkey % 5 - 2 AS cts, (l_suppkey % 7 + 1)::BIGINT AS delta, coalesce(sum(l_suppkey % 7 + 1) OVER (PARTITION BY l_orderkey ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ticks FROM l)"""


def _samples(rows):
    """(data, delta, cts, key) of an order's lines."""
    return [(bytes([r["q"]]) * r["q"], r["l_suppkey"] % 7 + 1, r["l_partkey"] % 5 - 2, i % 3 == 0) for i, r in enumerate(rows)]


@query(
    f"""WITH {_SAMPLES} SELECT l_orderkey, rn::INT AS sample_no, q::BIGINT AS size, ((2 * ticks * 1000 + 90) // 180)::BIGINT AS dts_ms, floor((2 * cts * 1000 + 90) / 180.0)::BIGINT AS cts_ms, n = 1 OR (rn - 1) % 3 = 0 AS is_key, q AS first_byte, q AS last_byte FROM s"""
)
def mp4_round_trip(spark, sf_dir):  # K3, S7-S9
    def write(key, rows):
        entry = mp4.box("avc1", bytes(78), mp4.box("avcC", b"\x01" + bytes(6)))
        yield key, mp4.file_bytes([{"track_id": 1, "handler": "vide", "timescale": 90, "entry": entry, "samples": _samples(rows)}])

    def read(key, data):
        for t in mp4.tracks(data):
            yield key, t["timescale"], t["sample_sizes"], t["stsc"], t["chunk_offsets"], t["stts"], t["ctts"], t["stss"], data

    files = each_order(spark, sf_dir, write, "l_orderkey bigint, content binary")
    tables = each(files, read, "l_orderkey bigint, timescale int, sample_sizes array<bigint>, stsc array<struct<first_chunk:int,spc:int>>, chunk_offsets array<bigint>, stts array<struct<count:int,delta:int>>, ctts array<struct<count:int,offset:int>>, stss array<int>, content binary")
    rows = mp4.samples(tables, ["l_orderkey"], "content")
    byte = lambda at: F.conv(F.hex(F.substring("data", at, 1)), 16, 10).cast("int")
    return rows.select("l_orderkey", "sample_no", "size", "dts_ms", "cts_ms", "is_key", byte(1).alias("first_byte"), byte(-1).alias("last_byte"))


@query(f"WITH {_SAMPLES} SELECT l_orderkey, rn::INT AS sample_no, ticks AS dts, cts::INT AS cts, delta::INT AS duration, q AS size, (rn - 1) % 3 = 0 AS is_key, q AS first_byte FROM s")
def fragment_round_trip(spark, sf_dir):  # K4, S10: fragments of three samples
    def make(key, rows):
        found, data, at = _samples(rows), b"", 0
        for k in range(0, len(found), 3):
            data += mp4.fragment(k // 3 + 1, 1, at, found[k : k + 3])
            at += sum(x[1] for x in found[k : k + 3])
        for i, s in enumerate(mp4.fragment_samples(data), 1):
            yield key, i, s["dts"], s["cts"], s["duration"], s["size"], s["is_key"], data[s["offset"]]

    return each_order(spark, sf_dir, make, "l_orderkey bigint, sample_no int, dts bigint, cts int, duration int, size int, is_key boolean, first_byte int")


@query("SELECT o_orderkey, (o_custkey * 10)::BIGINT AS duration, 'moov' AS holder FROM orders")
def init_duration(spark, sf_dir):  # R23, S7
    blank = mp4.file_bytes([])

    def make(key, cust):
        data = mp4.with_duration(blank, cust * 10)
        head = next(b for b in mp4.boxes(data) if b["type"] == "mvhd")
        at = head["offset"] + head["header"] + 16
        yield key, int.from_bytes(data[at : at + 4], "big"), head["path"].split("/")[1]

    return each_dealt(orders(spark, sf_dir).select("o_orderkey", "o_custkey"), make, "o_orderkey bigint, duration bigint, holder string")


@query(
    f"""WITH {TAGS_SQL} SELECT stream_id, seq, ['aac', 'aac', 'mp3', 'opus', 'unknown:flac', 'unknown:6'][(seq % 6 + 1)::INT] AS codec, seq % 6 IN (0, 3) AS header, CASE seq % 6 WHEN 4 THEN 3 END AS track, seq AS number FROM tags"""
)
def audio_tag_class(spark, sf_dir):  # P8
    heads = (b"\xaf\x00", b"\xaf\x01", b"\x2f", b"\x90Opus", b"\x95\x01fLaC\x03", b"\x6f")

    def make(stream, seq):
        c = audio_policy.classified(heads[seq % 6] + str(seq).encode())
        yield stream, seq, c["codec"], c["header"], c["track"], int(c["payload"])

    return each_dealt(tags(spark, sf_dir).select("stream_id", "seq"), make, "stream_id bigint, seq bigint, codec string, header boolean, track int, number bigint")


@query(
    """WITH t AS (SELECT o_orderkey, ['aac', 'mp3', 'opus', 'pcm', 'unknown:flac'][(o_orderkey % 5 + 1)::INT] AS source, ['aac', 'mp3', 'opus', 'pcm', 'vorbis'][(o_custkey % 5 + 1)::INT] AS target, [44100, 48000, 8000][(o_orderkey % 3 + 1)::INT] AS rate, (1 + o_custkey % 3)::INT AS channels FROM orders)
 SELECT o_orderkey, CASE WHEN channels = 3 THEN '3 channels' WHEN source LIKE 'unknown%' THEN 'no decoder for ' || source WHEN target = 'mp3' AND rate = 8000 THEN 'mp3 at 8000 Hz' WHEN target = 'opus' AND rate <> 48000 THEN 'opus at ' || rate || ' Hz' WHEN target = 'vorbis' THEN 'no encoder for vorbis' END AS refusal FROM t"""
)
def transcode_refusals(spark, sf_dir):  # P10
    def make(key, cust):
        yield key, audio_policy.transcodable(("aac", "mp3", "opus", "pcm", "unknown:flac")[key % 5], ("aac", "mp3", "opus", "pcm", "vorbis")[cust % 5], (44100, 48000, 8000)[key % 3], 1 + cust % 3)

    return each_dealt(orders(spark, sf_dir).select("o_orderkey", "o_custkey"), make, "o_orderkey bigint, refusal string")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 1000 < 640 THEN 'output width exceeds the source' WHEN o_custkey % 700 < 360 THEN 'output height exceeds the source' WHEN o_orderkey % 50 < 15 THEN 'output fps exceeds the source' END AS error FROM orders"""
)
def output_limits(spark, sf_dir):  # P11
    error = audio_policy.no_upscale(F.col("o_orderkey") % 1000, F.col("o_custkey") % 700, F.col("o_orderkey") % 50, 640, 360, 15)
    return orders(spark, sf_dir).select("o_orderkey", error.alias("error"))


@query(f"WITH {LINES_SQL}, e AS (SELECT *, sum((rn = 1 OR q >= 45)::INT) OVER (PARTITION BY l_orderkey ORDER BY rn) AS epoch FROM l) SELECT l_orderkey, rn::INT AS decoded, (ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY epoch, l_partkey, rn))::INT AS shown FROM e")
def display_order(spark, sf_dir):  # T2, O3: picture order inside each IDR's epoch
    def make(key, rows):
        coded = [(r["l_partkey"], i == 1 or r["q"] >= 45, i) for i, r in enumerate(rows, 1)]
        for shown, i in enumerate(frames.display_order(coded, depth=len(coded)), 1):
            yield key, i, shown

    return each_order(spark, sf_dir, make, "l_orderkey bigint, decoded int, shown int")


@query(
    f"""WITH {LINES_SQL}, k AS (SELECT l_orderkey, rn, n, rn > 1 AND q < 25 AS b, max(CASE WHEN rn = 1 OR q >= 25 THEN rn END) OVER (PARTITION BY l_orderkey ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(CASE WHEN rn = 1 OR q >= 25 THEN rn END) OVER (PARTITION BY l_orderkey ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM l)
 SELECT l_orderkey, rn::INT AS shown, CASE WHEN NOT b THEN CASE rn WHEN 1 THEN 'I' ELSE 'P' END WHEN after IS NULL THEN 'P' ELSE 'B' END AS kind, (CASE WHEN NOT b THEN coalesce(before, 0) + 1 WHEN after IS NULL THEN rn ELSE rn + 1 END)::INT AS coded FROM k"""
)
def coding_order(spark, sf_dir):  # E5
    def make(key, rows):
        kinds = "".join("I" if i == 0 else "B" if r["q"] < 25 else "P" for i, r in enumerate(rows))
        for i, kind, t in frames.coding_order(kinds):
            yield key, i + 1, kind, t + 1

    return each_order(spark, sf_dir, make, "l_orderkey bigint, shown int, kind string, coded int")


@query(
    """WITH p AS (SELECT p_partkey, x, y, CASE WHEN x < 4 AND y < 2 THEN 200 ELSE (p_partkey * 7 + (8 * y + x) * 13) % 256 END AS v FROM part, (SELECT unnest(range(0, 8)) AS x), (SELECT unnest(range(0, 8)) AS y))
 SELECT p_partkey, (x // 2)::INT AS x, (y // 2)::INT AS y, ((sum(v) + 2) // 4)::INT AS luma FROM p GROUP BY ALL"""
)
def scaled_frames(spark, sf_dir):  # V1, V2: a mark over the corner, then half the size
    def make(key):
        frame = bytes((key * 7 + i * 13) % 256 for i in range(64)) + bytes(32)
        out = pcm.scaled(pcm.watermarked(frame, 8, 8, bytes([200] * 8 + [9] * 4), 4, 2), 8, 8, 4, 4)
        for i, v in enumerate(out[:16]):
            yield key, i % 4, i // 4, v

    return each_dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), make, "p_partkey bigint, x int, y int, luma int")


@query(
    """WITH p AS (SELECT p_partkey, i, (p_partkey * 3 + i * 50) % 256 AS r, (p_partkey * 5 + i * 70) % 256 AS g, (p_partkey * 7 + i * 90) % 256 AS b FROM part, (SELECT unnest(range(0, 4)) AS i)),
 c AS (SELECT *, greatest(0, least(255, trunc(-0.14713::DOUBLE * r + -0.28886::DOUBLE * g + 0.436::DOUBLE * b + 128)))::INT AS u, greatest(0, least(255, trunc(0.615::DOUBLE * r + -0.51499::DOUBLE * g + -0.10001::DOUBLE * b + 128)))::INT AS v FROM p)
 SELECT p_partkey, i::INT AS pixel, trunc(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)::INT AS y, (sum(u) OVER (PARTITION BY p_partkey) // 4)::INT AS u, (sum(v) OVER (PARTITION BY p_partkey) // 4)::INT AS v FROM c"""
)
def mark_pixels(spark, sf_dir):  # V3: an image of four pixels as a mark
    def make(key):
        out = pcm.from_rgb(bytes((key * a + i * b) % 256 for i in range(4) for a, b in ((3, 50), (5, 70), (7, 90))), 2, 2)
        for i in range(4):
            yield key, i, out[i], out[4], out[5]

    return each_dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), make, "p_partkey bigint, pixel int, y int, u int, v int")


@query("SELECT p_partkey, abs(p_partkey % 200 - p_size * 3)::DOUBLE AS difference, (abs(p_partkey % 200 - p_size * 3) > 1)::INT::DOUBLE AS changed FROM part")
def scene_changes(spark, sf_dir):  # W23
    import numpy as np

    def make(key, size):
        a, b = (np.full((32, 32), v, np.uint8) for v in (key % 200, size * 3))
        m = frames.scene_change(a, b)
        yield key, m["difference"], m["changed"]

    return each_dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"), make, "p_partkey bigint, difference double, changed double")


@query("SELECT p_partkey, (SELECT sum((p_partkey * 5 + i * 11) % 256) FROM range(0, 384) r(i))::BIGINT AS total, 16 AS width, true AS same FROM part")
def pcm_macroblocks(spark, sf_dir):  # D1, E1, E4: the lossless corner, written and read
    import numpy as np

    sps = nal.sps(h264.parameter_sets(16, 16)[0])
    steps = np.arange(384) * 11

    def make(key):
        frame = (key * 5 % 256 + steps).astype(np.uint8).tobytes()
        back = h264.decode(h264.encode(frame, 16, 16, key), sps)
        yield key, sum(back), sps["width"], back == frame

    return each_dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), make, "p_partkey bigint, total bigint, width int, same boolean")


@query(f"WITH {LINES_SQL} SELECT l_orderkey, rn::INT AS message, CASE rn % 2 WHEN 0 THEN 8 ELSE 9 END AS tag_type, (16777215 - 2 + rn)::BIGINT AS ts_ms, 11 * q AS size, q AS number FROM l")
def rtmp_messages(spark, sf_dir):  # C3, C7, R21: chunks of 128 bytes, read in cuts; extended timestamps
    def make(key, rows):
        data = b"".join(live.rtmp_message(4 + i % 2, 8 if i % 2 == 0 else 9, 16777213 + i, 1, bytes([r["q"]]) * (11 * r["q"])) for i, r in enumerate(rows, 1))
        reader = live.RtmpChunks()
        found = [m for a in range(0, len(data), 300) for m in reader.push(data[a : a + 300])]
        for i, (kind, ts, body) in enumerate(live.rtmp_tags(found), 1):
            yield key, i, kind, ts, len(body), body[0]

    return each_order(spark, sf_dir, make, "l_orderkey bigint, message int, tag_type int, ts_ms bigint, size int, number int")


@query(f"WITH {LINES_SQL} SELECT l_orderkey, rn::INT AS message, 9 * q AS size, q AS number FROM l")
def socket_messages(spark, sf_dir):  # C1, C2: masked frames inside a chunked body, read in cuts
    def make(key, rows):
        frames_ = b"".join(live.frame(bytes([r["q"]]) * (9 * r["q"]), 2, b"\x01\x02\x03\x04") for r in rows)
        sent = b"".join(f"{len(frames_[a : a + 50]):x}\r\n".encode() + frames_[a : a + 50] + b"\r\n" for a in range(0, len(frames_), 50)) + b"0\r\n\r\n"
        body, socket, i = live.Chunked(), live.WebSocket(), 0
        for a in range(0, len(sent), 33):
            for m in socket.push(body.push(sent[a : a + 33])):
                i += 1
                yield key, i, len(m), m[0]

    return each_order(spark, sf_dir, make, "l_orderkey bigint, message int, size int, number int")


@query("SELECT page_id, ['http', 'http', 'websocket', 'rtmp'][(page_id % 4 + 1)::INT] AS puller FROM pages")
def url_routes(spark, sf_dir):  # C4
    def make(key, url):
        yield key, live.route(("http", "HTTPS", "wss", "rtmps")[key % 4] + "://" + (url or "").rpartition("://")[2])

    return each_dealt(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), make, "page_id bigint, puller string")


def _parts(spark, sf_dir) -> DataFrame:
    """Each stream's container in parts; a body is the tag's number and its size in zeros, 200 at most."""
    t = tags(spark, sf_dir)
    body = F.encode(F.rpad(F.col("seq").cast("string"), (F.length(F.col("seq").cast("string")) + F.col("size") % 200).cast("int"), " "), "utf-8")
    rows = t.select("stream_id", "seq", F.floor(F.col("ts") / 1000).alias("ts_ms"), "tag_type", body.alias("body"))
    return flv.files_of(rows, "stream_id", ("ts_ms", "seq"))


def _along(parts: DataFrame, make: Callable, ddl: str) -> DataFrame:
    """``make()`` for each stream, then its ``push(content)`` for each part in
    order; what it gives are rows behind the stream's id."""
    schema = to_arrow_schema(T._parse_datatype_string(ddl))

    def pushed(found):
        key, push = None, None
        for own, content in taken(found):
            if push is None or own != key:
                key, push = own, make()
            yield from ((own, *r) for r in push(content))

    return parts.repartition("stream_id").sortWithinPartitions("stream_id", "part").select("stream_id", "content").mapInArrow(lambda found: batches(pushed(found), schema), ddl)


@query(f"WITH {TAGS_SQL} SELECT stream_id, tag_type, ((ts // 1000) % 4294967296)::BIGINT AS ts_ms, seq::BIGINT AS number FROM tags")
def live_buffer(spark, sf_dir):  # S3, S6: complete tags of a buffer that fills in cuts of 1,000 bytes
    def make():
        buffer, at = bytearray(), 13  # behind the file header

        def push(content):
            nonlocal at
            for a in range(0, len(content), 1000):
                buffer.extend(content[a : a + 1000])
                found, end = flv.complete_tags(bytes(buffer), at)
                yield from ((kind, ts, int(body)) for kind, ts, body in found)
                del buffer[:end]
                at = 0

        return push

    return _along(_parts(spark, sf_dir), make, "stream_id bigint, tag_type int, ts_ms bigint, number bigint")


_STRICT = "stream_id bigint, whole bigint, refused boolean, all_tags bigint"


@query(f"WITH {TAGS_SQL}, b AS (SELECT stream_id, count(*) AS n FROM tags GROUP BY stream_id) SELECT stream_id, (n - 1)::BIGINT AS whole, true AS refused, n AS all_tags FROM b")
def strict_scan(spark, sf_dir):  # S5: a cut last tag ends the scan, or is an error
    schema = to_arrow_schema(T._parse_datatype_string(_STRICT))

    def scanned(found):
        key = cut = whole = None

        def ended():
            refused = False
            try:
                cut.finish(5)  # without the size field and a byte of the body or header
            except ValueError:
                refused = True
            whole.finish()
            return key, cut.count, refused, whole.count

        for own, content in taken(found):
            if cut is None or own != key:
                if cut is not None:
                    yield ended()
                key, cut, whole = own, flv.StrictScan(), flv.StrictScan()
            cut.push(content)
            whole.push(content)
        if cut is not None:
            yield ended()

    parts = _parts(spark, sf_dir).repartition("stream_id").sortWithinPartitions("stream_id", "part").select("stream_id", "content")
    return parts.mapInArrow(lambda found: batches(scanned(found), schema), _STRICT)


def _movies(spark, sf_dir) -> DataFrame:
    """(path, content): a tag container of each order's lines: a video frame each
    40 ms and an audio frame each 20 ms."""

    avc = nal.configuration_record([nal.sps_unit(64, 48)], [h264.parameter_sets(64, 48)[1]])
    aac = audio.audio_config_bytes(2, 48000, 2)

    def make(key, rows):
        unit = lambda i, r: nal.to_lengths([bytes([0x65 if i % 3 == 0 else 0x41]) + bytes([r["q"]]) * r["q"]])
        video = [(unit(i, r), 40 * i, 40 * (i % 2), i % 3 == 0) for i, r in enumerate(rows)]
        sound = [(bytes([r["q"]]) * 5, 20 * i, 0, True) for i, r in enumerate(rows)]
        yield str(key), conversions.muxed_flv({"avc": avc, "aac": aac, "video": video, "audio": sound})

    return each_order(spark, sf_dir, make, "path string, content binary")


def _media(files: DataFrame, key: str) -> DataFrame:
    """(l_orderkey, kind, frame, dts, cts, is_key, size, number) of tag containers."""

    def make(path, content):
        t = conversions.demuxed(content)
        for kind in ("video", "audio"):
            for i, (data, dts, cts, is_key) in enumerate(t[kind], 1):
                yield int(path), kind, i, dts, cts, is_key, len(data), data[-1]

    return each(files.select(key, "content"), make, "l_orderkey bigint, kind string, frame int, dts bigint, cts int, is_key boolean, size int, number int")


_MEDIA_SQL = f"""WITH {LINES_SQL} SELECT l_orderkey, 'video' AS kind, rn::INT AS frame, (40 * (rn - 1))::BIGINT AS dts, (40 * ((rn - 1) % 2))::INT AS cts, (rn - 1) % 3 = 0 AS is_key, q + 5 AS size, q AS number FROM l
 UNION ALL SELECT l_orderkey, 'audio', rn::INT, (20 * (rn - 1))::BIGINT, 0, true, 5, q FROM l"""


@query(_MEDIA_SQL)
def conversion_mp4(spark, sf_dir):  # API: tags to MP4 and back
    files = conversions.converted(conversions.converted(_movies(spark, sf_dir), "flv_to_mp4").select("path", "content"), "mp4_to_flv")
    return _media(files, "path")


@query(_MEDIA_SQL)
def conversion_fmp4(spark, sf_dir):  # API: fragments with a track each, and back to tags
    parts = conversions.converted(_movies(spark, sf_dir), "flv_to_split_fmp4").withColumnRenamed("path", "folder")
    return _media(conversions.converted_folders(parts, "fmp4_to_flv", together=True), "folder")


@query(_MEDIA_SQL)
def conversion_hls(spark, sf_dir):  # API: segments of a transport stream and their playlist, and back to tags
    parts = conversions.converted(_movies(spark, sf_dir), "flv_to_hls").withColumnRenamed("path", "folder")
    return _media(conversions.converted_folders(parts, "hls_to_flv", together=True), "folder")


@query(f"WITH {LINES_SQL} SELECT l_orderkey, rn::INT AS frame, 48000 AS rate, 2 AS channels, q AS number FROM l")
def conversion_aac(spark, sf_dir):  # API, S18: AAC out of tags, into MP4, out again as ADTS
    files = conversions.converted(conversions.converted(_movies(spark, sf_dir), "aac_to_mp4").select("path", "content"), "aac_to_adts")

    def make(path, content):
        for i, f in enumerate(audio.adts_frames(content), 1):
            yield int(path), i, f["rate"], f["channels"], f["payload"][0]

    return each(files.select("path", "content"), make, "l_orderkey bigint, frame int, rate int, channels int, number int")


@query(f"WITH {LINES_SQL} SELECT l_orderkey, (4 * count(*))::INT AS size, sum(q)::BIGINT AS total FROM l GROUP BY l_orderkey")
def conversion_wav(spark, sf_dir):  # API: PCM to WAVE and back
    samples = each_order(spark, sf_dir, lambda key, rows: [(str(key), b"".join(r["q"].to_bytes(4, "little") for r in rows))], "path string, content binary")
    files = conversions.converted(conversions.converted(samples, "pcm_to_wav").select("path", "content"), "wav_to_pcm")
    return each(files.select("path", "content"), lambda path, data: [(int(path), len(data), sum(data))], "l_orderkey bigint, size int, total bigint")


@query(
    f"""WITH {TAGS_SQL}, v AS (SELECT stream_id, seq, is_key, sum(is_key::INT) OVER (PARTITION BY stream_id ORDER BY ts // 1000, seq)::BIGINT AS gop FROM tags WHERE tag_type = 9)
 SELECT stream_id, seq, gop, is_key, 200 AS corner, (seq % 100)::INT AS "left", (seq % 100 + 50)::INT AS "right" FROM v WHERE gop > 0"""
)
def group_reencode(spark, sf_dir):  # API re-encode, D1, E1, R7, R8: pictures decoded, halved, marked and encoded by group
    from tideline.operators import gop

    sps = nal.sps(h264.parameter_sets(16, 16)[0])

    def write(stream, seq, ts, key):
        row = bytes([seq % 100] * 16 + [seq % 100 + 50] * 16)
        yield str(stream), seq, ts, key, h264.encode(row * 32 + bytes(512), 32, 32, seq)

    def read(stream, seq, group, key, data):
        frame = h264.decode(data, sps)
        yield int(stream), seq, group, key, frame[0], frame[16 * 8], frame[16 * 8 + 15]

    video = tags(spark, sf_dir).where("tag_type = 9").select("stream_id", "seq", F.floor(F.col("ts") / 1000).alias("ts_ms"), "is_key")
    coded = each_dealt(video, write, "stream_id string, seq bigint, ts_ms bigint, is_key boolean, data binary")
    out = gop.recoded(coded, 32, 32, 16, 16, mark=(bytes([200] * 4 + [0] * 2), 2, 2))
    return each(out.select("stream_id", "seq", "gop", "is_key", "data"), read, "stream_id bigint, seq bigint, gop bigint, is_key boolean, corner int, left int, right int")
