"""Queries over the ``events`` table read as tag streams, with DuckDB SQL.

Thresholds are scaled to the table: about 70 tags per stream over 30 days.
Names carry the inventory number of the operator that they exercise.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import audio_policy
from tideline.operators import aggregates as A
from tideline.operators import joins as J
from tideline.operators import segments as S
from tideline.operators import timeline as T
from tideline.sources.events import DAY, HOUR, TAGS_SQL, tags

BY, ORDER = ["stream_id"], ["ts", "seq"]
#: "Arrival" order for operators that repair disorder: rows by a scrambled number.
ARRIVAL = ["arrival", "seq"]


def video():
    return F.col("tag_type") == 9


def audio():
    return F.col("tag_type") == 8


def header():
    return F.col("is_header")


QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def arrivals(spark, sf_dir):
    """Tags in an arrival order that moves each up to 2 days."""
    return tags(spark, sf_dir).withColumn("arrival", F.col("ts") + F.pmod(F.col("seq") * 7919, F.lit(2 * 86400)) * 1000000)


ARRIVALS_SQL = f"WITH RECURSIVE {TAGS_SQL}, a AS (SELECT *, ts + (seq * 7919 % 172800) * 1000000 AS arrival FROM tags), arr AS (SELECT * EXCLUDE (rn), ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY arrival, seq) AS rn FROM a)"
W = "WINDOW w AS (PARTITION BY stream_id ORDER BY ts, seq)"


@query(
    f"""WITH {TAGS_SQL} SELECT stream_id,
 CASE WHEN count(v) >= 2 AND max(v) > min(v) THEN (count(v) - 1) * 86400000000.0::DOUBLE / (max(v) - min(v)) END AS fps,
 count_if(is_key)::BIGINT AS gop_count, max(ts) / 86400000000.0::DOUBLE AS real_duration
 FROM (SELECT *, CASE WHEN tag_type = 9 THEN ts END AS v FROM tags) GROUP BY stream_id"""
)
def stream_stats(spark, sf_dir):  # A1-A3
    return A.stream_stats(tags(spark, sf_dir), BY, "ts", video(), F.col("is_key"), DAY)


@query(
    f"""WITH {TAGS_SQL}, g AS (SELECT stream_id, ts - lag(ts) OVER (PARTITION BY stream_id ORDER BY ts, seq) AS gap FROM tags WHERE tag_type = 9),
 m AS (SELECT stream_id, 86400000000.0::DOUBLE * count(*) / sum(gap)::DOUBLE AS m FROM g WHERE gap > 0 GROUP BY stream_id),
 s AS (SELECT stream_id, CASE WHEN abs(m - 1.5) < 0.1 * 1.5 THEN 1.5 ELSE floor(m + 0.5) END AS s FROM m)
 SELECT stream_id, CASE WHEN s > 0 THEN least(s, 120.0)::DOUBLE END AS fps FROM s"""
)
def snapped_fps(spark, sf_dir):  # A4
    return A.snapped_fps(tags(spark, sf_dir).where(video()), BY, ORDER, "ts", DAY, 1.5)


@query(
    f"""WITH {TAGS_SQL}, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY stream_id, tag_type ORDER BY ts, seq) AS gap FROM tags)
 SELECT stream_id, tag_type, CASE WHEN count(*) = 1 THEN 1000 ELSE max(ts) - min(ts) + arg_max(gap, (ts, seq)) END AS duration FROM g GROUP BY ALL"""
)
def track_duration(spark, sf_dir):  # A5
    return A.track_durations(tags(spark, sf_dir), ["stream_id", "tag_type"], ORDER, "ts", 1000)


@query(f"WITH {TAGS_SQL} SELECT stream_id, count(*) AS tags, sum(size)::BIGINT AS bytes, count_if(tag_type = 8)::BIGINT AS audio, count_if(tag_type = 9)::BIGINT AS video, count_if(size > 10000)::BIGINT AS dropped FROM tags GROUP BY stream_id")
def stream_counters(spark, sf_dir):  # A8
    return A.counters(tags(spark, sf_dir), BY, "size", audio(), video(), F.col("size") > 10000)


@query(f"WITH {TAGS_SQL}, f AS (SELECT stream_id, tag_type, min((ts, seq)) AS f FROM tags GROUP BY ALL) SELECT stream_id, tag_type, (ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY f))::INT AS position FROM f")
def distinct_paths(spark, sf_dir):  # A9, O10
    return A.distinct_in_order(tags(spark, sf_dir), BY, ORDER, "tag_type")


@query(f"WITH {TAGS_SQL}, p AS (SELECT stream_id, ts // 86400000000 AS b, (sum(size) * 8)::DOUBLE / 86400.0::DOUBLE AS r FROM tags GROUP BY ALL) SELECT stream_id, round(sum(r) / count(*), 9) AS avg_rate, round(max(r), 9) AS max_rate FROM p GROUP BY stream_id")
def bit_rates(spark, sf_dir):  # A10
    out = A.bitrates(tags(spark, sf_dir), BY, F.floor(F.col("ts") / DAY), "size", 86400.0)
    return out.select("stream_id", F.round("avg_rate", 9).alias("avg_rate"), F.round("max_rate", 9).alias("max_rate"))


@query(
    f"""WITH RECURSIVE {TAGS_SQL}, r AS (SELECT stream_id, seq, rn, size::DOUBLE AS ema FROM tags WHERE rn = 1
 UNION ALL SELECT t.stream_id, t.seq, t.rn, 0.5 * t.size + (1 - 0.5) * r.ema FROM r JOIN tags t ON t.stream_id = r.stream_id AND t.rn = r.rn + 1)
 SELECT stream_id, seq, ema FROM r"""
)
def load_ema(spark, sf_dir):  # A11
    return A.moving_average(tags(spark, sf_dir).withColumn("x", F.col("size").cast("double")), BY, ORDER, "x").select("stream_id", "seq", "ema")


@query(
    """WITH d AS (SELECT l_linenumber, (l_quantity::BIGINT * 4 - l_suppkey % 256) AS d FROM lineitem)
 SELECT l_linenumber, sum(abs(d))::BIGINT AS sad, sum(d * d)::BIGINT AS sse, sum(d * d)::BIGINT::DOUBLE / count(*) AS mse, round(-10 * log10(sum(d * d)::BIGINT::DOUBLE / count(*) / 65025.0::DOUBLE), 9) AS psnr FROM d GROUP BY l_linenumber"""
)
def plane_psnr(spark, sf_dir):  # A12, A13
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return A.psnr(li, ["l_linenumber"], F.col("l_quantity").cast("long") * 4, F.col("l_suppkey") % 256).withColumn("psnr", F.round("psnr", 9))


@query(
    f"""WITH {TAGS_SQL}, o AS (SELECT *, coalesce(sum(size + 15) OVER (PARTITION BY stream_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 13 AS pos FROM tags)
 SELECT stream_id, string_agg(ts || '@' || pos, ',' ORDER BY ts, pos) AS index FROM o WHERE is_key GROUP BY stream_id"""
)
def keyframe_index(spark, sf_dir):  # A14
    placed = T.byte_offsets(tags(spark, sf_dir).withColumn("room", F.col("size") + 15), BY, ORDER, "room", F.lit(13), "pos")
    out = A.keyframe_index(placed, BY, "ts", "pos", F.col("is_key"))
    return out.select("stream_id", F.array_join(F.transform("index", lambda x: F.concat_ws("@", x["t"], x["pos"])), ",").alias("index"))


_DECIDE = """CASE WHEN s LIKE 'unknown%' THEN CASE WHEN t = 'mp3' THEN {a} ELSE {b} END WHEN s IN ('opus', 'pcm') THEN {c} ELSE {d} END"""


@query(
    "WITH k AS (SELECT DISTINCT CASE event_type WHEN 'view' THEN 'aac' WHEN 'click' THEN 'mp3' WHEN 'error' THEN 'unknown:9' WHEN 'signup' THEN 'opus' ELSE 'pcm' END AS s, CASE user_id % 4 WHEN 0 THEN 'aac' WHEN 1 THEN 'mp3' WHEN 2 THEN 'opus' END AS t FROM events) SELECT s AS source, t AS target, "
    + _DECIDE.format(a="NULL", b="'aac'", c="coalesce(t, 'aac')", d="coalesce(t, s)")
    + " AS output, "
    + _DECIDE.format(a="'error'", b="'silent'", c="'transcode'", d="CASE WHEN t IS NOT NULL AND t <> s THEN 'transcode' ELSE 'passthrough' END")
    + " AS mode FROM k"
)
def decision_table(spark, sf_dir):  # P9
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind, who = F.col("event_type"), F.pmod(F.col("user_id"), F.lit(4))
    source = F.when(kind == "view", "aac").when(kind == "click", "mp3").when(kind == "error", "unknown:9").when(kind == "signup", "opus").otherwise("pcm")
    target = F.when(who == 0, "aac").when(who == 1, "mp3").when(who == 2, "opus")
    pairs = e.select(source.alias("source"), target.alias("target")).distinct()
    output, mode = audio_policy.decision(F.col("source"), F.col("target"))
    return pairs.select("source", "target", output.alias("output"), mode.alias("mode"))


@query(f"WITH {TAGS_SQL}, h AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY ts, seq) AS n, count(*) FILTER (tag_type <> 18) OVER (PARTITION BY stream_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tags) SELECT stream_id, seq, tag_type FROM h WHERE tag_type <> 18 OR before = 0")
def kept_tags(spark, sf_dir):  # P1
    from tideline.sources.flv import kept

    return kept(tags(spark, sf_dir), BY, ORDER).select("stream_id", "seq", "tag_type")


@query(f"WITH {TAGS_SQL}, f AS (SELECT stream_id, seq, is_header, ts, first_value(CASE WHEN NOT is_header THEN ts END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM tags) SELECT stream_id, seq, CASE WHEN is_header THEN 0 ELSE greatest(ts - f, 0) END AS ts_out FROM f")
def rebase(spark, sf_dir):  # W1
    return T.rebase(tags(spark, sf_dir), BY, ORDER, "ts", header()).select("stream_id", "seq", "ts_out")


@query(
    f"""WITH {TAGS_SQL}, m AS (SELECT stream_id, seq, rn, (ts // 1000) % 4294967296 AS t FROM tags), f AS (SELECT *, t - first_value(t) OVER (PARTITION BY stream_id ORDER BY rn) AS d FROM m)
 SELECT stream_id, seq, CASE WHEN d < -2147483648 THEN d + 4294967296 ELSE greatest(d, 0) END AS ts_out FROM f"""
)
def rebase_wrap(spark, sf_dir):  # W2
    t = tags(spark, sf_dir).withColumn("ms", F.pmod(F.floor(F.col("ts") / 1000), F.lit(1 << 32)))
    return T.rebase_wrapped(t, BY, ORDER, "ms").select("stream_id", "seq", "ts_out")


@query(
    ARRIVALS_SQL
    + """, c AS (SELECT stream_id, seq, ts // 3600000000 AS t, rn FROM arr), r AS (SELECT stream_id, seq, rn, t AS o FROM c WHERE rn = 1
 UNION ALL SELECT c.stream_id, c.seq, c.rn, greatest(c.t, r.o + 1) FROM r JOIN c ON c.stream_id = r.stream_id AND c.rn = r.rn + 1)
 SELECT stream_id, seq, o AS ts_out FROM r"""
)
def clamp_strict(spark, sf_dir):  # W3, O2
    t = arrivals(spark, sf_dir).withColumn("h", F.floor(F.col("ts") / HOUR))
    return T.clamp_strict(t, BY, ARRIVAL, "h").select("stream_id", "seq", "ts_out")


@query(ARRIVALS_SQL + " SELECT stream_id, seq, max(ts) OVER (PARTITION BY stream_id ORDER BY arrival, seq ROWS UNBOUNDED PRECEDING) AS ts_out FROM arr")
def clamp_cummax(spark, sf_dir):  # W4
    return T.clamp(arrivals(spark, sf_dir), BY, ARRIVAL, "ts").select("stream_id", "seq", "ts_out")


@query(
    f"""WITH {TAGS_SQL}, d AS (SELECT stream_id, seq, coalesce(lead(ts) OVER w - ts, ts - lag(ts) OVER w, 1000) AS d FROM tags WINDOW w AS (PARTITION BY stream_id, tag_type ORDER BY ts, seq))
 SELECT stream_id, seq, greatest(d, 0) AS duration FROM d"""
)
def sample_duration(spark, sf_dir):  # W5
    return T.durations(tags(spark, sf_dir), ["stream_id", "tag_type"], ORDER, "ts", 1000).select("stream_id", "seq", "duration")


@query(
    f"""WITH {TAGS_SQL}, c AS (SELECT *, (rn - 1) // 8 AS chunk FROM tags), s AS (SELECT stream_id, chunk, sum(size) AS s FROM c GROUP BY ALL),
 b AS (SELECT stream_id, chunk, coalesce(sum(s + 64) OVER (PARTITION BY stream_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM s)
 SELECT stream_id, seq, (base + coalesce(sum(size) OVER (PARTITION BY stream_id, chunk ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM c JOIN b USING (stream_id, chunk)"""
)
def byte_offsets(spark, sf_dir):  # W6, J6
    from pyspark.sql import Window

    w = Window.partitionBy(*BY).orderBy(*ORDER)
    c = tags(spark, sf_dir).withColumn("chunk", F.floor((F.row_number().over(w) - 1) / 8))
    sizes = c.groupBy("stream_id", "chunk").agg((F.sum("size") + 64).alias("s"))
    bases = T.byte_offsets(sizes, BY, ["chunk"], "s", F.lit(0), "base").select("stream_id", "chunk", "base")
    return T.byte_offsets(c.join(bases, ["stream_id", "chunk"]), ["stream_id", "chunk"], ORDER, "size", F.col("base")).select("stream_id", "seq", "offset")


@query(f"WITH {TAGS_SQL}, p AS (SELECT stream_id, seq, coalesce(sum(size) OVER (PARTITION BY stream_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS t FROM tags) SELECT stream_id, seq, (2 * t * 1000 + 12800) // 25600 AS dts_ms FROM p")
def dts_prefix(spark, sf_dir):  # W7
    return T.decode_times(tags(spark, sf_dir), BY, ORDER, "size", F.lit(12800)).select("stream_id", "seq", "dts_ms")


@query(
    f"""WITH {TAGS_SQL}, m AS (SELECT *, CASE WHEN tag_type IS NOT DISTINCT FROM lag(tag_type) OVER w AND rn > 1 THEN 0 ELSE 1 END AS n FROM tags {W}), r AS (SELECT *, sum(n) OVER (PARTITION BY stream_id ORDER BY rn)::BIGINT AS run FROM m)
 SELECT stream_id, run, any_value(tag_type) AS tag_type, count(*) AS count FROM r GROUP BY stream_id, run"""
)
def rle_deltas(spark, sf_dir):  # W8
    return T.runs(tags(spark, sf_dir), BY, ORDER, "tag_type")


@query(f"WITH {TAGS_SQL} SELECT stream_id, seq, sum(CASE WHEN is_key THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS gop FROM tags")
def gop_id(spark, sf_dir):  # W9
    return T.groups_of_pictures(tags(spark, sf_dir), BY, ORDER, F.col("is_key")).select("stream_id", "seq", "gop")


_HLS = f"""{TAGS_SQL}, r AS (SELECT stream_id, seq, rn, ts AS s, 1 AS segment, ts, size FROM tags WHERE rn = 1
 UNION ALL SELECT t.stream_id, t.seq, t.rn, CASE WHEN t.is_key AND t.ts - r.s >= 86400000000 THEN t.ts ELSE r.s END, CASE WHEN t.is_key AND t.ts - r.s >= 86400000000 THEN r.segment + 1 ELSE r.segment END, t.ts, t.size
 FROM r JOIN tags t ON t.stream_id = r.stream_id AND t.rn = r.rn + 1)"""


@query(f"WITH RECURSIVE {_HLS} SELECT stream_id, seq, segment FROM r")
def hls_segments(spark, sf_dir):  # W10
    return S.at_keyframes(tags(spark, sf_dir), BY, ORDER, "ts", "is_key", DAY).select("stream_id", "seq", "segment")


@query(f'WITH RECURSIVE {_HLS} SELECT stream_id, segment, min(ts) AS "start", max(ts) AS "end", max(ts) - min(ts) AS duration, count(*) AS rows, sum(size)::BIGINT AS bytes FROM r GROUP BY stream_id, segment')
def segment_durations(spark, sf_dir):  # A6
    return S.segment_table(S.at_keyframes(tags(spark, sf_dir), BY, ORDER, "ts", "is_key", DAY), BY, "ts", "size")


@query(f"WITH RECURSIVE {_HLS}, g AS (SELECT stream_id, segment, max(ts) - min(ts) AS d FROM r GROUP BY ALL) SELECT stream_id, greatest(ceil(max(d) / 3600000000.0)::BIGINT, 24) AS target FROM g GROUP BY stream_id")
def target_duration(spark, sf_dir):  # A7
    segments = S.segment_table(S.at_keyframes(tags(spark, sf_dir), BY, ORDER, "ts", "is_key", DAY), BY, "ts", "size")
    return S.target_duration(segments, BY, "duration", HOUR, 24)


@query(
    f"""WITH RECURSIVE {_HLS}, g AS (SELECT stream_id, segment, max(ts) - min(ts) AS d FROM r GROUP BY ALL)
 SELECT stream_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-TARGETDURATION:' || ceil(max(d) / 3600000000.0)::BIGINT || chr(10) || '#EXT-X-MEDIA-SEQUENCE:1' || chr(10) || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10) ||
 string_agg('#EXTINF:' || (d // 3600000000) || '.' || lpad(((d % 3600000000) * 1000 // 3600000000)::VARCHAR, 3, '0') || ',' || chr(10) || 'segment_' || segment || '.ts', chr(10) ORDER BY segment) || chr(10) || '#EXT-X-ENDLIST' AS playlist FROM g GROUP BY stream_id"""
)
def segment_playlist(spark, sf_dir):  # K6
    segments = S.segment_table(S.at_keyframes(tags(spark, sf_dir), BY, ORDER, "ts", "is_key", DAY), BY, "ts", "size")
    return S.playlist(segments, BY, "duration", HOUR, F.concat(F.lit("segment_"), F.col("segment").cast("string"), F.lit(".ts")))


@query(
    f"""WITH RECURSIVE {TAGS_SQL}, r AS (SELECT stream_id, seq, rn, ts AS s, false AS ready, 1 AS segment FROM tags WHERE rn = 1
 UNION ALL SELECT t.stream_id, t.seq, t.rn, CASE WHEN cut THEN t.ts ELSE r.s END, CASE WHEN cut THEN false ELSE r.ready OR t.ts - r.s >= 86400000000 END, CASE WHEN cut THEN r.segment + 1 ELSE r.segment END
 FROM r JOIN tags t ON t.stream_id = r.stream_id AND t.rn = r.rn + 1, LATERAL (SELECT t.is_key AND (r.ready OR t.ts - r.s >= 172800000000) AS cut))
 SELECT stream_id, seq, segment FROM r"""
)
def fmp4_segments_mixed(spark, sf_dir):  # W11
    return S.mixed(tags(spark, sf_dir), BY, ORDER, "ts", "is_key", DAY, 2 * DAY).select("stream_id", "seq", "segment")


_TRACKS = f"{TAGS_SQL}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY stream_id, tag_type ORDER BY ts, seq) AS n FROM tags WHERE tag_type <> 18)"


@query(
    f"""WITH RECURSIVE {_TRACKS}, r AS (SELECT stream_id, tag_type, seq, n, NULL::BIGINT AS s, false AS ready, 1 AS segment, 1 AS next FROM k WHERE n = 1
 UNION ALL SELECT t.stream_id, t.tag_type, t.seq, t.n, CASE WHEN r.next > r.segment THEN NULL ELSE r.b END, CASE WHEN r.next > r.segment THEN false ELSE r.ready2 END, r.next,
 r.next + CASE WHEN (t.tag_type = 9 AND (t.ts - CASE WHEN r.next > r.segment THEN t.ts ELSE r.b END >= 172800000000 OR (t.is_key AND r.next = r.segment AND r.ready2))) OR (t.tag_type = 8 AND t.ts - CASE WHEN r.next > r.segment THEN t.ts ELSE r.b END >= 86400000000) THEN 1 ELSE 0 END
 FROM (SELECT r.*, coalesce(r.s, c.ts) AS b, r.ready OR c.ts - coalesce(r.s, c.ts) >= 86400000000 AS ready2 FROM r JOIN k c ON c.stream_id = r.stream_id AND c.tag_type = r.tag_type AND c.n = r.n) r
 JOIN k t ON t.stream_id = r.stream_id AND t.tag_type = r.tag_type AND t.n = r.n + 1)
 SELECT stream_id, seq, segment FROM r"""
)
def fmp4_segments_split(spark, sf_dir):  # W12
    t = tags(spark, sf_dir).where(~header()).withColumn("is_video", video())
    return S.separate(t, ["stream_id", "tag_type"], ORDER, "ts", "is_key", "is_video", DAY, 2 * DAY).select("stream_id", "seq", "segment")


@query(
    f"""WITH RECURSIVE {_TRACKS}, r AS (SELECT stream_id, tag_type, seq, n, ts AS s, 1 AS chunk, false AS closed FROM k WHERE n = 1
 UNION ALL SELECT t.stream_id, t.tag_type, t.seq, t.n, CASE WHEN r.closed THEN t.ts ELSE r.s END, CASE WHEN r.closed THEN r.chunk + 1 ELSE r.chunk END, NOT r.closed AND t.ts - r.s >= 43200000000
 FROM r JOIN k t ON t.stream_id = r.stream_id AND t.tag_type = r.tag_type AND t.n = r.n + 1)
 SELECT stream_id, seq, chunk, (ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY chunk, -tag_type, seq))::INT AS position FROM r"""
)
def chunk_interleave(spark, sf_dir):  # W13
    from pyspark.sql import Window

    c = S.chunks(tags(spark, sf_dir).where(~header()), ["stream_id", "tag_type"], ORDER, "ts", DAY // 2)
    return c.withColumn("position", F.row_number().over(Window.partitionBy("stream_id").orderBy("chunk", -F.col("tag_type"), "seq"))).select("stream_id", "seq", "chunk", "position")


_VIDEO = f"{TAGS_SQL}, v AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY ts, seq) AS n FROM tags WHERE tag_type = 9)"


@query(
    f"""WITH RECURSIVE {_VIDEO}, r AS (SELECT stream_id, seq, n, CASE WHEN is_key THEN ts END AS base, is_key AS kept, CASE WHEN is_key THEN 1 ELSE 0 END AS chosen FROM v WHERE n = 1
 UNION ALL SELECT t.stream_id, t.seq, t.n, b, keep, r.chosen + CASE WHEN keep THEN 1 ELSE 0 END
 FROM r JOIN v t ON t.stream_id = r.stream_id AND t.n = r.n + 1, LATERAL (SELECT coalesce(r.base, CASE WHEN t.is_key THEN t.ts END) AS b),
 LATERAL (SELECT b IS NOT NULL AND (t.is_key OR r.chosen = 0 OR (t.ts - b) * 1 >= r.chosen * 86400000000) AS keep))
 SELECT stream_id, seq, kept FROM r"""
)
def frame_decimate(spark, sf_dir):  # W14
    return T.decimate(tags(spark, sf_dir).where(video()), BY, ORDER, "ts", "is_key", 1, DAY).select("stream_id", "seq", "kept")


@query(
    f"""WITH RECURSIVE {_VIDEO}, r AS (SELECT stream_id, seq, n, ts AS base, true AS kept, 1 AS chosen FROM v WHERE n = 1
 UNION ALL SELECT t.stream_id, t.seq, t.n, r.base, keep, r.chosen + CASE WHEN keep THEN 1 ELSE 0 END
 FROM r JOIN v t ON t.stream_id = r.stream_id AND t.n = r.n + 1, LATERAL (SELECT (t.ts - r.base) * 1 >= r.chosen * 86400000000 AS keep))
 SELECT stream_id, seq, kept FROM r"""
)
def display_decimate(spark, sf_dir):  # W15
    return T.decimate_display(tags(spark, sf_dir).where(video()), BY, ORDER, "ts", 1, DAY).select("stream_id", "seq", "kept")


@query(f"WITH {TAGS_SQL}, g AS (SELECT stream_id, tag_type, seq, ts - lag(ts) OVER (PARTITION BY stream_id, tag_type ORDER BY ts, seq) AS gap FROM tags) SELECT stream_id, tag_type, seq, gap FROM g WHERE gap > 172800000000")
def jump_warnings(spark, sf_dir):  # W16
    return T.jumps(tags(spark, sf_dir), ["stream_id", "tag_type"], ORDER, "ts", 2 * DAY).select("stream_id", "tag_type", "seq", "gap")


@query(
    f"""WITH RECURSIVE {TAGS_SQL}, c AS (SELECT stream_id, seq, rn, ts, (rn - 1) // 6 AS chunk FROM tags),
 r AS (SELECT stream_id, seq, rn, chunk, ts, 0::BIGINT AS shift, 0::BIGINT AS gap, ts AS dts FROM c WHERE rn = 1
 UNION ALL SELECT t.stream_id, t.seq, t.rn, t.chunk, t.ts, sh, gp, greatest(t.ts - sh, r.dts + 1)
 FROM r JOIN c t ON t.stream_id = r.stream_id AND t.rn = r.rn + 1,
 LATERAL (SELECT CASE WHEN t.chunk = r.chunk THEN r.shift WHEN t.ts - (r.dts + greatest(r.gap, 1)) <= 43200000000 THEN t.ts - (r.dts + greatest(r.gap, 1)) ELSE 0 END AS sh, CASE WHEN t.chunk = r.chunk THEN t.ts - r.ts ELSE r.gap END AS gp))
 SELECT stream_id, seq, dts FROM r"""
)
def dts_correction(spark, sf_dir):  # W17
    from pyspark.sql import Window

    c = tags(spark, sf_dir).withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*BY).orderBy(*ORDER)) - 1) / 6))
    return T.corrected(c, BY, ORDER, "ts", "chunk", DAY // 2).select("stream_id", "seq", "dts")


@query(f"WITH {TAGS_SQL} SELECT stream_id, min(ts) AS base FROM tags WHERE tag_type <> 18 GROUP BY stream_id")
def common_base(spark, sf_dir):  # W18
    return T.common_base(tags(spark, sf_dir).where(~header()), BY, "tag_type", ORDER, "ts")


@query(
    ARRIVALS_SQL
    + """, c AS (SELECT stream_id, seq, rn, (ts // 1000000) % 262144 AS t FROM arr), r AS (SELECT stream_id, seq, rn, t::BIGINT AS "time", t::BIGINT AS anchor FROM c WHERE rn = 1
 UNION ALL SELECT c.stream_id, c.seq, c.rn, u, greatest(r.anchor, u) FROM r JOIN c ON c.stream_id = r.stream_id AND c.rn = r.rn + 1,
 LATERAL (SELECT c.t + sign(r.anchor - c.t)::BIGINT * ((2 * abs(r.anchor - c.t) + 262144) // 524288) * 262144 AS u))
 SELECT stream_id, seq, "time" FROM r"""
)
def unwrap_near(spark, sf_dir):  # W19, on an 18-bit clock of seconds
    t = arrivals(spark, sf_dir).withColumn("t", F.pmod(F.floor(F.col("ts") / 1000000), F.lit(1 << 18)))
    return T.unwrapped(t, BY, ARRIVAL, "t", 1 << 18).select("stream_id", "seq", "time")


@query(
    f"""WITH {TAGS_SQL}, e AS (SELECT stream_id, seq, size, sum(size) OVER (PARTITION BY stream_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS e FROM tags)
 SELECT stream_id, seq, least(size, greatest(6000 - (e - size), 0))::BIGINT AS trim_start, least(size, greatest(e - (200000 + 6000), 0))::BIGINT AS trim_end FROM e"""
)
def preskip_trim(spark, sf_dir):  # W20
    return T.trimmed(tags(spark, sf_dir), BY, ORDER, "size", 6000, F.lit(200000)).select("stream_id", "seq", "trim_start", "trim_end")


@query(f"WITH {TAGS_SQL} SELECT stream_id, seq, (ts // 1000 + (ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY ts, seq) - 1) * 1024 * 90000 // 44100)::BIGINT AS pts FROM tags WHERE tag_type = 8")
def audio_frame_pts(spark, sf_dir):  # W21
    return T.counted_pts(tags(spark, sf_dir).where(audio()), BY, ORDER, F.floor(F.col("ts") / 1000), 44100).select("stream_id", "seq", "pts")


@query(f"WITH {TAGS_SQL}, k AS (SELECT stream_id, min(ts) AS k FROM tags WHERE is_key GROUP BY stream_id) SELECT stream_id, seq FROM tags JOIN k USING (stream_id) WHERE ts >= CASE WHEN tag_type = 8 THEN k - 43200000000 ELSE k END")
def audio_start_cut(spark, sf_dir):  # W22
    return T.start_cut(tags(spark, sf_dir), BY, "ts", F.col("is_key"), audio(), DAY // 2).select("stream_id", "seq")


@query(
    f"""WITH RECURSIVE {_VIDEO}, r AS (SELECT stream_id, seq, n, CASE WHEN is_key THEN ts END AS last, false AS forced FROM v WHERE n = 1
 UNION ALL SELECT t.stream_id, t.seq, t.n, CASE WHEN t.is_key OR f THEN t.ts ELSE r.last END, f FROM r JOIN v t ON t.stream_id = r.stream_id AND t.n = r.n + 1,
 LATERAL (SELECT NOT t.is_key AND r.last IS NOT NULL AND t.ts - r.last >= 86400000000 AS f))
 SELECT stream_id, seq, forced FROM r"""
)
def forced_idr(spark, sf_dir):  # W24
    return T.forced_keys(tags(spark, sf_dir).where(video()), BY, ORDER, "ts", "is_key", DAY).select("stream_id", "seq", "forced")


@query(f"WITH {TAGS_SQL}, k AS (SELECT stream_id, ts, seq AS key_seq, size AS key_size FROM tags WHERE is_key) SELECT t.stream_id, t.seq, k.key_seq, k.key_size FROM tags t ASOF LEFT JOIN k ON t.stream_id = k.stream_id AND t.ts >= k.ts")
def asof_keyframe(spark, sf_dir):  # J1, J4
    t = tags(spark, sf_dir)
    keys = t.where("is_key").select("stream_id", "ts", F.col("seq").alias("key_seq"), F.col("size").alias("key_size"))
    return J.asof_backward(t, keys, BY, "ts", ["key_seq", "key_size"]).select("stream_id", "seq", "key_seq", "key_size")


@query("WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_linenumber >= 2) SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber, sum(l_quantity) AS l_quantity, sum(l_discount) AS l_discount, count(*) AS n FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1, 2")
def positional_join(spark, sf_dir):  # J2
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = {"a": li.where("l_linenumber <= 4").select("l_orderkey", "l_linenumber", "l_quantity"), "b": li.where("l_linenumber >= 2").select("l_orderkey", "l_linenumber", "l_discount")}
    return J.by_position(["l_orderkey"], "l_linenumber", parts).groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity"), F.sum("l_discount").alias("l_discount"), F.count("*").alias("n"))


@query(f"WITH {TAGS_SQL}, s AS (SELECT DISTINCT stream_id, rn FROM tags WHERE is_key AND stream_id % 5 <> 0) SELECT t.stream_id, t.seq, (NOT EXISTS (SELECT 1 FROM s WHERE s.stream_id = t.stream_id) OR s.rn IS NOT NULL) AS is_sync FROM tags t LEFT JOIN s ON s.stream_id = t.stream_id AND s.rn = t.rn")
def keyframe_semi(spark, sf_dir):  # J3
    from pyspark.sql import Window

    t = tags(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy(*BY).orderBy(*ORDER)))
    sync = t.where("is_key and stream_id % 5 <> 0").select("stream_id", "rn")
    return J.sync_flags(t, sync, BY, "rn", "is_sync").select("stream_id", "seq", "is_sync")


@query(f"WITH {TAGS_SQL}, h AS (SELECT *, ts // 3600000000 AS h FROM tags WHERE tag_type <> 18) SELECT stream_id, seq, (ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY h, CASE tag_type WHEN 9 THEN 0 ELSE 1 END, seq))::INT AS position FROM h")
def merge_av(spark, sf_dir):  # J5, O1, O9
    t = tags(spark, sf_dir).withColumn("h", F.floor(F.col("ts") / HOUR))
    return J.merged([(t.where(video()), 0), (t.where(audio()), 1)], BY, "h", ["seq"]).select("stream_id", "seq", "position")


@query(f"WITH {TAGS_SQL}, m AS (SELECT stream_id, count(*) AS n FROM tags WHERE is_header GROUP BY stream_id) SELECT t.stream_id, seq, coalesce(n, 0) AS n_headers FROM tags t LEFT JOIN m USING (stream_id)")
def track_lookup(spark, sf_dir):  # J6
    t = tags(spark, sf_dir)
    return t.join(t.where(header()).groupBy("stream_id").agg(F.count("*").alias("n")), "stream_id", "left").select("stream_id", "seq", F.coalesce("n", F.lit(0)).alias("n_headers"))


@query(f"WITH {TAGS_SQL} SELECT stream_id, seq, sink FROM tags, (VALUES ('archive'), ('relay')) s(sink) WHERE is_key")
def fan_out(spark, sf_dir):  # J8, K11
    return J.fan_out(tags(spark, sf_dir).where("is_key"), ["archive", "relay"]).select("stream_id", "seq", "sink")


@query("SELECT p_name, (ROW_NUMBER() OVER (ORDER BY regexp_replace(n, '\\d+$', ''), regexp_extract(n, '(\\d+)$', 1)::BIGINT, p_partkey))::INT AS position FROM (SELECT p_name, p_partkey, p_brand || '_' || p_size AS n FROM part)")
def natural_sort(spark, sf_dir):  # O5
    return naturally_sorted(spark.read.parquet(f"{sf_dir}/part.parquet"))


def naturally_sorted(part, rows=None):
    """Names of ``part`` and their positions over all its rows."""
    p = part.withColumn("n", F.concat_ws("_", "p_brand", "p_size"))
    order = [*J.naturally(p, "n")[:2], F.col("p_partkey")]
    return J.numbered(p, order, "position", rows).select("p_name", F.col("position").cast("int").alias("position"))


@query(f"WITH {TAGS_SQL}, m AS (SELECT stream_id, min(ts) AS s FROM tags GROUP BY ALL) SELECT stream_id, seq FROM tags JOIN m USING (stream_id) WHERE rn <= 10 AND ts < s + 432000000000")
def first_frames(spark, sf_dir):  # O6
    t = tags(spark, sf_dir)
    return J.within(J.first_rows(t, BY, ORDER, 10), BY, "ts", 5 * DAY).select("stream_id", "seq")


@query(f"WITH {TAGS_SQL}, d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY stream_id ORDER BY ts DESC, seq DESC) AS n FROM tags) SELECT stream_id, seq FROM d WHERE n <= 12")
def newest_tags(spark, sf_dir):  # O7
    return J.newest_rows(tags(spark, sf_dir), BY, ORDER, 12).select("stream_id", "seq")


@query(f"WITH {TAGS_SQL} SELECT stream_id, arg_min(seq, (size, seq)) AS seq, min(size) AS size FROM tags GROUP BY stream_id")
def lowest_order(spark, sf_dir):  # O8, O3
    return J.lowest(tags(spark, sf_dir), BY, ["size", "seq"]).select("stream_id", "seq", "size")


@query(
    ARRIVALS_SQL
    + """, r AS (SELECT stream_id, rn, ts AS newest, [{'t': ts, 'n': rn, 's': seq}] AS buf, list_filter([{'t': ts, 'n': rn, 's': seq}], lambda e: false) AS out FROM arr WHERE rn = 1
 UNION ALL SELECT c.stream_id, c.rn, y.nw, x.b[k + 1:], x.b[:k]
 FROM r JOIN arr c ON c.stream_id = r.stream_id AND c.rn = r.rn + 1, LATERAL (SELECT greatest(r.newest, c.ts) AS nw) y, LATERAL (SELECT list_sort(list_append(r.buf, {'t': c.ts, 'n': c.rn, 's': c.seq})) AS b) x,
 LATERAL (SELECT greatest(len(x.b) - 16, len([e FOR e IN x.b IF e.t <= y.nw - 86400000000])) AS k) z),
 o AS (SELECT stream_id, rn, 0 AS f, unnest(out) AS e, generate_subscripts(out, 1) AS i FROM r
 UNION ALL SELECT stream_id, rn, 1, unnest(buf), generate_subscripts(buf, 1) FROM r WHERE (stream_id, rn) IN (SELECT stream_id, max(rn) FROM arr GROUP BY stream_id))
 SELECT stream_id, e.s AS seq, ROW_NUMBER() OVER w AS position, max(e.t) OVER w AS ts_out FROM o WINDOW w AS (PARTITION BY stream_id ORDER BY rn, f, i)"""
)
def reorder_buffer(spark, sf_dir):  # T1, O4
    return T.reordered(arrivals(spark, sf_dir), BY, ARRIVAL, "ts", DAY, 16).select("stream_id", "seq", "position", "ts_out")


@query(f"WITH {TAGS_SQL}, s AS (SELECT stream_id, seq, seq // 40 AS n FROM tags), d AS (SELECT *, n - lag(n) OVER (PARTITION BY stream_id ORDER BY n, seq) AS d FROM s) SELECT stream_id, count_if(d = 0)::BIGINT AS repeated, sum(greatest(coalesce(d, 1) - 1, 0))::BIGINT AS missing FROM d GROUP BY stream_id")
def sequence_merge(spark, sf_dir):  # T3
    t = tags(spark, sf_dir).withColumn("n", F.floor(F.col("seq") / 40))
    return T.merged_in_sequence(t, BY, "n").groupBy("stream_id").agg(F.count_if(F.col("repeated")).alias("repeated"), F.sum("missing").alias("missing"))


@query(
    ARRIVALS_SQL
    + """, r AS (SELECT stream_id, seq, rn, ts AS o, 0::BIGINT AS off FROM arr WHERE rn = 1
 UNION ALL SELECT c.stream_id, c.seq, c.rn, CASE WHEN f >= r.o THEN f WHEN r.o - f > 43200000000 THEN r.o + 1 ELSE r.o END, CASE WHEN r.o - f > 43200000000 THEN r.o + 1 - c.ts ELSE r.off END
 FROM r JOIN arr c ON c.stream_id = r.stream_id AND c.rn = r.rn + 1, LATERAL (SELECT c.ts + r.off AS f))
 SELECT stream_id, seq, greatest(o, 0) AS ts_out FROM r"""
)
def timeline_realign(spark, sf_dir):  # T4
    return T.realigned(arrivals(spark, sf_dir), BY, ARRIVAL, "ts", DAY // 2).select("stream_id", "seq", "ts_out")


@query(
    f"""WITH RECURSIVE {TAGS_SQL}, r AS (SELECT stream_id, seq, rn, size >= 9000 AS dropped FROM tags WHERE rn = 1
 UNION ALL SELECT t.stream_id, t.seq, t.rn, CASE WHEN t.size >= 9000 THEN true WHEN t.is_key THEN false ELSE r.dropped END FROM r JOIN tags t ON t.stream_id = r.stream_id AND t.rn = r.rn + 1)
 SELECT stream_id, seq, dropped FROM r"""
)
def skip_until_key(spark, sf_dir):  # T5
    return T.shed(tags(spark, sf_dir), BY, ORDER, "size", "is_key", 9000).select("stream_id", "seq", "dropped")


@query(f"WITH {TAGS_SQL}, m AS (SELECT stream_id, max(rn) FILTER (is_key) AS k, max(rn) FILTER (is_header) AS h FROM tags GROUP BY stream_id) SELECT stream_id, seq FROM tags JOIN m USING (stream_id) WHERE CASE WHEN is_header THEN rn = h ELSE rn >= k END")
def latest_gop_cache(spark, sf_dir):  # T7
    return T.latest_group(tags(spark, sf_dir), BY, ORDER, F.col("is_key"), header()).select("stream_id", "seq")


@query(f"WITH {TAGS_SQL}, g AS (SELECT stream_id, ts, coalesce(greatest((lead(ts) OVER (PARTITION BY stream_id ORDER BY ts, seq) - ts) // 43200000000 - 1, 0), 0) AS n FROM tags) SELECT stream_id, ts + i * 43200000000 AS ts, i > 0 AS filled FROM g, LATERAL (SELECT unnest(range(0, n + 1)) AS i)")
def gap_fill(spark, sf_dir):  # T12
    return T.gaps_filled(tags(spark, sf_dir), BY, ORDER, "ts", DAY // 2)


@query(f"WITH {TAGS_SQL}, m AS (SELECT *, max(is_header::INT) OVER (PARTITION BY stream_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS h, max(is_key::INT) OVER (PARTITION BY stream_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS k, max((tag_type = 8)::INT) OVER (PARTITION BY stream_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS a FROM tags) SELECT stream_id, seq FROM m WHERE h + k + a = 3")
def init_barrier(spark, sf_dir):  # T9
    return T.init_barrier(tags(spark, sf_dir), BY, ORDER, [header(), F.col("is_key"), audio()]).select("stream_id", "seq")


@query("WITH a AS (SELECT o_orderkey, o_custkey, o_orderdate AS d, o_totalprice FROM orders), b AS (SELECT c_custkey, o_orderdate + INTERVAL 30 DAY AS d, o_orderkey AS prev_order FROM orders JOIN customer ON o_custkey = c_custkey) SELECT a.o_orderkey, max(b.prev_order) FILTER (b.d = (SELECT max(b2.d) FROM b b2 WHERE b2.c_custkey = a.o_custkey AND b2.d <= a.d)) AS prev_order FROM a LEFT JOIN b ON b.c_custkey = a.o_custkey AND b.d <= a.d GROUP BY a.o_orderkey")
def asof_settled_order(spark, sf_dir):  # J4: a customer's last order of 30 days before or earlier
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    left = o.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("d"))
    right = o.select("o_custkey", (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("d"), F.col("o_orderkey").alias("prev_order"))
    return J.asof_backward(left, right, ["o_custkey"], "d", ["prev_order"]).select("o_orderkey", "prev_order")


@query("SELECT o_orderkey, l_linenumber, l_quantity, o_totalprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 45")
def track_metadata_join(spark, sf_dir):  # J6 at table scale: filters and columns reach the scans
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 45").select("l_orderkey", "l_linenumber", "l_quantity")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity", "o_totalprice")


@query(
    f"""WITH RECURSIVE {TAGS_SQL}, r AS (SELECT stream_id, seq, rn, true AS admitted, CASE WHEN is_header THEN 4 ELSE 1 END::BIGINT AS credit FROM tags WHERE rn = 1
 UNION ALL SELECT t.stream_id, t.seq, t.rn, t.is_header OR r.credit > 0, CASE WHEN t.is_header THEN least(4, r.credit + 3) ELSE greatest(r.credit - 1, 0) END FROM r JOIN tags t ON t.stream_id = r.stream_id AND t.rn = r.rn + 1)
 SELECT stream_id, seq, admitted, credit FROM r"""
)
def credit_control(spark, sf_dir):  # T6: headers grant three, two to begin with, four at most
    t = tags(spark, sf_dir).withColumn("grant", F.when(header(), 3).otherwise(0))
    return T.credited(t, BY, ORDER, "grant", 2, 4).select("stream_id", "seq", "admitted", "credit")


@query(
    f"""WITH {TAGS_SQL}, h AS (SELECT *, sum(size) OVER (PARTITION BY stream_id ORDER BY ts, seq)::BIGINT AS head, 5 * (seq % 9) * 1000 AS behind FROM tags)
 SELECT stream_id, seq, head, greatest(head - 20000, 0) AS tail, greatest(head - behind, head - 20000, 0) AS position, greatest(head - behind, 0) < greatest(head - 20000, 0) AS lapped FROM h"""
)
def ring_buffer(spark, sf_dir):  # T8
    t = tags(spark, sf_dir).withColumn("behind", 5000 * (F.col("seq") % 9))
    return T.ring(t, BY, ORDER, "size", "behind", 20000).select("stream_id", "seq", "head", "tail", "position", "lapped")


@query(
    f"""WITH {TAGS_SQL}, g AS (SELECT *, ts - lag(ts) OVER w > 86400000000 AS pause, ts - first(ts) OVER w AS gone FROM tags WINDOW w AS (PARTITION BY stream_id ORDER BY ts, seq))
 SELECT stream_id, seq FROM g ANTI JOIN (SELECT stream_id, min(rn) AS stop FROM g WHERE pause GROUP BY stream_id) p ON p.stream_id = g.stream_id AND g.rn >= p.stop WHERE gone < 864000000000"""
)
def idle_end(spark, sf_dir):  # T14, T15
    return T.until(tags(spark, sf_dir), BY, ORDER, "ts", 10 * DAY, DAY).select("stream_id", "seq")


@query(
    f"""WITH {TAGS_SQL}, g AS (SELECT stream_id, seq, ts, (coalesce(ts - lag(ts) OVER (PARTITION BY stream_id ORDER BY ts, seq), 0) // 2)::BIGINT AS wait FROM tags)
 SELECT stream_id, seq, sum(CASE WHEN wait > 0 AND wait < 36000000000 THEN wait ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY ts, seq)::BIGINT AS due FROM g"""
)
def paced_replay(spark, sf_dir):  # T16
    return T.paced(tags(spark, sf_dir), BY, ORDER, "ts", 2, 10 * HOUR).select("stream_id", "seq", "due")


@query(
    """WITH r AS (SELECT o_custkey, epoch_us(o_orderdate) AS t, o_orderkey FROM orders), p AS (SELECT o_custkey, t - 86400000000 AS t, o_orderkey AS answer FROM r)
 SELECT r.o_orderkey, arg_min(p.answer, (p.t, -p.answer)) AS answer FROM r LEFT JOIN p ON p.o_custkey = r.o_custkey AND p.t >= r.t GROUP BY r.o_orderkey"""
)
def correlated_answers(spark, sf_dir):  # J9: a customer's next order of another day answers one
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)")
    asked = o.select("o_custkey", at.alias("at"), "o_orderkey")
    answers = o.select("o_custkey", (at - DAY).alias("at"), F.col("o_orderkey").alias("answer"))
    return J.correlated(asked, answers, ["o_custkey"], "at", ["answer"]).select("o_orderkey", "answer")


@query(
    """WITH l AS (SELECT l_orderkey, l_partkey AS poc, l_quantity >= 45 AS idr, l_quantity::INT % 3 <> 0 AS ref, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem),
 e AS (SELECT *, sum(idr::INT) OVER (PARTITION BY l_orderkey ORDER BY rn) AS epoch FROM l),
 x AS (SELECT a.l_orderkey, a.rn, a.poc, b.poc AS p, ROW_NUMBER() OVER (PARTITION BY a.l_orderkey, a.rn ORDER BY b.rn DESC) AS k FROM e a JOIN e b ON a.l_orderkey = b.l_orderkey AND a.epoch = b.epoch AND b.rn < a.rn AND b.ref),
 y AS (SELECT l_orderkey, rn, string_agg(p, ',' ORDER BY p > poc, abs(p - poc)) AS list0, string_agg(p, ',' ORDER BY p < poc, abs(p - poc)) AS list1 FROM x WHERE k <= 3 AND p <> poc GROUP BY ALL)
 SELECT l_orderkey, rn::INT AS frame, coalesce(list0, '') AS list0, coalesce(list1, '') AS list1 FROM l LEFT JOIN y USING (l_orderkey, rn)"""
)
def reference_lists(spark, sf_dir):  # J10
    from pyspark.sql import Window

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    frames = li.select("l_orderkey", F.col("l_partkey").alias("poc"), (F.col("l_quantity") >= 45).alias("idr"), (F.col("l_quantity").cast("int") % 3 != 0).alias("ref"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("frame"))
    out = T.reference_lists(frames, ["l_orderkey"], ["frame"], "poc", "idr", "ref", 3)
    return out.select("l_orderkey", "frame", *[F.array_join(c, ",").alias(c) for c in ("list0", "list1")])


@query(f"""WITH {TAGS_SQL} SELECT stream_id, '{{"tags":' || count(*) || ',"bytes":' || sum(size)::BIGINT || ',"duration":' || (max(ts) - min(ts)) || ',"keyframes":' || count_if(is_key) || '}}' AS meta FROM tags GROUP BY stream_id""")
def meta_json(spark, sf_dir):  # K15
    return A.meta_json(tags(spark, sf_dir), BY, "ts", "size", F.col("is_key"))


def _day(ts: str = "ts"):
    return F.floor(F.col(ts) / DAY)


@query(SQL["gop_id"])
def gop_id_by_day(spark, sf_dir):  # W9 of streams too long for one task
    return T.groups_of_pictures(tags(spark, sf_dir), BY, ORDER, F.col("is_key"), part=_day()).select("stream_id", "seq", "gop")


@query(SQL["dts_prefix"])
def dts_prefix_by_day(spark, sf_dir):  # W6, W7 of streams too long for one task
    return T.decode_times(tags(spark, sf_dir), BY, ORDER, "size", F.lit(12800), part=_day()).select("stream_id", "seq", "dts_ms")


@query(SQL["clamp_cummax"])
def clamp_cummax_by_day(spark, sf_dir):  # W4 of streams too long for one task
    return T.clamp(arrivals(spark, sf_dir), BY, ARRIVAL, "ts", part=_day("arrival")).select("stream_id", "seq", "ts_out")


@query(SQL["clamp_strict"])
def clamp_strict_by_day(spark, sf_dir):  # W3 of streams too long for one task
    t = arrivals(spark, sf_dir).withColumn("h", F.floor(F.col("ts") / HOUR))
    return T.clamp_strict(t, BY, ARRIVAL, "h", part=_day("arrival")).select("stream_id", "seq", "ts_out")
