"""Queries that send table rows through a container and back: what comes out of
the reader must be what SQL sees in the table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.sources import flv, mp4, ts
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


def _bodies(spark, sf_dir):
    """Tags with bodies: a video body has frame and codec flags, others are the event id."""
    t = tags(spark, sf_dir)
    number = F.to_binary(F.lpad(F.hex("seq"), 8, "0"), F.lit("hex"))
    head = F.when(F.col("is_key"), F.lit(b"\x17\x01\x00\x00\x00")).when(F.col("tag_type") == 9, F.lit(b"\x27\x01\xff\xff\xfe")).when(F.col("tag_type") == 8, F.lit(b"\xaf\x01")).otherwise(F.lit(b"\x02\x00"))
    return t.select(F.col("stream_id"), "seq", F.floor(F.col("ts") / 1000).alias("ts_ms"), "tag_type", F.concat(head, number).alias("body"))


@query(
    f"""WITH {TAGS_SQL} SELECT stream_id, tag_type, ((ts // 1000) % 4294967296)::BIGINT AS ts_ms, is_key, tag_type <> 18 AS is_media, CASE tag_type WHEN 9 THEN CASE WHEN is_key THEN 0 ELSE -2 END END::BIGINT AS cts, seq::BIGINT AS number FROM tags"""
)
def tag_round_trip(spark, sf_dir):  # K1, S1, S2, P2-P7
    parts = flv.files_of(_bodies(spark, sf_dir), "stream_id", ("ts_ms", "seq"))
    named = parts.select(F.col("stream_id").cast("string").alias("path"), "part", "content")
    out = flv.with_packets(flv.scanned_parts(named))
    at = F.when(F.col("tag_type") == 9, 6).otherwise(3)
    number = F.conv(F.hex(F.substring("body", at, F.lit(4))), 16, 10).cast("bigint")
    return out.select(F.col("stream_id").cast("bigint").alias("stream_id"), "tag_type", "ts_ms", "is_key", "is_media", "cts", number.alias("number"))


@query(f"WITH {TAGS_SQL} SELECT stream_id, true AS has_audio, true AS has_video, count(*)::BIGINT AS tags, sum(CASE tag_type WHEN 9 THEN 9 ELSE 6 END)::BIGINT AS bytes FROM tags GROUP BY stream_id")
def tag_probe(spark, sf_dir):  # S2, S4: header-only scan
    parts = flv.files_of(_bodies(spark, sf_dir), "stream_id", ("ts_ms", "seq")).select(F.col("stream_id").cast("string").alias("path"), "part", "content")
    flags = flv.probed(parts.where("part = 0")).select(F.col("path").alias("stream_id"), "has_audio", "has_video")
    sizes = flv.scanned_parts(parts, payload=False).groupBy("stream_id").agg(F.count("*").alias("tags"), F.sum("data_size").cast("bigint").alias("bytes"))
    return flags.join(sizes, "stream_id").select(F.col("stream_id").cast("bigint").alias("stream_id"), "has_audio", "has_video", "tags", "bytes")


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS size, (l_suppkey % 7 + 1)::BIGINT AS delta, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem),
 d AS (SELECT l_orderkey, l_linenumber, any_value(size) AS size, any_value(delta) AS delta FROM l GROUP BY ALL),
 s AS (SELECT *, ROW_NUMBER() OVER w AS sample_no, (ROW_NUMBER() OVER w - 1) // 2 AS c, coalesce(sum(delta) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ticks FROM d WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
 SELECT l_orderkey, sample_no::INT AS sample_no, (c + 1)::INT AS chunk, (1000 * (c + 1) + coalesce(sum(size) OVER (PARTITION BY l_orderkey, c ORDER BY sample_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", size,
 ((2 * ticks * 1000 + 90) // 180)::BIGINT AS dts_ms, l_orderkey % 8 <> 0 OR sample_no % 3 = 1 AS is_key FROM s"""
)
def sample_table(spark, sf_dir):  # S9, J1-J3, W6, W7: chunks of two samples, the last may hold one
    return samples_of(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def samples_of(li):
    """Samples of the tables that any rows of lineitem make, by order.  Of rows
    with the same numbers the first in the table counts, wherever it is read."""
    at = F.struct("_metadata.file_path", "_metadata.row_index")
    first = lambda value: F.min_by(value, F.when(value.isNotNull(), at))
    d = li.groupBy("l_orderkey", "l_linenumber").agg(first(F.col("l_quantity").cast("bigint")).alias("size"), first((F.col("l_suppkey") % 7 + 1).cast("int")).alias("delta"))
    n = F.size("rows")
    order = F.sort_array(F.collect_list(F.struct("l_linenumber", "size", "delta")))
    t = d.groupBy("l_orderkey").agg(order.alias("rows"))
    chunks = F.ceil(n / 2).cast("int")
    entry = lambda first, spc: F.struct(first.cast("int").alias("first_chunk"), spc.cast("int").alias("spc"))
    stsc = F.when(n % 2 == 0, F.array(entry(F.lit(1), F.lit(2)))).when(n == 1, F.array(entry(F.lit(1), F.lit(1)))).otherwise(F.array(entry(F.lit(1), F.lit(2)), entry(chunks, F.lit(1))))
    tables = t.select(
        "l_orderkey",
        F.lit(90).alias("timescale"),
        F.transform("rows", lambda r: r["size"]).alias("sample_sizes"),
        stsc.alias("stsc"),
        F.transform(F.sequence(F.lit(1), chunks), lambda c: (c * 1000).cast("bigint")).alias("chunk_offsets"),
        F.transform("rows", lambda r: F.struct(F.lit(1).alias("count"), r["delta"].alias("delta"))).alias("stts"),
        F.array().cast("array<struct<count:int,offset:int>>").alias("ctts"),
        F.when(F.col("l_orderkey") % 8 == 0, F.filter(F.sequence(F.lit(1), n), lambda i: i % 3 == 1)).alias("stss"),
    )
    return mp4.samples(tables, ["l_orderkey"]).select("l_orderkey", "sample_no", "chunk", "offset", "size", "dts_ms", "is_key")


@query(f"WITH {TAGS_SQL} SELECT stream_id, (ts // 1000 * 90 % 8589934592)::BIGINT AS pts, seq FROM tags WHERE tag_type = 8")
def transport_round_trip(spark, sf_dir):  # K5, S12, T10
    import pyarrow as pa

    rows = tags(spark, sf_dir).where("tag_type = 8").select("stream_id", "seq", "ts").repartition("stream_id").sortWithinPartitions("stream_id", "ts", "seq")
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def write(batches):
        key, data, w = None, b"", None
        for batch in batches:
            for own, seq, t in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != key:
                    if key is not None:
                        yield pa.RecordBatch.from_pydict({"path": [str(key)], "content": [data]}, schema=schema)
                    key, w = own, ts.Writer(has_video=False)
                    data = w.tables()
                data += w.media(w.AUDIO, str(seq).encode() * 40, t // 1000 * 90)
        if key is not None:
            yield pa.RecordBatch.from_pydict({"path": [str(key)], "content": [data]}, schema=schema)

    files = rows.mapInArrow(write, "path string, content binary")
    out = ts.elementary(ts.scanned(files))
    text = F.decode("data", "utf-8")
    return out.select(F.col("file").cast("bigint").alias("stream_id"), "pts", F.substring(text, F.lit(1), (F.length(text) / 40).cast("int")).cast("bigint").alias("seq"))
