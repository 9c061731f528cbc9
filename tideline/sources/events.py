"""The ``events`` table read as a tag stream (our convention).

stream_id = user_id, order (ts, seq); purchase is a video keyframe, view and
click are video deltas, error is audio, signup a sequence header; size is
floor(100 * value) bytes.  Times are microseconds, which needs no rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIO, VIDEO, SCRIPT = 8, 9, 18
DAY, HOUR, MINUTE = 86_400_000_000, 3_600_000_000, 60_000_000


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("stream_id"),
        F.col("event_id").alias("seq"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ts"),
        F.when(kind == "error", AUDIO).when(kind == "signup", SCRIPT).otherwise(VIDEO).alias("tag_type"),
        (kind == "purchase").alias("is_key"),
        (kind == "signup").alias("is_header"),
        F.floor(F.col("value") * 100).cast("long").alias("size"),
    )


#: The same view for DuckDB, with the row number of each tag in its stream.
TAGS_SQL = """tags AS (SELECT user_id AS stream_id, event_id AS seq, epoch_us(ts) AS ts,
 CASE event_type WHEN 'error' THEN 8 WHEN 'signup' THEN 18 ELSE 9 END AS tag_type,
 event_type = 'purchase' AS is_key, event_type = 'signup' AS is_header,
 CAST(floor(value * 100) AS BIGINT) AS size,
 ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"""
