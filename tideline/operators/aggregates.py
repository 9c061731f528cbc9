"""Aggregates over streams (inventory A)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.scan import ordered_scan


def stream_stats(df: DataFrame, by: Sequence[str], ts: str, video: Column, key: Column, unit: int) -> DataFrame:
    """A1-A3: source fps ((n - 1) / span of the video rows; null without a
    span), keyframes, and the largest time in units."""
    t = F.when(video, F.col(ts))
    span = F.max(t) - F.min(t)
    fps = F.when((F.count(t) >= 2) & (span > 0), (F.count(t) - 1) * F.lit(float(unit)) / span)
    return df.groupBy(*by).agg(fps.alias("fps"), F.count_if(key).alias("gop_count"), (F.max(ts) / F.lit(float(unit))).alias("real_duration"))


def snapped_fps(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, unit: int, declared: float | None, near: float = 0.1, most: float = 120.0) -> DataFrame:
    """A4: rate from the mean positive interval: the declared one if within
    ``near`` of it, else rounded; at most ``most``, null without intervals."""
    gap = F.col(ts) - F.lag(ts).over(Window.partitionBy(*by).orderBy(*order))
    rates = df.withColumn("__gap", gap).where(F.col("__gap") > 0).groupBy(*by).agg((F.lit(float(unit)) * F.count("*") / F.sum("__gap")).alias("measured"))
    rounded = F.floor(F.col("measured") + 0.5).cast("double")
    snapped = rounded if declared is None else F.when(F.abs(F.col("measured") - declared) < near * declared, F.lit(float(declared))).otherwise(rounded)
    valid = F.when(snapped > 0, F.least(snapped, F.lit(most)))
    return rates.select(*by, valid.alias("fps"))


def track_durations(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, fallback: int) -> DataFrame:
    """A5: last time less first plus the last gap; ``fallback`` for one row."""
    w = Window.partitionBy(*by).orderBy(*order)
    gap = df.withColumn("__gap", F.col(ts) - F.lag(ts).over(w))
    at = F.struct(*order)
    last = F.max_by("__gap", at)
    return gap.groupBy(*by).agg(F.when(F.count("*") == 1, F.lit(fallback)).otherwise(F.max_by(ts, at) - F.min_by(ts, at) + last).alias("duration"))


def counters(df: DataFrame, by: Sequence[str], size: str, audio: Column, video: Column, dropped: Column) -> DataFrame:
    """Rows, bytes, audio, video and dropped rows."""
    return df.groupBy(*by).agg(F.count("*").alias("tags"), F.sum(size).alias("bytes"), F.count_if(audio).alias("audio"), F.count_if(video).alias("video"), F.count_if(dropped).alias("dropped"))


def distinct_in_order(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Each distinct value once, numbered by its first appearance."""
    first = df.groupBy(*by, value).agg(F.min(F.struct(*order)).alias("__at"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("__at"))).drop("__at")


def bitrates(df: DataFrame, by: Sequence[str], bucket: Column, size: str, unit_s: float) -> DataFrame:
    """A10: mean and largest bits a second over the buckets that hold rows."""
    per = df.groupBy(*by, bucket.alias("__b")).agg((F.sum(size) * 8 / F.lit(unit_s)).alias("__rate"))
    return per.groupBy(*by).agg((F.sum("__rate") / F.count("*")).alias("avg_rate"), F.max("__rate").alias("max_rate"))


def moving_average(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, alpha: float = 0.5, to: str = "ema") -> DataFrame:
    """Exponential moving average; the first value starts it."""

    def make():
        now = None

        def step(x):
            nonlocal now
            now = x if now is None else alpha * x + (1 - alpha) * now
            return (now,)

        return step

    return ordered_scan(df, by, order, [value], f"{to} double", make)


def psnr(df: DataFrame, by: Sequence[str], a: Column, b: Column) -> DataFrame:
    """Sum of absolute and of squared differences, mean squared error
    and PSNR against 255; no difference gives infinity."""
    d = (a - b).cast("long")
    out = df.groupBy(*by).agg(F.sum(F.abs(d)).alias("sad"), F.sum(d * d).alias("sse"), F.count("*").alias("n"))
    mse = F.col("sse") / F.col("n")
    return out.select(*by, "sad", "sse", mse.alias("mse"), F.when(F.col("sse") == 0, F.lit(float("inf"))).otherwise(-10 * F.log10(mse / 65025.0)).alias("psnr"))


def keyframe_index(df: DataFrame, by: Sequence[str], ts: str, position: str, key: Column) -> DataFrame:
    """Times and file positions of the keyframes, in order."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(position).alias("pos"))))
    return df.where(key).groupBy(*by).agg(pairs.alias("index"))


def meta_json(df: DataFrame, by: Sequence[str], ts: str, size: str, key: Column) -> DataFrame:
    """What a player is told of each stream, as JSON text."""
    facts = F.struct(F.count("*").alias("tags"), F.sum(size).alias("bytes"), (F.max(ts) - F.min(ts)).alias("duration"), F.count_if(key).alias("keyframes"))
    return df.groupBy(*by).agg(F.to_json(facts).alias("meta"))
