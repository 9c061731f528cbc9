"""Join-shaped computations (inventory J) and sorts and limits (inventory O)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, values: Sequence[str], strict: bool = False) -> DataFrame:
    """Each left row with ``values`` of the last right row of its key
    at or before it (``strict``: before it), null if there is none.

    Both sides are stacked and the last right value is carried forward by one
    window: one shuffle and one sort, however long the look-back.  Right rows
    that tie on ``at`` are ordered by their values.
    """
    side = 1 if not strict else -1
    names = left.columns
    held = F.struct(*[F.col(v) for v in values])
    l_rows = left.select(*[F.col(k) for k in by], F.col(at).alias("__at"), F.lit(side).alias("__side"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("__held"))
    r_rows = right.select(*[F.col(k) for k in by], F.col(at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(l_rows.schema["__row"].dataType).alias("__row"), held.alias("__held"))
    w = Window.partitionBy(*by).orderBy("__at", "__side", "__held").rowsBetween(Window.unboundedPreceding, 0)
    carried = l_rows.unionByName(r_rows).withColumn("__held", F.last("__held", ignorenulls=True).over(w)).where(F.col("__row").isNotNull())
    return carried.select("__row.*", *[F.col(f"__held.{v}").alias(v) for v in values])


def by_position(by: Sequence[str], number: str, parts: dict[str, DataFrame]) -> DataFrame:
    """Columns of several tables joined by key and sample number."""
    out = None
    for table in parts.values():
        out = table if out is None else out.join(table, [*by, number], "full")
    return out


def sync_flags(samples: DataFrame, sync: DataFrame, by: Sequence[str], number: str, to: str = "is_key") -> DataFrame:
    """Whether a sample is listed; a key without any list has all listed."""
    listed = sync.select(*by, number).distinct().withColumn("__in", F.lit(True))
    some = sync.select(*by).distinct().withColumn("__some", F.lit(True))
    return samples.join(listed, [*by, number], "left").join(some, list(by), "left").withColumn(to, F.col("__some").isNull() | F.col("__in").isNotNull()).drop("__in", "__some")


def merged(tracks: Sequence[tuple[DataFrame, int]], by: Sequence[str], ts: str, order: Sequence[str], to: str = "position") -> DataFrame:
    """Tracks stacked and numbered by time; ties by the track's
    priority, then ``order``."""
    rows = None
    for table, priority in tracks:
        table = table.withColumn("__p", F.lit(priority))
        rows = table if rows is None else rows.unionByName(table)
    return rows.withColumn(to, F.row_number().over(Window.partitionBy(*by).orderBy(ts, "__p", *order))).drop("__p")


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def within(df: DataFrame, by: Sequence[str], ts: str, length: int) -> DataFrame:
    """Rows before the key's first time plus ``length``."""
    start = df.groupBy(*by).agg(F.min(ts).alias("__start"))
    return df.join(start, list(by)).where(F.col(ts) < F.col("__start") + length).drop("__start")


def newest_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The newest ``n`` rows of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))).where(F.col("__n") <= n).drop("__n")


def lowest(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key (lowest picture order first)."""
    row = F.min_by(F.struct(*[F.col(c) for c in df.columns if c not in by]), F.struct(*order))
    return df.groupBy(*by).agg(row.alias("__r")).select(*by, "__r.*")


def naturally(df: DataFrame, name: str, to: str = "position") -> Column:
    """Sort columns of names by their prefix, then their last number."""
    number = F.regexp_extract(F.col(name), r"(\d+)(?!.*\d)", 1)
    return [F.regexp_replace(F.col(name), r"\d+(?!.*\d)", ""), F.when(number == "", F.lit(-1)).otherwise(number.cast("bigint")), F.col(name)]


#: Rows of one range of ``numbered``, about, and sampled keys for each range.
RANGE_ROWS, RANGE_KEYS = 250_000, 32


def numbered(df: DataFrame, order: Sequence[Column], to: str = "position", rows: int | None = None) -> DataFrame:
    """Rows numbered from 1 over the whole table.  Sampled keys cut it into
    ranges; rows are numbered in their range, and a range starts where the
    counts of those before it end.  Keys that are all equal share a range."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    df = df.withColumn("__key", key)
    n = -(-df.count() // (rows or RANGE_ROWS))
    bounds = df.select("__key", F.xxhash64("__key").alias("__h")).orderBy("__h").limit(RANGE_KEYS * n).select("__key").orderBy("__key").collect() if n > 1 else []
    ends = [bounds[len(bounds) * i // n]["__key"] for i in range(1, n)] if bounds else []
    kind = df.schema["__key"].dataType
    table = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(e, kind.fields, strict=True)]) for e in ends]) if ends else None
    df = df.withColumn("__range", F.size(F.filter(table, lambda e: e < F.col("__key"))) if ends else F.lit(0))
    counts = {r["__range"]: r["n"] for r in df.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    starts = F.array(*[F.lit(sum(x for k, x in counts.items() if k < i)).cast("bigint") for i in range(n or 1)])
    own = F.row_number().over(Window.partitionBy("__range").orderBy("__key"))
    return df.withColumn(to, F.get(starts, F.col("__range")) + own).drop("__key", "__range")


def fan_out(df: DataFrame, sinks: Sequence[str]) -> DataFrame:
    """Every row once per sink name."""
    return df.withColumn("sink", F.explode(F.array(*[F.lit(s) for s in sinks])))


def correlated(requests: DataFrame, responses: DataFrame, by: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Each request with ``values`` of the first response of its id at or
    after it, null if none came: the as-of join with time turned round."""
    turned = lambda df: df.withColumn("__turned", -F.col(at))
    return asof_backward(turned(requests), turned(responses).drop(at), by, "__turned", values).drop("__turned")
