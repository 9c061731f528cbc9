"""Timeline operators on ordered, keyed rows (inventory W, T).

Each takes a DataFrame and column names; ``by`` are the keys of a stream and
``order`` its total order.  What a window frame can express is a window; the
recursive rules are ordered scans.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.scan import ordered_scan

U32, U33 = 1 << 32, 1 << 33


def _w(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def _running(by: Sequence[str], order: Sequence[str]):
    return _w(by, order).rowsBetween(Window.unboundedPreceding, 0)


def _prefix(df: DataFrame, by: Sequence[str], order: Sequence[str], join: Callable, value: Column, to: str, part: Column | None, before: bool = False) -> DataFrame:
    """``df`` with running sums or maxima (``join``: F.sum, F.max) of ``value`` as
    ``to``; with ``before``, of the rows before each.

    ``part`` grows with ``order`` (a day of the time, say) and cuts streams too
    long for one task: parts run on their own, and what the parts before a part
    come to is a window over one row for each part."""
    upto = -1 if before else 0
    if part is None:
        return df.withColumn(to, join(value).over(_w(by, order).rowsBetween(Window.unboundedPreceding, upto)))
    wide = df.withColumn("__part", part).withColumn("__value", value)
    keys = [f"__k{i}" for i in range(len(by))]
    totals = wide.groupBy(*[F.col(k).alias(n) for k, n in zip(by, keys, strict=True)], F.col("__part").alias("__p")).agg(join("__value").alias("__total"))
    so_far = totals.withColumn("__before", join("__total").over(Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).drop("__total")
    same = F.col("__part").eqNullSafe(F.col("__p"))
    for k, n in zip(by, keys, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    own = join("__value").over(_w([*by, "__part"], order).rowsBetween(Window.unboundedPreceding, upto))
    out = wide.withColumn("__own", own).join(so_far, same)
    both = F.greatest("__before", "__own") if join is F.max else F.when(F.col("__before").isNull() & F.col("__own").isNull(), None).otherwise(F.coalesce("__before", F.lit(0)) + F.coalesce("__own", F.lit(0)))
    return out.withColumn(to, both).drop("__part", "__value", "__own", "__before", "__p", *keys)


def rebase(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, header: Column, to: str = "ts_out") -> DataFrame:
    """Time since the first media row of the stream; headers are 0, and
    nothing is below 0."""
    first = F.first(F.when(~header, F.col(ts)), ignorenulls=True).over(_running(by, order))
    return df.withColumn(to, F.when(header, F.lit(0)).otherwise(F.greatest(F.col(ts) - first, F.lit(0))).cast("long"))


def rebase_wrapped(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, to: str = "ts_out", modulus: int = U32) -> DataFrame:
    """As W1 for times modulo ``modulus``: a step back of more than half of
    it is a wrap."""
    first = F.first(ts).over(_running(by, order))
    gone = F.col(ts) - first
    return df.withColumn(to, F.when(gone < -(modulus // 2), gone + modulus).otherwise(F.greatest(gone, F.lit(0))))


def clamp_strict(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, to: str = "ts_out", part: Column | None = None) -> DataFrame:
    """t' = max(t, t'_before + 1), as max(t - n) so far + n."""
    lifted = _prefix(df, by, order, F.sum, F.lit(1), "__n", part)
    return _prefix(lifted, by, order, F.max, F.col(ts) - F.col("__n"), "__d", part).withColumn(to, F.col("__d") + F.col("__n")).drop("__n", "__d")


def clamp(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, to: str = "ts_out", part: Column | None = None) -> DataFrame:
    """Cumulative maximum."""
    return _prefix(df, by, order, F.max, F.col(ts), to, part)


def durations(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, fallback: int, to: str = "duration", floor: int | None = 0) -> DataFrame:
    """Time to the next row; the last repeats the one before, a single row
    has ``fallback``; negative ones become ``floor`` (None: stay)."""
    w = _w(by, order)
    gap = F.lead(ts).over(w) - F.col(ts)
    last = F.col(ts) - F.lag(ts).over(w)
    d = F.coalesce(gap, last, F.lit(fallback))
    return df.withColumn(to, d if floor is None else F.when(d < 0, F.lit(floor)).otherwise(d))


def byte_offsets(df: DataFrame, by: Sequence[str], order: Sequence[str], size: str, base: Column, to: str = "offset", part: Column | None = None) -> DataFrame:
    """Base plus the sizes before the row in its chunk."""
    return _prefix(df, by, order, F.sum, F.col(size), "__before_row", part, before=True).withColumn(to, base + F.coalesce("__before_row", F.lit(0))).drop("__before_row")


def decode_times(df: DataFrame, by: Sequence[str], order: Sequence[str], delta: str, timescale: Column, to: str = "dts_ms", part: Column | None = None) -> DataFrame:
    """Prefix sum of deltas in ticks, rounded to ms after summing."""
    summed = _prefix(df, by, order, F.sum, F.col(delta), "__ticks", part, before=True)
    ticks = F.coalesce("__ticks", F.lit(0))
    return summed.withColumn(to, F.floor((2 * ticks * 1000 + timescale) / (2 * timescale)).cast("long")).drop("__ticks")


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Run-length encoding (by, run, value, count), runs from 1."""
    w = _w(by, order)
    marked = df.withColumn("__new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    numbered = marked.withColumn("run", F.sum("__new").over(_running(by, order)))
    return numbered.groupBy(*by, "run").agg(F.first(value).alias(value), F.count("*").alias("count"))


def groups_of_pictures(df: DataFrame, by: Sequence[str], order: Sequence[str], key: Column, to: str = "gop", part: Column | None = None) -> DataFrame:
    """Running count of keyframes; 0 before the first."""
    return _prefix(df, by, order, F.sum, F.when(key, 1).otherwise(0), to, part)


def decimate(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, key: str, fps: int, unit: int = 1000, spare_first: bool = True) -> DataFrame:
    """``kept`` marks the frames of a reduced rate.  Keys stay; frames
    before the first key go; another frame goes if it comes before the time of
    the next selected one.  ``spare_first``: only once a frame was selected."""

    def make():
        base, chosen = None, 0

        def step(t, is_key):
            nonlocal base, chosen
            if base is None:
                if not is_key:
                    return (False,)
                base = t
            keep = is_key or (spare_first and not chosen) or (t - base) * fps >= chosen * unit
            chosen += keep
            return (bool(keep),)

        return step

    return ordered_scan(df, by, order, [ts, key], "kept boolean", make)


def decimate_display(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, fps: int, unit: int = 1000) -> DataFrame:
    """As W14 in display order (by time first), without regard to keys.

    Frame i is selected if its slot q(i) has reached the count of those before
    it.  Slots never fall, so the count is c(i) = min(c(i-1) + 1, q(i) + 1), that
    is i + min(0, smallest q(j) + 1 - j so far): a running minimum."""
    if order[0] != ts:
        raise ValueError("display order goes by time first")
    w, running = _w(by, order), _running(by, order)
    slots = df.withColumn("__gone", (F.col(ts) - F.first(ts).over(running)) * fps).withColumn("__n", F.row_number().over(w))
    counted = slots.withColumn("__d", F.expr(f"(__gone div {unit}) + 1 - __n")).withColumn("__c", F.col("__n") + F.least(F.lit(0), F.min("__d").over(running)))
    return counted.withColumn("kept", F.col("__c") > F.coalesce(F.lag("__c").over(w), F.lit(0))).drop("__gone", "__n", "__d", "__c")


def jumps(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, limit: int) -> DataFrame:
    """Rows whose time is more than ``limit`` after the one before."""
    return df.withColumn("gap", F.col(ts) - F.lag(ts).over(_w(by, order))).where(F.col("gap") > limit)


def corrected(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, chunk: str, tolerance: int = 3) -> DataFrame:
    """Decode times continued across chunks.  The first row of a chunk is
    compared with where the chunk before ended (its last row plus its last
    gap): within ``tolerance``, or earlier, it continues there, else it keeps
    its own time; the chunk's other rows shift alike and stay increasing."""

    def make():
        now, shift, expected, last, gap, before = None, 0, None, None, 0, None

        def step(t, c):
            nonlocal now, shift, expected, last, gap, before
            if c != now:
                now = c
                shift = t - expected if expected is not None and t - expected <= tolerance else 0
            elif before is not None:
                gap = t - before
            out = t - shift
            if last is not None and out <= last:
                out = last + 1
            last, before, expected = out, t, out + max(gap, 1)
            return (out,)

        return step

    return ordered_scan(df, by, order, [ts, chunk], "dts bigint", make)


def common_base(df: DataFrame, by: Sequence[str], track: str, order: Sequence[str], ts: str) -> DataFrame:
    """Smallest of the tracks' first times, one row per stream."""
    first = df.groupBy(*by, track).agg(F.min_by(ts, F.struct(*order)).alias("first"))
    return first.groupBy(*by).agg(F.min("first").alias("base"))


def unwrapped(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, modulus: int = U33, to: str = "time") -> DataFrame:
    """Times modulo ``modulus`` placed nearest to the newest so far."""

    def make():
        anchor = None

        def step(t):
            nonlocal anchor
            if anchor is None:
                anchor = t
                return (t,)
            d = anchor - t  # rounded half away from zero
            turns = (2 * abs(d) + modulus) // (2 * modulus)
            t += (turns if d >= 0 else -turns) * modulus
            anchor = max(anchor, t)
            return (t,)

        return step

    return ordered_scan(df, by, order, [ts], f"{to} bigint", make)


def trimmed(df: DataFrame, by: Sequence[str], order: Sequence[str], samples: str, skip: int, total: Column) -> DataFrame:
    """trim_start and trim_end of each packet so that the first ``skip``
    samples go and ``total`` samples (null: all) remain after them."""
    end = F.sum(samples).over(_running(by, order))
    start = end - F.col(samples)
    cut = F.least(F.col(samples), F.greatest(F.lit(skip) - start, F.lit(0)))
    tail = F.coalesce(F.least(F.col(samples), F.greatest(end - (total + skip), F.lit(0))), F.lit(0))
    return df.withColumn("trim_start", cut.cast("long")).withColumn("trim_end", tail.cast("long"))


def counted_pts(df: DataFrame, by: Sequence[str], order: Sequence[str], base: Column, rate: int, frame: int = 1024, clock: int = 90_000, to: str = "pts") -> DataFrame:
    """Base plus whole ticks of the frames before in the segment."""
    ticks = (F.row_number().over(_w(by, order)) - 1).cast("long") * (frame * clock)
    return df.withColumn(to, base + ((ticks - ticks % rate) / rate).cast("long"))


def start_cut(df: DataFrame, by: Sequence[str], ts: str, key: Column, audio: Column, before: int) -> DataFrame:
    """Rows from the stream's first keyframe on, audio from ``before``
    earlier; streams without a keyframe give nothing."""
    first = df.where(key).groupBy(*by).agg(F.min(ts).alias("__key"))
    return df.join(first, list(by)).where(F.when(audio, F.col(ts) >= F.col("__key") - before).otherwise(F.col(ts) >= F.col("__key"))).drop("__key")


def forced_keys(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, key: str, period: int) -> DataFrame:
    """``forced`` where ``period`` has passed since the last key, natural
    or forced; nothing is forced before the first key."""

    def make():
        last = None

        def step(t, is_key):
            nonlocal last
            if is_key:
                last = t
                return (False,)
            if last is not None and t - last >= period:
                last = t
                return (True,)
            return (False,)

        return step

    return ordered_scan(df, by, order, [ts, key], "forced boolean", make)


def reordered(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, window: int, most: int = 128) -> DataFrame:
    """T1, over a finished stream: rows leave a buffer once they are ``window``
    older than its newest, or when it holds more than ``most``.  ``position``
    is the order in which they leave and ``ts_out`` their time, never less than
    the one before.  Rows come out in the order they leave."""
    import heapq

    from pyspark.sql import types as T

    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("position", T.LongType()), T.StructField("ts_out", T.LongType())])
    at, keyed = names.index(ts), [names.index(k) for k in by]

    def run(batches):
        import pyarrow as pa

        key, heap, n, newest, last, left = None, [], 0, None, None, 0
        arrow = None

        def leave(row):
            nonlocal last, left
            last = row[at] if last is None else max(last, row[at])
            left += 1
            return (*row, left, last)

        for batch in batches:
            if not batch.num_rows:
                continue
            arrow = arrow or [*batch.schema.types, pa.int64(), pa.int64()]
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = tuple(row[i] for i in keyed)
                if own != key:
                    out += [leave(heapq.heappop(heap)[2]) for _ in range(len(heap))]
                    key, n, newest, last, left = own, 0, None, None, 0
                heapq.heappush(heap, (row[at], n, row))
                n += 1
                newest = row[at] if newest is None else max(newest, row[at])
                while heap and (heap[0][0] <= newest - window or len(heap) > most):
                    out.append(leave(heapq.heappop(heap)[2]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], names=schema.names)
        if heap:
            out = [leave(heapq.heappop(heap)[2]) for _ in range(len(heap))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], names=schema.names)

    parted = df.repartition(*[F.col(k) for k in by]).sortWithinPartitions(*by, *order)
    return parted.mapInArrow(run, schema)


def realigned(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, limit: int, to: str = "ts_out") -> DataFrame:
    """T4: times that go back by more than ``limit`` start a new offset, one
    after the last; smaller steps back repeat the last time."""

    def make():
        offset, last = 0, None

        def step(t):
            nonlocal offset, last
            out = t + offset
            if last is not None and out < last:
                if last - out > limit:
                    offset = last + 1 - t
                    out = last + 1
                else:
                    out = last
            last = out
            return (max(0, out),)

        return step

    return ordered_scan(df, by, order, [ts], f"{to} bigint", make)


def shed(df: DataFrame, by: Sequence[str], order: Sequence[str], lag: str, key: str, most: int) -> DataFrame:
    """T5: once ``lag`` reaches ``most``, rows are dropped up to the next key
    that comes with less: the last row that says either decides."""
    says = F.when(F.col(lag) >= most, F.lit(True)).when(F.col(key), F.lit(False))
    return df.withColumn("dropped", F.coalesce(F.last(says, ignorenulls=True).over(_running(by, order)), F.lit(False)))


def merged_in_sequence(df: DataFrame, by: Sequence[str], seq: str) -> DataFrame:
    """Rows of all inputs in sequence; ``missing`` counts the numbers
    skipped before a row and ``repeated`` marks a number seen before."""
    w = _w(by, [seq])
    step = F.col(seq) - F.lag(seq).over(w)
    return df.withColumn("missing", F.greatest(F.coalesce(step, F.lit(1)) - 1, F.lit(0))).withColumn("repeated", F.coalesce(step == 0, F.lit(False)))


def latest_group(df: DataFrame, by: Sequence[str], order: Sequence[str], key: Column, header: Column) -> DataFrame:
    """What a late joiner gets: the newest header row and every other row
    from the newest key on."""
    at = F.struct(*order)
    marks = df.groupBy(*by).agg(F.max(F.when(key, at)).alias("__key"), F.max(F.when(header, at)).alias("__header"))
    return df.join(marks, list(by)).where(F.when(header, at == F.col("__header")).otherwise(at >= F.col("__key"))).drop("__key", "__header")


def gaps_filled(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, step: int, most: int | None = None) -> DataFrame:
    """A row stands for ``step``; where the next comes later, whole missing
    steps are filled with rows ``filled`` = true.  A gap of more than ``most``
    steps (if given) is an error."""
    gap = F.lead(ts).over(_w(by, order)) - F.col(ts)
    n = F.coalesce(F.greatest(F.floor(gap / step) - 1, F.lit(0)).cast("long"), F.lit(0).cast("long"))
    wide = df.withColumn("__n", n)
    if most is not None:
        error = F.raise_error(F.concat(F.lit("gap of "), F.col("__n").cast("string"), F.lit(f" steps, {most} at most"))).cast("long")
        wide = wide.withColumn("__n", F.when(F.col("__n") > most, error).otherwise(F.col("__n")))
    return wide.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n")))).select(*by, (F.col(ts) + F.col("__i") * step).alias(ts), (F.col("__i") > 0).alias("filled"))


def init_barrier(df: DataFrame, by: Sequence[str], order: Sequence[str], needs: Sequence[Column]) -> DataFrame:
    """Rows from the one on which every condition in ``needs`` has been met
    by it or a row before it."""
    seen = [F.max(n.cast("int")).over(_running(by, order)) for n in needs]
    met = seen[0] == 1
    for s in seen[1:]:
        met = met & (s == 1)
    return df.withColumn("__met", met).where("__met").drop("__met")


def credited(df: DataFrame, by: Sequence[str], order: Sequence[str], grant: str, initial: int, most: int) -> DataFrame:
    """Rows go out on credit.  A row with a ``grant`` above 0 adds that much,
    up to ``most``; every other row spends one, or is held back (``admitted``
    false) where there is none.  ``credit`` is what is left."""

    def make():
        credit = initial

        def step(more):
            nonlocal credit
            if more:
                credit = min(most, credit + more)
                return True, credit
            out = credit > 0
            credit -= out
            return out, credit

        return step

    return ordered_scan(df, by, order, [grant], "admitted boolean, credit bigint", make)


def ring(df: DataFrame, by: Sequence[str], order: Sequence[str], size: str, behind: str, capacity: int) -> DataFrame:
    """A ring of ``capacity`` bytes.  ``head`` is what was written up to and
    with a row, ``tail`` the oldest byte still held; a reader that is ``behind``
    bytes late reads on at ``position``, and has ``lapped`` if that was not where
    it stood."""
    head = F.sum(size).over(_running(by, order))
    wide = df.withColumn("head", head).withColumn("tail", F.greatest(F.col("head") - capacity, F.lit(0)))
    stood = F.greatest(F.col("head") - F.col(behind), F.lit(0))
    return wide.withColumn("position", F.greatest(stood, F.col("tail"))).withColumn("lapped", stood < F.col("tail"))


def until(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, duration: int, idle: int) -> DataFrame:
    """Rows of a stream up to the first pause longer than ``idle``, and
    less than ``duration`` after its first row."""
    pause = (F.col(ts) - F.lag(ts).over(_w(by, order)) > idle).cast("int")
    marked = df.withColumn("__pause", F.coalesce(pause, F.lit(0))).withColumn("__first", F.first(ts).over(_running(by, order)))
    return marked.withColumn("__over", F.max("__pause").over(_running(by, order))).where((F.col("__over") == 0) & (F.col(ts) - F.col("__first") < duration)).drop("__pause", "__first", "__over")


def paced(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, speed: int, longest: int, to: str = "due") -> DataFrame:
    """When a replay at ``speed`` sends each row, from 0: the waits before
    it added up; a wait of ``longest`` or more is skipped, as is a step back."""
    wait = F.coalesce(F.col(ts) - F.lag(ts).over(_w(by, order)), F.lit(0))
    scaled = df.withColumn("__wait", wait).withColumn("__wait", F.expr(f"__wait div {speed}"))
    return scaled.withColumn(to, F.sum(F.when((F.col("__wait") > 0) & (F.col("__wait") < longest), F.col("__wait")).otherwise(F.lit(0))).over(_running(by, order))).drop("__wait")


def reference_lists(df: DataFrame, by: Sequence[str], order: Sequence[str], picture: str, idr: str, reference: str, depth: int) -> DataFrame:
    """The reference pictures of each frame, in coding order: of the newest
    ``depth`` reference frames since the last IDR, ``list0`` has those shown
    before it, nearest first, then those after; ``list1`` the other way round."""
    from collections import deque

    def make():
        held: deque[int] = deque(maxlen=depth)

        def step(poc, is_idr, is_reference):
            if is_idr:
                held.clear()
            before, after = sorted((p for p in held if p < poc), reverse=True), sorted(p for p in held if p > poc)
            if is_reference:
                held.append(poc)
            return before + after, after + before

        return step

    return ordered_scan(df, by, order, [picture, idr, reference], "list0 array<bigint>, list1 array<bigint>", make)
