"""Closed forms and scans against plain loops, on disordered fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import joins as J
from tideline.operators import segments as S
from tideline.operators import timeline as T


def streams(seed, n=60, keys=3, step=1000):
    rng = random.Random(seed)
    rows = []
    for k in range(keys):
        t = 0
        for i in range(n):
            t += rng.choice([0, 1, 5, step, -step // 3])
            rows.append((f"s{k}", i, max(0, t), rng.random() < 0.3))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "stream_id string, seq long, ts long, is_key boolean")


def by_stream(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def got(df, *cols):
    return {(r.stream_id, r.seq): tuple(r[c] for c in cols) for r in df.collect()}


def test_clamp_strict_is_the_loop(spark):
    for seed in range(3):
        rows = streams(seed)
        mine = got(T.clamp_strict(frame(spark, rows), ["stream_id"], ["seq"], "ts"), "ts_out")
        for k, rs in by_stream(rows).items():
            last = None
            for r in rs:
                last = r[2] if last is None else max(r[2], last + 1)
                assert mine[k, r[1]] == (last,)


def test_reorder_is_the_loop(spark):
    rows = streams(7, 120)
    mine = got(T.reordered(frame(spark, rows), ["stream_id"], ["seq"], "ts", 2000, 16), "position", "ts_out")
    for k, rs in by_stream(rows).items():
        held, out, last = [], [], -1
        for r in rs:
            held.append((r[2], r[1]))
            held.sort()
            newest = max(x[2] for x in rs[: rs.index(r) + 1])
            n = max(sum(t <= newest - 2000 for t, _ in held), len(held) - 16)
            out, held = out + held[:n], held[n:]
        for i, (t, s) in enumerate(out + held, 1):
            last = max(last, t)
            assert mine[k, s] == (i, last)


def test_segments_and_empty(spark):
    rows = streams(3)
    mine = got(S.at_keyframes(frame(spark, rows), ["stream_id"], ["seq"], "ts", "is_key", 3000), "segment")
    for k, rs in by_stream(rows).items():
        start, n = rs[0][2], 1
        for r in rs:
            if r[3] and r[2] - start >= 3000:
                start, n = r[2], n + 1
            assert mine[k, r[1]] == (n,)
    empty = frame(spark, [])
    assert S.at_keyframes(empty, ["stream_id"], ["seq"], "ts", "is_key", 1).count() == 0
    assert T.reordered(empty, ["stream_id"], ["seq"], "ts", 1).count() == 0


def test_wraps(spark):
    top = (1 << 33) - 10
    rows = [("a", 0, top, False), ("a", 1, 5, False), ("a", 2, top + 3, False), ("a", 3, 40, False)]
    assert got(T.unwrapped(frame(spark, rows), ["stream_id"], ["seq"], "ts"), "time") == {("a", 0): (top,), ("a", 1): ((1 << 33) + 5,), ("a", 2): (top + 3,), ("a", 3): ((1 << 33) + 40,)}
    rows = [("a", 0, (1 << 32) - 5, False), ("a", 1, 10, False)]
    assert got(T.rebase_wrapped(frame(spark, rows), ["stream_id"], ["seq"], "ts"), "ts_out")["a", 1] == (15,)


def test_shed_and_gaps(spark):
    rows = [("a", i, t, key) for i, (t, key) in enumerate([(1, False), (9, True), (2, False), (3, True), (1, False)])]
    assert [v[0] for _, v in sorted(got(T.shed(frame(spark, rows), ["stream_id"], ["seq"], "ts", "is_key", 9), "dropped").items())] == [False, True, True, False, False]
    rows = [("a", 0, 0, False), ("a", 1, 50, False), ("a", 2, 60, False)]
    filled = T.gaps_filled(frame(spark, rows), ["stream_id"], ["seq"], "ts", 10).orderBy("ts").collect()
    assert [(r.ts, r.filled) for r in filled] == [(0, False), (10, True), (20, True), (30, True), (40, True), (50, False), (60, False)]


def test_asof_ties_and_none(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t long")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 9, 90)], "k string, t long, v long")
    assert {(r.k, r.t): r.v for r in J.asof_backward(left, right, ["k"], "t", ["v"]).collect()} == {("a", 5): 50, ("a", 1): None, ("b", 9): None}
    assert {(r.k, r.t): r.v for r in J.asof_backward(left, right, ["k"], "t", ["v"], strict=True).collect()} == {("a", 5): 20, ("a", 1): None, ("b", 9): None}


def test_start_cut_drops_streams_without_keys(spark):
    from pyspark.sql import functions as F

    rows = [("a", 0, 0, False), ("a", 1, 10, True), ("b", 0, 5, False)]
    out = T.start_cut(frame(spark, rows), ["stream_id"], "ts", F.col("is_key"), F.lit(False), 0)
    assert got(out, "ts") == {("a", 1): (10,)}


def test_natural_sort_of_all_parts(spark, sf):
    import duckdb

    from tideline.plans import registry
    from tideline.plans.timeline_queries import naturally_sorted

    path = sf.replace("sf0.001", "sf0.01")  # 2,000 parts
    sql = registry.SQL["natural_sort"].replace(" WHERE p_partkey <= 200", "").replace("FROM part", f"FROM '{path}/part.parquet'")
    want = duckdb.sql(sql).fetchall()
    for rows in (None, 100):
        mine = naturally_sorted(spark.read.parquet(f"{path}/part.parquet"), rows)
        assert len(want) == 2000 and sorted(map(tuple, mine.collect())) == sorted(want)
        plan = mine._jdf.queryExecution().executedPlan().toString()
        assert rows is None or "SinglePartition" not in plan  # one range of bounded size may be one task


def test_gaps_over_the_limit_are_errors(spark):
    df = frame(spark, [("a", 0, 0, False), ("a", 1, 50, False)])
    assert T.gaps_filled(df, ["stream_id"], ["seq"], "ts", 10).count() == 6
    assert T.gaps_filled(df, ["stream_id"], ["seq"], "ts", 10, 4).count() == 6
    with pytest.raises(Exception, match="gap of 4 steps"):
        T.gaps_filled(df, ["stream_id"], ["seq"], "ts", 10, 3).collect()


def test_counted_pts_of_long_segments(spark):
    rows = spark.range(100).selectExpr("'s' as stream_id", "id as seq", "id * 20 as ts")
    found = T.counted_pts(rows, ["stream_id"], ["ts", "seq"], F.col("ts"), 44100).collect()
    assert {r.seq: r.pts for r in found} == {i: 20 * i + i * 1024 * 90000 // 44100 for i in range(100)}
