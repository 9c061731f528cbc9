"""Stateful processors over micro-batches give what their batch twins give."""

import random

from tideline.operators import segments as S
from tideline.operators import timeline as T
from tideline.streaming import stateful


def run(spark, tmp_path, rows, processor, name):
    src = tmp_path / "in"
    for i in range(3):
        part = rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3]
        spark.createDataFrame(part, stateful.IN).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(stateful.IN).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = stateful.processed(stream, processor).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def rows_of(seed=0, n=60):
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 10, 500, -300])
        out.append((f"s{i % 2}", i, max(0, t), rng.random() < 0.3, rng.randint(0, 10)))
    return out


def test_reorder(spark, tmp_path):
    rows = rows_of(1)
    end = [("s0", 1000, None, False, 0), ("s1", 1001, None, False, 0)]
    mine = {(r.stream_id, r.seq): (r.position, r.ts_out) for r in run(spark, tmp_path, rows + end, stateful.Reorder(800, 8), "reorder_out")}
    twin = T.reordered(spark.createDataFrame(rows, stateful.IN), ["stream_id"], ["seq"], "ts", 800, 8).collect()
    assert mine == {(r.stream_id, r.seq): (r.position, r.ts_out) for r in twin}


def test_segments(spark, tmp_path):
    rows = rows_of(2)
    mine = {(r.stream_id, r.seq): r.segment for r in run(spark, tmp_path, rows, stateful.Segment(900), "segment_out")}
    twin = S.at_keyframes(spark.createDataFrame(rows, stateful.IN), ["stream_id"], ["seq"], "ts", "is_key", 900).collect()
    assert mine == {(r.stream_id, r.seq): r.segment for r in twin}


def test_realign_and_shed(spark, tmp_path):
    rows = rows_of(3)
    mine = {(r.stream_id, r.seq): r.ts_out for r in run(spark, tmp_path / "a", rows, stateful.Realign(250), "realign_out")}
    twin = T.realigned(spark.createDataFrame(rows, stateful.IN), ["stream_id"], ["seq"], "ts", 250).collect()
    assert mine == {(r.stream_id, r.seq): r.ts_out for r in twin}
    mine = {(r.stream_id, r.seq): r.dropped for r in run(spark, tmp_path / "b", rows, stateful.Shed(9), "shed_out")}
    twin = T.shed(spark.createDataFrame(rows, stateful.IN), ["stream_id"], ["seq"], "lag", "is_key", 9).collect()
    assert mine == {(r.stream_id, r.seq): r.dropped for r in twin}
