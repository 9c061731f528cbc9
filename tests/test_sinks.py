"""Atomic output and recorders."""

import pytest
from pyspark.sql import functions as F

from tideline.operators import segments as S
from tideline.sources import sinks
from tideline.streaming import stateful


def test_replaced_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.replaced(spark.range(3), path)
    sinks.replaced(spark.range(5), path)
    with pytest.raises(Exception, match="no such thing"):
        sinks.replaced(spark.range(9).select(F.raise_error(F.lit("no such thing")).alias("x")), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out"]


def test_live_playlists(spark, tmp_path):
    rows = [("a", i, 400 * i, i % 2 == 0, 0) for i in range(12)]
    for k in range(3):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], stateful.IN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def listing(all_rows):
        cut = S.segment_table(S.at_keyframes(all_rows, ["stream_id"], ["seq"], "ts", "is_key", 1000), ["stream_id"], "ts", "lag")
        return S.playlist(cut, ["stream_id"], "duration", 1000, F.concat(F.lit("s"), F.col("segment")))

    write = sinks.playlists(str(tmp_path / "lists"), listing, str(tmp_path / "rows"))
    stream = spark.readStream.schema(stateful.IN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    write(spark.createDataFrame(rows[:4], stateful.IN), 0)  # a batch that runs again changes nothing
    got, want = spark.read.parquet(str(tmp_path / "lists")).collect(), listing(spark.createDataFrame(rows, stateful.IN)).collect()
    assert [(r.stream_id, r.playlist) for r in got] == [(r.stream_id, r.playlist) for r in want]
