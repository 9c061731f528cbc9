"""Packing into optimal length buckets.

Dynamic programming over the global length histogram picks the bucket
boundaries that minimise padding: a document is padded to its bucket's length.
Batches of a bounded number of padded tokens form inside each bucket.

Rows are numbered within a bucket without bringing a bucket into one task: each
bucket is dealt into chunks by a hash, rows are numbered within their chunk,
and chunks start where the counts of the chunks before them end.

Defined results: a null length counts as 0; a document longer than the budget
makes a batch of its own; an empty table gives an empty result.  Rows repeating
an id are packed one by one, rows without one too; texts of any length count.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm import common
from tideline.llm.tokencount import with_tokens

#: Buckets, and padded tokens of one batch.
BUCKETS, BUDGET = 16, 65_536
#: Rows of a chunk, about.
CHUNK = 4096


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padding.

    The cost of a bucket over sorted lengths i..j is lengths[j] * n(i..j) less
    the tokens in it.  It satisfies the quadrangle inequality, so the best last
    cut never moves back and each layer takes O(n log n).
    """
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate(([0], np.cumsum(counts))).astype(float)
    tokens = np.concatenate(([0], np.cumsum(lengths * counts))).astype(float)
    cost = lambda i, j: lengths[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])  # noqa: E731  bins i..j-1
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            total = best[i] + cost(i, mid)
            k = int(total.argmin())
            new[mid], cut[mid] = total[k], a + k
            todo += [(lo, mid - 1, a, a + k), (mid + 1, hi, a + k, b)]
        cuts.append(cut)
        best = new
        best[0] = np.inf  # later buckets hold at least one bin
    out, at = [], n
    for cut in reversed(cuts):
        out.append(int(lengths[at - 1]))
        at = int(cut[at])
    return out[::-1]


def packed(docs: DataFrame, length: str, key: str, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``docs`` with bucket (from 0), bucket_length, batch and position (both
    from 0, within the bucket and the batch).  ``key`` orders rows of equal
    length and deals them into chunks."""
    made = ["bucket", "bucket_length", "batch", "position"]
    names = [c for c in docs.columns if c not in made]
    kept = [f"k{i}" for i in range(len(names))]
    rows = common.positional(docs, names, n=length, key=key).withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    # Rows without a key are told apart by where they were read, so that they do not all meet in one chunk.
    salt = F.when(F.col("key").isNull(), F.monotonically_increasing_id())
    rows = common.cut(rows.withColumn("hashed", F.xxhash64("key", "n", salt)), "lengths")
    # Exact: d distinct lengths take d * d / 2 tokens, so T tokens have no more than sqrt(2 * T).
    histogram = rows.groupBy("n").agg(F.count("*").alias("rows")).toArrow()
    ends = boundaries(histogram.column("n").to_numpy(), histogram.column("rows").to_numpy(), buckets)
    # A bucket's padded length: its longest row, which ends its range.
    table = F.from_json(F.lit(json.dumps(ends)), "array<bigint>")
    rows = rows.withColumn("bucket", F.size(F.filter(table, lambda e: e < F.col("n"))).cast("int"))
    stats = {r["bucket"]: (r["rows"], r["longest"]) for r in rows.groupBy("bucket").agg(F.count("*").alias("rows"), F.max("n").alias("longest")).collect()}
    per = lambda f, kind: F.get(F.from_json(F.lit(json.dumps([f(stats.get(b, (0, 0))) for b in range(len(ends) + 1)])), f"array<{kind}>"), F.col("bucket"))
    rows = rows.withColumn("chunk", F.pmod("hashed", per(lambda s: max(1, -(-s[0] // CHUNK)), "bigint"))).withColumn("bucket_length", per(lambda s: s[1], "bigint"))
    room = per(lambda s: max(1, budget // max(1, s[1])), "bigint")
    counts = rows.groupBy("bucket", "chunk").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("bucket", "chunk", F.coalesce(before, F.lit(0)).alias("start"))
    own = Window.partitionBy("bucket", "chunk").orderBy("n", "key", "hashed")
    numbered = rows.withColumn("r", F.row_number().over(own) - 1).join(starts, ["bucket", "chunk"])
    at = F.col("start") + F.col("r")
    return numbered.select(*[F.col(k).alias(c) for k, c in zip(kept, names, strict=True)], "bucket", "bucket_length", F.floor(at / room).alias("batch"), F.pmod(at, room).cast("int").alias("position"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and place: bucket, its padded length, batch
    in the bucket and position in the batch."""
    docs = with_tokens(common.table(spark, sf_dir, "documents"), keep=["doc_id"])
    return packed(docs, "n_tokens", "doc_id")
