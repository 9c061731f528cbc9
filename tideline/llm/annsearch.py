"""Approximate nearest neighbours by an inverted multi-index.

Each vector's halves are quantised separately, by k-means centroids fitted on a
bounded sample; a pair of centroids is a cell.  For a query, cells come in
order of the summed distance of its halves to their centroids: the pairs are
traversed with a heap, so no pair list is sorted, until the cells hold
``visit`` of all vectors.  The sampled vectors of these cells give a floor for
the ``k`` best scores.  A cell's norms and distances from its centroids bound
its inner products from above, and every cell whose bound reaches the floor is
searched, so no cell that holds one of the ``k`` nearest is left out, whatever
the norms.  Its vectors are ranked by the exact inner product in double precision.

Equal vectors form a class, since ties go to smaller ids: of one class at most
``k`` + 1 smallest ids can be among a query's ``k`` nearest without itself.  So
a vector that repeats a million times costs one product per query.

Classes are dealt into blocks of bounded size within ranges of cells; each
query goes to the blocks of its visited cells, and a task holds one block of
classes and a slice of queries.  Only each block's best ``k`` of a query leave
it, and of these only what reaches the query's floor.  The sampled vectors are
candidates too, so the floor never cuts off one of the ``k`` found.

Defined results: vectors that are null, empty, zero, of another length than
the most common one, or that hold null or non-finite components take no part.
Queries find all candidates if there are fewer than ``k``; an empty table gives
an empty result.  Rows repeating an id are candidates each on its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import common

#: Centroids per half are this many times the fourth root of the number of
#: vectors (so cells grow with its square root); least rows of the sample that
#: fits them, and rows for each centroid; rounds of k-means.
CENTROIDS, SAMPLE, EACH, ROUNDS = 2.0, 8192, 32, 8
#: Share of the vectors that the cells hold whose sampled vectors give the floor.
VISIT = 0.25
#: Vectors of one block, and queries compared with it at a time.
BLOCK, QUERIES = 8192, 256
#: Queries of one task, about.
LOT = 8192


def centroids(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means of the rows of ``x``, from distinct rows."""
    x = np.unique(x, axis=0)
    random = np.random.default_rng(seed)
    c = x[random.permutation(len(x))[:k]].astype(float)
    for _ in range(ROUNDS):
        near = (((c * c).sum(axis=1) - 2 * x @ c.T)).argmin(axis=1)
        for j in range(len(c)):
            own = x[near == j]
            if len(own):
                c[j] = own.mean(axis=0)
    return c


class Index:
    """Centroids of both halves and the share of vectors in each cell."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right
        self.share = np.zeros((len(left), len(right)))

    @property
    def half(self) -> int:
        return self.left.shape[1]

    @staticmethod
    def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]

    def cell(self, x: np.ndarray) -> np.ndarray:
        a = self.distances(x[:, : self.half], self.left).argmin(axis=1)
        b = self.distances(x[:, self.half :], self.right).argmin(axis=1)
        return a * len(self.right) + b

    def visited(self, q: np.ndarray, visit: float) -> list[int]:
        """Cells of one query by summed distance, until they hold ``visit``."""
        da, db = self.distances(q[None, : self.half], self.left)[0], self.distances(q[None, self.half :], self.right)[0]
        oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        heap, pushed, out, held = [(da[oa[0]] + db[ob[0]], 0, 0)], {(0, 0)}, [], 0.0
        while heap and held < visit:
            _, i, j = heapq.heappop(heap)
            out.append(int(oa[i]) * len(self.right) + int(ob[j]))
            held += self.share[oa[i], ob[j]]
            for i2, j2 in ((i + 1, j), (i, j + 1)):
                if i2 < len(oa) and j2 < len(ob) and (i2, j2) not in pushed:
                    pushed.add((i2, j2))
                    heapq.heappush(heap, (da[oa[i2]] + db[ob[j2]], i2, j2))
        return out

    def searched(self, q: np.ndarray, sample: np.ndarray, sample_cells: np.ndarray, most: np.ndarray, filled: np.ndarray, k: int, visit: float) -> tuple[np.ndarray, float]:
        """Cells that may hold one of a query's ``k`` nearest, and a floor of
        their scores: the k + 1-th best (one may be the query) of the sampled
        vectors in the cells that are visited first."""
        known = sample[np.isin(sample_cells, self.visited(q, visit))] @ q
        floor = np.partition(known, len(known) - k - 1)[len(known) - k - 1] if len(known) > k else -np.inf
        return np.flatnonzero(filled & (self.bounds(q, most) >= floor)), float(floor)

    def spread(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """(norm of the left half, of the right half, distances of both from
        their centroids) of each vector in its cell."""
        l, r = x[:, : self.half], x[:, self.half :]
        parts = (l, r, l - self.left[cell // len(self.right)], r - self.right[cell % len(self.right)])
        return np.stack([np.sqrt((p * p).sum(axis=1)) for p in parts])

    def bounds(self, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """An upper bound of the inner products of one query with the vectors
        of each cell; ``most`` has the largest ``spread`` of each."""
        l, r = q[: self.half], q[self.half :]
        a, b = np.sqrt(l @ l), np.sqrt(r @ r)
        left = np.minimum(a * most[0], np.repeat(self.left @ l, len(self.right)) + a * most[2])
        right = np.minimum(b * most[1], np.tile(self.right @ r, len(self.left)) + b * most[3])
        return left + right + 1e-9 * (1 + a * most[0] + b * most[1])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return common.flat(column).flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.float64)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, embedding as array<double>) of the rows that take part."""
    e = F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), e.alias("embedding")).where("vec_id is not null and embedding is not null")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return rows.where(sound)


def nearest(vectors: DataFrame, is_query: str, k: int = 20, visit: float = VISIT, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of each row that
    satisfies the SQL condition ``is_query`` on vec_id."""
    spark = vectors.sparkSession
    common.arrow_batches(spark)
    rows = usable(vectors, vec_id, embedding)
    result = "query_id long, rank int, vec_id long, score double"
    widths = rows.groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    if not widths or widths[0]["w"] < 2:
        return spark.createDataFrame([], result) if not widths else _plain(rows.where(F.size("embedding") == 1), is_query, k)
    width, total = widths[0]["w"], widths[0]["n"]
    rows = rows.where(F.size("embedding") == width)
    near = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30))
    per_half = max(4, round(CENTROIDS * total**0.25))
    size = max(SAMPLE, EACH * per_half)
    share = min(1.0, 1.3 * size / total)
    sample = rows.where(near < share * (1 << 30)).dropDuplicates(["embedding"]).select("embedding", near.alias("at")).orderBy("at").limit(size).select("embedding").toArrow()
    x = matrix(sample.column("embedding"), width) if sample.num_rows else matrix(rows.select("embedding").limit(per_half).toArrow().column("embedding"), width)
    half = width // 2
    index = Index(centroids(x[:, :half], per_half, 1), centroids(x[:, half:], per_half, 2))
    cells = len(index.left) * len(index.right)

    # Classes of equal vectors, each with its k + 1 smallest ids.
    ranked = rows.withColumn("h", F.xxhash64("embedding"))
    classes = ranked.groupBy("embedding", "h").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    single = classes.where("n = 1").select("embedding", F.array("vec_id").alias("ids"))
    several = classes.where("n > 1").select("embedding", "h", "n")
    ids = smallest(ranked.join(several.select("embedding", "h"), ["h", "embedding"], "left_semi"), k + 1)
    members = single.unionByName(ids.select("embedding", "ids"))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), width)
                cell = index.cell(x)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), *map(pa.array, index.spread(x, cell))], names=["embedding", "ids", "cell", *spread])

    spread = ["s0", "s1", "s2", "s3"]
    indexed = common.cut(members.mapInArrow(celled, "embedding array<double>, ids array<long>, cell int, " + ", ".join(f"{s} double" for s in spread)), "index")
    stats = indexed.groupBy("cell").agg(F.count("*").alias("n"), *[F.max(s).alias(s) for s in spread]).collect()  # a row for each cell
    counts = {r["cell"]: r["n"] for r in stats}
    most = np.zeros((len(spread), cells))
    for r in stats:
        most[:, r["cell"]] = [r[s] for s in spread]
    filled = np.array([c in counts for c in range(cells)], bool)
    held = sum(counts.values())
    for cell, n in counts.items():
        index.share[cell // len(index.right), cell % len(index.right)] = n / held
    # Blocks: consecutive cells together while small, a large cell in several.
    first, parts, block, size = np.zeros(cells, np.int64), np.ones(cells, np.int64), 0, 0
    for cell in range(cells):
        n = counts.get(cell, 0)
        if size and size + n > BLOCK:
            block, size = block + 1, 0
        first[cell], parts[cell] = block, max(1, -(-n // BLOCK))
        if parts[cell] > 1:
            block, size = block + int(parts[cell]), 0
        else:
            size += n
    queries = rows.where(is_query)
    lots = max(1, -(-queries.count() // LOT))

    sample_cells = index.cell(x)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, to, floors = [], [], []
            for i, q in enumerate(matrix(batch.column(1), width)):
                searched, floor = index.searched(q, x, sample_cells, most, filled, k, visit)
                blocks = sorted({int(first[c]) + p for c in searched for p in range(int(parts[c]))})
                at += [i] * len(blocks)
                to += blocks
                floors += [floor - 1e-9] * len(blocks)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(to, pa.int64()), pa.array(floors, pa.float64())], names=["query_id", "q", "block", "floor"])

    asked = queries.mapInArrow(sent, "query_id long, q array<double>, block long, floor double").withColumn("lot", F.pmod(F.xxhash64("query_id"), F.lit(lots)))
    table = F.from_json(F.lit(str([[int(a), int(b)] for a, b in zip(first, parts, strict=True)])), "array<array<long>>")
    at = F.get(table, F.col("cell"))
    blocks = indexed.select("embedding", "ids", (F.get(at, F.lit(0)) + F.pmod(F.xxhash64("embedding"), F.get(at, F.lit(1)))).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))).alias("lot"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            vectors, lists = matrix(left.column("embedding"), width), left.column("ids").to_pylist()
            lengths = np.array([len(x) for x in lists])
            flat = np.fromiter((v for x in lists for v in x), np.int64, int(lengths.sum()))
            owner = np.repeat(np.arange(len(lists)), lengths)
            names = right.column("query_id").to_numpy()
            asking, floors = matrix(right.column("q"), width), right.column("floor").to_numpy()
            for a in range(0, len(names), QUERIES):
                scores = np.einsum("ij,kj->ik", asking[a : a + QUERIES], vectors, optimize=True)
                for i, s in enumerate(scores):
                    # The k + 1 best classes hold the k best ids; ties at the edge stay.
                    pick = np.arange(len(s)) if len(s) <= k + 1 else np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1] - 1e-9)
                    mine = np.isin(owner, pick)
                    v = flat[mine]
                    exact = np.ascontiguousarray((vectors[owner[mine]] * asking[a + i]).T).sum(axis=0)  # components one after another
                    own = (v != names[a + i]) & (exact >= floors[a + i])
                    v, exact = v[own], exact[own]
                    order = np.lexsort((v, -exact))[:k]
                    out_q += [names[a + i]] * len(order)
                    out_v += v[order].tolist()
                    out_s += exact[order].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    found = blocks.groupBy("block", "lot").cogroup(asked.groupBy("block", "lot")).applyInArrow(best, "query_id long, vec_id long, score double")
    return top(found, k)


def smallest(rows: DataFrame, k: int) -> DataFrame:
    """(embedding, ids): the ``k`` smallest ids of each vector.  Ids are first
    dealt into salted groups that each keep their ``k`` smallest, so a vector
    with very many rows never meets in one task."""
    from pyspark.sql import Window

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit("salt")), F.lit(64)))
    part = salted.withColumn("r", F.row_number().over(Window.partitionBy("h", "embedding", "salt").orderBy("vec_id"))).where(F.col("r") <= k)
    return part.groupBy("h", "embedding").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k).alias("ids"))


def top(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _plain(rows: DataFrame, is_query: str, k: int) -> DataFrame:
    """Vectors of one component: sorted ends hold every query's nearest."""
    x = F.get("embedding", F.lit(0))
    flat = rows.select("vec_id", x.alias("x"))
    ends = flat.orderBy(F.desc("x"), "vec_id").limit(k + 1).unionByName(flat.orderBy("x", "vec_id").limit(k + 1)).distinct()
    pairs = flat.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("x").alias("qx")).join(F.broadcast(ends), F.col("query_id") != F.col("vec_id"))
    return top(pairs.select("query_id", "vec_id", (F.col("qx") * F.col("x")).alias("score")), k)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")
