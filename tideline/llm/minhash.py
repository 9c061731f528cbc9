"""MinHash near-dedup: minima of many universal hashes of a document's shingle
set, banded; signature and set verification; connected components by
alternating large-star and small-star.

Steps, each over all rows:

1. One pass over the texts gives each document its set size, a 128-bit digest
   of the set, its signature and its band keys.
2. Documents with equal sets form a class; the smallest id stands for it, and
   only classes go on, so copies cost nothing further.
3. Each band bucket has its smallest class as pivot; every other member is
   paired with it.  Pairs whose signatures agree enough are verified on full
   sets, recomputed for the classes concerned only.  The verified pairs give
   first components.
4. Members of a bucket that are in different components after that could still
   be linked to each other.  They are compared in blocks of bounded size, by
   their full sets: those outside the pivot's component with those in it, and
   among themselves.  A task counts what its members share through postings of
   its hashes and passes on only links that join components, one for each join.
   So the components are those of all pairs that share a bucket, while no pair
   of a group becomes a row unless it joins something.

Keys that very many rows share (a bucket, a pivot, a set's digest) meet in
sort-merge joins, whose skewed partitions adaptive execution splits.

With 30 bands of 4 minima a link at the threshold of 0.8 misses every bucket
with probability 1.4e-7, and its signatures agree in fewer than ``AGREE`` of
120 places with probability 1e-8.  Sets hold 64-bit hashes of shingles.

Defined results: a text without words (or null) has an empty set, is linked
with nothing and stands for itself; a row with a null id takes part in nothing
(component null, kept).  Rows that repeat an id are compared like any others;
texts of any length give their whole sets; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import common
from tideline.llm.quality import ranges

BANDS, ROWS = 30, 4
MINIMA = BANDS * ROWS
#: Signature places in which a pair must agree to be verified.
AGREE = 70
#: Members of a bucket, and hashes of their sets, in one of its blocks, about;
#: a task compares two blocks.
BLOCK, HASHES = 1024, 1 << 20
SEED = 0x5EED
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words.to_pylist()), np.uint64, len(words))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``size``-word shingles; a
    text with fewer words has its whole sequence as one."""
    words, codes, offsets = common.unique_words(pc.ascii_lower(pc.fill_null(common.flat(texts).cast(pa.string()), "")))
    hashes = word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            h = hashes[a:b]
            k = min(size, len(h))
            if not k:
                out.append(h)
                continue
            n = len(h) - k + 1
            x = np.full(n, k, np.uint64)
            for i in range(k):
                x = (x + h[i : i + n]) * ODD[i % 4]
                x ^= x >> np.uint64(29)
            out.append(np.unique(mixed(x)))
    return out


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    high = 1 << 63
    return random.integers(0, high, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, high, MINIMA, np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, MINIMA) minima of (a x + b mod 2^64) / 2^32; sets not empty."""
    a, b = coefficients()
    out = np.empty((len(sets), MINIMA), np.uint32)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(sets):  # so many at a time that they stay in the cache
            to, n = at + 1, len(sets[at])
            while to < len(sets) and n + len(sets[to]) <= 1 << 15:
                n += len(sets[to])
                to += 1
            x = np.concatenate(sets[at:to])
            starts = np.cumsum([0, *[len(s) for s in sets[at : to - 1]]])
            for k in range(MINIMA):
                out[at:to, k] = np.minimum.reduceat(((x * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
            at = to
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * ODD[0]
        for i in range(ROWS):
            key = mixed(key * ODD[1] + parts[:, :, i])
    return key.view(np.int64)


def binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def profiled(docs: DataFrame, size: int, text: str) -> DataFrame:
    """doc_id, n_shingles, digest, signature, bands of every row."""
    common.arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 4 << 20):
            sets = shingle_sets(batch.column(1), size)
            full = np.flatnonzero([len(s) > 0 for s in sets])
            digests, signs, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if len(full):
                made = signatures([sets[i] for i in full])
                for i, s, keys in zip(full.tolist(), made, band_keys(made).tolist(), strict=True):
                    digests[i], signs[i], bands[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), s.tobytes(), keys
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), binary(digests), binary(signs), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "signature", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(lambda batches: common.trimmed(run(batches)), "doc_id long, n_shingles long, digest binary, signature binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int, text: str) -> DataFrame:
    """id and set (packed 64-bit hashes) of the wanted classes; a row's text is
    read again only if its id is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 4 << 20):
            sets = shingle_sets(batch.column(1), size)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), binary(digests), binary([s.tobytes() for s in sets])], names=["id", "digest", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).join(wanted.select("id"), "id", "left_semi")
    made = rows.mapInArrow(lambda batches: common.trimmed(run(batches)), "id long, digest binary, set binary")
    # An id may be repeated with other texts: the class's digest decides.
    return made.join(wanted, ["id", "digest"], "left_semi").dropDuplicates(["id"]).select("id", "set")


def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of rows (a, b, sa, sb) whose signatures agree enough."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(n, MINIMA) for k in (2, 3))
        keep = pa.array((left == right).sum(axis=1) >= AGREE)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, text: str) -> DataFrame:
    """Of the pairs (a, b) of class ids, those whose full sets are similar."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(classes.where("own").select("id", "digest"), "id")
    sets = common.cut(full_sets(docs, wanted, size, text), "sets")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").join(common.by_key(sets.select(F.col("id").alias("a"), F.col("set").alias("x"))), "a").select("a", "b", "x", "y")
    out = common.cut(both.mapInArrow(linked(percent), "a long, b long"), "links")
    common.dropped(sets)
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); the component is its
    smallest id.  Alternates large-star and small-star until both leave the
    edges alone; each round's edges are written to the shared folder."""
    ordered = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, mark = common.cut(ordered, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(common.dealt(lowest), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: edges now point from larger to smaller.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(common.dealt(least), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = common.cut(small, "edges")
        common.dropped(edges)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out.reads = edges
    return out


def labelled(links: DataFrame) -> DataFrame:
    """``components``, written; its edges go."""
    found = components(links)
    labels = common.cut(found, "labels")
    common.dropped(found.reads)
    return labels


def joining(percent: int):
    """A task of ``leftovers``: of the links between its left and right members,
    those that join components (a spanning forest of what they join)."""

    def run(table: pa.Table) -> pa.Table:
        ids, out = table.column("id").to_numpy(), table.column("outside").to_numpy()
        names, comp = np.unique(table.column("component").to_numpy(), return_inverse=True)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set").combine_chunks()]
        left = np.flatnonzero(out)
        right = np.flatnonzero(~out) if table.column("kind")[0].as_py() == "mo" else left
        n = np.array([len(x) for x in sets])
        # Postings: which right members hold each hash.
        hashes, codes = np.unique(np.concatenate([sets[j] for j in right]), return_inverse=True)
        owner = np.repeat(right, n[right])[np.argsort(codes, kind="stable")]
        ends = np.cumsum(np.bincount(codes, minlength=len(hashes)))
        joined = np.arange(len(names))  # local component of each component
        pairs: list[tuple[int, int]] = []
        for i in left.tolist():
            if (joined[comp[right]] == joined[comp[i]]).all():
                continue
            at = np.searchsorted(hashes, sets[i]).clip(max=len(hashes) - 1)
            at = at[hashes[at] == sets[i]]
            first = np.where(at > 0, ends[at - 1], 0)
            both = np.bincount(owner[ranges(first, ends[at] - first)], minlength=len(ids))
            near = np.flatnonzero((both > 0) & (100 * both >= percent * (n[i] + n - both)) & (joined[comp] != joined[comp[i]]))
            for j in near.tolist():
                if joined[comp[j]] != joined[comp[i]]:
                    pairs.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
                    joined[joined == joined[comp[j]]] = joined[comp[i]]
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return run


def leftovers(members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, text: str) -> DataFrame | None:
    """Links of one bucket that join different components; of links that join
    the same components, a task names the first.  None if no bucket has more
    than one component.

    ``members``: (key, id, pivot, n_shingles) of buckets with more than two
    members; ``labels``: (id, component) of linked classes.
    """
    placed = members.join(labels, "id", "left").select("key", "id", "pivot", "n_shingles", F.coalesce("component", "id").alias("component"))
    home = placed.where("id = pivot").select("key", F.col("component").alias("home"))
    placed = placed.join(common.by_key(home), "key").select("key", "id", "n_shingles", "component", (F.col("component") != F.col("home")).alias("outside"))
    placed = common.cut(placed, "placed")
    hashes = lambda inside: F.coalesce(F.sum(F.when(F.col("outside") != inside, F.col("n_shingles"))), F.lit(0))
    sizes = placed.groupBy("key").agg(
        F.count_if(F.col("outside")).alias("o"), F.count_if(~F.col("outside")).alias("m"), hashes(True).alias("oh"), hashes(False).alias("mh"), F.sum(F.pmod(F.xxhash64("id"), F.lit(1 << 40))).alias("who")
    )
    sizes = sizes.where("o > 0 and o + m > 2").groupBy("o", "m", "oh", "mh", "who").agg(F.min("key").alias("key")).drop("who")  # buckets of the same members count once
    blocks = lambda n, h: F.greatest(F.ceil(F.col(n) / BLOCK), F.least(F.col(n), F.ceil(F.col(h) / HASHES))).cast("int")
    sizes = sizes.select("key", blocks("o", "oh").alias("ob"), blocks("m", "mh").alias("mb"))
    of = lambda n: F.pmod(F.xxhash64("id", F.lit("block")), F.greatest(F.col(n), F.lit(1))).cast("int")
    cells = common.cut(placed.join(common.by_key(sizes), "key").withColumn("at", F.when(F.col("outside"), of("ob")).otherwise(of("mb"))), "cells")
    common.dropped(placed)
    if cells.isEmpty():
        common.dropped(cells)
        return None
    wanted = classes.where("own").join(cells.select("id").distinct(), "id", "left_semi").select("id", "digest")
    known = common.cut(full_sets(docs, wanted, size, text), "known")
    row = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = F.col("at")
    inside = F.transform(upto("ob"), lambda j: row("mo", at, j))
    outside = F.concat(
        F.when(F.col("mb") > 0, F.transform(upto("mb"), lambda i: row("mo", i, at))).otherwise(F.array().cast("array<struct<kind:string,i:int,j:int>>")),
        F.transform(upto("ob"), lambda j: row("oo", F.least(at, j), F.greatest(at, j))),
    )
    dealt = cells.select("key", "id", "component", "outside", F.explode(F.when(F.col("outside"), outside).otherwise(inside)).alias("c")).select("key", "c.*", "id", "component", "outside").join(known, "id")
    rest = common.cut(dealt.groupBy("key", "kind", "i", "j").applyInArrow(joining(percent), "a long, b long").distinct(), "rest")
    common.dropped(cells, known)
    return rest


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``; texts
    are linked whose shingle sets have a Jaccard similarity of ``percent``."""
    profile = common.cut(profiled(docs, size, text), "profile")
    full = profile.where("n_shingles > 0 and doc_id is not null")
    ids = common.cut(full.groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    signed = full.join(ids.select("digest", F.col("id").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["digest"]).select(F.col("doc_id").alias("id"), "n_shingles", "digest", "signature", "bands")
    # An id that stands for several sets (it repeats with other texts) has one of them as its own.
    owned = ids.groupBy("id").agg(F.min("digest").alias("digest")).select("digest", F.lit(True).alias("own"))
    classes = common.cut(signed.join(common.by_key(owned), "digest", "left"), "signed")
    signs = classes.where("own").select("id", "signature")
    members = classes.select("id", "n_shingles", F.explode("bands").alias("key")).dropDuplicates(["id", "key"])
    buckets = common.cut(members.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = common.cut(members.join(common.by_key(buckets), "key").select("key", "id", "n_shingles", "pivot", "n"), "members")
    pairs = shared.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    near = pairs.join(signs.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b").join(common.by_key(signs.select(F.col("id").alias("a"), F.col("signature").alias("sa"))), "a").select("a", "b", "sa", "sb")
    near = common.cut(near.mapInArrow(agreeing, "a long, b long"), "near")
    links = verified(near, docs, classes, size, percent, text)
    labels = labelled(links)
    rest = leftovers(shared.where("n > 2"), labels, classes, docs, size, percent, text)
    if rest is not None:
        first = labels
        labels = labelled(first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(rest))
        common.dropped(first, rest)
    common.dropped(classes, buckets, shared, near, links)
    placed = ids.join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    rows = profile.select("doc_id", "n_shingles", "digest")
    out = rows.where("digest is not null and doc_id is not null").join(common.by_key(placed), "digest", "left").select("doc_id", "n_shingles", "component")
    out = out.unionByName(rows.where("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    component = F.coalesce("component", "doc_id")
    made = common.cut(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")), "components")
    common.dropped(profile, ids, labels)
    return made


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), size=4)
