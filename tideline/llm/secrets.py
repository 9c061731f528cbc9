"""Secret scans with DataFrame functions only.

Base patterns find assigned values, access keys and long hex runs.  Beyond
them, two first-order character Markov models, of random strings and of
ordinary identifiers, are compared by log-likelihood ratio on every run of key
characters; runs that look random are added as ``markov`` spans where no base
span overlaps them.

The models are trained from labelled samples: identifiers are the letter words
of sampled documents, alone and joined in snake, kebab and path form; random
strings are digests in hex, base64 and base-36-like spellings.  Only counts of
character pairs (at most 128 x 128 per label) reach the driver.

Matches' places come from the pieces between them: the lengths of the pieces
and matches before a match add up to its start.  Running sums and maxima go by
chunks (``running``), so cost is linear in a text and in its matches.  Offsets
are code points, ends exclusive.

Defined results: a null text is an empty one, without spans; texts of any length
are scanned whole; repeated rows have their spans each; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import math
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import common

#: Kinds in order, with their patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
ASSIGN_SEEN = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
KINDS = ("assign", "access", "hex", "markov")

#: Runs that the Markov models look at.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
RUN_SEEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20}"
#: A run is random if its log-likelihood ratio reaches both, in nats.
LEAST_TOTAL, LEAST_MEAN = 20.0, 0.8
#: Bounds of the training samples.
TEXTS, RANDOM = 400, 4000
MARK = "<SECRET>"

SPAN = "struct<start:int,end:int,kind:int>"
#: Elements that a running sum takes at a time, and code points of a text's pieces.
CHUNK, PIECE = 32, 4096


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column] = operator.add, levels: int = 3) -> Column:
    """Running sums (or what else ``join`` gives, from 0 up) of an array<int>.

    A fold that appends copies its array each time, so it runs over chunks; the
    chunks' totals run the same way, and the last level's few as one."""
    none = F.array().cast("array<int>")

    def folded(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("last"), none.alias("out"))
        step = lambda acc, x: let(join(acc["last"], x), lambda now: F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out")))
        return F.aggregate(part, start, step, lambda acc: acc["out"])

    if levels == 1:
        return folded(values)

    def chunked(v: Column) -> Column:
        n = F.ceil(F.size(v) / CHUNK).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda c: folded(F.slice(v, c * CHUNK + 1, F.lit(CHUNK))))).otherwise(F.array().cast("array<array<int>>"))

    def placed(chunks: Column) -> Column:
        before = running(F.transform(chunks, lambda x: F.get(x, F.size(x) - 1)), join, levels - 1)
        return let(before, lambda b: F.flatten(F.transform(chunks, lambda x, c: let(F.coalesce(F.get(b, c - 1), F.lit(0)), lambda at: F.transform(x, lambda y: join(at, y))))))

    return let(let(values, chunked), placed)


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<start, end, text, part>> of the leftmost non-overlapping
    matches; ``part`` is the given group."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits

    def placed(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda x: F.length(x["gap"]) + F.length(x["hit"])))
        return let(ends, lambda e: F.transform(rows, lambda x, i: F.struct((F.get(e, i) - F.length(x["hit"])).alias("start"), F.get(e, i).alias("end"), x["hit"].alias("text"), x["part"].alias("part"))))

    # The gap before each match; what follows the last one is left out.
    zipped = let(hits, lambda h: F.arrays_zip(h.alias("hit"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(h)).alias("gap"), parts.alias("part")))
    return let(zipped, placed)


def as_spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def nothing() -> Column:
    return F.array().cast(f"array<{SPAN}>")


class Model:
    """Log-likelihood ratios of character pairs, 128 x 128, in nats."""

    def __init__(self, ratios: list[float]):
        self.ratios = ratios

    def ratio(self, run: Column) -> Column:
        """Summed log-likelihood ratio of a run's pairs."""
        table = F.from_json(F.lit(json.dumps([round(x, 6) for x in self.ratios])), "array<double>")  # folded to one literal
        codes = F.transform(F.filter(F.split(run, "", -1), lambda c: c != ""), lambda c: F.ascii(c))
        return F.aggregate(
            F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))),
            F.struct(F.get(codes, F.lit(0)).alias("before"), F.lit(0.0).alias("sum")),
            lambda acc, c: F.struct(c.alias("before"), (acc["sum"] + F.get(table, acc["before"] * 128 + c)).alias("sum")),
            lambda acc: acc["sum"],
        )


def pair_counts(samples: DataFrame) -> DataFrame:
    """(label, pair, n) of samples (label, word)."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))
    return samples.where(F.length("word") >= 2).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n"))


def labelled_samples(docs: DataFrame, text: str, texts: int, random: int) -> DataFrame:
    """(label, word): 0 for ordinary identifiers, 1 for random strings."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{text}`").alias("text")).where("text is not null").withColumn("h", F.xxhash64("text"))
    n = rows.agg(F.approx_count_distinct("h")).first()[0]
    share = min(1.0, texts / max(1, n))
    near = rows.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["h"])
    words = near.select("h", F.filter(F.split("text", r"[^A-Za-z]+", -1), lambda w: (F.length(w) >= 2) & (F.length(w) < 20)).alias("w"))
    three = lambda sep: F.transform(F.sequence(F.lit(0), F.size("w") - 3, F.lit(3)), lambda i: F.concat_ws(sep, F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    ordinary = words.where(F.size("w") >= 3).select(F.lit(0).alias("label"), F.explode(F.concat(F.col("w"), *[three(s) for s in ("_", "-", "/", "")])).alias("word"))
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    spelled = F.array(digest, F.base64(F.unhex(digest)), F.translate(F.base64(F.unhex(digest)), "+/=", "-_"), F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", "")))
    made = spark.range(random).select(F.lit(1).alias("label"), F.explode(spelled).alias("word"))
    return ordinary.unionByName(made)


def train(samples: DataFrame) -> Model:
    """From samples (label, word), by pair counts with a half added to each."""
    letters = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]
    counts: tuple[dict, dict] = ({}, {})
    for r in pair_counts(samples).collect():  # at most two rows for each pair of key characters
        if len(r["pair"]) == 2 and all(ord(c) < 128 for c in r["pair"]):
            counts[r["label"]][ord(r["pair"][0]), ord(r["pair"][1])] = r["n"]
    ratios = [0.0] * (128 * 128)
    logs = []
    for c in counts:
        # A pair's probability leans on how common its second character is.
        second = {b: 0.5 for b in letters}
        for (_, b), n in c.items():
            if b in second:
                second[b] += n
        total = sum(second.values())
        table = {}
        for a in letters:
            row = sum(c.get((a, b), 0) for b in letters)
            for b in letters:
                table[a, b] = math.log((c.get((a, b), 0) + 20 * second[b] / total) / (row + 20))
        logs.append(table)
    for a, b in logs[0]:
        ratios[a * 128 + b] = max(-6.0, min(6.0, logs[1][a, b] - logs[0][a, b]))
    return Model(ratios)


def fit(docs: DataFrame, text: str = "text", texts: int = TEXTS, random: int = RANDOM) -> Model:
    """Train on identifiers of about ``texts`` distinct texts, chosen by hash,
    and on four spellings of each of ``random`` digests."""
    return train(labelled_samples(docs, text, texts, random))


def scanned(docs: DataFrame, model: Model, text: str = "text", to: str = "secret_spans", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``columns``) with ``to``: an array of (start, end, kind
    number in KINDS), sorted by start, then kind."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = nothing()
    assign = F.when(t.rlike(ASSIGN_SEEN), as_spans(F.filter(matches(t, ASSIGN, 2), lambda m: F.length(m["part"]) >= ASSIGN_LEAST), 0)).otherwise(none)
    access = F.when(t.contains("AKIA"), as_spans(F.filter(matches(t, ACCESS), lambda m: F.length(m["text"]) >= ACCESS_LEAST), 1)).otherwise(none)
    runs = F.when(
        t.rlike(RUN_SEEN),
        F.struct(
            as_spans(matches(t, HEX), 2).alias("hex"),
            as_spans(F.filter(F.transform(matches(t, RUN), lambda m: F.struct(m["start"], m["end"], model.ratio(m["text"]).alias("llr"))), lambda m: (m["llr"] >= LEAST_TOTAL) & (m["llr"] >= LEAST_MEAN * (m["end"] - m["start"]))), 3).alias("markov"),
        ),
    )
    names = [c for c in (docs.columns if columns is None else columns) if c != to]
    kept = [f"k{i}" for i in range(len(names))]
    found = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(kept, names, strict=True)], F.concat(assign, access).alias("first"), runs.alias("runs"))
    found = found.select(*kept, F.concat("first", F.coalesce(F.col("runs.hex"), none)).alias("base"), F.coalesce(F.col("runs.markov"), none).alias("more"))
    ordered = F.array_sort(F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))

    def clear(rows: Column) -> Column:
        """Without runs that overlap a base span: one before (by the furthest end
        so far) or one that starts next."""
        ends = running(F.transform(rows, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(F.lit(0))), F.greatest)

        def stays(e: Column, x: Column, i: Column) -> Column:
            after = F.get(rows, i + 1)
            return (x["kind"] < 3) | ((F.coalesce(F.get(e, i - 1), F.lit(0)) <= x["start"]) & ~F.coalesce((after["kind"] < 3) & (after["start"] < x["end"]), F.lit(False)))

        return let(ends, lambda e: F.filter(rows, lambda x, i: stays(e, x, i)))

    spans = F.transform(F.when(F.size("more") > 0, let(ordered, clear)).otherwise(ordered), lambda s: F.struct(s["start"], s["end"], s["kind"])).cast(f"array<{SPAN}>")
    return found.select(*[F.col(k).alias(c) for k, c in zip(kept, names, strict=True)], spans.alias(to))


def redacted(text: Column, spans: Column, mark: str = MARK) -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by ``mark``."""

    def between(pieces: Column, a: Column, b: Column | None) -> Column:
        """Code points ``a`` to ``b`` (or to the end), from pieces of the text."""
        first, at = (a / PIECE).cast("int"), (a % PIECE) + 1
        head = F.coalesce(F.get(pieces, first).substr(at, F.lit(PIECE)), F.lit(""))
        if b is None:
            return F.concat(head, F.array_join(F.slice(pieces, first + 2, F.size(pieces)), ""))
        last = (b / PIECE).cast("int")
        middle = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        tail = F.coalesce(F.get(pieces, last).substr(F.lit(1), b % PIECE), F.lit(""))
        return F.when(first == last, F.coalesce(F.get(pieces, first).substr(at, b - a), F.lit(""))).otherwise(F.concat(head, middle, tail))

    def cut(pieces: Column, s: Column, ends: Column) -> Column:
        gaps = F.filter(F.transform(s, lambda x, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("a"), x["start"].alias("b"))), lambda g: g["a"] <= g["b"])
        kept = F.transform(gaps, lambda g: F.concat(between(pieces, g["a"], g["b"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), between(pieces, F.get(ends, F.size(ends) - 1), None))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    whole = let(pieces, lambda p: let(spans, lambda s: let(running(F.transform(s, lambda x: x["end"]), F.greatest), lambda e: cut(p, s, e))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = scanned(docs, fit(docs), columns=["doc_id"])
    spans = F.col("secret_spans")
    n = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled(spans).alias("spans"), n(3).alias("n_markov"))
