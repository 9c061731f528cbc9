"""Toxicity: a linear-chain conditional random field with two states tags toxic
words; forward-backward marginals give a document score and offending spans.

Words are chunks between ASCII white space.  A word's features are its core
(lower-cased, without punctuation around it), the core's beginnings and its
ends.  Token labels come from document labels: in a toxic document a word is
toxic if one of its features occurs almost only in toxic documents; every other
word, and every word of a clean document, is not.  The CRF learns feature and
transition weights from these by its exact likelihood gradient.

With two states the forward and backward passes are scalar recurrences of odds,
so all documents of a batch run in step.  Long documents run in blocks with a
warm-up that is long enough for the recurrence to forget its start to below
double precision, so marginals are those of the whole text.

A document's score is a logistic function of its largest marginal log-odds and
its expected number of toxic words, fitted on the training rows with the class
shares of all labelled rows.

Defined results: null and empty texts get the score of a text without toxic
words; without labelled rows of both classes the score is the share of toxic
labels (0 without any label).  Ties and repeated rows score alike.
"""

from __future__ import annotations

import json
import math
import re
import string
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import common

#: Bounds of the training sample: rows of each class (0, 1), by hash of the id,
#: and their code points, so many for each of these rows; texts of any length
#: are taken whole until either bound is reached.
SAMPLE, POINTS = (1800, 1400), 4000
#: A feature is telling if it is in this many sampled toxic documents at least
#: and this many times likelier in a toxic document than in a clean one.
LEAST, LIFT = 5, 40.0
#: Features with less lift stay out of the model.
FEATURE_LIFT = 4.0
BEGINNINGS, ENDS = range(3, 9), range(3, 7)
BLOCK = 1024
STEPS = 80
FLOOR = 12.0
EDGE = string.punctuation + "…“”„«»’‘¡¿–—"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def features(word: str) -> list[str]:
    core = word.strip(EDGE)
    n = len(core)
    if not n:
        return []
    return ["=" + core] + [">" + core[:k] for k in BEGINNINGS if k < n] + ["<" + core[-k:] for k in ENDS if k < n]


@dataclass(frozen=True)
class Model:
    """Feature weights, transition log-weights (from, to) and score weights."""

    weights: dict[str, float]
    bias: float
    moves: tuple[float, float, float]  # 0 to 1, 1 to 0, 1 to 1; 0 to 0 is 0
    score: tuple[float, float, float]

    def logits(self, words: list[str]) -> np.ndarray:
        get, bias = self.weights.get, self.bias
        return np.array([bias + sum([get(f, 0.0) for f in features(w)]) for w in words]).clip(-30, 30)


def potentials(moves: tuple[float, float, float]) -> tuple[float, float, float]:
    return tuple(math.exp(x) for x in moves)


def chains(offsets: np.ndarray, moves: tuple[float, float, float]) -> tuple[np.ndarray, ...]:
    """Blocks of the rows: (first inner, first, inner size, size) with warm-ups
    on both sides inside the row."""
    p01, p10, p11 = potentials(moves)
    rate = math.tanh(abs(math.log(p11 / (p01 * p10))) / 4)  # contraction of the odds per step
    warm = 8 if rate < 1e-6 else min(4096, 8 + int(math.ceil(-40.0 / math.log(rate)))) if rate < 1 else 4096
    sizes = np.diff(offsets)
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    inner = offsets[owner] + number * BLOCK
    end = np.minimum(inner + BLOCK, offsets[owner + 1])
    first = np.maximum(inner - warm, offsets[owner])
    last = np.minimum(end + warm, offsets[owner + 1])
    return inner, end, first, last


def marginals(logit: np.ndarray, offsets: np.ndarray, moves: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-odds of the marginals, forward odds, backward odds) of each word."""
    p01, p10, p11 = potentials(moves)
    forward, backward = np.zeros(len(logit)), np.ones(len(logit))
    inner, end, first, last = chains(offsets, moves)
    order = np.argsort(first - last, kind="stable")
    inner, end, first, last = inner[order], end[order], first[order], last[order]
    size = last - first
    odds = np.exp(logit)
    for a in range(0, len(first), 1024):
        at, n, lo, hi = first[a : a + 1024], size[a : a + 1024], inner[a : a + 1024], end[a : a + 1024]
        longest = int(n[0])
        active = np.searchsorted(-n, -np.arange(longest), "left")
        where = at[None, :] + np.arange(longest)[:, None]
        e = odds.take(where, mode="clip")
        own = (where >= lo) & (where < hi)
        r = np.empty_like(e)
        before = e[0]
        r[0] = before
        for t in range(1, longest):
            k = active[t]
            before = before[:k]
            before = e[t, :k] * (p01 + before * p11) / (1.0 + before * p10)
            r[t, :k] = before
        forward[where[own]] = r[own]
        # Backward, from each block's last word.
        s = r
        after = np.ones(len(at))
        for t in range(longest - 1, -1, -1):
            k = active[t]
            if t + 1 < longest:
                k2 = active[t + 1]
                x = e[t + 1, :k2] * after[:k2]
                after[:k2] = (p10 + p11 * x) / (1.0 + p01 * x)
            s[t, :k] = after[:k]
        backward[where[own]] = s[own]
    with np.errstate(divide="ignore"):
        return np.log(forward) + np.log(backward), forward, backward


def train(docs: list[tuple[str, int]], share: float) -> Model:
    """Fit on (text, label) rows; ``share`` is that of toxic rows among all
    labelled rows."""
    toxic = sum(label for _, label in docs)
    if not toxic or toxic == len(docs):
        share = min(max(share, 1e-6), 1 - 1e-6) if docs else 1e-6
        return Model({}, -FLOOR, (0.0, 0.0, 0.0), (math.log(share / (1 - share)), 0.0, 0.0))
    clean = len(docs) - toxic
    texts = pc.utf8_lower(pa.array([text for text, _ in docs], pa.string()))  # as judge() does
    words, codes, offsets = common.unique_words(texts)
    words = words.to_pylist()
    row = np.repeat(np.arange(len(docs)), np.diff(offsets))
    label = np.array([x for _, x in docs])
    # In how many documents of each class a feature occurs.
    # Features count by 64-bit hashes; only those in use get their names back.
    digest = xxhash.xxh3_64_intdigest
    found, lengths = array("Q"), np.empty(len(words), np.int64)
    for i, w in enumerate(words):
        own = features(w)
        lengths[i] = len(own)
        found.extend([digest(f) for f in own])
    index, pool = np.unique(np.frombuffer(found, np.uint64) if found else np.zeros(0, np.uint64), return_inverse=True)
    pool = pool.astype(np.int32)
    del found
    starts = np.cumsum(lengths) - lengths
    pairs = np.unique(row * np.int64(len(words)) + codes)
    owner, word = pairs // len(words), pairs % len(words)
    from tideline.llm.quality import ranges

    ones, zeros = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
    for a in range(0, len(docs), 128):  # few documents at a time: less memory
        part = slice(*np.searchsorted(owner, [a, a + 128]))
        seen = np.unique(np.repeat(owner[part], lengths[word[part]]) * np.int64(len(index)) + pool[ranges(starts[word[part]], lengths[word[part]])])
        toxic_one, feature = label[seen // len(index)] == 1, seen % len(index)
        ones += np.bincount(feature[toxic_one], minlength=len(index))
        zeros += np.bincount(feature[~toxic_one], minlength=len(index))
    lift = (ones / toxic) / ((zeros + 1) / clean)
    telling = (ones >= LEAST) & (lift >= LIFT)
    used = (ones >= LEAST) & (lift >= FEATURE_LIFT)
    column = np.cumsum(used) - 1
    place = {int(h): int(column[k]) for k, h in enumerate(index) if used[k]}
    names = [""] * len(place)
    for w in words:
        for f in features(w):
            if (k := place.get(digest(f))) is not None:
                names[k] = f
    # Sparse word-by-feature matrix of the used features.
    take = used[pool]
    m_word, m_feature = np.repeat(np.arange(len(words)), lengths)[take], column[pool[take]]
    strong = np.zeros(len(words), bool)
    strong[np.repeat(np.arange(len(words)), lengths)[telling[pool]]] = True
    y = (strong[codes] & (label[row] == 1)).astype(float)
    # Only classes' shares of the sample differ from those of all rows.
    weight = np.where(label == 1, share / toxic, (1 - share) / clean) * len(docs)
    w = weight[row]
    theta = np.zeros(len(names) + 4)
    theta[-4] = -4.0
    moment, second = np.zeros_like(theta), np.zeros_like(theta)
    first_word = np.zeros(len(codes), bool)
    first_word[offsets[:-1][np.diff(offsets) > 0]] = True
    inside = np.flatnonzero(~first_word)  # words with one before them
    y_before = y[inside - 1]
    want = np.array([(w[inside] * y[inside] * (1 - y_before)).sum(), (w[inside] * (1 - y[inside]) * y_before).sum(), (w[inside] * y[inside] * y_before).sum()])
    scale = 1.0 / w.sum()
    for step in range(1, STEPS + 1):
        per_word = np.bincount(m_word, theta[m_feature], len(words))
        logit = (per_word + theta[-4])[codes].clip(-30, 30)
        moves = tuple(theta[-3:])
        p01, p10, p11 = potentials(moves)
        log_odds, forward, backward = marginals(logit, offsets, moves)
        p = 1.0 / (1.0 + np.exp(-log_odds))
        # Marginals of neighbours: from the odds before, the word's, and after.
        f, x = forward[inside - 1], np.exp(logit[inside]) * backward[inside]
        z = 1.0 + p01 * x + f * p10 + f * p11 * x
        expected = np.array([(w[inside] * p01 * x / z).sum(), (w[inside] * f * p10 / z).sum(), (w[inside] * f * p11 * x / z).sum()])
        off = w * (y - p)
        by_word = np.bincount(codes, off, len(words))
        grad = np.concatenate((np.bincount(m_feature, by_word[m_word], len(names)), [by_word.sum()], want - expected)) * scale
        grad -= 1e-6 * theta
        moment = 0.9 * moment + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta = theta + 0.25 * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        theta[-3:] = theta[-3:].clip(-6, 6)
    moves = tuple(float(x) for x in theta[-3:])
    crf = Model({f: float(x) for f, x in zip(names, theta, strict=False) if x}, float(theta[-4]), moves, (0.0, 0.0, 0.0))
    top, total = summary(marginals(crf.logits(words)[codes], offsets, moves)[0], offsets)
    x = np.stack((np.ones(len(docs)), top, np.log1p(total)), axis=1)
    c = np.zeros(3)
    for _ in range(50):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-(x @ c).clip(-30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-2, 1e-2])
        c = c + np.linalg.solve(hessian, x.T @ (weight * (label - p)) - np.array([1e-3, 1e-2, 1e-2]) * c)
    return Model(crf.weights, crf.bias, moves, tuple(float(v) for v in c))


def summary(log_odds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(largest log-odds within +-FLOOR, expected toxic words) of each row."""
    rows = len(offsets) - 1
    top = np.full(rows, -FLOOR)
    some = np.diff(offsets) > 0
    if some.any():
        top[some] = np.maximum.reduceat(log_odds, offsets[:-1][some]).clip(-FLOOR, FLOOR)
    return top, common.per_row(1.0 / (1.0 + np.exp(-log_odds)), offsets)


def judge(texts: pa.Array, model: Model) -> tuple[np.ndarray, list[str]]:
    """(score, offending spans as start:end in code points, comma-joined) of each text."""
    texts = pc.fill_null(common.flat(texts).cast(pa.string()), "")
    words, codes, offsets = common.unique_words(pc.utf8_lower(texts))
    logit = model.logits(words.to_pylist())
    log_odds = marginals(logit[codes] if len(codes) else np.zeros(0), offsets, model.moves)[0]
    top, total = summary(log_odds, offsets)
    c = model.score
    score = 1 / (1 + np.exp(-(c[0] + c[1] * top + c[2] * np.log1p(total)).clip(-30, 30)))
    spans = [""] * len(texts)
    hits = np.flatnonzero(log_odds > 0)
    owner = np.searchsorted(offsets, hits, "right") - 1
    for i in np.unique(owner):
        marked = set((hits[owner == i] - offsets[i]).tolist())
        spans[i] = ",".join(f"{m.start()}:{m.end()}" for k, m in enumerate(WORD.finditer(texts[int(i)].as_py())) if k in marked)
    return score, spans


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    """Learn from ``docs`` (doc_id, text) joined with ``labels`` (doc_id, toxic).

    Rows with a null id, text or label teach nothing.  At most ``sample`` rows
    of each class are taken, chosen by a hash of the id, whatever their length;
    long texts make them fewer.  One task learns from them, and only the model
    reaches the driver.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return train([], 0.0)
    near = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    # Some ids may have no text, so half as many again are looked up.
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * sample[k] / n)))])
    ids = known.where(near < share[F.col("toxic")]).orderBy(near).limit(2 * sum(sample))
    rows = (
        docs.select("doc_id", "text")
        .where("text is not null")
        .join(F.broadcast(ids), "doc_id")  # at most 2 * sum(sample) ids
        .select(near.alias("at"), "text", "toxic")
        .orderBy("at", "text")
        .limit(2 * sum(sample))
    )
    own = Window.partitionBy("toxic").orderBy("at", "text")
    before = F.coalesce(F.sum(F.length("text")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = F.when(F.col("toxic") == 1, sample[1]).otherwise(sample[0])
    chosen = rows.select("at", "text", "toxic", F.row_number().over(own).alias("n"), before.alias("before")).where((F.col("n") <= most) & (F.col("before") < most * POINTS))
    part = sizes.get(1, 0) / sum(sizes.values())

    def learn(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("at", "ascending"), ("text", "ascending")])
        model = train(list(zip(rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), strict=True)), part)
        return pa.table({"model": [json.dumps(model.__dict__)]})

    # The sample is bounded, so one task learns from it, away from the driver.
    found = chosen.select("at", "text", "toxic", F.lit(1).alias("one")).groupBy("one").applyInArrow(learn, "model string").collect()
    if not found:
        return train([], part)
    got = json.loads(found[0]["model"])
    return Model(got["weights"], got["bias"], tuple(got["moves"]), tuple(got["score"]))


def scored(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all, if not given) with ``score``,
    ``predicted`` (1 from 0.5 on) and ``toxic_spans``."""
    made = ["score", "predicted", "toxic_spans"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    common.arrow_batches(docs.sparkSession)
    source, kept = common.through(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 4 << 20):
            score, spans = judge(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([*kept(batch), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, pa.string())], names=[*keep, *made])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("score", "double", True).add("predicted", "integer", True).add("toxic_spans", "string", True)
    return source.mapInArrow(lambda batches: common.trimmed(run(batches)), schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    labels = common.table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~common.held_out()))
    return scored(docs.withColumn("held_out", common.held_out()), model, keep=["doc_id", "held_out"])
