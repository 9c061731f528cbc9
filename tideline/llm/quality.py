"""Quality rules: base counts of a text and its fertility under public vocabularies.

Base counts are plain: words, their characters, symbols, repeated lines, words
in repeated 3-word windows.  Fertility looks at how each of several public
vocabularies takes the text: characters per token, the share of byte-fallback
tokens (single bytes of a character) and the entropy of the token distribution.

Rejection bands are fitted on all distinct texts that pass the base rule: within
a language (where rows name one) or a script, and within texts of like length (an
octave of tokens, as entropy grows with length), a value more than ``WIDTH``
quartile ranges beyond the quartiles lies outside.  A text outside any band of
its group is rejected.  Groups with too few texts use their script's bands of
that length, else the wide bands in ``BANDS``.  The quartiles are exact: counts
of fine bins tell which bins hold them, and only the values there are sorted.

Defined results: a null or empty text has 0 words, fails the base rule
(n_words < 50) and is not kept; its fertility columns are null, as are those of
a text whose words give no token, which has no part in the bands and is not kept
either.  Texts of any length are measured whole; repeated rows are judged alike
and count once for the bands of each language they name and once for their
script's; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import common

VOCABULARY = "piece_bpe_32k.model"
#: The vocabularies whose fertility counts.
VOCABULARIES = (VOCABULARY, "byte_bpe_50k.tiktoken")
SYMBOLS = "[#*$%&|<>]"
#: Distinct words whose tokens one Python worker keeps.
CACHE = 40_000
#: Tokens from which on a text is expected to show the full entropy of prose.
REACH = 512
#: Distinct texts that a group must have, quartile ranges beyond the quartiles
#: where its band ends, and bins to a unit of a measure.
ROWS, WIDTH, BINS = 30, 2.5, 256
#: Measures with a band, and the least range of quartiles that counts.
MEASURES = {"chars_per_token": 0.04, "byte_share": 0.02, "token_entropy": 0.1}


@dataclass(frozen=True)
class Band:
    """Accepted fertility: characters per token, byte share, and token entropy
    as a share of what the text can reach."""

    low: float
    high: float
    bytes: float
    entropy: float


#: Scripts by their code point ranges (fixed values), the rest is "other".
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F),)),
    ("semitic", ((0x590, 0x6FF), (0x750, 0x77F))),
    ("indic", ((0x900, 0xDFF),)),
    ("kana", ((0x3040, 0x30FF),)),
    ("hangul", ((0xAC00, 0xD7A3), (0x1100, 0x11FF))),
    ("han", ((0x3400, 0x9FFF), (0x20000, 0x2FFFF))),
)
#: A vocabulary made mostly from Latin text splits other scripts finer.
BANDS = {
    "latin": Band(1.3, 8.0, 0.10, 0.42),
    "greek": Band(0.7, 6.0, 0.30, 0.35),
    "cyrillic": Band(0.9, 8.0, 0.30, 0.40),
    "semitic": Band(0.5, 6.0, 0.60, 0.35),
    "indic": Band(0.3, 6.0, 0.90, 0.30),
    "kana": Band(0.4, 6.0, 0.75, 0.35),
    "hangul": Band(0.3, 6.0, 0.85, 0.30),
    "han": Band(0.3, 6.0, 0.85, 0.30),
    "other": Band(0.25, 8.0, 0.95, 0.30),
}
NAMES = [name for name, _ in SCRIPTS] + ["other"]


def script_table() -> np.ndarray:
    table = np.full(0x110000, len(SCRIPTS), np.uint8)
    for k, (_, ranges) in enumerate(SCRIPTS):
        for lo, hi in ranges:
            table[lo : hi + 1] = k
    return table


class Tokens:
    """Token ids of words under one vocabulary: a piece model with byte fallback
    or the ranks of a byte-level one (a word with the blank before it)."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = self.model.get_piece_size()
            self.byte = np.array([self.model.is_byte(i) for i in range(self.size)])
            self.encode = lambda words: self.model.encode(words, num_threads=1)
        else:
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.model = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.size = max(ranks.values()) + 1
            self.byte = np.zeros(self.size, bool)
            self.byte[[i for piece, i in ranks.items() if len(piece) == 1 and piece[0] >= 0x80]] = True
            self.encode = lambda words: [self.model.encode_ordinary(" " + w) for w in words]
        self.seen: dict[str, np.ndarray] = {}

    def __call__(self, words: list[str]) -> list[np.ndarray]:
        seen = self.seen
        out = [seen.get(w) for w in words]
        new = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(new), 8192):
            some = new[at : at + 8192]
            for i, ids in zip(some, self.encode([words[i] for i in some]), strict=True):
                out[i] = np.array(ids, np.int32)
        for i in new:
            if len(words[i]) <= 48:
                if len(seen) >= CACHE:
                    seen.clear()
                seen[words[i]] = out[i]
        return out


_state: dict[str, tuple[Tokens, np.ndarray]] = {}


def state(path: str) -> tuple[Tokens, np.ndarray]:
    if path not in _state:
        _state[path] = (Tokens(path), script_table())
    return _state[path]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... of each range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def repeated_words(codes: np.ndarray, offsets: np.ndarray, vocabulary: int) -> np.ndarray:
    """Words in 3-word windows that occur twice or more in their text."""
    sizes = np.diff(offsets)
    n = len(codes)
    if n < 4:
        return np.zeros(len(sizes), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    wide = codes.astype(np.int64)
    pair = wide[:-2] * vocabulary + wide[1:-1]
    if vocabulary < 1 << 20:
        window = pair * vocabulary + wide[2:]
    else:  # the triple would not fit: number the pairs first
        window = np.unique(pair, return_inverse=True)[1].astype(np.int64) * vocabulary + wide[2:]
    inside = row[:-2] == row[2:]
    at = np.flatnonzero(inside)
    key, owner = window[at], row[at]
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    same = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[at[order[twice]] + k] = True
    return common.per_row(hit.astype(np.int64), offsets)


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """\\n-split lines with a word, equal to an earlier line of their text."""
    parts = pc.split_pattern(texts, "\n")
    lo, hi = parts.offsets[0].as_py(), parts.offsets[-1].as_py()
    offsets = parts.offsets.to_numpy() - lo
    encoded = common.flat(parts.values.slice(lo, hi - lo)).dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(codes):
        return np.zeros(len(texts), np.int64)
    worded = pc.not_equal(pc.ascii_trim_whitespace(encoded.dictionary), "").to_numpy(zero_copy_only=False)[codes]
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    keys = np.sort(row[worded] * np.int64(len(encoded.dictionary)) + codes[worded])
    again = keys[1:][keys[1:] == keys[:-1]] // np.int64(len(encoded.dictionary))
    return np.bincount(again, minlength=len(texts)).astype(np.int64)


def fertility(tokens: Tokens, words: list[str], codes: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_tokens, byte tokens and token entropy of each text under one vocabulary."""
    rows = len(offsets) - 1
    spread = lambda x: common.per_row(x[codes] if len(codes) else np.zeros(0, x.dtype), offsets)
    ids = tokens(words)
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    pool = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    starts = np.cumsum(lengths) - lengths
    n = spread(lengths)
    fallback = spread(np.add.reduceat(np.append(tokens.byte[pool], False).astype(np.int64), starts) * (lengths > 0) if len(ids) else lengths)
    entropy = np.zeros(rows)
    step = max(1, (4 << 20) // max(1, int(n.max()) if rows else 1))
    for a in range(0, rows, step):  # tokens of a few rows at a time
        b = min(rows, a + step)
        some = codes[offsets[a] : offsets[b]]
        if not len(some):
            continue
        each = pool[ranges(starts[some], lengths[some])]
        owner = np.repeat(np.arange(b - a), n[a:b])
        keys = np.sort(owner * np.int64(tokens.size) + each)
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        times, owner = np.diff(edge), keys[edge[:-1]] // tokens.size
        total = n[a:b][owner]
        entropy[a:b] = np.bincount(owner, -times / total * np.log2(times / total), minlength=b - a)
    return {"n_tokens": n, "byte_share": fallback / np.maximum(n, 1), "token_entropy": entropy}


def measure(texts: pa.Array, paths: Sequence[str]) -> dict[str, np.ndarray]:
    """Base counts, script, and the fertility under each vocabulary; measures of
    the second and later ones end in _2, _3, ..."""
    texts = pc.fill_null(common.flat(texts).cast(pa.string()), "")
    words, codes, offsets = common.unique_words(texts)
    rows = len(texts)
    spread = lambda x: common.per_row(x[codes] if len(codes) else np.zeros(0, x.dtype), offsets)
    as_np = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
    out = {
        "n_words": np.diff(offsets),
        "word_chars": spread(as_np(pc.utf8_length(words))),
        "n_symbols": spread(as_np(pc.count_substring_regex(words, SYMBOLS))),
        "n_dup_lines": repeated_lines(texts),
        "n_repeat_words": repeated_words(codes, offsets, max(1, len(words))),
    }
    listed = words.to_pylist()
    for k, path in enumerate(paths):
        found = fertility(state(path)[0], listed, codes, offsets)
        found["chars_per_token"] = out["word_chars"] / np.maximum(found["n_tokens"], 1)
        out |= {name + (f"_{k + 1}" if k else ""): x for name, x in found.items()}
    # Script of a text: the script of most of its letters.
    points = np.frombuffer("".join(listed).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = as_np(pc.utf8_length(words))
    of = state(paths[0])[1][points]
    edges = np.cumsum(chars) - chars
    votes = np.stack([spread(np.add.reduceat(np.append(of == k, False).astype(np.int64), edges) * (chars > 0) if len(words) else chars) for k in range(len(NAMES) - 1)], axis=1) if len(words) else np.zeros((rows, len(NAMES) - 1), np.int64)
    out["script"] = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(NAMES) - 1)
    return out


def octave(tokens: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(tokens, 1))).astype(np.int64)


#: (lower, upper) ends of each measure of a group (language, "script" and its
#: name) at an octave of tokens.
Fitted = dict[tuple[str, str, int], dict[str, tuple[float, float]]]


def verdict(m: dict[str, np.ndarray], languages: list[str | None], fitted: Fitted) -> np.ndarray:
    """True where a text's fertility lies in all bands of its group."""
    get = lambda field: np.array([getattr(BANDS[name], field) for name in NAMES])[m["script"]]
    share = m["token_entropy"] / np.log2(np.clip(m["n_tokens"], 2, REACH))
    cpt = m["chars_per_token"]
    out = (cpt >= get("low")) & (cpt <= get("high")) & (m["byte_share"] <= get("bytes")) & (share >= get("entropy"))
    if fitted:
        for i, (lang, script, at) in enumerate(zip(languages, m["script"].tolist(), octave(m["n_tokens"]).tolist(), strict=True)):
            ends = fitted.get(("lang", lang, at)) if lang is not None else None
            ends = ends or fitted.get(("script", NAMES[script], at))
            if ends:
                out[i] = all(lo <= m[name][i] <= hi for name, (lo, hi) in ends.items())
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def failing(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def measures(paths: Sequence[str]) -> list[str]:
    return [name + (f"_{k + 1}" if k else "") for k in range(len(paths)) for name in MEASURES]


def added(paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """All columns that ``assessed`` adds, and those of the fertility."""
    fertile = [name + (f"_{k + 1}" if k else "") for k in range(len(paths)) for name in ("n_tokens", *MEASURES)]
    return [*COUNTS, "base_failed", "kept", "script", *fertile], fertile


def vocabularies(paths: Sequence[str] | None) -> list[str]:
    import public_tokenizers

    return list(paths or [public_tokenizers.path(name) for name in VOCABULARIES])


def quartiles(values: DataFrame, least: int) -> DataFrame:
    """Exact quartiles ``low`` and ``high`` (between two values by proportion) of
    ``value`` in each group of the other columns with ``least`` rows or more."""
    group = [c for c in values.columns if c != "value"]
    values = values.withColumn("bin", F.floor(F.col("value") * BINS))
    whole, running = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counted = values.groupBy(*group, "bin").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(whole)).withColumn("before", F.sum("n").over(running) - F.col("n")).where(F.col("total") >= least)
    # Ranks from 0, the values on both sides of each quartile.
    ranks = F.array(*[F.expr(x) for x in ("(total - 1) div 4", "(total + 2) div 4", "3 * (total - 1) div 4", "3 * total div 4")])
    holds = lambda rank: (rank >= F.col("before")) & (rank < F.col("before") + F.col("n"))
    held = common.cut(counted.where(F.exists(ranks, holds)).drop("n"), "bins")  # written, so that its size is known where it is joined
    within = Window.partitionBy(*group, "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    near = values.join(held, [*group, "bin"]).groupBy(*group, "total", "bin", "before", "value").agg(F.count("*").alias("n")).withColumn("before", F.col("before") + F.sum("n").over(within) - F.col("n"))
    at = [F.max(F.when(holds(ranks[k]), F.col("value"))).alias(f"v{k}") for k in range(4)]
    part = lambda times: (F.lit(times) * (F.col("total") - 1) % 4) / 4
    between = lambda a, b, t: F.when(F.col(a) == F.col(b), F.col(a)).otherwise((1 - t) * F.col(a) + t * F.col(b))
    out = near.groupBy(*group, "total").agg(*at).select(*group, between("v0", "v1", part(1)).alias("low"), between("v2", "v3", part(3)).alias("high"))
    out.reads = held
    return out


def bands(rows: DataFrame, names: Sequence[str]) -> Fitted:
    """Bands from all rows of ``measured`` that pass the base rule.  They come to
    the driver: one entry for each language or script and octave that has ``ROWS``
    texts."""
    groups = F.explode(F.array(F.struct(F.lit("lang").alias("by"), F.col("lang").alias("name")), F.struct(F.lit("script").alias("by"), F.col("script").alias("name")))).alias("g")
    octaves = (F.length(F.bin(F.greatest("n_tokens", F.lit(1)))) - 1).cast("long").alias("octave")
    texts = rows.where("not base_failed and n_tokens > 0").select(groups, octaves, "key", *names).where("g.name is not null").select("g.by", "g.name", "octave", "key", *names)
    texts = common.cut(texts.dropDuplicates(), "texts")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in names])).alias("m")
    found = quartiles(texts.select("by", "name", "octave", each).select("by", "name", "octave", "m.measure", "m.value"), ROWS)

    def ends(name: str, low: float, high: float) -> tuple[float, float]:
        room = WIDTH * max(high - low, MEASURES[name.rstrip("_0123456789")])
        return (float("-inf") if name.startswith("byte_share") else low - room), high + room

    out: Fitted = {}
    for r in found.collect():
        out.setdefault((r["by"], r["name"], r["octave"]), {})[r["measure"]] = ends(r["measure"], r["low"], r["high"])
    common.dropped(texts, found.reads)
    return out


def measured(docs: DataFrame, text: str, keep: list[str], lang: str | None, paths: Sequence[str]) -> DataFrame:
    """``assessed`` before bands are fitted, written once: columns ``keep`` as k0,
    k1, ..., the language and a key that copies of a text share."""
    named = docs.withColumn("__lang", F.col(f"`{lang}`").cast("string") if lang else F.lit(None).cast("string"))
    rows = common.positional(named, keep, text=text, lang="__lang").withColumn("key", F.xxhash64("text"))
    return common.cut(assessed(rows, keep=[*[f"k{i}" for i in range(len(keep))], "lang", "key"], paths=paths), "measured")


def fit(docs: DataFrame, text: str = "text", lang: str | None = None, paths: Sequence[str] | None = None) -> Fitted:
    """Bands from all distinct texts of ``docs``; ``lang`` names a column of
    languages, if there is one (null: by script only)."""
    paths = vocabularies(paths)
    rows = measured(docs, text, [], lang, paths)
    fitted = bands(rows, measures(paths))
    common.dropped(rows)
    return fitted


def assessed(docs: DataFrame, fitted: Fitted | None = None, text: str = "text", keep: list[str] | None = None, lang: str | None = None, paths: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all, if not given) with the base counts,
    base_failed, kept, and the fertility behind the verdict.  ``lang`` names the
    column that was given to ``fit``."""
    paths, fitted = vocabularies(paths), fitted or {}
    made, fertile = added(paths)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    common.arrow_batches(docs.sparkSession)
    named = docs.withColumn("__lang", F.col(f"`{lang}`").cast("string") if lang else F.lit(None).cast("string"))
    source, kept = common.through(named, [*keep, "__lang"], text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 4 << 20):
            m = measure(batch.column("text"), paths)
            failed = failing(m)
            none = m["n_tokens"] == 0
            *own, languages = kept(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    *own,
                    *[pa.array(m[c], pa.int64()) for c in COUNTS],
                    pa.array(failed),
                    pa.array(~failed & ~none & verdict(m, languages.to_pylist(), fitted)),
                    pa.array(NAMES, pa.string()).take(pa.array(m["script"])),
                    *[pa.array(m[c], pa.int64()) if c.startswith("n_tokens") else pa.array(m[c], pa.float64(), mask=none) for c in fertile],
                ],
                names=[*keep, *made],
            )

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    for name in made:
        schema = schema.add(name, "long" if name in COUNTS or name.startswith("n_tokens") else "boolean" if name in ("base_failed", "kept") else "string" if name == "script" else "double", True)
    return source.mapInArrow(lambda batches: common.trimmed(run(batches)), schema)


def screened(docs: DataFrame, text: str = "text", keep: list[str] | None = None, lang: str | None = None, paths: Sequence[str] | None = None) -> DataFrame:
    """``assessed`` by bands fitted on ``docs`` itself, whose texts are measured
    once for both; the columns ``keep`` are written along with the measures."""
    paths = vocabularies(paths)
    made, fertile = added(paths)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    rows = measured(docs, text, keep, lang, paths)
    fitted = bands(rows, measures(paths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            m = {c: column(c) for c in fertile} | {"script": pc.index_in(batch.column("script"), pa.array(NAMES)).to_numpy(zero_copy_only=False)}
            kept = ~column("base_failed").astype(bool) & verdict(m, batch.column("lang").to_pylist(), fitted)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(kept) if c == "kept" else batch.column(c) for c in made]], names=[*keep, *made])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    for name in made:
        schema = schema.add(rows.schema[name])
    return rows.mapInArrow(run, schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return screened(common.table(spark, sf_dir, "documents"), keep=["doc_id"], lang="lang")
