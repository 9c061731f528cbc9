"""BPE encoding and decoding of whole texts with a public tokenizer file.

Nothing of the tokenizer reaches across ASCII white space (it only separates),
so a text is the sequence of its chunks between white space, and a batch
encodes each distinct chunk once.

A chunk that no white space splits may be very long.  Such a chunk is encoded
by tree concatenation: its halves, quarters and so on down to leaves are
encoded in one parallel batch, then neighbours are joined upwards.  At a join
the tokens next to it are re-encoded in a growing window until the first token
of the new window equals the left side's and the last equals the right side's.
A sequence of BPE tokens is the encoding of its text exactly if every two
neighbours are the encoding of theirs, so this agreement makes the joined
sequence exact.

Defined results: a null text is an empty one: 0 tokens, digests of ''; texts of
any length are encoded whole, with or without white space; repeated rows encode
alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import common

TOKENIZER = "word_bpe_49k.json"
#: Chunks and words longer than this, in characters, are encoded as trees.
LONG = 2048
#: Leaf length of a tree, in characters.
LEAF = 1024
#: Distinct chunks whose encodings one Python worker keeps.
CACHE = 80_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@contextmanager
def threads() -> Iterator[None]:
    """The library's threads, as many as a task has cores, for the leaves of a
    long text; elsewhere one thread a task, as the cores are Spark's."""
    os.environ.setdefault("RAYON_NUM_THREADS", os.environ.get("OMP_NUM_THREADS", "2"))
    before = os.environ.get("TOKENIZERS_PARALLELISM")
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    try:
        yield
    finally:
        if before is None:
            del os.environ["TOKENIZERS_PARALLELISM"]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = before


class Encoder:
    """Encodes chunks with the tokenizer of ``path``, long ones as trees."""

    def __init__(self, path: str, long: int = LONG, leaf: int = LEAF):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.long, self.leaf = long, max(2, leaf)
        spec = json.load(open(path, encoding="utf-8"))
        specials = [x["content"] for x in spec["added_tokens"]]
        self.specials = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.special_ids = {x["content"]: x["id"] for x in spec["added_tokens"]}
        # The same merges over bare byte letters: ``open`` for what ends inside
        # a word, ``closed`` for what ends with it.
        self.closed, self.open = self.bare(spec, True), self.bare(spec, False)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.names: dict[int, str] = {}
        self.seen: dict[str, tuple[int, str, str]] = {}

    @staticmethod
    def bare(spec: dict, closed: bool):
        from tokenizers import Tokenizer

        spec = json.loads(json.dumps({k: spec[k] for k in ("version", "model")}))
        if not closed:
            spec["model"]["end_of_word_suffix"] = None
        return Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None}))

    def name(self, token: int) -> str:
        if (found := self.names.get(token)) is None:
            found = self.names[token] = self.tokenizer.id_to_token(token)
        return found

    def width(self, token: int, last: bool) -> int:
        """Byte letters that a token covers."""
        n = self.name(token)
        return len(n) - (len(self.suffix) if last else 0)

    def tree(self, word: str) -> list[int]:
        """Ids of one pre-tokenised word of byte letters, of any length."""
        cuts = list(range(0, len(word), self.leaf))
        if len(cuts) > 1 and len(word) - cuts[-1] < 2:
            cuts.pop()
        leaves = [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True)]
        with threads():
            parts = [e.ids for e in self.open.encode_batch(leaves[:-1], add_special_tokens=False)]
        parts.append(self.closed.encode(leaves[-1], add_special_tokens=False).ids)
        at = [*cuts, len(word)]
        while len(parts) > 1:
            joined, ends = [], [0]
            for i in range(0, len(parts) - 1, 2):
                joined.append(self.join(word, parts[i], parts[i + 1], at[i + 1], at[i + 2] == len(word)))
                ends.append(at[i + 2])
            if len(parts) % 2:
                joined.append(parts[-1])
                ends.append(at[-1])
            parts, at = joined, ends
        return parts[0]

    def join(self, word: str, left: list[int], right: list[int], seam: int, last: bool) -> list[int]:
        size = 4
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            lo = seam - sum(self.width(t, False) for t in left[a:])
            closing = last and b == len(right)
            hi = seam + sum(self.width(t, False) for t in right[: b - closing]) + (self.width(right[-1], True) if closing else 0)
            window = (self.closed if closing else self.open).encode(word[lo:hi], add_special_tokens=False).ids
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            size *= 2

    def chunk(self, text: str) -> list[int]:
        """Ids of a long chunk."""
        out: list[int] = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special_ids:
                out.append(self.special_ids[part])
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                    out += self.tree(word) if len(word) > self.long else self.closed.encode(word, add_special_tokens=False).ids
        return out

    def chunks(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(tokens, decimal ids joined by a space, decoded text) of each chunk."""
        seen, out = self.seen, [None] * len(texts)
        new: list[int] = []
        for i, text in enumerate(texts):
            if (found := seen.get(text)) is not None:
                out[i] = found
            else:
                new.append(i)
        short = [i for i in new if len(texts[i]) <= self.long]
        for at in range(0, len(short), 8192):
            some = short[at : at + 8192]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([texts[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = self.result(e.ids)
        for i in new:
            if len(texts[i]) > self.long:
                out[i] = self.result(self.chunk(texts[i]))
            elif len(texts[i]) <= 64:
                if len(seen) >= CACHE:
                    seen.clear()
                seen[texts[i]] = out[i]
        return out

    def result(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """As the tokenizer's ``decode(ids, skip_special_tokens=False)`` where it
        has no decoder: the tokens joined by a space."""
        if self.tokenizer.decoder is None:
            return " ".join([self.name(i) for i in ids])
        return self.tokenizer.decode(ids, skip_special_tokens=False)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(token counts, ids joined by spaces, decoded texts) of each text.

    Decoding a text is joining its chunks' decodings by a space, which holds
    for tokenizers without a decoder (``op5``'s); others are not taken here.
    """
    e = encoder(path)
    if e.tokenizer.decoder is not None:
        raise ValueError("this operator joins decoded chunks by a space: the tokenizer must have no decoder")
    words, codes, offsets = common.unique_words(texts)
    found = e.chunks(words.to_pylist())
    n = np.fromiter((x[0] for x in found), np.int64, len(found))
    if len(codes) and not n.all():  # chunks without tokens leave no gap
        keep = n[codes] > 0
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
    taken = pa.array(codes)
    lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([x[k] for x in found], pa.string()).take(taken)) for k in (1, 2)]
    counts = common.per_row(n[codes] if len(codes) else np.zeros(0, np.int64), offsets)
    return counts, pc.binary_join(lists[0], " "), pc.binary_join(lists[1], " ")


def encoded(docs: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` (all, if not given) with ``n_tokens``,
    ``ids`` (decimal, joined by a space) and ``decoded``; with ``digests``,
    their SHA-256 in lowercase hex as ``ids_sha256`` and ``decoded_sha256``
    instead, so that texts do not travel back."""
    path = path or tokenizer_path()
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    common.arrow_batches(docs.sparkSession)
    source, kept = common.through(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        for batch in common.slices(batches, "text", 4 << 20):
            n, ids, decoded = encode(batch.column("text"), path)
            if digests:
                ids, decoded = (pa.array([hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in col.cast(pa.binary())], pa.string()) for col in (ids, decoded))
            yield pa.RecordBatch.from_arrays([*kept(batch), pa.array(n, pa.int64()), ids, decoded], names=[*keep, *made])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    for name, kind in zip(made, ("long", "string", "string"), strict=True):
        schema = schema.add(name, kind, True)
    return source.mapInArrow(lambda batches: common.trimmed(run(batches)), schema)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(common.table(spark, sf_dir, "documents"), keep=["doc_id"], digests=True)
