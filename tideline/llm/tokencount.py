"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary match in a word; dynamic
programming carries the best score and its piece count to each end position, and
pieces are never built.  The words of a batch go in step (``Lanes``); very long
words go one by one (``Counter``), with the same result.

Tie rules are those of the ``tokenizers`` Unigram model with ``Metaspace``
words: candidates for one end are tried by rising start, and only a strictly
better score replaces an earlier one; a character that is no piece costs the
lowest score of the vocabulary less 10, runs of such characters fuse into one
unknown, and an unknown is spelled in byte pieces where all of them exist.

Defined results: a null or empty text has 0 tokens; texts of any length are
processed whole, word by word; repeated rows count alike; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections import Counter as FrequencyCounter
from collections.abc import Iterator
from functools import cached_property
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import common

#: The vocabulary file used by the queries.
VOCABULARY = "piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
#: Longer words are counted one by one; so many others go in step.
LONG, LANES = 64, 8192
#: Commonest characters of a vocabulary that have columns in the dense table.
COLUMNS = 96


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a piece model file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Counts unigram pieces of words, exactly as the Unigram model would."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.pieces = pieces
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        names = {piece for piece, _ in pieces}
        self.byte = [f"<0x{b:02X}>" in names for b in range(256)]
        self.lanes = Lanes(pieces, self.unknown) if all(self.byte) else None

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for piece, score in self.pieces:
            if piece and piece not in made:
                made.add_word(piece, (len(piece), score))
        made.make_automaton()
        return made

    def __call__(self, word: str) -> int:
        """Tokens of one Metaspace word, its leading mark included."""
        n = len(word)
        best = [-inf] * (n + 1)  # score of the best path to each end
        best[0] = 0.0
        start = [0] * (n + 1)  # where that path's last piece starts
        strange = set()  # ends whose last piece is an unknown character
        at, single = 0, True

        def unknown(end: int) -> None:
            if (score := best[end - 1] + self.unknown) > best[end]:
                best[end], start[end] = score, end - 1
                strange.add(end)

        # Matches come by end, the longest (the earliest start) first.
        for last, (length, score) in self.automaton.iter(word):
            if last >= at:
                if not single:
                    unknown(at)
                at += 1
                while at <= last:
                    unknown(at)
                    at += 1
                single = False
            if (score := score + best[at - length]) > best[at]:
                best[at], start[at] = score, at - length
            if length == 1:
                single = True
        if not single:
            unknown(at)
        for end in range(at + 1, n + 1):
            unknown(end)
        pieces, end = 0, n
        while end:
            if end in strange:
                to = end
                while end in strange:
                    end = start[end]
                pieces += self.spelled(word[end:to])
            else:
                pieces += 1
                end = start[end]
        return pieces

    def spelled(self, unknown: str) -> int:
        """Tokens of a fused unknown: its bytes if each is a piece, else one."""
        raw = unknown.encode("utf-8", "surrogatepass")
        return len(raw) if all(self.byte[b] for b in raw) else 1

    def words(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        alone = lengths > LONG if self.lanes else np.ones(len(words), bool)
        for i in np.flatnonzero(alone).tolist():
            out[i] = self(words[i])
        if self.lanes:
            rest = np.flatnonzero(~alone)
            rest = rest[np.argsort(-lengths[rest], kind="stable")]
            for at in range(0, len(rest), LANES):
                some = rest[at : at + LANES]
                out[some] = self.lanes([words[i] for i in some.tolist()], lengths[some])
        return out


class Lanes:
    """The same automaton and programme for many words in step, one character
    of each at a time, for vocabularies with all byte pieces (an unknown
    character adds its bytes).

    States are numbered level by level.  Moves by the vocabulary's commonest
    characters, failures followed, fill a dense table; the others are looked up
    by (state, character) and fail step by step.
    """

    def __init__(self, pieces: list[tuple[str, float]], unknown: float):
        self.unknown = unknown
        score: dict[str, float] = {}
        for piece, x in pieces:
            if piece:
                score.setdefault(piece, x)
        states = sorted({piece[:k] for piece in score for k in range(len(piece) + 1)} | {""}, key=len)
        number = {x: i for i, x in enumerate(states)}
        used = FrequencyCounter(x[-1] for x in states[1:])
        letters = [c for c, _ in sorted(used.items(), key=lambda x: (-x[1], x[0]))]
        self.width = min(COLUMNS, len(letters)) + 1  # the last is for all other characters
        self.code = np.zeros(0x110000, np.int32)
        self.code[:] = len(letters)  # in no piece
        for i, c in enumerate(letters):
            self.code[ord(c)] = i
        self.codes = len(letters) + 1
        n = len(states)
        self.fail = np.zeros(n, np.int32)
        table = np.zeros((n, self.width), np.int32)
        keys, moves = [], []
        outputs: list[list[tuple[int, float]]] = [[]]
        for i, x in enumerate(states[1:], 1):
            up, letter = number[x[:-1]], self.code[ord(x[-1])]
            at = x[1:]
            while at not in number:
                at = at[1:]
            self.fail[i] = number[at]
            outputs.append(([(len(x), score[x])] if x in score else []) + outputs[self.fail[i]])
            if letter < self.width - 1:
                table[up, letter] = i
            else:
                keys.append(up * self.codes + int(letter))
                moves.append(i)
        for i in range(1, n):  # a state's failure is on a level above it
            missing = table[i] == 0
            table[i, missing] = table[self.fail[i], missing]
        self.table = table.ravel()
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.moves = np.array(keys, np.int64)[order], np.array(moves, np.int32)[order]
        self.n_out = np.array([len(x) for x in outputs], np.int32)
        self.first_out = np.cumsum(self.n_out) - self.n_out
        self.out_length = np.array([k for x in outputs for k, _ in x], np.int32)
        self.out_score = np.array([v for x in outputs for _, v in x], np.float64)
        self.has_single = np.array([bool(x) and x[-1][0] == 1 for x in outputs])

    def move(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        out = self.table.take(state * self.width + np.minimum(code, self.width - 1))
        rare = np.flatnonzero(code >= self.width - 1)
        if len(rare):
            at, c = state[rare].astype(np.int64), code[rare]
            to = np.zeros(len(rare), np.int32)
            open_ = np.arange(len(rare)) if len(self.keys) else rare[:0]
            while len(open_):
                key = at[open_] * self.codes + c[open_]
                k = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
                hit = self.keys[k] == key
                to[open_[hit]] = self.moves[k[hit]]
                open_ = open_[~hit & (at[open_] > 0)]
                at[open_] = self.fail[at[open_]]
            out[rare] = to
        return out

    def __call__(self, words: list[str], lengths: np.ndarray) -> np.ndarray:
        """Tokens of each word; ``words`` by falling length."""
        if not len(words):
            return np.zeros(0, np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(lengths) - lengths
        longest, rows = int(lengths[0]), len(words)
        active = np.searchsorted(-lengths, -np.arange(longest), "left")
        best = np.full((longest + 1, rows), -np.inf)
        best[0] = 0.0
        count = np.zeros((longest + 1, rows), np.int32)
        flat, flat_count = best.ravel(), count.ravel()
        state = np.zeros(rows, np.int32)
        for t in range(longest):
            k = int(active[t])
            point = points[starts[:k] + t]
            state = self.move(state[:k], self.code[point])
            found, pieces = best[t + 1, :k], count[t + 1, :k]
            n, at = self.n_out[state], self.first_out[state]
            lane = np.flatnonzero(n)
            j = 0
            while len(lane):  # the longest match (the earliest start) first
                o = at[lane] + j
                source = (t + 1 - self.out_length[o]) * rows + lane
                total = self.out_score[o] + flat[source]
                better = total > found[lane]
                won = lane[better]
                found[won] = total[better]
                pieces[won] = flat_count[source[better]] + 1
                j += 1
                lane = lane[n[lane] > j]
            lane = np.flatnonzero(~self.has_single[state])
            if len(lane):
                total = best[t, lane] + self.unknown
                won = lane[total > found[lane]]
                found[won] = best[t, won] + self.unknown
                p = point[won]
                pieces[won] = count[t, won] + 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
        return count[lengths, np.arange(rows)].astype(np.int64)


def metaspace_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words as Metaspace cuts them (each with its mark), coded."""
    texts = pc.fill_null(common.flat(texts).cast(pa.string()), "")
    # U+2581 in a text acts as the mark itself.
    texts = pc.replace_substring(texts, "▁", " ")
    filled = pc.not_equal(texts, "")
    texts = pc.if_else(pc.and_(filled, pc.invert(pc.starts_with(texts, " "))), pc.binary_join_element_wise(" ", texts, ""), texts)
    # Every word now has its blank in front.
    parts = pc.split_pattern(texts, " ")
    lo, hi = parts.offsets[0].as_py(), parts.offsets[-1].as_py()
    offsets = parts.offsets.to_numpy() - lo
    encoded = common.flat(parts.values.slice(lo, hi - lo)).dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    # The first part of each row is what stands before its first mark: nothing.
    keep = np.ones(len(codes), bool)
    keep[offsets[:-1][offsets[1:] > offsets[:-1]]] = False
    offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
    return ["▁" + w for w in encoded.dictionary.to_pylist()], codes[keep], offsets


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per vocabulary and Python worker."""
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def count(texts: pa.Array, path: str) -> np.ndarray:
    words, codes, offsets = metaspace_words(texts)
    return common.per_row(counter(path).words(words)[codes] if len(codes) else np.zeros(0, np.int64), offsets)


def with_tokens(docs: DataFrame, text: str = "text", to: str = "n_tokens", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the token count of ``text`` as
    column ``to``; a column of that name is replaced."""
    path = path or vocabulary_path()
    keep = [c for c in (docs.columns if keep is None else keep) if c != to]
    common.arrow_batches(docs.sparkSession)
    source, kept = common.through(docs, keep, text)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            n = pa.array(count(batch.column("text"), path), pa.int64())
            yield pa.RecordBatch.from_arrays([*kept(batch), n], names=[*keep, to])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(to, "long", True)
    return source.mapInArrow(lambda batches: common.trimmed(counted(batches)), schema)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens of every document (0 for a null or empty text)."""
    return with_tokens(common.table(spark, sf_dir, "documents"), keep=["doc_id"])
