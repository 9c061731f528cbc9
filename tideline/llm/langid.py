"""Language ID by cross-parsing: a text is parsed into phrases, each the longest
match that starts there in a language's reference text.  The language that
needs the fewest phrases per character wins; ties go to the smaller name.

A suffix automaton of the reference text accepts exactly its substrings, so
walking it greedily and restarting at its initial state on a failure gives the
longest matches.  The automaton with restarts is one flat transition table, with
sorted keys for the moves by a language's rarer letters; all
texts of a batch walk it in step, in blocks of ``BLOCK`` letters whose phrases go
on into the next, so long texts cost no more per letter than short ones.

Letters are lower-cased; every run of other characters is one separator.

Defined results: null, empty and letterless texts get ``und`` and score 0.
With no labelled language at all every text gets ``und``.  Score is
second / (best + second) of the phrase counts: 0.5 for a tie, near 1 for a
clear winner, 1 where only one language was learned.  Texts of any length are
parsed whole; repeated rows are predicted alike; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import common

UNKNOWN = "und"
BLOCK = 1024
#: Bounds of the training sample: distinct texts and letters per language, code
#: points taken from one text (from a place that depends on its hash).
TEXTS, LETTERS, TAKEN = 160, 30_000, 2_000
#: Letters of a language with columns in the flat table, the most frequent ones
#: (its other letters are looked up), and entries of that table, about.
ALPHABET, TABLE = 60, 100_000_000


@dataclass(frozen=True)
class Model:
    """Reference texts per language; small enough to travel with each task."""

    references: tuple[tuple[str, str], ...]

    def tables(self) -> Tables:
        if self not in _tables:
            _tables.clear()
            _tables[self] = Tables(self)
        return _tables[self]


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is initial."""
    nexts: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for ch in text:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in nexts[p]:
            nexts[p][ch] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][ch]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(ch) == q:
                    nexts[p][ch] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return nexts


class Tables:
    """The flat transition table of all languages and the letter codes.

    Every letter of any reference has its code.  Where they are too many for
    one alphabet, each language maps codes to columns of its own; the letters
    of its reference that have none there move by ``keys`` and ``moves``."""

    def __init__(self, model: Model):
        self.languages = [name for name, _ in model.references]
        used = Counter("".join(text for _, text in model.references))
        used.pop(" ", None)
        letters = [c for c, _ in sorted(used.items(), key=lambda x: (-x[1], x[0]))]
        self.codes = len(letters) + 2  # separator, letters, any other letter
        room = max(4, min(ALPHABET, int(TABLE / max(1.0, 1.5 * sum(len(text) for _, text in model.references))) - 2))
        self.shared = len(letters) <= room
        self.width = self.codes if self.shared else room + 2
        other = self.codes - 1
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.code = np.where(self.letter, other, 0).astype(np.min_scalar_type(other))
        codes = {" ": 0} | {c: i + 1 for i, c in enumerate(letters)}
        for c, k in codes.items():
            if c != " ":
                self.code[ord(c)] = k
        parts, self.roots, base = [], [], 0
        self.columns = np.full((len(self.languages), self.codes), self.width - 1, np.int32)
        self.rare = np.zeros((len(self.languages), self.codes), bool)
        keys, moved = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        everywhere = codes
        for j, (_, text) in enumerate(model.references):
            nexts = automaton(text)
            if not self.shared:
                own = Counter(text)
                own.pop(" ", None)
                by_count = [c for c, _ in sorted(own.items(), key=lambda x: (-x[1], x[0]))]
                codes = {" ": 0} | {c: i + 1 for i, c in enumerate(by_count[:room])}
                self.columns[j, [everywhere[c] for c in codes]] = list(codes.values())
                self.rare[j, [everywhere[c] for c in by_count[room:]]] = True
                far = [((base + s) * self.codes + everywhere[c], (base + to) * self.width << 1 | (s == 0)) for s, moves in enumerate(nexts) for c, to in moves.items() if c not in codes]
                keys.append(np.array([k for k, _ in far], np.int64))
                moved.append(np.array([v for _, v in far], np.int32))
            root = np.full(self.width, (base * self.width << 1) | 1, np.int32)
            for c, to in nexts[0].items():
                if c in codes:
                    root[codes[c]] = ((base + to) * self.width << 1) | 1
            table = np.tile(root, (len(nexts), 1))
            for s, moves in enumerate(nexts[1:], 1):
                for c, to in moves.items():
                    if c in codes:
                        table[s, codes[c]] = (base + to) * self.width << 1
            parts.append(table)
            self.roots.append(base * self.width)
            base += len(nexts)
        self.table = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int32)
        order = np.argsort(np.concatenate(keys))
        self.keys, self.moves = np.concatenate(keys)[order], np.concatenate(moved)[order]

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next states of (languages, lanes), doubled, plus 1 where a phrase starts."""
        if self.shared:
            return self.table.take(state + codes)
        move = self.table.take(state + self.columns[:, codes])
        j, lane = np.nonzero(self.rare[:, codes])
        if len(j):
            code = codes[lane].astype(np.int64)
            key = state[j, lane].astype(np.int64) // self.width * self.codes + code
            at = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
            lost = np.flatnonzero(self.keys[at] != key)  # start again; every letter has a move from its root
            root = np.array(self.roots, np.int64)[j[lost]] // self.width * self.codes + code[lost]
            at[lost] = np.searchsorted(self.keys, root)
            move[j, lane] = self.moves[at]
        return move

    def letters(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(letter codes with runs of others made one separator, offsets of each
        text, whether a text has a letter)."""
        texts = pc.utf8_lower(pc.fill_null(common.flat(texts).cast(pa.string()), ""))
        points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate(([0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))))
        is_letter = self.letter[points]
        codes = self.code[points]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]  # the first of a run of others
        starts = offsets[:-1][offsets[1:] > offsets[:-1]]
        keep[starts] = is_letter[starts]  # none at a text's start
        found = np.concatenate(([0], np.cumsum(is_letter)))
        return codes[keep], np.concatenate(([0], np.cumsum(keep)))[offsets], found[offsets[1:]] > found[offsets[:-1]]

    def phrases(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text in each language: (languages, texts).

        Blocks of all texts first run in step, each as if a phrase began with it.
        Then every block that continues a text runs again from the state in which
        the block before it ended, beside its first run, until the two agree;
        from there on they are one, so the counts are those of whole texts.
        """
        sizes = np.diff(offsets)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        if not len(owner):
            return np.zeros((len(self.roots), len(sizes)), np.int64)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = offsets[owner] + number * BLOCK
        size = np.minimum(BLOCK, offsets[owner + 1] - start)
        roots = np.array(self.roots, np.int32)[:, None]
        count, end = np.zeros((len(self.roots), len(owner)), np.int32), np.zeros((len(self.roots), len(owner)), np.int32)
        order = np.argsort(-size, kind="stable")
        for a in range(0, len(order), 8192):  # lanes that fit the caches
            own = order[a : a + 8192]
            first, n = start[own], size[own]
            longest = int(n[0])
            lanes = codes.take(first[None, :] + np.arange(longest)[:, None], mode="clip").astype(np.int32)
            active = np.searchsorted(-n, -np.arange(longest), "left")
            state = np.repeat(roots, len(first), axis=1)
            seen = np.zeros(state.shape, np.int32)
            for t in range(longest):
                k = active[t]
                move = self.step(state[:, :k], lanes[t, :k])
                seen[:, :k] += move & 1
                np.right_shift(move, 1, out=state[:, :k])
            count[:, own], end[:, own] = seen, state
        total, fresh_end = count.copy(), end.copy()
        again = np.flatnonzero(number > 0)
        while len(again):  # a second round only where a whole block did not agree
            late = []
            for a in range(0, len(again), 8192):
                late.append(self.continued(codes, start, size, again[a : a + 8192], roots, count, fresh_end, end, total))
            late = np.concatenate(late) + 1
            again = late[(late < len(owner)) & (number[np.minimum(late, len(owner) - 1)] > 0)]
        out = np.zeros((len(self.roots), len(sizes)), np.int64)
        for j in range(len(self.roots)):
            out[j] = np.bincount(owner, total[j], len(sizes)).astype(np.int64)
        return out

    def continued(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray, own: np.ndarray, roots: np.ndarray, count: np.ndarray, fresh_end: np.ndarray, end: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Run blocks ``own`` from their predecessors' ends; set their ``total``
        and ``end``, and give those whose end has changed."""
        true, fresh = end[:, own - 1].copy(), np.repeat(roots, len(own), axis=1)
        more = np.zeros(true.shape, np.int32)
        lane, late, t = np.arange(len(own)), [], 0
        while len(lane):
            letters = codes[start[own[lane]] + t].astype(np.int32)
            a, b = self.step(true[:, lane], letters), self.step(fresh[:, lane], letters)
            more[:, lane] += (a & 1) - (b & 1)
            true[:, lane], fresh[:, lane] = a >> 1, b >> 1
            t += 1
            open_ = ((a >> 1) != (b >> 1)).any(axis=0)
            over = open_ & (size[own[lane]] <= t)
            late.append(lane[over])
            lane = lane[open_ & ~over]
        total[:, own] = count[:, own] + more
        late = np.concatenate(late) if late else lane
        ends = fresh_end[:, own]
        ends[:, late] = true[:, late]
        changed = (ends != end[:, own]).any(axis=0)
        end[:, own] = ends
        return own[changed]

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, or -1 for unknown; score) of each text."""
        codes, offsets, lettered = self.letters(texts)
        if not self.languages:
            return np.full(len(texts), -1), np.zeros(len(texts))
        total = self.phrases(codes, offsets)
        best = total.argmin(axis=0)
        ranked = np.sort(total, axis=0)
        score = ranked[1] / np.maximum(ranked[0] + ranked[1], 1) if len(ranked) > 1 else np.ones(len(texts))
        return np.where(lettered, best, -1), np.where(lettered, score, 0.0)


_tables: dict[Model, Tables] = {}


def normal(text: str) -> str:
    """Letters lower-cased (as in ``Tables.letters``), runs of others one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in pc.utf8_lower(pa.scalar(text)).as_py()).split())


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", texts: int = TEXTS, letters: int = LETTERS) -> Model:
    """Learn from labelled rows (rows with a null label or text teach nothing).

    Per language a sample of about ``texts`` distinct texts, chosen by their
    hash, gives a reference of at most ``letters`` letters.
    """
    rows = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").collect()
    if not sizes:
        return Model(())
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, texts / max(1, r["n"]))))])
    near = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    at = F.lit(1) + F.pmod(F.col("h"), F.greatest(F.length("text") - TAKEN, F.lit(1)))
    sample = (
        rows.where(near < share[F.col("lang")])
        .select("lang", "h", F.substring(F.col("text"), at.cast("int"), F.lit(TAKEN)).alias("text"))
        .dropDuplicates(["lang", "h"])
        .orderBy("h")
        .limit(2 * texts * len(sizes))
        .collect()
    )
    found: dict[str, list[str]] = {}
    for r in sample:
        found.setdefault(r["lang"], []).append(normal(r["text"]))
    return Model(tuple((name, " ".join(found[name])[:letters]) for name in sorted(found) if any(found[name])))


def identified(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all, if not given) with ``lang_pred`` and ``score``."""
    made = ["lang_pred", "score"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    common.arrow_batches(docs.sparkSession)
    source, kept = common.through(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        names = pa.array([*tables.languages, UNKNOWN], pa.string())
        for batch in common.slices(batches, "text", 4 << 20):
            best, score = tables.predict(batch.column("text"))
            picked = names.take(pa.array(np.where(best < 0, len(names) - 1, best)))
            yield pa.RecordBatch.from_arrays([*kept(batch), picked, pa.array(score, pa.float64())], names=[*keep, *made])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("lang_pred", "string", True).add("score", "double", True)
    return source.mapInArrow(lambda batches: common.trimmed(run(batches)), schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.where(~common.held_out()))
    return identified(docs.withColumn("held_out", common.held_out()), model, keep=["doc_id", "held_out"])
