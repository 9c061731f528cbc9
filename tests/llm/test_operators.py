"""Each operator against brute force, and its defined results for nulls, empty
and very long texts, ties and repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import html
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import annsearch, bpe, common, htmlmain, langid, minhash, packing, quality, secrets, tokencount, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or add; they must not get in the way.
CLASH = ["n_tokens", "score", "h", "key", "id", "ids", "digest", "signature", "__text", "bucket", "batch", "spans", "kept", "host", "embedding_"]


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts_of(spark, sf, n=None):
    rows = documents(spark, sf).select("doc_id", "text").orderBy("doc_id").collect()
    return [(r.doc_id, r.text) for r in rows][:n]


def odd(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "x" * 200_000, "en", None, 200_000), (5, "the cat sat on the mat " * 4000, "en", "s", 1), (5, "the cat sat on the mat " * 4000, "en", "s", 1), (None, "the cat sat on the mat", "fr", "s", 1), (7, "日本語 ☃ \U0001f600 tok", None, "s", 9)]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 ---------------------------------------------------------------------------


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]
    return sorted(out)


@pytest.fixture(scope="module")
def secret_model(spark, sf):
    return secrets.fit(documents(spark, sf))


def test_secret_spans(spark, secret_model):
    rng = random.Random(5)
    parts = ["token", "secret", "password", ' = "', "\":  '", ":", "=", "AKIA", "0123456789abcdef" * 2, "ABCDEF0123456", "é", "日本", "x", "api_key", "APIKEY", "aB3+/", "\n", "hello_world_this_is_fine"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "a" * 50_000), (903, " ".join(["token=abcdefgh1"] * 300)), (903, "again token: 12345678")]
    found = secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string"), secret_model).withColumn("red", secrets.redacted(F.col("text"), F.col("secret_spans"))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [(s.start, s.kind, s.end) for s in r.secret_spans if s.kind < 3] == base_spans(r.text)
        whole, at, out = r.text or "", 0, ""
        for s in r.secret_spans:
            if s.start >= at:
                out += whole[at : s.start] + secrets.MARK
            at = max(at, s.end)
        assert (r.red or "") == out + whole[at:]


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randint(0, 99) for _ in range(n)]) for i, n in enumerate([0, 1, 31, 32, 33, 64, 1000, 1024, 1025, 5000])]
    got = spark.createDataFrame(rows, "i int, v array<int>").select("i", "v", secrets.running(F.col("v")).alias("sums"), secrets.running(F.col("v"), F.greatest).alias("most")).collect()
    assert all(r.sums == list(itertools.accumulate(r.v)) and r.most == list(itertools.accumulate(r.v, max)) for r in got) and len(got) == len(rows)


def test_many_secrets_in_one_text(spark, secret_model):
    import time

    rng = random.Random(7)
    key = lambda n: "".join(rng.choice("ABCDEFGHIJabcdefghij0123456789+/") for _ in range(n))
    text = lambda n: "é".join(f"token={key(12)} {key(30) if i % 3 else ''}\n" for i in range(n))
    took = {}
    for n in (4000, 16000):
        whole = text(n)
        began = time.perf_counter()
        r = secrets.scanned(spark.createDataFrame([(1, whole)], "doc_id long, text string"), secret_model).withColumn("red", secrets.redacted(F.col("text"), F.col("secret_spans"))).first()
        took[n] = time.perf_counter() - began
        assert [(s.start, s.kind, s.end) for s in r.secret_spans if s.kind < 3] == base_spans(whole)
        out, at = [], 0
        for s in r.secret_spans:
            if s.start >= at:
                out += [whole[at : s.start], secrets.MARK]
            at = max(at, s.end)
        assert r.red == "".join(out) + whole[at:]
    assert took[16000] < 8 * took[4000] + 2  # four times the matches, not sixteen times the time


def test_markov_models(spark, secret_model):
    rng = random.Random(1)
    key = lambda letters: "".join(rng.choice(letters) for _ in range(40))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    random_texts = [(i, f"see {key(b64)} now") for i in range(50)]
    words = [w for _, t in texts_of(spark, "/root/testdata/sf0.001") for w in re.findall("[A-Za-z]+", t)][:3000]
    plain = [(100 + i, "see " + "_".join(words[8 * i : 8 * i + 8]) + " now") for i in range(50)]
    found = {r.doc_id: len(r.secret_spans) for r in secrets.scanned(spark.createDataFrame(random_texts + plain, "doc_id long, text string"), secret_model).collect()}
    assert sum(found[i] > 0 for i, _ in random_texts) >= 48
    assert sum(found[i] > 0 for i, _ in plain) == 0


def test_secret_query(spark, sf):
    rows = {r.doc_id: r for r in secrets.op1_secrets(spark, sf).collect()}
    for i, t in texts_of(spark, sf):
        want = base_spans(t)
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e in want).encode()).hexdigest()
    assert secrets.scanned(empty(spark), secrets.fit(empty(spark))).count() == 0
    assert secrets.scanned(odd(spark), secrets.fit(odd(spark))).count() == 8


# 2 ---------------------------------------------------------------------------


def shingles(t, size):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    k = min(size, len(w))
    return frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if k else frozenset()


def brute_components(rows, size, percent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    posts = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            posts[x].append(i)
    shared = collections.Counter(p for ids in posts.values() for p in itertools.combinations(sorted(ids), 2))
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def variants():
    """Groups of near copies that chain, copies, and texts without words."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, i = [], 0
    for _ in range(6):
        base = [word() for _ in range(120)]
        for _ in range(30):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = word()
            rows.append((i, " ".join(text)))
            i += 1
    rows += [(1000, rows[3][1].upper()), (1001, rows[3][1]), (1002, ""), (1003, None), (1004, "one two"), (1005, "ONE  two"), (1006, " \n")]
    return rows


def test_minhash_is_brute_force(spark):
    rows = variants()
    for size in (4, 5):
        mine = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size).collect()}
        assert mine == brute_components(rows, size)


def test_minhash_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = variants()[:90]
    mine = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert mine == brute_components(rows, 4)


def test_minhash_unlinked_bucket_stays_linear(spark, monkeypatch):
    """Texts of 24 equal words but one share buckets and are under 0.8: no pair
    of them may become a row, however many they are."""
    written = []
    keep = minhash.common.cut

    def cut(df, name):
        out = keep(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(minhash.common, "cut", cut)
    words = [f"w{i}" for i in range(24)]
    rows = [(i, " ".join([*words[:12], f"x{i}", *words[13:]])) for i in range(600)]
    rows += [(700 + i, " ".join([*words, f"y{i}"])) for i in range(3)]
    mine = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert mine == brute_components(rows, 4)
    assert max(n for name, n in written if name in ("near", "links", "rest", "edges")) <= 30 * len(rows) and sum(n for name, n in written if name == "rest") <= len(rows)


def test_minhash_query_and_odd_rows(spark, sf):
    mine = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.op2_minhash(spark, sf).collect()}
    assert mine == brute_components(texts_of(spark, sf), 4)
    rows = minhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == 8 and [r.kept for r in rows if r.doc_id is None] == [True]
    assert {r.component_id for r in rows if r.doc_id == 5} == {5}
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_minhash_sql(spark, sf):
    import duckdb

    from tideline.llm import queries

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    mine = sorted(tuple(r) for r in minhash.op2_minhash(spark, sf).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert mine == sorted(c.execute(queries.SQL["op2_minhash"]).fetchall())


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)]
    found = {r.id: r.component for r in minhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# 3 ---------------------------------------------------------------------------


def test_token_counts_are_the_library(spark, sf):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = tokencount.vocabulary_path()
    own = Tokenizer(models.Unigram(tokencount.vocabulary(path), 0, True))
    own.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(1)
    letters = " \n\t▁aabcdeéè日本☃\U0001d4b3<0x>nthe.,"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [t for _, t in texts_of(spark, sf)] + ["ab" * 30_000, "☃" * 3000]
    assert tokencount.count(pa.array(texts), path).tolist() == [len(own.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_ties():
    # Equal scores: the earlier start (the longer last piece) stays.
    c = tokencount.Counter([("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -9.0), ("c", -1.0)])
    assert c("ab") == 1 and c("abc") == 2 and c("aXYb") == 3


def test_words_in_step_count_like_words_alone():
    rng = random.Random(8)
    for trial in range(30):
        letters = "abcdé日☃" + "".join(chr(0x3400 + i) for i in range(200 if trial % 3 == 0 else 0))  # more letters than columns
        pieces = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))): float(-rng.randint(1, 6)) for _ in range(rng.randint(1, 150))}
        own = tokencount.Counter([("<unk>", 0.0), *[(f"<0x{b:02X}>", 0.0) for b in range(256)], *pieces.items()])
        words = ["".join(rng.choice(letters + "xyz") for _ in range(rng.randint(0, 70))) for _ in range(200)]
        assert own.words(words).tolist() == [own(w) for w in words]


def test_token_counts_of_odd_rows(spark):
    rows = tokencount.with_tokens(odd(spark)).select("doc_id", "n_tokens").collect()
    assert {r.doc_id: r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1: 0, 2: 0} and len(rows) == 8
    assert tokencount.with_tokens(empty(spark)).count() == 0


# 4 ---------------------------------------------------------------------------


def test_boundaries_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n = rng.integers(1, 9)
        lengths, counts, k = np.sort(rng.choice(40, n, replace=False)), rng.integers(1, 9, n), int(rng.integers(1, 5))
        padding = lambda ends: sum(int(c) * (min(e for e in ends if e >= x) - int(x)) for x, c in zip(lengths, counts))  # noqa: B023, B905, E731
        mine = packing.boundaries(lengths, counts, k)
        best = min(padding([*map(int, s), int(lengths[-1])]) for r in range(min(k, n)) for s in itertools.combinations(lengths[:-1], r))
        assert padding(mine) == best and len(mine) <= k


def test_packing(spark, sf):
    rows = packing.op4_packing(spark, sf).collect()
    assert len(rows) == documents(spark, sf).count()
    batches = collections.defaultdict(list)
    for r in rows:
        batches[r.bucket, r.batch].append(r)
        assert r.n_tokens <= r.bucket_length
    for (bucket, batch), found in batches.items():
        assert sorted(r.position for r in found) == list(range(len(found)))
        assert len(found) == 1 or len(found) * found[0].bucket_length <= packing.BUDGET
        last = max(b for k, b in batches if k == bucket)
        assert batch == last or (len(found) + 1) * found[0].bucket_length > packing.BUDGET  # only a bucket's last batch has room
    rows = packing.packed(tokencount.with_tokens(odd(spark)), "n_tokens", "doc_id", budget=10).collect()
    assert len(rows) == 8 and packing.packed(tokencount.with_tokens(empty(spark)), "n_tokens", "doc_id").count() == 0


def test_one_long_document_leaves_padding_least(spark):
    rng = random.Random(4)
    lengths = [int(rng.lognormvariate(5, 1)) for _ in range(3000)] + [2_000_000]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    rows = packing.packed(df, "n", "doc_id").collect()
    count = collections.Counter(lengths)
    ends = packing.boundaries(np.array(list(count)), np.array(list(count.values())), packing.BUCKETS)
    least = sum(min(e for e in ends if e >= x) - x for x in lengths)
    assert sum(r.bucket_length - r.n for r in rows) == least


def test_rows_without_a_key_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 50)
    df = spark.createDataFrame([(None if i % 3 else i, 10 + i % 4) for i in range(1500)], "doc_id long, n long")
    rows = packing.packed(df, "n", "doc_id", budget=200).collect()
    places = {(r.bucket, r.batch, r.position) for r in rows}
    assert len(rows) == len(places) == 1500
    assert max(r.batch for r in rows if r.bucket == 0) == -(-sum(r.bucket == 0 for r in rows) // (200 // 10)) - 1


# 5 ---------------------------------------------------------------------------


def test_bpe_is_the_library(spark, sf):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    own = Tokenizer.from_file(path)
    rng = random.Random(1)
    letters = [*" \n\t\x0b\x85 \x1caabcdeéè日本☃nthe.,'sΣİ12٣́Å", "<|endoftext|>", "'ll"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [t for _, t in texts_of(spark, sf, 60)]
    for n in (2049, 5000, 30_000):
        texts += ["".join(rng.choice("aabcdenthe") for _ in range(n)), "a" * n, "é☃" * (n // 2), "x" * n + "<|endoftext|>" + "Ab" * n]
    n, ids, decoded = bpe.encode(pa.array(texts), path)
    for t, k, i, d in zip(texts, n, ids.to_pylist(), decoded.to_pylist(), strict=True):
        want = own.encode(t, add_special_tokens=False).ids
        assert (k, i, d) == (len(want), " ".join(map(str, want)), own.decode(want, skip_special_tokens=False))


def test_bpe_trees():
    e = bpe.Encoder(bpe.tokenizer_path(), long=8, leaf=3)
    rng = random.Random(2)
    for _ in range(1500):
        w = "".join(rng.choice("aabcdentheringsto") for _ in range(rng.randint(9, 80)))
        assert e.tree(w) == e.tokenizer.encode(w, add_special_tokens=False).ids


def test_bpe_of_odd_rows(spark):
    rows = {r.doc_id: r for r in bpe.encoded(odd(spark), keep=["doc_id"], digests=True).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert (rows[1].n_tokens, rows[1].ids_sha256, rows[2].decoded_sha256) == (0, none, none)
    assert bpe.encoded(empty(spark)).count() == 0 and "ids" in bpe.encoded(odd(spark)).columns


# 6 ---------------------------------------------------------------------------


def test_quality_counts(spark, sf):
    def brute(t):
        t = t or ""
        w = WORD.findall(t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        seen, again = set(), 0
        for line in t.split("\n"):
            again += bool(WORD.search(line)) and line in seen
            seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(hit)

    paths = quality.vocabularies(None)
    rng = random.Random(3)
    texts = [None, "", " \n "] + ["".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 80))) for _ in range(800)] + [t for _, t in texts_of(spark, sf)]
    m = quality.measure(pa.array(texts), paths)
    for i, t in enumerate(texts):
        assert tuple(int(m[c][i]) for c in quality.COUNTS) == brute(t)
    for k, path in enumerate(paths):
        tokens, _ = quality.state(path)
        end = f"_{k + 1}" if k else ""
        for i in range(len(texts) - 30, len(texts)):
            ids = [x for w in WORD.findall(texts[i]) for x in (tokens.model.encode_ordinary(" " + w) if k else tokens.model.encode(w))]
            c = collections.Counter(ids)
            assert m["n_tokens" + end][i] == len(ids) and abs(m["token_entropy" + end][i] + sum(n / len(ids) * math.log2(n / len(ids)) for n in c.values())) < 1e-9


def test_quality_verdict(spark, sf):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality")
    rows = quality.op6_quality(spark, path).join(labels, "doc_id", "left").collect()
    prose = [r for r in rows if not r.base_failed and r.n_symbols < 0.05 * r.n_words]
    assert sum(r.kept for r in prose) >= 0.98 * len(prose) and not any(r.kept for r in rows if r.base_failed)
    junk = [r for r in rows if r.quality == 0 and not r.base_failed]  # the bands see no labels
    assert len(junk) >= 15 and sum(r.kept for r in junk) <= 0.5 * len(junk)
    bad = " ".join(f"abc\U0001f9ff\U0001f9ff{i}" for i in range(300))  # byte fallback in Latin text
    good = " ".join(f"{a}{b} and" for a in ("river", "stone", "cloud", "garden", "winter") for b in ("s", "ed", "ing", "er", "less", "ful", "side", "like"))
    found = {r.doc_id: r.kept for r in quality.assessed(spark.createDataFrame([(1, bad), (2, good), (3, "x " * 100)], "doc_id long, text string")).collect()}
    assert found == {1: False, 2: True, 3: False}
    fitted = quality.fit(odd(spark), lang="lang")
    assert quality.assessed(odd(spark), fitted, lang="lang").count() == 8 and quality.assessed(empty(spark), quality.fit(empty(spark))).count() == 0


def test_quality_bands_are_fitted(spark):
    """Planted junk of each kind is rejected by bands fitted on a mixture that
    holds it; other scripts have bands of their own."""
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    prose = lambda letters: " ".join(word(letters) for _ in range(rng.randint(140, 160)))
    latin, greek = "etaoinshrdlu", "αειοντσρκλ"
    rows = [(i, prose(latin if i % 2 else greek), None if i % 3 else "xx") for i in range(600)]
    junk = [(1000 + i, " | ".join(word(latin) for _ in range(100)), None) for i in range(10)] + [(1100 + i, " ".join(word(latin) + "☃\U0001f9ff" for _ in range(120)), None) for i in range(10)]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    fitted = quality.fit(df, lang="lang")
    assert {k[:2] for k in fitted} >= {("script", "latin"), ("script", "greek"), ("lang", "xx")}
    kept = {r.doc_id: r.kept for r in quality.assessed(df, fitted, lang="lang").collect()}
    assert not any(kept[i] for i, *_ in junk) and sum(kept[i] for i, *_ in rows) >= 0.98 * len(rows)


def test_quality_bands_count_all_texts(spark):
    """Bands are the quartiles of all distinct texts, however many, and of
    languages with few of them; the query's way gives the same verdicts."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    texts = [" ".join(rng.choices(vocabulary, k=70 if i % 300 == 0 else rng.choice((70, 150)))) for i in range(9500)]
    rows = [(i, t, "rare" if i % 300 == 0 else "aa" if i % 2 else None) for i, t in enumerate(texts)]  # 32 rare ones
    rows += [(20_000 + i, t, "bb") for i, t in enumerate(texts[:40])] + [(30_000 + i, texts[1], "aa") for i in range(500)] + [(40_000, None, "aa"), (40_001, " ".join("\u200b" * k for k in range(1, 61)), "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    fitted = quality.fit(df, lang="lang")
    paths = quality.vocabularies(None)
    m = quality.measure(pa.array(texts), paths)
    octaves, failing = quality.octave(m["n_tokens"]), quality.failing(m)
    groups = collections.defaultdict(set)
    for i, t, lang in rows:
        i = i if i < 9500 else {20_000: i - 20_000, 30_000: 1}.get(i // 10_000 * 10_000)
        if i is not None and not failing[i]:
            groups["script", "latin", octaves[i]].add(i)
            if lang is not None:
                groups["lang", lang, octaves[i]].add(i)
    groups = {k: sorted(g) for k, g in groups.items() if len(g) >= quality.ROWS}
    assert set(fitted) == set(groups) and any("rare" in k for k in groups) and len(groups) >= 5
    for k, g in groups.items():
        for name in quality.measures(paths):
            low, high = np.percentile(m[name][g], (25, 75))
            room = quality.WIDTH * max(high - low, quality.MEASURES[name.removesuffix("_2")])
            assert fitted[k][name] == pytest.approx((-math.inf if name.startswith("byte_share") else low - room, high + room), rel=1e-12)
    one, other = ({r.doc_id: r for r in x.collect()} for x in (quality.assessed(df, fitted, lang="lang"), quality.screened(df, lang="lang")))
    assert one == other and len(one) == len(rows) and 0 < sum(r.kept for r in one.values()) and not one[40_001].kept
    assert quality.screened(empty(spark), lang="lang").count() == 0
    both = [sorted(map(repr, x.collect())) for x in (quality.assessed(odd(spark)), quality.screened(odd(spark), lang="lang"))]
    assert both[0] == both[1] and len(both[0]) == 8


# 7 ---------------------------------------------------------------------------


def test_html_main_text(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    mine = {r.page_id: r for r in htmlmain.op7_html_extraction(spark, sf).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", inner)
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks) if x)
        assert mine[r.page_id].text == want and mine[r.page_id].n_chars == len(want)


def test_html_furniture():
    source = """<!DOCTYPE html><body><header>h</header><nav><p>menu</nav><main><div class="cookie-notice">c</div><h1>A &amp; B</h1><p>one <b>two
    three<p>four<br>five<aside>side</aside><script>if (a < b) "</p>"</script><form>f</form><ul><li>x<li>y</ul><div id="comments"><p>rant</p></div></main><footer>foot</footer>"""
    assert htmlmain.extract(source, []) == "A & B\none two three\nfour five\nx\ny"
    assert htmlmain.extract("<div>plain<!-- no --> text</div><p>more", []) == "plain text\nmore"
    deep = "<div>" * 5000 + "x<nav>menu</nav>y" + "</div>" * 5000
    assert htmlmain.extract(deep, []) == "x\ny"
    assert htmlmain.extract(None, []) == htmlmain.extract("", []) == "" and htmlmain.extract("a < b &lt; c", []) == "a < b < c"


def test_html_templates(spark):
    page = lambda i: f"<html><body><div class='top'>Site</div><div class='wrap'><h2>Title {i}</h2><p>{'word ' * 50} {i}</p></div><div class='low'>end</div></body></html>"
    rows = [(i, "http://Host.example/x", page(i)) for i in range(6)] + [(9, None, None), (9, "no url", "<p>q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    found = {r.host: r.mains for r in htmlmain.templates(df).collect()}
    p = htmlmain.Page(page(1))
    wrap = next(p.parent[t] for t, tag in p.tag.items() if tag == "h2")
    assert found == {"host.example": [wrap]}
    mine = htmlmain.extracted(df).collect()
    assert len(mine) == 8 and all(r.text.startswith("Title") and "Site" not in r.text for r in mine if r.page_id < 6)
    assert htmlmain.extracted(df.limit(0)).count() == 0


def test_html_letters_that_change_length():
    source = "<article><p>before İ İİİ text</p><SCRIPT>x</p></Script><p>after one</p><style>p</STYLE ><p>K two</p></article>"
    assert htmlmain.extract(source) == "before İ İİİ text\nafter one\nK two"


def test_html_names_are_a_tie_break():
    source = "<article><h1 class='header'>T</h1><div class='related-work'><p>earlier studies</p></div><p id='share-price'>up 3</p><div class='cookie-notice'>eat</div><div class='ad slot'>buy</div><div class='reader-comments'>" + "long rant " * 40 + "</div></article>"
    assert htmlmain.extract(source) == "T\nearlier studies\nup 3"
    assert htmlmain.extract("<div class='page sidebar-left'><h1>T</h1><p>" + "long text " * 9 + "</div><div class='sidebar'>side</div>") == "T\n" + ("long text " * 9).strip()
    assert htmlmain.extract("<p>a longer text <span class='ad'>x <span>y</span> z</span> b</p>") == "a longer text b"


def unnamed_page(rng, i):
    """A page without article or main, with unnamed menu, adverts and footer."""
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    menu = "".join(f"<li><a href='/{w}'>{w}</a>" for w in words(5).split())
    body = [f"Title {i} {words(3)}", *[words(rng.randint(10, 40)) for _ in range(rng.randint(3, 6))]]
    text = f"<h1>{body[0]}</h1>" + "<div class=k9>Join our list today</div>".join(f"<p>{p}</p>" for p in body[1:])
    return f"<html><body><div class=a1><ul>{menu}</ul></div><div class=b2><div class=c3>{words(8)}</div><div class=d4>{text}</div><div class=e5>{words(9)}</div></div><div class=f6>{words(6)}</div></body></html>", "\n".join(body)


def test_html_main_by_template(spark):
    rng = random.Random(11)
    made = [unnamed_page(rng, i) for i in range(40)]
    df = spark.createDataFrame([(i, f"https://u@www.a.example:80/{i}", h) for i, (h, _) in enumerate(made)], "page_id long, url string, html string")
    mine = {r.page_id: r.text for r in htmlmain.extracted(df).collect()}
    assert [mine[i] for i in range(40)] == [t for _, t in made]
    assert all(htmlmain.extract(h) != t for h, t in made)  # without the template none is right


def test_html_hot_host_and_deep_pages(spark):
    deep = "<div>" * 30_000 + "<p>x<nav>menu</nav>y" + "</div>" * 30_000
    assert htmlmain.extract(deep) == "x\ny"
    rows = [(i, "http://hot.example/", f"<body><div class=n>All rights kept</div><main><p>Part {i % 7} of {i}</p></main></body>") for i in range(300)]
    rows += rows[:3] + [(1000, "http://hot.example/", deep), (1001, "http://hot.example/", "<p>" + "long " * 200_000), (1002, "http://hot.example/", "")]
    found = htmlmain.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows) and all(r.text == f"Part {r.page_id % 7} of {r.page_id}" for r in found if r.page_id < 300)
    mine = {r.page_id: r for r in found}
    assert mine[1000].text == "x\ny" and mine[1001].n_chars == 999_999 and mine[1002].text == ""


def test_html_repeated_text(spark):
    page = lambda i: f"<body><article><h1>Title {i}</h1><div class='x1'>Read our paper every day</div><p>Story {i} of the <b>town</b></p><div class='q7'>Part {i}<p>Join <i>us</i> now</p></div></article></body>"
    rows = [(i, "http://a.example/x%d" % i, page(i)) for i in range(6)] + [(10 + i, "http://b.example/x%d" % i, page(1)) for i in range(4)] + [(20, "http://c.example/x", page(20))]
    mine = {r.page_id: r.text for r in htmlmain.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [mine[i] for i in range(6)] == [f"Title {i}\nStory {i} of the town\nPart {i}" for i in range(6)]
    whole = "Title {0}\nRead our paper every day\nStory {0} of the town\nPart {0}\nJoin us now"
    assert {mine[10 + i] for i in range(4)} == {whole.format(1)} and mine[20] == whole.format(20)  # copies, or too few pages, show no template


# 8 ---------------------------------------------------------------------------


def test_cross_parsing_is_brute_force():
    texts = {"en": "the cat sat on the mat and then the dog ran", "fr": "le chat est sur la table et puis le chien"}
    tables = langid.Tables(langid.Model(tuple(sorted(texts.items()))))

    def phrases(t, ref):
        n = at = 0
        while at < len(t):
            k = 1
            while at + k < len(t) and t[at : at + k + 1] in ref:
                k += 1
            at, n = at + k, n + 1
        return n

    rng = random.Random(0)
    for _ in range(200):
        t = langid.normal("".join(rng.choice("abcdehlnorst uéz,") for _ in range(rng.randint(1, 80))))
        codes, offsets, _ = tables.letters(pa.array([t]))
        assert tables.phrases(codes, offsets)[:, 0].tolist() == [phrases(t, texts[x]) for x in ("en", "fr")]


@pytest.mark.parametrize("block", [1, 2, 7, 1024])
def test_phrases_cross_blocks(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(4)
    text = lambda n, k: "".join(rng.choice("abc "[:k]) for _ in range(n))
    refs = tuple((x, langid.normal(text(300, k) + "x" * 40)) for x, k in (("a", 2), ("b", 3), ("c", 4)))
    tables = langid.Tables(langid.Model(refs))
    texts = [langid.normal(t) for t in ["x" * 90, refs[0][1], refs[1][1][3:] * 30, text(5000, 4), "", "b", *[text(rng.randint(1, 60), 4) for _ in range(60)]]]

    def phrases(t, ref):
        n = at = 0
        while at < len(t):
            k = 1
            while at + k < len(t) and t[at : at + k + 1] in ref:
                k += 1
            at, n = at + k, n + 1
        return n

    codes, offsets, _ = tables.letters(pa.array(texts))
    assert tables.phrases(codes, offsets).T.tolist() == [[phrases(t, ref) for _, ref in refs] for t in texts]


def test_language_of_many_scripts(spark):
    rng = random.Random(6)
    scripts = {"ar": 0x627, "el": 0x3B1, "en": 0x61, "ja": 0x3042, "ko": 0xAC00, "ru": 0x430, "zh": 0x4E00}
    spread = {"ja": 80, "ko": 400, "zh": 600}

    def text(lang):
        letters = [c for c in map(chr, range(scripts[lang], scripts[lang] + spread.get(lang, 24))) if c.isalpha()]
        return " ".join("".join(rng.choice(letters) for _ in range(3)) for _ in range(40))

    refs = tuple((x, langid.normal(" ".join(text(x) for _ in range(20)))) for x in sorted(scripts))
    tables = langid.Tables(langid.Model(refs))
    assert not tables.shared and tables.rare.any()
    texts = [(x, langid.normal(text(x) + " " + text(y)[:9])) for x in scripts for y in ("en", "zh", "ru")]

    def phrases(t, ref):
        n = at = 0
        while at < len(t):
            k = 1
            while at + k < len(t) and t[at : at + k + 1] in ref:
                k += 1
            at, n = at + k, n + 1
        return n

    codes, offsets, _ = tables.letters(pa.array([t for _, t in texts]))
    assert tables.phrases(codes, offsets).T.tolist() == [[phrases(t, ref) for _, ref in refs] for _, t in texts]
    best, score = tables.predict(pa.array([t for _, t in texts]))
    assert [tables.languages[b] for b in best] == [x for x, _ in texts] and (score > 0.5).all()


def test_all_languages_are_learned(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in str(100 + i)) * 3
    df = spark.createDataFrame([(i, f"l{i:03}", f"{word(i)} {word(i)}") for i in range(90)], "doc_id long, lang string, text string")
    model = langid.fit(df)
    assert len(model.references) == 90
    assert all(r.lang == r.lang_pred for r in langid.identified(df, model).collect())


def test_language_held_out(spark, sf):
    rows = langid.op8_language_id(spark, "/root/testdata/sf0.01").join(documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    model = langid.fit(odd(spark))
    rows = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(odd(spark), model, keep=["doc_id"]).collect()}
    assert rows[1] == rows[2] == rows[3] == ("und", 0.0) and rows[5][0] in ("en", "fr")
    assert [r.lang_pred for r in langid.identified(odd(spark), langid.fit(empty(spark)), keep=["doc_id"]).collect()] == ["und"] * 8
    assert langid.identified(empty(spark), model).count() == 0


# 9 ---------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_nearest(rows, queries, k=20):
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q in queries:
        s = (m * m[q]).sum(axis=1)
        keep = ids != ids[q]
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[int(ids[q])] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist(), strict=True))
    return out


def test_nearest_recall(spark):
    path = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").orderBy("vec_id").collect()]
    want = brute_nearest(rows, [i for i, (v, _) in enumerate(rows) if v % 20 == 0])
    mine = collections.defaultdict(list)
    for r in annsearch.op9_nearest(spark, path).orderBy("query_id", "rank").collect():
        mine[r.query_id].append((r.vec_id, r.score, r.rank))
    hits = 0
    for q, found in want.items():
        assert [x[2] for x in mine[q]] == list(range(1, 21))
        hits += len({v for v, _ in found} & {x[0] for x in mine[q]})
        exact = dict(found)
        assert all(abs(s - exact[v]) < 1e-12 for v, s, _ in mine[q] if v in exact)
    assert hits >= 0.9 * 20 * len(want)


def test_nearest_sql(spark):
    import duckdb

    from tideline.llm import queries

    c = duckdb.connect()
    c.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    mine = sorted(tuple(r) for r in annsearch.op9_nearest(spark, "/root/testdata/sf0.01").collect())
    assert mine == sorted(c.execute(queries.SQL["op9_nearest"]).fetchall())


def test_visited_cells_come_by_distance():
    rng = np.random.default_rng(1)
    index = annsearch.Index(rng.normal(size=(5, 3)), rng.normal(size=(4, 3)))
    index.share[:] = 1 / 20
    for _ in range(20):
        q = rng.normal(size=6)
        d = (index.distances(q[None, :3], index.left)[0][:, None] + index.distances(q[None, 3:], index.right)[0][None, :]).ravel()
        cells = index.visited(q, 0.99)
        assert len(cells) == 20 and np.allclose(d[cells], np.sort(d))


def test_clustered_vectors_are_searched_in_part(spark, monkeypatch):
    monkeypatch.setattr(annsearch, "BLOCK", 16)  # many blocks
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(40, 16))
    x = middles[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    shares = []
    searched = annsearch.Index.searched

    index = annsearch.Index(annsearch.centroids(x[:, :8], 16, 1), annsearch.centroids(x[:, 8:], 16, 2))
    cell = index.cell(x)
    count = np.bincount(cell, minlength=256)
    index.share = (count / 4000).reshape(16, 16)
    spread = index.spread(x, cell)
    most = np.stack([np.array([s[cell == c].max(initial=0.0) for c in range(256)]) for s in spread])
    for q in x[::100]:
        cells, _ = searched(index, q, x, cell, most, count > 0, 20, annsearch.VISIT)
        shares.append(count[cells].sum() / 4000)
    assert np.mean(shares) < 0.3
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    mine = collections.defaultdict(list)
    for r in annsearch.nearest(spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS), "vec_id % 100 = 0").orderBy("query_id", "rank").collect():
        mine[r.query_id].append(r.vec_id)
    assert dict(mine) == {q: [v for v, _ in found] for q, found in brute_nearest(rows, range(0, 4000, 100)).items()}


def test_nearest_with_mixed_norms(spark, monkeypatch):
    monkeypatch.setattr(annsearch, "BLOCK", 16)  # so that cells are skipped
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[::10] *= 5
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    mine = collections.defaultdict(list)
    for r in annsearch.nearest(df, "vec_id % 100 = 1").orderBy("query_id", "rank").collect():
        mine[r.query_id].append(r.vec_id)
    want = brute_nearest(rows, range(1, 3000, 100))
    assert dict(mine) == {q: [v for v, _ in found] for q, found in want.items()}


def test_nearest_with_repeats_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(120)] + [(200 + i, [1.0] * 8) for i in range(60)]
    bad = [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [float("inf")] + [1.0] * 7), (480, [1.0, 2.0]), (500, [None] + [1.0] * 7), (520, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad] + [(None, [1.0] * 8, 1)], VECTORS).withColumn("h", F.lit("clash")).withColumn("cell", F.lit("clash"))
    mine = collections.defaultdict(list)
    for r in annsearch.nearest(df, "vec_id % 20 = 0", visit=1.0).orderBy("query_id", "rank").collect():
        mine[r.query_id].append(r.vec_id)
    want = brute_nearest(rows, [i for i, (v, _) in enumerate(rows) if v % 20 == 0])
    assert dict(mine) == {q: [v for v, _ in found] for q, found in want.items()}
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1)], VECTORS)
    assert [(r.query_id, r.vec_id, r.score) for r in annsearch.nearest(few, "vec_id % 20 = 0").collect()] == [(0, 1, 0.5)]
    assert annsearch.nearest(df.limit(0), "vec_id % 20 = 0").count() == 0


# 10 --------------------------------------------------------------------------


def test_marginals_are_the_forward_backward_pass():
    u, moves = np.random.default_rng(0).normal(-2, 3, 2500), (-1.0, 0.5, 2.0)
    p01, p10, p11 = toxicity.potentials(moves)
    t = np.array([[1, p01], [p10, p11]])
    offsets = np.array([0, 0, 5, 2500])
    mine = toxicity.marginals(u, offsets, moves)[0]
    for a, b in ((0, 5), (5, 2500)):
        e = np.stack((np.ones(b - a), np.exp(u[a:b])), axis=1)
        f, g = np.zeros_like(e), np.ones_like(e)
        f[0] = e[0] / e[0].sum()
        for i in range(1, b - a):
            f[i] = (f[i - 1] @ t) * e[i]
            f[i] /= f[i].sum()
        for i in range(b - a - 2, -1, -1):
            g[i] = t @ (e[i + 1] * g[i + 1])
            g[i] /= g[i].sum()
        assert np.abs(np.log(f[:, 1] * g[:, 1] / (f[:, 0] * g[:, 0])) - mine[a:b]).max() < 1e-9


def test_toxicity_held_out(spark):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op10_toxicity(spark, path).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    clean = [r for r in rows if r.toxic == 0]
    assert right >= 0.9 * len(rows) and sum(r.predicted == 0 for r in clean) >= 0.97 * len(clean)


def test_toxic_words_of_long_texts(spark):
    filler = " ".join(f"word{i % 97}" for i in range(800))  # over 4,000 code points
    rows = [(i, f"{filler} {'vileslur' if i % 2 else 'kindword'} {filler}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert all(r.predicted == r.doc_id % 2 for r in toxicity.scored(df.select("doc_id", "text"), model).collect())


def test_toxic_spans_and_odd_rows(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    train = [(" ".join([word() for _ in range(40)] + (["Villain!"] * 2 if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(150)]
    model = toxicity.train(train, 1 / 3)
    score, spans = toxicity.judge(pa.array([None, "", "ein Villain! da", "nothing at all"]), model)
    assert spans == ["", "", "4:12", ""] and score[2] > 0.5 > score[3] and abs(score[0] - score[1]) < 1e-12
    rows = toxicity.scored(odd(spark), model).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    flat = toxicity.fit(odd(spark), none)
    assert toxicity.scored(odd(spark), flat).where("predicted = 1").count() == 0 and toxicity.scored(empty(spark), flat).count() == 0


# Pipeline --------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = documents(spark, sf)
    rows = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.cut(stage(spark, kept, sf), f"test-{name}")
        assert kept.columns == docs.columns
    assert rows == {r.doc_id for r in kept.select("doc_id").collect()} and 0 < len(rows) < docs.count()
    assert not kept.where("text rlike '[0-9a-f]{40}'").count() and kept.where("n_chars <> length(text)").count() == 0
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0
    odd_docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11), (None, "some words here", "en", "s", 15)], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd_docs = common.cut(stage(spark, odd_docs, sf), "odd")
    assert odd_docs.where("doc_id is null").count() == 1 and odd_docs.where("doc_id = 3").count() == 1
