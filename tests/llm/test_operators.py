"""Corpus operators against brute force on a small corpus with nulls, empty, blank and long texts, ties, repeated rows
and extra columns with names that the operators use themselves."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlark.llm import decontaminate, kernel, language_model, line_dedup, links, near_dedup, packing, pii, repeats, toxicity, url_filter
from gridlark.llm.common import without
from gridlark.llm.exact_dedup import exact_dedup
from gridlark.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, bucket int, row int, tag string"


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("the of and in on to a is".split()) if r.random() < 0.4 else "".join(r.choice("ea on th st ing er ou ti".split()) for _ in range(r.randint(2, 4))) for _ in range(n)]


def edited(text, k, seed):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(k):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    base = [" ".join(words(120, s)) for s in range(30)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[3]) for i in range(6)] + [(120 + i, base[4].upper()) for i in range(2)]
    out += [(200 + i, edited(base[5], 3, i)) for i in range(40)] + [(300 + i, edited(base[6], 12, i)) for i in range(20)]
    passage = " ".join(words(60, 99))
    out += [(400 + i, f"{' '.join(words(20, 1000 + i))} {passage} {' '.join(words(20, 2000 + i))}") for i in range(10)]
    out += [(500, None), (501, ""), (502, " \n\t "), (503, "one"), (504, "one"), (505, "a" * 900), (506, "é" * 300 + " ñandú"), (507, " ".join(words(4000, 7)))]
    out += [(600 + k, "\n".join(["same line of text here to be repeated", "and another one", "", f"own line {k} " + " ".join(words(12, 3000 + k))])) for k in range(3)]
    out += [(None, base[3]), (8, base[8])]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, "t") for i, t in texts], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def counted(rows):
    return Counter(map(tuple, rows))


def test_exact_dedup(docs, none, texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[lower(t)].append(i)
    want = Counter()
    for i, t in texts:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        want[(i, keep, len(g), i == keep, hashlib.sha256(lower(t).encode()).hexdigest())] += 1
    assert counted(exact_dedup(docs).collect()) == want
    assert counted(exact_dedup(docs, buckets=1).collect()) == want
    assert exact_dedup(none).count() == 0


def brute_near(texts, width, percent):
    sets = {}
    for i, t in texts:
        w = tokens(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(sets[i]), None if i is None else find(i), i is None or find(i) == i) for i, _ in texts)


@pytest.mark.parametrize(("width", "gathered"), [(2, 16 << 20), (2, 100), (5, 16 << 20)])
def test_near_dedup(docs, texts, monkeypatch, width, gathered):
    monkeypatch.setattr(links, "GATHERED", gathered)
    monkeypatch.setattr(links, "MANY", 8)
    assert counted(near_dedup.near_duplicates(docs, width=width).collect()) == brute_near(texts, width, 80)


def test_near_dedup_where_pivots_coincide(spark):
    # buckets of three whose pivots all fall on the smallest id, which resembles the other two less than they each other
    triples = spark.range(3000).where(" and ".join(f"xxhash64(id * 3, {p}) < least(xxhash64(id * 3 + 1, {p}), xxhash64(id * 3 + 2, {p}))" for p in range(1, links.PIVOTS)))
    firsts, rows, pairs = [3 * x.id for x in triples.limit(40).collect()], [], set()
    sign = near_dedup._signer(2, 1, 1)
    for first in firsts:
        base = [f"w{first}x{k}" for k in range(60)]
        group = [base[:], base[:], base[:59] + ["z"]]
        for k in (10, 20, 30, 40):
            group[0][k] += "y"
        texts = [" ".join(g) for g in group]
        keys = next(sign(iter([pa.record_batch({"id": pa.array([0, 1, 2]), "text": pa.array(texts)})]))).column("keys").to_pylist()
        if keys[0] == keys[1] == keys[2]:
            rows += [(first + k, t) for k, t in enumerate(texts)]
            pairs.add((first + 2, first + 1))
    assert len(pairs) > 10
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2, bands=1, rows_per_band=1)
    assert {(x.doc_id, x.component_id) for x in found.where("not kept").collect()} == pairs


def test_near_dedup_of_nothing(none):
    assert near_dedup.near_duplicates(none, width=2).count() == 0


def brute_repeats(texts, n):
    data = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(x[k : k + n] for _, x in data for k in range(len(x) - n + 1))
    out = Counter()
    for i, x in data:
        gone = bytearray(len(x))
        for k in range(len(x) - n + 1):
            if seen[x[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        spans = sum(1 for k in range(len(x)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[(i, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("transform", [1 << 20, 2000])
def test_repeats(docs, none, texts, monkeypatch, transform):
    monkeypatch.setattr(repeats, "TRANSFORM", transform)
    assert counted(repeats.remove_repeats(docs).collect()) == brute_repeats(texts, 200)
    if transform > 2000:
        assert repeats.remove_repeats(none).count() == 0


def test_interval_expansion():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 3, 600).astype(np.uint16)
    text[300:420] = text[20:140]
    text[[150, 450, 599]] = 0
    s = text.astype("<u2").tobytes()
    for depth in (3, 9, 40):
        pieces = [s[2 * i : 2 * (i + depth)] for i in range(len(text) - depth + 1)]
        c = Counter(pieces)
        want = [0 not in np.frombuffer(p, dtype="<u2") and c[p] > 1 for p in pieces]
        got = repeats.repeated_suffixes(text, depth)
        solid = [0 not in np.frombuffer(p, dtype="<u2") for p in pieces]
        assert [bool(g) for g, ok in zip(got, solid, strict=False) if ok] == [w for w, ok in zip(want, solid, strict=True) if ok]


def test_language_model(docs, none, texts):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0
    out = language_model.log_bilinear_scores(docs, held, vocab=40).collect()
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in texts if not is_held(i) for w in [*tokens(t), None])
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for i, t in texts:
        w = [*tokens(t), None]
        want[i].append((is_held(i), len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    assert len(out) == len(texts)
    for r in out:
        assert r.score < 0
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and math.isclose(r.base_score, w[4], rel_tol=1e-9) for w in want[r.doc_id])
    assert language_model.log_bilinear_scores(none, held).count() == 0


def test_model_learns_contexts(spark):
    """Texts of one of two languages each: held-out texts are likelier than by word counts."""
    r = random.Random(1)
    rows = [(k, " ".join(f"{'ab'[k % 2]}{r.randrange(15)}" for _ in range(80))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = language_model.log_bilinear_scores(docs, F.col("doc_id") >= 500).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (out.s - out.b) / out.n > 0.2


def _model(size=9, dims=4, words=5):
    rng = np.random.default_rng(0)
    return language_model.Model(vocab=np.sort(rng.integers(0, 2**62, words)), contexts=rng.normal(size=(3, size + 1, dims)).astype(np.float32), outputs=rng.normal(size=(size, dims)).astype(np.float32), bias=rng.normal(size=size).astype(np.float32), noise=np.full(size, 1 / size), class_base=np.zeros(language_model.CLASSES), head=np.zeros(0, dtype=np.int64), head_log=np.zeros(0), mark=np.arange(size + 1) < 2, end_log=0.0)


def test_model_is_normalised():
    model = _model()
    contexts = np.array([[0, 3, 9], [9, 2, 9], [1, 9, 0]])
    words, which = np.tile(np.arange(9), 3), np.repeat(np.arange(3), 9)
    p = np.exp(language_model.log_probabilities(model, contexts, words, which, at_once=2)).reshape(3, 9)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    for k in range(3):
        s = sum(model.contexts[j, contexts[j, k]] for j in range(3)) @ model.outputs.T + model.bias
        assert np.allclose(p[k], np.exp(s) / np.exp(s).sum(), atol=1e-5)


def test_large_scores_are_normalised():
    model = _model()
    model.bias[:] = 500.0 * np.arange(9) - 2000
    p = language_model.log_probabilities(model, np.array([[0], [2], [1]]), np.arange(9), np.zeros(9, dtype=np.int64))
    assert math.isclose(np.exp(p).sum(), 1, abs_tol=1e-5) and p[0] < -3000


def test_contexts_of_tokens():
    model = _model(size=language_model.CLASSES + 6, words=5)
    v, none, end = model.vocab, language_model.CLASSES + 6, language_model.CLASSES + 5
    words = np.array([v[0], v[3], v[4], v[2], v[3], v[1]])
    tokens, context = model.sequence(words, np.zeros(6, dtype=np.int64), np.array([5, 0, 1]))
    assert tokens.tolist() == [0, 3, 4, 2, 3, end, end, 1, end]
    assert context[0].tolist() == [none, 0, 3, 4, 2, 3, none, none, 1]
    assert context[1].tolist() == [none, none, 0, 3, 4, 2, none, none, none]
    assert context[2].tolist() == [none, none, none, 0, 0, 0, none, none, none]


def test_end_is_counted_apart_from_the_head(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 1)
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    out = {x.doc_id: x for x in language_model.log_bilinear_scores(df, F.col("doc_id") == 3, vocab=1).collect()}
    n = math.log10(6 + 0.1 * 4)
    assert out[3].n_known == 1 and math.isclose(out[3].base_score, math.log10(0.1) + math.log10(2.1) - 2 * n, rel_tol=1e-9)
    assert out[1].n_known == 3 and math.isclose(out[1].base_score, 3 * (math.log10(2.1) - n), rel_tol=1e-9)


def test_model_gains_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_model.log_bilinear_scores(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0)
    x = out.where("held_out").agg(((F.sum("score") - F.sum("base_score")) / F.sum("n_tokens")).alias("gain")).first()
    assert x.gain > LEAST_GAIN


#: Held-out gain a token over word counts, in log10.
LEAST_GAIN = 0.1


def test_line_dedup(docs, none, texts):
    out = line_dedup.line_dedup_report(docs).collect()
    lines = [(i, k, x) for i, t in texts if i is not None for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\r")]
    sets = {}
    for _, _, x in lines:
        b = x.encode()
        sets[x] = frozenset(b[j : j + 10] for j in range(max(1, len(b) - 9)))
    names = list(sets)
    parent = list(range(len(names)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            both = len(sets[names[a]] & sets[names[b]])
            if both >= 0.8 * (len(sets[names[a]]) + len(sets[names[b]]) - both):
                parent[find(a)] = find(b)
    number = {x: k for k, x in enumerate(names)}
    first, gone = {}, defaultdict(set)
    for i, k, x in sorted(lines):
        c = find(number[x])
        if first.setdefault(c, (i, k)) != (i, k):
            gone[i].add(k)
    assert {r.doc_id: set(r.removed) for r in out if r.removed} == gone
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count()
    assert kept.where("doc_id = 100").first().text == ""
    assert line_dedup.drop_repeated_lines(none).count() == 0


@pytest.mark.parametrize("gathered", [16 << 20, 100])
def test_line_dedup_compares_all_of_a_bucket(spark, monkeypatch, gathered):
    # lines with a common half in one bucket: pairs of copies that resemble neither of the bucket's pivots are found
    monkeypatch.setattr(links, "GATHERED", gathered)
    r = random.Random(5)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common, lines = letters(150), []
    for _ in range(12):
        own = letters(90)
        lines += [common + own, common + own + letters(10)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "minima", lambda hashes, begins, ends, n: np.zeros((n, len(begins)), dtype=np.uint32))
    found = {(x.id, x.keep_id) for x in line_dedup.repeated_lines(df).collect()}
    assert found == {(k + 1, k) for k in range(0, len(lines), 2)}


def test_line_dedup_compares_no_sets_of_too_different_sizes(spark, monkeypatch):
    # as many shingles, but of the second line only two distinct ones
    r, compared, confirm = random.Random(9), [], links._confirm
    lines = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200)), "ab" * 100]
    monkeypatch.setattr(line_dedup, "minima", lambda hashes, begins, ends, n: np.zeros((n, len(begins)), dtype=np.uint32))
    monkeypatch.setattr(links, "_confirm", lambda pairs, *how: compared.append(pairs.where("rep <> b").count()) or confirm(pairs, *how))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert line_dedup.repeated_lines(df).count() == 0 and compared == [0]
    hashes = np.array([7, 7, 9, 1 << 40, 7], dtype=np.uint64) << np.uint64(20)
    assert line_dedup._distinct(hashes, np.array([2, 0, 2, 1])).tolist() == [1, 0, 2, 1]


def test_line_dedup_of_templated_lines(spark):
    # lines of one template with a similarity of 0.5 to 0.7; 300 pairs of them at 0.88
    r = random.Random(8)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common, lines = letters(110), []
    for _ in range(300):
        own = letters(60)
        lines += [common + own, common + own + letters(20)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {(x.id, x.keep_id) for x in line_dedup.repeated_lines(df).collect()} == {(k + 1, k) for k in range(0, len(lines), 2)}


@pytest.mark.parametrize("percent", [80, 50, 100])
def test_joining_links(percent):
    # against all pairs: the same components, without comparing sets that share only what all share
    rng = np.random.default_rng(percent)
    sets = [np.unique(np.concatenate([[1, 2], rng.integers(3, 40, rng.integers(0, 9))])).astype(np.uint64) for _ in range(200)]
    sets += [sets[k][:-1] for k in range(0, 200, 3)] + [np.zeros(0, dtype=np.uint64)]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a]) and 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))]

    def components_of(edges):
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        return [find(x) for x in range(len(sets))]

    counts = np.array([len(s) for s in sets])
    got = links.joining_links(np.concatenate(sets), counts, np.zeros(len(sets), dtype=int), np.arange(len(sets)), percent)
    other = links._one_by_one(links._Sets(np.concatenate(sets), counts, percent), np.arange(len(sets)), np.arange(len(sets)))
    for found in (got, other):
        assert {(max(e), min(e)) for e in found} <= set(pairs)
        assert components_of(found) == components_of(pairs)
    # two buckets with different hashes at once
    twice = links.joining_links(np.concatenate([*sets, *(s + np.uint64(1000) for s in sets)]), np.tile(counts, 2), np.repeat([0, 1], len(sets)), np.arange(2 * len(sets)), percent)
    assert components_of([(a, b) for a, b in twice if a < len(sets)]) == components_of([(a - len(sets), b - len(sets)) for a, b in twice if a >= len(sets)]) == components_of(pairs)


def test_joining_links_of_a_common_hash():
    # 40,000 sets that share one hash only: a second or so, since it is in no rare part
    n = 40_000
    hashes = np.concatenate([np.array([0, *(5 * k + j for j in range(1, 5))], dtype=np.uint64) for k in range(n)])
    began = time.perf_counter()
    assert links.joining_links(hashes, np.full(n, 5), np.zeros(n, dtype=int), np.arange(n), 80) == []
    assert time.perf_counter() - began < 10


def test_line_dedup_finds_pairs_at_the_threshold(spark):
    # 1000 pairs of similarity 81/101
    r = random.Random(6)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = [x for own in (letters(90) for _ in range(1000)) for x in (own, own + letters(20))]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {(x.id, x.keep_id) for x in line_dedup.repeated_lines(df).collect()} == {(k + 1, k) for k in range(0, len(lines), 2)}


def test_line_dedup_is_native_and_compares_all_of_a_bucket(spark, monkeypatch):
    # all bands in one bucket, looked at by pairs, after a pivot, and by rare hashes; no Python in any plan
    r = random.Random(5)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(n))
    common, lines = letters(150), []
    for _ in range(12):
        own = letters(90)
        lines += [common + own, common + own + letters(10)]
    lines += ["ha" * 30, "ha" * 300, "ab"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    plans, write = [], line_dedup.scratch

    def seen(table):
        plans.append(table._jdf.queryExecution().executedPlan().toString())
        return write(table)

    for module in (line_dedup, links):
        monkeypatch.setattr(module, "scratch", seen)
    monkeypatch.setattr(line_dedup, "band_key", lambda part, minima: F.lit(1).cast("long"))
    want = {(k + 1, k) for k in range(0, 26, 2)}
    for small, most in ((1000, 1000), (1, 1000), (1, 1)):
        monkeypatch.setattr(links, "ALL_PAIRS", small)
        monkeypatch.setattr(links, "MOST_PAIRS", most)
        assert {(x.id, x.keep_id) for x in line_dedup.repeated_lines(df).collect()} == want
    assert len(plans) > 30 and not any(name in plan for plan in plans for name in ("Arrow", "Python", "Pandas"))


def test_bands_and_sketches_miss_few_similar_sets(spark):
    # 3000 pairs of similarity 0.8 of 5 to 600 shingles in all: none without a common band, none ruled out
    r = random.Random(7)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for k in range(3000):
        one = letters(r.choice([13, 14, 17, 21, 29, 49, 89, 200, 489]))
        n = len(one) - 9
        rows += [(2 * k, one), (2 * k + 1, one + letters(n // 4))]
    df = spark.createDataFrame(rows, "rep long, line string")
    bands = line_dedup.band_rows(df.select("line", F.col("rep").alias("name")), 10, 15, 3)
    pair = F.floor(F.col("rep") / 2).alias("pair")
    assert bands.select("key", pair, "rep").groupBy("key", "pair").agg(F.count_distinct("rep").alias("c")).where("c = 2").select("pair").distinct().count() == 3000
    sk = links.sketches(df.select("rep", F.col("line").cast("binary").alias("payload")), line_dedup.shingle_set(10)).withColumn("pair", pair)
    assert {x.rep: x["size"] for x in sk.collect()} == {k: len({t[i : i + 10] for i in range(len(t) - 9)}) for k, t in rows}
    both = sk.where("rep % 2 = 0").alias("x").join(sk.where("rep % 2 = 1").alias("y"), "pair")
    assert both.where(links._may_fit("x", "y", 80)).count() == 3000


def test_sketches_rule_out_no_similar_pair_and_most_others(spark, monkeypatch):
    # lines of one template in one bucket: pairs at the threshold pass, and of those of similarity 0.65 few are compared
    r = random.Random(11)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common, lines = letters(350), []
    for _ in range(20):
        own = letters(93)
        lines += [common + own, common + own + letters(108)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "band_key", lambda part, minima: F.lit(1).cast("long"))
    monkeypatch.setattr(links, "ALL_PAIRS", 1000)
    compared, confirm = [], links._confirm
    monkeypatch.setattr(links, "_confirm", lambda pairs, *how: compared.append(pairs.count()) or confirm(pairs, *how))
    assert {(x.id, x.keep_id) for x in line_dedup.repeated_lines(df).collect()} == {(k + 1, k) for k in range(0, len(lines), 2)}
    assert 20 <= compared[0] <= 60


def test_long_lines_take_time_in_proportion(spark):
    # a column of bytes read for each shingle would copy 400 KB for each of 400,000: over ten seconds
    line = "".join(random.Random(12).choices("abcdefghijklmnopqrstuvwxyz", k=400_000)).encode()
    df = spark.createDataFrame([(1, bytearray(line))], "rep long, payload binary")
    began = time.perf_counter()
    assert links.sketches(df, line_dedup.shingle_set(10)).first()["size"] == len({line[i : i + 10] for i in range(len(line) - 9)})
    assert time.perf_counter() - began < 10


def test_decontamination(spark, docs, none):
    items = [" ".join(words(40, 5000)), "Alice bought 12 kg of fine apples, and Maria paid 40 dollars for the same 12 kg in the old market of town"]
    bench = spark.createDataFrame([(0, items[0]), (1, items[1]), (2, None), (3, "too short")], "item_id long, text string")
    other = items[1].replace("12", "75").replace("40", "9").replace("Maria", "Petra")
    clash = items[1].replace("same 12", "same 13")
    planted = [(9000, f"before it {items[0]} after it"), (9001, f"It says {other}"), (9002, items[0].upper()), (9003, " ".join(items[0].split()[:15])), (9004, edited(items[0], 1, 4)), (9005, clash)]
    more = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"), allowMissingColumns=True)
    out = {r.doc_id: r for r in decontaminate.contamination(more, bench).collect()}
    assert {i for i, r in out.items() if r.contaminated} >= {9000, 9001, 9002, 9004}
    assert not any(r.contaminated for i, r in out.items() if i is None or i < 9000 or i == 9003)
    leaks = {(r.id, r.item_id): r for r in decontaminate.leaks(more, bench).collect()}
    assert leaks[9001, 1].n_changed > 0 and leaks[9001, 1].consistent
    assert (9005, 1) not in leaks or leaks[9005, 1].plain_share >= 0.8
    left = decontaminate.drop_contaminated(more, bench)
    assert left.columns == more.columns
    assert left.count() == more.count() - sum(r.contaminated for r in out.values())
    assert decontaminate.drop_contaminated(none, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.where("false")).count() == docs.count()


def test_decontamination_of_names_at_the_start_of_sentences(spark):
    item = "Maria has a large basket with many red apples in it. Maria buys some more of them every week:\n\"Maria gives three of them away\" to a good friend who lives next door"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(0, item.replace("Maria", "Tom")), (1, item.replace("Maria", "Tom", 1))], "doc_id long, text string")
    assert {(r.id, r.n_changed) for r in decontaminate.leaks(df, bench).collect() if r.id == 0} == {(0, 1)}


@pytest.mark.parametrize("most", [1 << 21, 0])
def test_decontamination_looks_up_all_windows(spark, monkeypatch, most):
    # a lower-cased copy of a title shares no template window; nine words with the last one changed share four windows of five
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    title, short = " ".join(w.capitalize() for w in words(20, 1) if len(w) > 2), " ".join(words(9, 2))
    bench = spark.createDataFrame([(1, title), (2, short)], "item_id long, text string")
    docs = [(0, title.lower())] + [(1 + k, " ".join([*words(k, 50 + k), *short.split()[:-1], "other"])) for k in range(10)]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {(r.id, r.item_id) for r in found.collect()} == {(0, 1)} | {(1 + k, 2) for k in range(10)}


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(s)))) % 10 == 0


def base_spans(x):
    good = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 12 <= len(re.sub(r"\D", "", s)) <= 19 and luhn(re.sub(r"\D", "", s)), "phone": lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15}
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, x) if good[kind](m[0]))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in found]


def test_personal_data(spark, docs, none):
    cases = ["a.b@c.de_d@e.fg h@i", "x@y.z@w.v", "é 1.2.3.4.5.6.7.8 300.1.1.1 00255.0.0.1 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111", "+1 (234) 555-6789 +12 +49.30.1234567-", "9" * 5000, "a" * 50000, "1.2.3.4@5.6", "+1 4111111111111111", "a1" * 5000]
    r = random.Random(3)
    plain = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    learned = [f"Some text here, {x}." for k in range(60) for x in (f"ann.{k}@mail{k % 7}.example.com", f"{k}.{k + 90}.7.{3 * k}", f"+1 ({200 + 9 * k}) 555-{1000 + 77 * k}", CARDS[k], f'token = "{plain[k]}"')]
    hidden = {30_000: "write to user12 [at] mail3.com please", 30_001: "call me: (415) 555-2671", 30_002: "from host 10[.]20[.]30[.]40", 30_003: f"pay with {CARDS[60][:4]}/{CARDS[60][4:8]}/{CARDS[60][8:12]}/{CARDS[60][12:]}", 30_004: f"password: {plain[5][::-1]}"}
    not_hidden = {31_000: "order no. 415-555-2671", 31_001: "from host 310[.]20[.]30[.]40", 31_002: "pay with 4111/1111/1111/1112", 31_003: f"the commit {plain[7][::-1]}", 31_004: "meet at home. Then go"}
    rows = [(10_000 + k, x) for k, x in enumerate([*cases, *learned])] + [*hidden.items(), *not_hidden.items()]
    more = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    out = pii.find_personal_data(more).join(more.select("doc_id", "text"), "doc_id").collect()
    for x in out:
        base = base_spans(x.text or "")
        assert x.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), x
        assert set(base) <= set(x.spans.split(",")) | {""} and len(base) == x.n_email + x.n_ip + x.n_card + x.n_phone
        assert x.personal == bool(x.spans or x.secrets)
    by = {x.doc_id: x for x in out}
    assert [(by[i].spans, by[i].secrets) for i in hidden] == [("email:9:30", ""), ("phone:9:23", ""), ("ip:10:27", ""), ("card:9:28", ""), ("", "secret:10:50")]
    assert not any(by[i].personal for i in not_hidden)
    assert sum(by[10_000 + len(cases) + k].n_secrets for k in range(4, 300, 5)) == 60
    assert not any(x.n_added for x in out if x.doc_id is not None and x.doc_id < 10_000)
    assert pii.find_personal_data(none).count() == 0


def _card(k):
    body = f"4{k * 7919 % 10**14:014d}"
    return body + next(str(d) for d in range(10) if luhn(body + str(d)))


CARDS = [_card(k + 1) for k in range(61)]


def test_trees_fit_and_calibrate():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, len(pii.FEATURES)))
    y = ((x[:, 1] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    trees, start, threshold = pii.fit_trees(x[:3000], y[:3000])
    said = start + sum(pii.tree_values(t, x[3000:]) for t in trees) >= threshold
    assert y[3000:][said].mean() > 0.95 and said[y[3000:] == 1].mean() > 0.8
    for none in (y[:0], np.zeros(4000)):
        assert pii.fit_trees(x[: len(none)], none)[2] == float("inf")


def test_packing(docs, none, texts):
    out = packing.pack(docs, lengths=(64, 128, 256), shard_pieces=40).collect()
    assert sum(r.n_tokens for r in out) == sum(len(tokens(t)) + 1 for _, t in texts)
    bins = defaultdict(list)
    for r in out:
        bins[r.bin_id].append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in rows:
            assert r.bin_offset == at
            at += r.n_tokens
        cap = rows[0].bin_capacity
        assert cap in (64, 128, 256) and at <= cap and (cap == 64 or at > cap // 2)
    assert packing.pack(none).count() == 0
    used, room = sum(r.n_tokens for r in out), sum(rows[0].bin_capacity for rows in bins.values())
    assert used / room > 0.9


def packed_cost(sizes, lengths, top):
    bins, offsets, final = packing.best_fit(sizes, lengths)
    used = Counter()
    for b, n in zip(bins, sizes, strict=True):
        used[b] += n
    assert all(used[b] <= final[b] for b in used)
    final = [next(x for x in LENGTHS if x >= u) for u in (used[b] for b in sorted(used))]  # downsized to any permitted length
    return sum(packing.bin_cost(c, used[b], top) for b, c in enumerate(final)), Counter(final)


LENGTHS = (64, 128, 256)


def test_packing_beats_single_lengths():
    rng = np.random.default_rng(2)
    for spread in (0.5, 1.0, 1.5):
        sizes = np.clip(rng.lognormal(4, spread, 5000), 1, 256).astype(int).tolist()
        cost, opened = packed_cost(sizes, LENGTHS, 256)
        single, _ = packed_cost(sizes, (256,), 256)
        assert cost < single
        assert min(opened[x] for x in LENGTHS) > 20


def test_packing_against_all_partitions():
    def partitions(items):
        if not items:
            yield []
            return
        for rest in partitions(items[1:]):
            yield [items[:1], *rest]
            for k in range(len(rest)):
                yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]

    r, ratios = random.Random(4), []
    for _ in range(60):
        sizes = [r.choice((r.randint(1, 60), r.randint(40, 256))) for _ in range(r.randint(1, 6))]
        best = min(sum(packing.bin_cost(next(x for x in LENGTHS if x >= sum(b)), sum(b), 256) for b in p) for p in partitions(sizes) if all(sum(b) <= 256 for b in p))
        ratios.append((packed_cost(sizes, LENGTHS, 256)[0] + sum(sizes)) / (best + sum(sizes)))
    assert max(ratios) < 1.35 and np.mean(ratios) < 1.05 and np.mean(np.array(ratios) < 1.0001) > 0.5


def test_url_filter(spark):
    urls = ["http://www.A.example.org/es/1", "http://a.example.org/en/12?x", "https://b.com/fr/3#y", "https://b.com/de/3", "http://c.net/de/7", None, "no scheme", "http://d.org", "http://evilorg/x", "x://h?q", "http://b.com/de/4/5/6/7/8.html"]
    pages = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string, salt int")
    rules = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/")]
    r = {x.page_id: x for x in url_filter.judge_urls(pages, rules).collect()}
    assert [(r[k].host, r[k].path, r[k].rule, r[k].verdict) for k in range(4)] == [("www.a.example.org", "/es/1", "example.org/es/", "block"), ("a.example.org", "/en/12", "example.org/en/1", "block"), ("b.com", "/fr/3", "com/fr/", "allow"), ("b.com", "/de/3", "com/de/", "block")]
    assert [(r[k].host, r[k].path, r[k].rule) for k in (5, 6, 7, 8, 9)] == [("", "", None), ("", "", None), ("d.org", "", None), ("evilorg", "/x", None), ("h", "", None)]
    assert r[0][1:] == r[11][1:] and all(x.verdict in ("allow", "block") for x in r.values())
    assert url_filter.judge_urls(pages.where("false"), rules).count() == 0


def test_url_templates_learn(spark):
    rows = [(k, f"http://h.net/{'ads' if k % 3 == 0 else 'news'}/{k}.html", k % 3 == 0 if k < 150 else None) for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    r = {x.page_id: x for x in url_filter.judge_urls(pages, [], bad=F.col("bad")).collect()}
    assert all((r[k].verdict == "block") == (k % 3 == 0) for k in range(300))
    assert {x.template for x in r.values()} == {"/ads/*.html", "/news/*.html"}


def test_url_templates_of_unlabelled_hosts(spark):
    # labels on some hosts only: pages of other hosts are judged by the same templates; one host is bad throughout
    rows = [(k, f"http://h{k % 20}.net/{('ads', 'news', 'blog')[k % 3]}/a/b/c/d/e{k % 7}/x", k % 3 == 0 or k % 20 == 7 if k % 20 < 12 else None) for k in range(1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    r = {x.page_id: x for x in url_filter.judge_urls(pages, [], bad=F.col("bad")).collect()}
    assert all((r[k].verdict == "block") == (k % 3 == 0 or k % 20 == 7) for k in range(1200))
    assert {x.template for x in r.values()} == {f"/{s}/a/b/c/d/*/x" for s in ("ads", "news", "blog")}
    assert len({x.purity for x in r.values()}) > 3


def test_url_rules_against_sql(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    want = duckdb.sql(f"""
        with t as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from '{path}'),
        h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) as path from t)
        select page_id, host, path, case {' '.join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in longest)} end as rule from h""").fetchall()
    got = url_filter.judge_urls(spark.read.parquet(path), [url_filter.Rule(*r) for r in rules])
    assert counted(got.select("page_id", "host", "path", "rule").collect()) == counted(want)


def test_toxicity(spark, docs, none):
    r = random.Random(5)
    rows = [(k, " ".join([*words(60, 7000 + k), *(r.sample(["vilex", "scumx", "trashx"], 3 - k % 2) if k % 5 == 0 else [])])) for k in range(600)]
    more = docs.unionByName(spark.createDataFrame([(20_000 + k, t) for k, t in rows], "doc_id long, text string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(20_000 + k, k % 10 and 1, int(k % 5 == 0)) for k in range(400)] + [(None, 1, 1), (1, None, None), (2, None, 0)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in toxicity.score_severity(more, toxicity.graded_labels(labels)).collect()}
    assert {i - 20_000 for i, x in out.items() if x.rejected} == {k for k in range(600) if k % 5 == 0}
    assert all(0 <= x.severity <= 2 for x in out.values())
    left = toxicity.drop_toxic(more, toxicity.graded_labels(labels))
    assert left.columns == more.columns and left.count() == more.count() - 120
    assert toxicity.score_severity(none, toxicity.graded_labels(labels)).count() == 0
    assert not any(x.rejected for x in toxicity.score_severity(docs, toxicity.graded_labels(labels.where("false"))).collect())


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(80)] + [(300, 300), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x.id: x.comp for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_without(docs):
    gone = docs.where("doc_id in (1, 2)").select("doc_id").distinct()
    left = without(docs, "doc_id", gone)
    assert left.columns == docs.columns and left.count() == docs.count() - 2


def test_words_are_the_same_in_every_block():
    one = np.frombuffer(b"Alpha  beta\x0bGAMMA", dtype=np.uint8)
    two = np.frombuffer("é alpha Beta".encode(), dtype=np.uint8)
    h = [kernel.word_hashes(d, *kernel.word_spans(d, np.array([0, len(d)]))[:2]) for d in (one, two)]
    assert list(h[0][:2]) == list(h[1][1:])
    assert list(kernel.word_spans(one, np.array([0, 3, len(one)]))[2]) == [1, 3]


def test_template_words_are_as_many_as_plain_words(spark):
    # slots at any place, characters that stand for slots, punctuation alone, units without a number
    n, a, u = decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT
    texts = ["Tom has 3 kg, Ann 4.5KG; kg 10:30 h", f"{n}xy {u} 7 kgs 7 kg", "McDonald Jean-Luc The Theo They're 'Eve' ÉMILE Émile", "-- 12 -- ... 1,000,000 MILES a1 B2", None, "", " \t\n"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = {x.k: x for x in df.select("k", decontaminate.template_words(F.col("text")).alias("t"), decontaminate.plain_words(F.col("text")).alias("p")).collect()}
    assert all(len(x.t) == len(x.p) for x in got.values())
    assert got[0].t == [a, "has", n, u, a, f"{n}kg", "kg", n, u]
    assert got[1].t == ["xy", n, "kgs", n, u]
    assert got[2].t == [f"{a}donald", f"{a}{a}", "the", a, "theyre", a, "émile", a]
    assert got[3].t == [n, n, u, f"a{n}", f"b{n}"]
    assert not got[4].t and not got[5].t and not got[6].t


def test_decontamination_of_long_texts(spark):
    # words are made once a text, not once a window: seconds for 300,000 words
    long, item = words(300_000, 77), " ".join(words(30, 78))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(0, " ".join([*long, item])), (1, " ".join(long))], "doc_id long, text string")
    began = time.perf_counter()
    assert {(r.id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == {(0, 1)}
    assert time.perf_counter() - began < 60
