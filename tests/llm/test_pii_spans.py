"""Spans, contexts, overlaps and selection of personal data against plain loops, with very many matches in one text."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from gridlark.llm import pii


@pytest.mark.parametrize("levels", [1, 2])
def test_running_results(spark, levels):
    r = random.Random(1)
    rows = [([r.randint(0, 9) for _ in range(n)],) for n in (0, 1, 2, 63, 64, 65, 128, 4095, 4097, 9000)]
    df = spark.createDataFrame(rows, "x array<int>")
    for op, plain in (("{a} + {b}", lambda a, b: a + b), ("greatest({a}, {b})", max)):
        for x, got in df.select("x", F.expr(pii.scan_sql("x", op, levels))).collect():
            want, at = [], 0
            for v in x:
                at = plain(at, v)
                want.append(at)
            assert got == want


def test_spans_and_contexts(spark):
    r = random.Random(2)
    texts = ["".join(r.choice(["1", "22", "a", "é", "12345", "\n", " " * r.randint(1, 30)]) for _ in range(r.randint(0, 200))) for _ in range(60)] + ["", "7", "9é" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("m", F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))
    for x in df.select("text", pii._pairs(F.col("text"), "[0-9]+", F.col("m")).alias("pairs")).select("text", pii._spans("pairs", True).alias("s")).collect():
        assert [tuple(s) for s in x.s] == [(m.start(), m.end(), m[0], x.text[max(m.start() - pii.CONTEXT, 0) : m.start()]) for m in re.finditer("[0-9]+", x.text)]


def test_overlaps_and_choice(spark):
    r = random.Random(3)
    rows = []
    for n in (0, 1, 3, 40, 300):
        base, at = [], 0
        for _ in range(n):
            at += r.randint(0, 6)
            base.append((at, at + r.randint(1, 5)))
            at = base[-1][1]
        some = [(a := r.randint(0, at + 5), r.randint(0, 4), a + r.randint(1, 9), -float(r.randint(1, 30))) for _ in range(2 * n)]
        rows.append((base, list(dict.fromkeys(some))))
    df = spark.createDataFrame(rows, "base array<struct<start:int,end:int>>, more array<struct<start:int,k:int,end:int,loss:double>>")
    met = df.select("base", "more", F.expr(f"transform(more, s -> {pii._meets_sql('base', 's')})").alias("meets"))
    for x in pii._best_apart(met, "more", "apart").collect():
        assert x.meets == [any(s.start < b.end and b.start < s.end for b in x.base) for s in x.more]
        kept = []
        for s in sorted(x.more, key=lambda s: (s.loss, s.start, s.k, s.end)):
            if not any(s.start < b.end and b.start < s.end for b in kept):
                kept.append(s)
        assert [tuple(s) for s in x.apart] == sorted((s.start, s.k, s.end) for s in kept)


def test_many_matches_and_long_secrets(spark):
    """A text of very many spans, and secrets longer than any bound on their length."""
    r = random.Random(4)
    token = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    keys = [token(n) for n in (40, 40, 60, 201, 240, 900, 5000) for _ in range(8)]
    texts = [f"here the api key: {k} and more words" for k in keys] + [f"see commit {token(40)} of the list" for _ in range(60)]
    many = "call +49 30 1234567 or a.b@c.de, from 10.0.0.7 " * 20_000
    df = spark.createDataFrame([*enumerate(texts), (1000, many), (1001, None)], "doc_id long, text string").repartition(4)
    got = {x.doc_id: x for x in pii.find_personal_data(df).collect()}
    assert (got[1000].n_phone, got[1000].n_email, got[1000].n_ip) == (20_000, 20_000, 20_000)
    assert got[1000].spans.count(",") == 60_000 - 1 and got[1000].spans.startswith("phone:5:19,email:23:31,ip:38:46,phone:52:66")
    found = [got[i].n_secrets for i in range(len(keys))]
    assert sum(found) >= 0.9 * len(keys) and all(found[24:])
    assert sum(got[i].n_secrets for i in range(len(keys), len(texts))) <= 1


def test_copies_of_a_candidate_count_once(spark):
    # 5000 copies of one address: the others are still among 100 candidates, whatever their hashes
    texts = ["ask 10.0.0.7 now"] * 5000 + [f"write to person{k}@example.org today" for k in range(60)]
    x, _ = pii.training_rows(spark.createDataFrame([(t,) for t in texts], "text string"), 100)
    y, _ = pii.training_rows(spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "text string"), 100)
    assert x.tolist() == y.tolist()
