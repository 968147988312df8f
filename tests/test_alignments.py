"""Alignments by dynamic programming against plain recursions, proposals against all pairs."""

from __future__ import annotations

import random
from functools import cache

import numpy as np
import pytest

from gridlark.operators import align


def plain(a, b, score, opening, extension, local):
    """The best score by the textbook recursion over gaps of every length."""

    @cache
    def h(i, j):
        if local and (i == 0 or j == 0):
            return 0.0
        if i == 0 or j == 0:
            n = max(i, j)
            return -(opening + (n - 1) * extension) if n else 0.0
        options = [h(i - 1, j - 1) + score(a[i - 1], b[j - 1])]
        options += [h(i - n, j) - opening - (n - 1) * extension for n in range(1, i + 1)]
        options += [h(i, j - n) - opening - (n - 1) * extension for n in range(1, j + 1)]
        return max([*options, 0.0] if local else options)

    return max(h(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1)) if local else h(len(a), len(b))


def cost(x, y, score, opening, extension, local):
    """The score of an alignment as it stands; outside a local one, letters opposite gaps are free."""
    if local:
        both = [k for k in range(len(x)) if x[k] != "-" and y[k] != "-"]
        x, y = (x[both[0] : both[-1] + 1], y[both[0] : both[-1] + 1]) if both else ("", "")
    total, last = 0.0, None
    for p, q in zip(x, y, strict=True):
        now = "x" if p == "-" else "y" if q == "-" else None
        total += score(p, q) if now is None else -(extension if now == last else opening)
        last = now
    return total


@pytest.mark.parametrize("local", [False, True])
def test_scores_and_alignments(local):
    r = random.Random(1)
    pairs = [("".join(r.choice("ABCé") for _ in range(r.randint(0, 9))), "".join(r.choice("ABCé") for _ in range(r.randint(0, 9)))) for _ in range(250)]
    pairs += [("", ""), ("A", ""), ("", "AB"), ("ABCABC", "ABCABC"), ("AAAA" + "C" * 7 + "BBBB", "AAAABBBB")]
    for match, mismatch, opening, extension in ((5.0, -4.0, 10.0, 0.5), (2.0, -1.0, 2.0, 1.0), (1.0, -1.0, 0.5, 0.5)):
        score = lambda p, q: match if p == q else mismatch
        got = align.align([a for a, _ in pairs], [b for _, b in pairs], align.substitution(match, mismatch), opening, extension, local)
        for (a, b), (s, x, y) in zip(pairs, got, strict=True):
            assert s == pytest.approx(plain(a, b, score, opening, extension, local)), (a, b)
            assert x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)
            assert cost(x, y, score, opening, extension, local) == pytest.approx(s), (a, b, x, y)


def test_band():
    r = random.Random(2)
    texts = ["".join(r.choice("ACGT") for _ in range(60)) for _ in range(20)]
    others = [t[:20] + "GG" + t[20:45] + t[48:] for t in texts]
    whole, near = (align.align(texts, others, align.substitution(), band=b) for b in (None, 5))
    assert whole == near
    narrow = align.align(texts, texts, align.substitution(), band=0)
    assert all(s == 300 and x == y == t for (s, x, y), t in zip(narrow, texts, strict=True))


def test_proposals_lose_no_pair(spark):
    r = random.Random(3)
    base = ["".join(r.choice("ABCD") for _ in range(30)) for _ in range(12)]
    seqs = [(i, "".join(c if r.random() > 0.08 else r.choice("ABCD") for c in base[i % 12])) for i in range(90)]
    seqs += [(200, None), (201, ""), (None, base[0]), (202, "AB"), (203, "AB"), (204, base[0])]
    df = spark.createDataFrame(seqs, "key long, seq string").repartition(5)
    sets = {k: {s[i : i + 3] for i in range(max(len(s) - 2, 1))} for k, s in seqs if k is not None and s}
    for percent in (20, 40, 90):
        want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * max(len(sets[a]), len(sets[b]))}
        got = [tuple(x) for x in align.kmer_pairs(df, "key", "seq", percent=percent).collect()]
        assert len(got) == len(set(got)) and set(got) == want and (202, 203) in want
    found = align.align_pairs(align.kmer_pairs(df, "key", "seq"), df, "key", "seq").select("a", "b", "score", align.identity().alias("same")).collect()
    assert len(found) == align.kmer_pairs(df, "key", "seq").count()
    assert {(x.a, x.b): (x.score, x.same) for x in found}[202, 203] == (10.0, 1.0)
    assert align.align_pairs(align.kmer_pairs(df.where("false"), "key", "seq"), df, "key", "seq").count() == 0


def test_reference_alignment_and_contacts(spark):
    rng = np.random.default_rng(5)
    x, ref = rng.normal(size=(2, 5, 3)), rng.normal(size=(4, 3))
    res = spark.createDataFrame([(k, i, x[k, i].tolist()) for k in range(2) for i in range(5)], "key long, pos int, vector array<double>")
    refs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(ref)], "ref int, vector array<double>")
    pairs = spark.createDataFrame([(0, 1), (0, 9)], "a long, b long")
    dist = lambda p, q: np.abs(p[:, None] - q[None]).sum(axis=2)
    soft = lambda d, axis: np.exp(-d) / np.exp(-d).sum(axis=axis, keepdims=True)
    beta = [soft(dist(x[k], ref), 0) for k in range(2)]
    d, w = dist(x[0], x[1]), beta[0] @ beta[1].T
    al, be = soft(d, 1), soft(d, 0)
    for gate, weight in ((False, w), (True, w * (al + be - al * be))):
        got = align.reference_alignment(res, refs, pairs, gate=gate).collect()
        assert len(got) == 1 and got[0]["dist"] == pytest.approx((weight * d).sum() / weight.sum())
    m = rng.normal(size=(5, 5))
    maps = spark.createDataFrame([(1, i, j, float(m[i, j])) for i in range(5) for j in range(5)], "key long, i int, j int, m double")
    got = {(r["ref"], r["other"]): r["x"] for r in align.contact_pool(res, refs, maps).collect()}
    want = beta[1].T @ m @ beta[1]
    assert len(got) == 16 and all(got[k] == pytest.approx(want[k]) for k in got)
