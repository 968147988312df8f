"""Buckets too large for a task: all links between their components, without all their pairs."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from gridlark.llm import links
from gridlark.llm.graph import components


def test_large_bucket_of_unlinked_members(spark, monkeypatch):
    """4000 sets of one template, 60 % alike, hardly any linked: every link is found, few pairs are compared."""
    r = random.Random(1)
    common = [r.getrandbits(63) for _ in range(36)]
    sets = {i: common + [r.getrandbits(63) for _ in range(24)] for i in range(4000)}
    planted = []
    for k in range(60):
        a, b = 20 * k, 20 * k + 7
        sets[b] = sets[a][:57] + [r.getrandbits(63) for _ in range(3)]
        planted.append((a, b))
    for k in range(1300, 1304):  # a chain through one member
        sets[k] = sets[1300][: 60 - 2 * (k - 1300)] + [r.getrandbits(63) for _ in range(2 * (k - 1300))]
    rows = [(i, np.array(s, dtype=np.uint64).tobytes()) for i, s in sets.items()]
    payloads = spark.createDataFrame(rows, "rep long, payload binary").repartition(6).cache()
    mates = spark.createDataFrame([(7, i, len(set(s)), len(sets)) for i, s in sets.items()] + [(8, i, len(set(sets[i])), 40) for i in range(40)], "key long, rep long, n long, m long")
    compared = []
    confirm = links._confirm
    monkeypatch.setattr(links, "_confirm", lambda pairs, *how: compared.append(pairs.where("rep <> b").distinct().count()) or confirm(pairs, *how))
    monkeypatch.setattr(links, "GATHERED", 1)
    got = {x.id: x.comp for x in links.similar_components(mates, payloads, 80).collect()}
    chain = [(k, k + 1) for k in range(1300, 1303)]
    edges = spark.createDataFrame(planted + chain, "a long, b long")
    want = {x.id: x.comp for x in components(edges).collect()}
    assert got == want
    assert sum(compared) < 20 * len(sets)


def test_one_large_component_and_stragglers(spark, monkeypatch):
    """Nearly all members are one component; some others are linked to single members of it only."""
    r = random.Random(2)
    base = [r.getrandbits(63) for _ in range(50)]
    sets = {i: base[:] for i in range(300)}
    for i in range(1, 300):
        sets[i][i % 50] = r.getrandbits(63)
    for j in range(20):
        sets[1000 + j] = sets[10 + j][:45] + [r.getrandbits(63) for _ in range(5)]
        sets[1000 + j][r.randrange(45)] = r.getrandbits(63)
    for j in range(20):
        sets[2000 + j] = [r.getrandbits(63) for _ in range(50)]
    payloads = spark.createDataFrame([(i, np.array(s, dtype=np.uint64).tobytes()) for i, s in sets.items()], "rep long, payload binary")
    mates = spark.createDataFrame([(1, i, 50, len(sets)) for i in sets], "key long, rep long, n long, m long")
    monkeypatch.setattr(links, "GATHERED", 1)
    got = {x.id: x.comp for x in links.similar_components(mates, payloads, 80).collect()}
    ids = sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))]
    want = {x.id: x.comp for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want and payloads.select(F.max("rep")).first()[0] == 2019
