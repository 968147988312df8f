"""Chat examples, collocations and periodic runs against brute force, on odd rows too."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridlark.llm import chat, runs
from gridlark.llm.collocations import collocations
from gridlark.llm.queries import with_planted_runs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CONVS = "conv_id long, turn long, role string, text string, conv string, block string, example int"


@pytest.fixture(scope="module")
def turns():
    r = random.Random(3)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "\\", "\n", "é", "<", "[", "word ", "\\<s>", "<\\s>"]
    out = []
    for c in range(30):
        for t in range(r.randint(1, 9)):
            out.append((c, t, r.choice(["user", "assistant", "system", "tool", "to\nol\\", "[INST]"]), "".join(r.choice(bits) for _ in range(r.randint(0, 12)))))
    out += [(100, 0, "user", None), (100, 1, "assistant", None), (101, 0, None, "x"), (102, None, "user", "first"), (102, 0, "assistant", "second"), (102, 0, "assistant", "second")]
    out += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (103, 0, "assistant", "x" * 200_000), (103, 1, "user", "end")]
    out += [(104, i, "assistant" if i % 2 else "user", f"turn {i} " * 20) for i in range(300)]
    return out


def test_chat_examples(spark, turns):
    df = spark.createDataFrame([(*t, "x", "y", 1) for t in turns], CONVS).repartition(5)
    convs = defaultdict(list)
    for c, t, role, text in turns:
        convs[c].append(((t is not None, t), role or "", text or ""))
    examples = chat.prefix_target_examples(df)
    got = defaultdict(list)
    for row in examples.collect():
        got[row.conv_id].append(row)
    assert set(got) == set(convs)
    for c, found in convs.items():
        found.sort()
        rows = sorted(got[c], key=lambda x: x.example)
        targets = [i for i, (_, role, _) in enumerate(found) if role == "assistant"]
        assert len(rows) == len(targets) + (not targets or targets[-1] < len(found) - 1)
        for i, row in enumerate(rows):
            upto = targets[i] + 1 if i < len(targets) else len(found)
            assert list(chat.read_turns(row.text)) == [(role, text) for _, role, text in found[:upto]]
            if i < len(targets):
                assert chat.unescaped(row.text[row.loss_start : row.loss_end]) == found[targets[i]][2]
                assert not any(x in row.text[row.loss_start : row.loss_end] for x in chat.CONTROLS)
                assert row.text[row.loss_end :] == " </s>"
            else:
                assert row.loss_start is None and row.target_turn is None
    for row in chat.read_back(examples).collect():
        found = convs[row.conv_id]
        said = "".join(t for _, role, t in found if role == "assistant")
        assert (row.n_turns, row.loss_chars, row.formatted_chars) == (len(found), len(said), sum(len(x.text) for x in got[row.conv_id]))
        assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert row.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in found).encode()).hexdigest()
    assert chat.read_back(chat.prefix_target_examples(df.where("false"))).count() == 0


def phrases(rows, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(longest, len(w) - i) + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        best = []
        for p, a in frequent.items():
            inside = any(len(o) > len(p) and b >= a and any(o[i : i + len(p)] == p for i in range(len(o))) for o, b in frequent.items())
            if not inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -score))
    return Counter(out)


def test_collocations(spark):
    r = random.Random(5)
    vocab = "a b c D é ß\x01 a\x01 \x00b the of".split(" ")
    rows = []
    for i in range(300):
        text = "".join(r.choice(vocab) + r.choice([" ", " ", " ", " ", "\t", "  ", ". ", "\n", "!?", ","]) for _ in range(r.randint(0, 60)))
        rows.append((i, r.choice(["en", "de", None, "und", ""]), text + r.choice(["", " New York City hall", " a a a a a a"])))
    rows += [(300, "en", None), (301, "en", ""), (302, None, " \n.,"), (None, "en", "the of the of"), (0, "en", rows[0][2]), (303, "de", "x y z " * 3000), (304, "fr", "w" * 100_000)]
    df = spark.createDataFrame([(*x, "n", "p") for x in rows], "doc_id long, lang string, text string, n string, phrase string").repartition(6)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for least, longest, top in ((8, 5, 2000), (3, 4, 7), (40, 2, 5)):
        got = Counter(map(tuple, collocations(df, min_count=least, longest=longest, top=top).select(names).collect()))
        assert got == phrases([x[1:] for x in rows], least, longest, top)
    assert collocations(df.where("false")).count() == 0
    assert collocations(df.limit(1)).count() == 0


def brute_runs(w):
    found, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i:
                size = j - i + q
                if size >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                    found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found)


def test_periodic_runs(spark):
    r = random.Random(11)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "a a a a a"), (5, "a a a a a a"), (None, "b b b b b b b c"), (6, "A a A a A a A a A"), (6, "A a A a A a A a A"), (7, "x " * 3000)]
    for i in range(10, 400):
        parts = []
        for _ in range(r.randint(0, 5)):
            block = [r.choice("abé") for _ in range(r.randint(1, 9))]
            parts += block * r.randint(1, 7) + block[: r.randint(0, len(block))]
            parts += [r.choice("abcdefgh") for _ in range(r.randint(0, 8))]
        rows.append((i, r.choice([" ", "\n", "\t  "]).join(parts)))
    df = spark.createDataFrame([(*x, "r", 5) for x in rows], "doc_id long, text string, runs string, n_words int").repartition(5)
    want = Counter()
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = brute_runs(w)
        gone = {x for s, n, q in found for x in range(s + q, s + n)}
        want[i, len(w), tuple(found), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    got = Counter((x.doc_id, x.n_words, tuple(map(tuple, x.runs)), x.collapsed) for x in runs.periodic_runs(df).collect())
    assert got == want
    assert sum(bool(k[2]) for k in want) > 100
    assert runs.periodic_runs(df.where("false")).count() == 0


def test_planted_runs(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(300)] + [(None, "a b"), (10, None)]
    got = Counter(map(tuple, with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    want = Counter()
    for i, t in rows:
        h = zlib.crc32(str(i).encode())
        w, g = (t or "").split(), h // 10
        if i is not None and h % 10 == 0:
            n = len(w)
            if n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            t = " ".join(w)
        want[i, t] += 1
    assert got == want


def test_candidate_lags_are_few():
    """One long text with a run of a long period, and one without: lags are found, and not one for every word."""
    r = np.random.default_rng(1)
    words = r.integers(0, 50, 40_000)
    ids = np.concatenate([words, np.tile(r.integers(0, 50, 7_000), 5), words])
    rows, lags = runs.candidate_lags(ids, np.zeros(len(ids), dtype=np.int64))
    assert set(rows) == {0} and 7_000 in lags and len(lags) < 500
    assert (40_000, 35_000, 7_000) in runs.periodic_stretches(ids, lags.tolist())
