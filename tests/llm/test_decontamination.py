"""Decontamination against all pairs by brute force, and recall of items asked again with other values."""

from __future__ import annotations

import random
import re

import pytest

from gridlark.llm import decontaminate

FIRST = "Maria Tom McKenna DeShawn JOHN DAN Anne-Marie O'Neill Jürgen Chloé Iñigo Priya Olu Sven Yuki Lara".split()
WORDS = "eight nine seven twelve fifteen twenty forty-two sixty".split()
STUFF = "apples books coins marbles stamps pencils shells tickets".split()
SENTENCES = [
    "{a} had {n} {s} in a large basket and gave {m} of them to a friend called {b} before lunch on that day",
    "on the way to the old market {a} bought {n} kg of {s} while {b} paid {m} dollars for a smaller bag of the same kind",
    "when {b} came back to the house there were only {n} {s} left on the table so {a} went out for {m} more of them",
    "{a} walks {n} km to school every morning and {b} walks {m} km in the other direction to get to work by the river",
]
ANSWER = "how many are there in the end if nobody takes any of them away during the night and nothing else is lost"


def filled(k, r, numbers):
    a, b = r.sample(FIRST, 2)
    n, m = r.sample(numbers, 2)
    return SENTENCES[k % 4].format(a=a, b=b, n=n, m=m, s=STUFF[k // 4 % 8]) + f" and {ANSWER}" + f" {''.join(chr(97 + int(c)) for c in str(k))}"


def test_recall_of_items_with_other_values(spark):
    """200 documents that ask an item again with other names and numbers, some as words, and 200 that ask none."""
    r = random.Random(1)
    digits = [str(n) for n in range(2, 90)] + ["1,250", "3.5"]
    bench = spark.createDataFrame([(k, filled(k, r, digits)) for k in range(32)], "item_id long, text string")
    filler = lambda n: " ".join(r.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split()) for _ in range(n))
    docs = [(i, f"{filler(30)}. {filled(i % 32, r, WORDS if i % 3 == 0 else digits)}. {filler(20)}") for i in range(200)]
    docs += [(1000 + i, f"{filler(60)} {ANSWER.split(' if ')[1]} {filler(20)}") for i in range(200)]
    found = {(x.id, x.item_id) for x in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), bench).collect()}
    hit = sum((i, i % 32) in found for i in range(200))
    assert hit >= 190 and not any(i >= 1000 for i, _ in found)


@pytest.mark.parametrize("change", [("Maria", "McKenna"), ("Tom", "DeShawn"), ("Maria", "JOHN"), ("Tom", "Anna Lopez"), ("5", "five"), ("2", "twenty-two"), ("Tom", "O'Neill")])
def test_single_changes(spark, change):
    item = "Maria had 5 apples and gave 2 apples to her brother Tom before she went to the market with 3 friends to look for some more of them"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, f"so it was said. {item.replace(*change)}. and so on")], "doc_id long, text string")
    assert decontaminate.leaks(df, bench).count() == 1


def plain_leaks(docs, items, share=0.8, width=5):
    """All pairs: shares of windows of words and of templates, and one value for each slot value."""
    wins = lambda w: [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
    out = set()
    for d, (dt, dp) in docs.items():
        for i, (it, ip) in items.items():
            iw, ipw, dw, dpw = wins(it), wins(ip), wins(dt), wins(dp)
            if not iw:
                continue
            held = lambda a, b: len(set(a) & set(b)) / len(set(a)) >= share - 1e-9
            if held(ipw, dpw):
                out.add((d, i))
            elif held(iw, dw):
                shifts = [dw.index(w) - k for k, w in enumerate(iw) if w in dw]
                best = max(set(shifts), key=lambda s: (shifts.count(s), s))
                pairs = {(ip[k], dp[k + best]) for k in range(len(it)) if it[k] in "" and 0 <= k + best < len(dt) and it[k] == dt[k + best]}
                if len({a for a, _ in pairs}) == len(pairs):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("most_items", [64, 2])
def test_all_pairs(spark, monkeypatch, most_items):
    monkeypatch.setattr(decontaminate, "MOST_ITEMS", most_items)
    r = random.Random(3)
    vocab = "Anna Bob 5 7 seven kg the of and in red blue Old".split()
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(k, text(r.randint(4, 14))) for k in range(40)] + [(90, "Anna Bob Anna Bob Anna Bob"), (91, "7 5 7 5 7 5 7"), (92, None), (93, "")]
    swap = lambda t: re.sub("Anna|Bob|5|7", lambda m: {"Anna": r.choice(["Anna", "Eva"]), "Bob": "Tim", "5": "5", "7": r.choice(["7", "9"])}[m[0]], t)
    docs = [(k, f"{text(6)} {swap(items[k % 40][1])} {text(r.randint(0, 8))}") for k in range(120)] + [(500, "Eva Tim " * 12), (501, None), (502, "")]
    ddf, bdf = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    split = lambda df, key: {x[0]: (x.t, x.p) for x in df.select(key, decontaminate.template_words(df["text"]).alias("t"), decontaminate.plain_words(df["text"]).alias("p")).collect()}
    want = plain_leaks(split(ddf, "doc_id"), split(bdf, "item_id"))
    got = [(x.id, x.item_id) for x in decontaminate.leaks(ddf, bdf).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
