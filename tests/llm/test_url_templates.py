"""Templates of urls against a plain walk, at any depth, and the work of making them."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from gridlark.llm import url_filter


def plain_templates(rows, most):
    """Templates by walking the tree level by level on all different paths."""
    out = {}
    live = {}
    for host, path in set(rows):
        segments = re.sub("^/", "", path).split("/")
        live[host, path] = ("", ["*" + (m[1] if (m := re.search(r"(\.[A-Za-z]{1,5})$", s)) else "") if re.search("[0-9]", s) else s for s in segments])
    while live:
        kinds = defaultdict(set)
        for (host, _), (done, rest) in live.items():
            kinds[host, done].add(rest[0])
        after = {}
        for (host, path), (done, rest) in live.items():
            step = f"{done}/{'*' if len(kinds[host, done]) > most else rest[0]}"
            if rest[1:]:
                after[host, path] = (step, rest[1:])
            else:
                out[host, path] = step
        live = after
    return out


def test_templates_at_any_depth(spark):
    r = random.Random(1)
    rows = [("a.com", "/" + "/".join(r.choice("xyz") for _ in range(r.randint(0, 9)))) for _ in range(200)]
    rows += [("b.com", f"/one/two/three/four/five/six/{w}/end/{e}") for w in ["w" + chr(97 + i) + chr(97 + i) for i in range(20)] for e in ("p", "q")]
    rows += [("b.com", f"/one/two/page{i}.html") for i in range(30)] + [("b.com", "/one//x/"), ("", ""), ("c.com", ""), ("c.com", "/"), ("c.com", "/" + "s/" * 3000), ("c.com", "//")]
    rows += rows[:50] + [("hot.com", "/same")] * 300
    df = spark.createDataFrame([(i, h, p) for i, (h, p) in enumerate(rows)], "id long, host string, path string").repartition(4)
    got = url_filter.templates(df, 16)
    # the pages are read once for their different paths and once to name them
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    want = plain_templates(rows, 16)
    found = [(x.host, x.path, x.template) for x in got.collect()]
    assert len(found) == len(rows)
    assert all(t == want[h, p] for h, p, t in found)
    deep = {t for h, p, t in found if h == "b.com" and p.endswith("/end/p")}
    assert deep == {"/one/two/three/four/five/six/*/end/p"}


def test_branching_depth(spark):
    leaf = lambda rows: spark.createDataFrame(rows, "host string, template string")
    assert url_filter.branching_depth(leaf([("a", "/x/y/z"), ("b", "/x/y/z")])) == 0
    assert url_filter.branching_depth(leaf([("a", "/x/y/z/1"), ("a", "/x/y/z/2"), ("a", "/q")])) == 3
    assert url_filter.branching_depth(leaf([])) == 0


def test_deep_branches_are_judged_apart(spark):
    """Labels that differ only below the seventh segment reach the verdicts of unlabelled pages."""
    rows = [(i, f"http://s.com/a/b/c/d/e/f/{'good' if i % 2 else 'bad'}/p{i}", None if i % 5 == 0 else i % 2 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {x.page_id: x.verdict for x in url_filter.judge_urls(df, [], bad=F.col("bad")).collect()}
    assert all(got[i] == ("block" if i % 2 == 0 else "allow") for i in range(400))
