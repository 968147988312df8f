"""Verdicts on urls: fixed rules first, then a path-template tree with smoothed labelled purity.

For each host, path segments become templates from the root down: segments with digits, and segments of a node with
many different children, are wildcards. The tree is as deep as it branches; what a path has below that is one branch. At
every node of the tree, branches whose labelled shares don't differ from the
parent's by a z-test, or that have no labels, are merged. From the root down, the share of bad pages of a branch is
smoothed towards that of the same template over all hosts, shifted by how far the host's parent node is from that node
over all hosts. The cut above which templates are rejected is fitted on labelled pages, each judged by other hosts only.
Labels come from the caller; the rules' own decisions serve by default."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import UPPER, scratch

#: Copies of each tree node when pages are joined with it, so that a host's pages spread over so many tasks.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and the paths that start with a prefix."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ://, A-Z lower-cased, and path up to ? or #; both empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def templates(pages: DataFrame, most_children: int = 16) -> DataFrame:
    """Adds `template` to rows with host and path.

    Level by level, a node with more than `most_children` different children, or a segment with a digit, gives a
    wildcard. The levels are walked on the different paths, which are read from the pages once; a node with no more than
    `most_children` paths below it can't have a wide node any more, so its paths keep the rest of their segments, and the
    walk ends when no other node is left."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    plain = F.transform(parts, lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(s))
    pages = pages.withColumn("shape", F.array_join(plain, "/"))
    salt = F.pmod(F.xxhash64("shape"), F.lit(SALTS)).alias("salt")
    left = scratch(pages.select("host", "shape").distinct().select("host", "shape", salt, F.split("shape", "/", -1).alias("rest"), F.lit("").alias("template")))
    whole = F.concat("template", F.when(F.size("rest") > 0, F.concat(F.lit("/"), F.array_join("rest", "/"))).otherwise("")).alias("template")
    done = []
    while True:
        children = left.where("size(rest) > 0").groupBy("host", "template", F.get("rest", F.lit(0)).alias("segment")).agg(F.count(F.lit(1)).alias("n"))
        large = scratch(children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).where(F.col("n") > most_children).select("host", "template", "kinds"))
        if not large.limit(1).count():
            done.append(left.select("host", "shape", whole))
            break
        spread = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        marked = scratch(left.join(spread, ["host", "template", "salt"], "left"))
        stays = (F.size("rest") == 0) | F.col("kinds").isNull()
        done.append(marked.where(stays).select("host", "shape", whole))
        segment = F.when(F.col("kinds") > most_children, F.lit("*")).otherwise(F.get("rest", F.lit(0)))
        left = marked.where(~stays).select("host", "shape", "salt", F.slice("rest", 2, F.size("rest")).alias("rest"), F.concat("template", F.lit("/"), segment).alias("template"))
    # both sides are plain, so that Spark can split the rows of a hot path
    known = scratch(reduce(DataFrame.union, done))
    return pages.join(known, ["host", "shape"], "left").drop("shape")


def branching_depth(leaf: DataFrame) -> int:
    """The deepest level at which a node of a host's tree has several leaves (host, template) below it."""
    step = lambda acc, part: F.struct(F.xxhash64(acc.h, part).alias("h"), F.concat(acc.all, F.array(F.xxhash64(acc.h, part))).alias("all"))
    chain = F.aggregate(F.split("template", "/", -1), F.struct(F.lit(0).cast("long").alias("h"), F.array().cast("array<long>").alias("all")), step, lambda acc: acc.all)
    nodes = leaf.select("host", F.posexplode(chain).alias("level", "node")).groupBy("host", "level", "node").agg(F.count(F.lit(1)).alias("n"))
    return nodes.where("n > 1").agg(F.max("level")).first()[0] or 0


def nodes_of(leaf: DataFrame, depth: int) -> DataFrame:
    """(host, level, node, parent, n, b): the labelled pages, and the bad ones, under each node of each host's tree.

    Level 0 is the root, and the nodes of a leaf (host, template, n, b) are its prefixes down to `depth` and itself."""
    parts = F.split("template", "/", -1)
    last = F.size(parts) - 1
    prefix = lambda level: F.array_join(F.slice(parts, 1, level + 1), "/")
    node = lambda level, name: F.struct(level.alias("level"), name.alias("node"), F.when(level > 0, prefix(F.greatest(level, F.lit(1)) - 1)).alias("parent"))
    levels = F.transform(F.sequence(F.lit(0), F.least(last, F.lit(depth))), lambda level: node(level, prefix(level)))
    levels = F.when(last > depth, F.concat(levels, F.array(node(F.lit(depth + 1), F.col("template"))))).otherwise(levels)
    return leaf.select("host", "n", "b", F.explode(levels).alias("x")).groupBy("host", "x.level", "x.node", "x.parent").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))


def _logit(share: Column) -> Column:
    return F.log(share / (1 - share))


def smoothed_shares(nodes: DataFrame, everywhere: float, depth: int, weight: float, z_same: float) -> DataFrame:
    """(host, node, share): the smoothed share of bad pages of every node of nodes_of()."""
    over = scratch(nodes.groupBy("level", "node", "parent").agg(F.sum("n").alias("tn"), F.sum("b").alias("tb")))
    root = F.lit(everywhere)
    general = host = None
    out = []
    for level in range(depth + 2):
        these = over.where(F.col("level") == level).drop("level")
        if general is None:
            general = these.select("node", ((F.col("tb") + weight * root) / (F.col("tn") + weight)).alias("all"), root.alias("above"))
        else:
            up = general.select(F.col("node").alias("parent"), F.col("all").alias("above"))
            general = these.join(up, "parent").select("node", ((F.col("tb") + weight * F.col("above")) / (F.col("tn") + weight)).alias("all"), "above")
        own = nodes.where(F.col("level") == level).join(general, "node")
        if host is None:
            host = own.select("host", "node", ((F.col("b") + weight * F.col("all")) / (F.col("n") + weight)).alias("share"), "n", "b")
        else:
            up = host.select("host", F.col("node").alias("parent"), F.col("share").alias("parent_share"), F.col("n").alias("pn"), F.col("b").alias("pb"))
            own = own.join(up, ["host", "parent"])
            p = F.col("pb") / F.greatest(F.col("pn"), F.lit(1))
            z = F.abs(F.col("b") - F.col("n") * p) / F.sqrt(F.greatest(F.col("n") * p * (1 - p), F.lit(1e-9)))
            own = own.withColumn("same", (F.col("n") == 0) | (z <= z_same))
            pool = own.where("same").groupBy("host", "parent").agg(F.sum("n").alias("mn"), F.sum("b").alias("mb"))
            own = own.join(pool, ["host", "parent"], "left")
            prior = 1 / (1 + F.exp(-(_logit(F.col("all")) + _logit(F.col("parent_share")) - _logit(F.col("above")))))
            n, b = (F.when(F.col("same"), F.col(m)).otherwise(F.col(o)) for m, o in (("mn", "n"), ("mb", "b")))
            host = own.select("host", "node", ((b + weight * prior) / (n + weight)).alias("share"), "n", "b")
        # nodes are few against pages; written, so that a level does not plan all levels above again
        general, host = scratch(general), scratch(host)
        out.append(host.select("host", "node", "share"))
    return reduce(DataFrame.union, out)


def fitted_cut(leaf: DataFrame, everywhere: float, weight: float, default: float) -> float:
    """The cut with the best sum of both shares of right decisions on labelled pages, each judged by the same template
    on other hosts; `default` where only one kind of label exists. At most 101 rows of counts reach the driver."""
    over = leaf.groupBy("template").agg(F.sum("n").alias("tn"), F.sum("b").alias("tb"))
    judged = leaf.where("n > 0").join(over, "template").select(((F.col("tb") - F.col("b") + weight * everywhere) / (F.col("tn") - F.col("n") + weight)).alias("score"), "n", "b")
    rows = {r["bin"]: (r["good"], r["bad"]) for r in judged.groupBy(F.floor(F.col("score") * 100).cast("int").alias("bin")).agg(F.sum(F.col("n") - F.col("b")).alias("good"), F.sum("b").alias("bad")).collect()}
    good, bad = sum(g for g, _ in rows.values()), sum(b for _, b in rows.values())
    if not good or not bad:
        return default
    right = [sum(g for k, (g, _) in rows.items() if k < cut) / good + sum(b for k, (_, b) in rows.items() if k >= cut) / bad for cut in range(1, 101)]
    best = [k for k, x in enumerate(right, 1) if x >= max(right) - 1e-9]
    return best[len(best) // 2] / 100


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", bad: Column | None = None, weight: float = 4.0, reject_at: float = 0.5, z_same: float = 1.64) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, template, purity (smoothed share of good pages).

    `bad` is a boolean Column of labels (null: unlabelled); without it, pages that a rule decides are labelled by it.
    `reject_at` is the cut where labels of one kind only, or none, leave nothing to fit. Null urls and urls without ://
    have empty host and path and an empty template. Repeated rows are judged alike; urls may be of any length. An empty
    table gives an empty result."""
    host, path = host_and_path(F.col(url_col))
    named = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), *([] if bad is None else [bad.cast("int").alias("bad")]))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = named.withColumns({"rule": text, "by_rule": verdict, "salt": F.pmod(F.xxhash64("id", "path"), F.lit(SALTS))})
    if bad is None:
        named = named.withColumn("bad", (F.col("by_rule") == "block").cast("int"))
    rows = scratch(templates(named))
    leaf = scratch(rows.groupBy("host", "template").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")))
    n_all, bad_all = leaf.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    everywhere = (bad_all + 1) / (n_all + 2)
    cut = fitted_cut(leaf, everywhere, weight, reject_at)
    depth = branching_depth(leaf)  # below it, what is left of a path is one branch
    shares = smoothed_shares(scratch(nodes_of(leaf, depth)), everywhere, depth, weight, z_same)
    shares = shares.join(leaf.select("host", F.col("template").alias("node")), ["host", "node"], "left_semi")
    known = shares.select("host", F.col("node").alias("template"), (1 - F.col("share")).alias("purity"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = rows.join(known, ["host", "template", "salt"], "left")
    by_method = F.when(1 - F.col("purity") >= cut, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "template", "purity")
