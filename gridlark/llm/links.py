"""Components of similar items that share buckets, with every link confirmed on whole sets of hashes.

All members of a bucket are compared with a few pivots first; then those outside its largest component are compared with
all others through the rarest hashes of each set: in one task, or by a join where a bucket is too large for a task. So no
link that joins components of a bucket is left out, without all its pairs being made."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm import kernel
from gridlark.llm.common import discard, mark_members, scratch
from gridlark.llm.graph import components

U64 = np.uint64
#: Pivots of a bucket in the first round, and above how many members it has one only.
PIVOTS, MANY = 4, 64
#: Bytes of sets that a task compares at once; larger buckets are compared by a join.
GATHERED = 8 << 20
#: Pairs, and bytes of both their payloads, that are compared at once; a pair is never cut.
_PAIRS, _BYTES = 4096, 4 << 20

#: Hashes of the sets of payloads, one after another, and how many each has; a set's hashes may repeat.
FlatOf = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class SetOf:
    """The distinct hashes of a payload (the name of its column) as an expression, where no Python is to run."""

    of: Callable[[str], Column]


def stored_sets(payload: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Payloads that are the hashes themselves, 8 bytes each."""
    sets = [np.frombuffer(x.as_buffer(), dtype=U64) for x in payload]
    return np.concatenate(sets) if sets else np.zeros(0, dtype=U64), np.array([len(s) for s in sets], dtype=np.int64)


def _tagged(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers of the row (12 bits) and 52 bits of the hash."""
    tag = np.repeat(np.arange(len(counts), dtype=U64) << U64(52), counts)
    tag |= hashes >> U64(12)
    tag.sort()
    return tag[np.concatenate([[True], tag[1:] != tag[:-1]])] if len(tag) else tag


def _verifier(percent: int, flat_of: FlatOf) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def similar(part: pa.RecordBatch) -> np.ndarray:
        a, b = (_tagged(*flat_of(part.column(c))) for c in ("pa", "pb"))
        per = lambda x: np.bincount((x >> U64(52)).astype(np.int64), minlength=len(part))
        both = np.concatenate([a, b])
        both.sort()
        both = per(both[1:][both[1:] == both[:-1]])
        return 100 * both >= percent * (per(a) + per(b) - both)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(sum(np.array(pc.binary_length(batch.column(c)).to_numpy(), dtype=np.int64) for c in ("pa", "pb")))
            at = 0
            while at < len(batch):
                end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BYTES, side="right"))
                end = min(max(end, at + 1), at + _PAIRS, len(batch))
                part = batch.slice(at, end - at)
                yield part.select(["a", "b"]).filter(pa.array(similar(part)))
                at = end

    return verify


def _confirm(pairs: DataFrame, payloads: DataFrame, percent: int, flat_of: FlatOf | SetOf) -> DataFrame:
    """Links (a, b) among pairs (rep, b), confirmed on whole sets."""
    kind = payloads.schema["rep"].dataType.simpleString()
    pairs = pairs.where("rep <> b").select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
    if isinstance(flat_of, SetOf):
        # payloads that no pair asks for aren't shuffled
        pairs = scratch(pairs)
        payloads = mark_members(payloads.select("rep", "payload"), "rep", pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "asked").where("asked")
    side = lambda x: payloads.select(F.col("rep").alias(x), F.col("payload").alias(f"p{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "pa", "pb")
    if isinstance(flat_of, SetOf):
        # a generator, so that each set is made once
        sets = both.select("a", "b", F.explode(F.array(F.struct(flat_of.of("pa").alias("x"), flat_of.of("pb").alias("y")))).alias("s"))
        return sets.where((100 + percent) * F.size(F.array_intersect("s.x", "s.y")) >= percent * (F.size("s.x") + F.size("s.y"))).select("a", "b")
    return both.mapInArrow(_verifier(percent, flat_of), f"a {kind}, b {kind}")


class _Sets:
    """Sets of items, each from its rarest to its most frequent item, and who holds an item among its rare ones.

    Sets of that similarity share one of the rarest items of each: the first n - ceil(share * n) + 1 by frequency. Only
    sets found that way are compared in full, so items that all sets share cost nothing."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, percent: int):
        self.percent = percent
        _, item = np.unique(hashes, return_inverse=True)
        owner = np.repeat(np.arange(len(counts)), counts)
        new = np.lexsort((item, owner))
        item, owner = item[new], owner[new]
        keep = np.ones(len(item), dtype=bool)
        keep[1:] = (item[1:] != item[:-1]) | (owner[1:] != owner[:-1])
        item, owner = item[keep], owner[keep]
        df = np.bincount(item)
        self.item = item[np.lexsort((item, df[item], owner))]
        self.sizes = np.bincount(owner, minlength=len(counts))
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.first = np.where(self.sizes > 0, self.sizes - -(-percent * self.sizes // 100) + 1, 0)
        place = np.arange(len(item)) - np.repeat(self.offsets[:-1], self.sizes)
        rare = np.flatnonzero(place < np.repeat(self.first, self.sizes))
        rare = rare[np.argsort(self.item[rare], kind="stable")]
        self.holder, self.begins = owner[rare], np.searchsorted(self.item[rare], np.arange(len(df) + 1))

    def fit(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether sizes allow that similarity."""
        a, b = self.sizes[p], self.sizes[q]
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)

    def items_of(self, rows: np.ndarray) -> np.ndarray:
        n = self.sizes[rows]
        return self.item[np.arange(n.sum()) + np.repeat(self.offsets[rows] - (np.cumsum(n) - n), n)]

    def similar(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether pairs are similar, counted in full."""
        out = np.zeros(len(p), dtype=bool)
        for at in range(0, len(p), _PAIRS):
            x, y = p[at : at + _PAIRS], q[at : at + _PAIRS]
            n = self.sizes[x] + self.sizes[y]
            tags = [np.repeat(np.arange(len(x), dtype=np.int64), self.sizes[z]) << 40 | self.items_of(z) for z in (x, y)]
            both = np.concatenate(tags)
            both.sort()
            both = np.bincount(both[1:][both[1:] == both[:-1]] >> 40, minlength=len(x))
            out[at : at + _PAIRS] = 100 * both >= self.percent * (n - both)
        return out

    def pairs(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs p > q of holders of some items."""
        n = (self.begins[1:] - self.begins[:-1])[lists]
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # place in its list; it meets all before it
        start = np.repeat(self.begins[lists], n)
        mate = np.arange(row.sum()) - np.repeat(np.cumsum(row) - row, row)
        one, two = self.holder[np.repeat(start + row, row)], self.holder[np.repeat(start, row) + mate]
        found = np.unique(np.maximum(one, two) * len(self.sizes) + np.minimum(one, two))
        return found // len(self.sizes), found % len(self.sizes)


def joining_links(hashes: np.ndarray, counts: np.ndarray, bucket: np.ndarray, group: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the groups of the sets of each bucket; hashes of different buckets differ, groups too.

    A bucket with few pairs to compare has them all compared at once; in others a set is compared with those outside its
    group, and what is linked becomes one group."""
    sets = _Sets(hashes, counts, percent)
    group = np.unique(group, return_inverse=True)[1].copy()
    bucket = np.unique(bucket, return_inverse=True)[1]
    per_list = sets.begins[1:] - sets.begins[:-1]
    some = np.flatnonzero(per_list > 1)
    of = bucket[sets.holder[sets.begins[some]]]
    n_pairs = np.bincount(of, weights=per_list[some] * (per_list[some] - 1) / 2, minlength=bucket.max() + 1)
    few = n_pairs <= 32 * np.bincount(bucket) + 1000
    links: list[tuple[int, int]] = []
    p, q = sets.pairs(some[few[of]])
    use = (group[p] != group[q]) & sets.fit(p, q)
    p, q = p[use], q[use]
    use = sets.similar(p, q)
    links += zip(p[use].tolist(), q[use].tolist(), strict=True)
    for k in np.flatnonzero(~few):
        links += _one_by_one(sets, group, np.flatnonzero(bucket == k))
    return links


def _one_by_one(sets: _Sets, group: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
    members = np.bincount(group[rows])
    links, main, mine = [], int(members.argmax()), np.zeros(len(sets.begins) - 1, dtype=bool)
    # once all sets outside one group have been compared with all, nothing is missed
    for p in rows[np.lexsort((rows, members[group[rows]]))]:
        if group[p] == main or not sets.sizes[p]:
            continue
        own = sets.item[sets.offsets[p] : sets.offsets[p + 1]]
        near = np.unique(np.concatenate([sets.holder[sets.begins[x] : sets.begins[x + 1]] for x in own[: sets.first[p]]]))
        near = near[(group[near] != group[p]) & sets.fit(near, p)]
        if not len(near):
            continue
        mine[own] = True
        n = sets.sizes[near]
        both = np.add.reduceat(mine[sets.items_of(near)].astype(np.int64), np.cumsum(n) - n)
        mine[own] = False
        near = near[100 * both >= sets.percent * (n + sets.sizes[p] - both)]
        joined, which = np.unique(group[near], return_index=True)
        for g, k in zip(joined.tolist(), which.tolist(), strict=True):
            links.append((int(p), int(near[k])))
            main = int(group[p]) if g == main else main
            group[rows[group[rows] == g]] = group[p]
    return links


def _in_task(percent: int, flat_of: FlatOf) -> Callable[[pa.Table], pa.Table]:
    def codes(column: pa.ChunkedArray) -> np.ndarray:
        return pc.dictionary_encode(column).combine_chunks().indices.to_numpy().astype(np.int64)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        hashes, counts = flat_of(table.column("payload").combine_chunks())
        bucket, comp = codes(table.column("key")), codes(table.column("comp"))
        apart = kernel.mix(hashes ^ kernel.mix(np.repeat(bucket + 1, counts).astype(U64)))
        links = np.array(joining_links(apart, counts, bucket, bucket * (comp.max() + 1) + comp, percent), dtype=np.int64).reshape(-1, 2)
        rep = table.column("rep")
        return pa.table({"a": rep.take(pa.array(links[:, 0])), "b": rep.take(pa.array(links[:, 1]))})

    return run


def _per_bucket(now: DataFrame) -> DataFrame:
    """Largest component, members outside it and bytes of sets of each bucket (key, rep, n, comp) that has several."""
    per = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("size"))
    per = per.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), (F.sum("c") - F.max("c")).alias("outside"), (8 * F.sum("size")).alias("bytes"))
    return scratch(per.where("outside > 0"))


def _exploder(flat_of: FlatOf) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with a payload as one row for each distinct hash of its set, with the size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("payload")).to_numpy().astype(np.int64))
            at = 0
            while at < len(batch):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BYTES // 4, side="right")))
                part = batch.slice(at, end - at)
                hashes, counts = flat_of(part.column("payload"))
                owner = np.repeat(np.arange(len(part)), counts)
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                keep = np.ones(len(owner), dtype=bool)
                keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                hashes, owner = hashes[keep], owner[keep]
                sizes = np.bincount(owner, minlength=len(part)).astype(np.int64)
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in ("key", "rep", "comp", "out")), pa.array(sizes[owner]), pa.array(hashes.view(np.int64))], names=["key", "rep", "comp", "out", "n", "h"])
                at = end

    return run


def _by_rare_hashes(members: DataFrame, payloads: DataFrame, percent: int, flat_of: FlatOf | SetOf) -> DataFrame:
    """All links between components of buckets too large for one task (key, rep, n, comp).

    The hashes of each set are ordered by how many sets outside the bucket's largest component have them. Two sets of
    that similarity share one of the first n - ceil(share * n) + 1 of each, so only sets that do are compared; at least
    one of a pair is outside the largest component. Hashes that all sets of a bucket have come last and cost nothing."""
    kind = payloads.schema["rep"].dataType.simpleString()
    marked = members.join(_per_bucket(members).select("key", "main"), "key").select("key", "rep", "comp", (F.col("comp") != F.col("main")).alias("out"))
    items = marked.join(payloads, "rep").select("key", "rep", "comp", "out", "payload")
    if isinstance(flat_of, SetOf):
        items = items.select("key", "rep", "comp", "out", F.explode(F.array(flat_of.of("payload"))).alias("s")).select("key", "rep", "comp", "out", F.size("s").cast("long").alias("n"), F.explode("s").alias("h"))
    else:
        items = items.mapInArrow(_exploder(flat_of), f"key long, rep {kind}, comp {kind}, out boolean, n long, h long")
    items = scratch(items)
    spread = items.where("out").groupBy("key", "h").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("key", "rep").orderBy(F.coalesce("df", F.lit(0).cast("long")), "h"))
    rare = items.join(spread, ["key", "h"], "left").withColumn("at", place).where(f"at <= n - ceil(n * {percent} / 100) + 1 and df is not null").select("key", "h", "rep", "comp", "out", "n")
    rare = scratch(rare)
    one = rare.where("out").select("key", "h", "rep", "comp", "n")
    two = rare.select("key", "h", F.col("rep").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"))
    pairs = one.join(two, ["key", "h"]).where(f"comp <> cb and 100 * least(n, nb) >= {percent} * greatest(n, nb)").select("rep", "b")
    found = scratch(_confirm(pairs, payloads, percent, flat_of))
    discard(items, rare)
    return found


def shared_buckets(items: DataFrame) -> DataFrame:
    """(key, rep, n, m) of items (rep, n, keys): members of buckets that have m > 1 of them; more columns stay.

    Of buckets with the same members, by two 64-bit sums over them, one is kept."""
    member = items.select(*(c for c in items.columns if c != "keys"), F.explode("keys").alias("key"))
    shared = scratch(member.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"))
    rows = scratch(mark_members(member, "key", shared, "maybe").where("maybe").drop("maybe").join(shared, "key"))
    sums = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *sums).groupBy("m", "x1", "x2").agg(F.min("key").alias("key"))
    mates = scratch(rows.join(scratch(keys.select("key", "m")), "key"))
    discard(shared, rows)
    return mates


def similar_components(mates: DataFrame, payloads: DataFrame, percent: int, flat_of: FlatOf = stored_sets, size: str = "n") -> DataFrame:
    """(id, comp) of the items (key, rep, n, m) of buckets that have a link; payloads are (rep, payload).

    n bounds a set's size, the column `size` is its exact one: pairs of too different sizes are not compared."""
    fits = f"100 * least({size}, nb) >= {percent} * greatest({size}, nb)"
    # first round: each bucket's smallest item against the others, in small buckets more pivots, in the smallest all
    drawn = [F.min(F.struct(F.xxhash64("rep", F.lit(k)) if k else F.lit(0).cast("long"), "rep", F.col(size).alias("n"))).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = F.when(F.col("m") > MANY, F.array("p0")).otherwise(F.array(*(f"p{k}" for k in range(PIVOTS))))
    chosen = mates.where(F.col("m") > PIVOTS).groupBy("key", "m").agg(*drawn).select("key", F.explode(F.array_distinct(F.transform(pivots, lambda p: F.struct(p.rep.alias("b"), p.n.alias("nb"))))).alias("p"))
    chosen = chosen.select("key", "p.b", "p.nb").union(mates.where(F.col("m") <= PIVOTS).select("key", F.col("rep").alias("b"), F.col(size).alias("nb")))
    edges = scratch(_confirm(mates.join(scratch(chosen), "key").where(fits), payloads, percent, flat_of))
    comps = components(edges)
    # then, within buckets whose items aren't one component yet, all items outside the largest
    now = scratch(mates.where(F.col("m") > PIVOTS).join(comps, mates.rep == comps.id, "left").select("key", "rep", "n", F.coalesce("comp", "rep").alias("comp")))
    open_ = scratch(now.join(_per_bucket(now).select("key", "bytes"), "key"))
    small = open_.where(F.col("bytes") <= GATHERED)
    # a call takes several buckets, of GATHERED bytes in all or so
    n_calls = 1 + int((small.agg(F.sum(8 * F.col("n"))).first()[0] or 0) // GATHERED)
    here = small.select("key", "rep", "comp").join(payloads, "rep").withColumn("call", F.pmod(F.xxhash64("key"), F.lit(n_calls)))
    kind = payloads.schema["rep"].dataType.simpleString()
    more = scratch(here.groupBy("call").applyInArrow(_in_task(percent, flat_of), f"a {kind}, b {kind}").distinct())
    if more.limit(1).count():
        edges = scratch(edges.union(more))
        comps = components(edges)
    large = open_.where(F.col("bytes") > GATHERED)
    if large.limit(1).count():
        now = scratch(large.select("key", "rep", "n").join(comps, large.rep == comps.id, "left").select("key", "rep", "n", F.coalesce("comp", "rep").alias("comp")))
        more = _by_rare_hashes(now, payloads, percent, flat_of)
        if more.limit(1).count():
            comps = components(edges.union(more))
    return comps



#: Of linked_components: members of a bucket up to which all pairs are looked at at once, and outside its largest component.
ALL_PAIRS, MOST_PAIRS = 16, 2048
#: Words of 64 bits of a sketch.
_WORDS = [f"w{j}" for j in range(16)]


def sketches(payloads: DataFrame, set_of: SetOf) -> DataFrame:
    """(rep, size, w0 to w15): the exact size of each set, and bits that its hashes turn over, each one of them."""
    # dealt by item once, so that hashes aren't shuffled
    sets = payloads.select("rep", "payload").repartition("rep").select("rep", F.explode(F.array(set_of.of("payload"))).alias("s")).select("rep", F.size("s").alias("size"), F.explode("s").alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    words = sets.groupBy("rep", "size", F.pmod(F.shiftrightunsigned("h", 6), F.lit(len(_WORDS))).cast("int").alias("at")).agg(F.bit_xor(bit).alias("word"))
    return words.groupBy("rep", "size").agg(*(F.bit_xor(F.when(F.col("at") == j, F.col("word")).otherwise(F.lit(0).cast("long"))).alias(w) for j, w in enumerate(_WORDS)))


def _may_fit(a: str, b: str, percent: int) -> Column:
    """Whether sizes allow that similarity and sketches do; no pair that has it is ruled out.

    Sketches differ in the bits that an odd number of hashes in one set only turn over, so in no more than there are such
    hashes; of two sets of that similarity these are (100 - percent) / (100 + percent) of the sum of sizes at most."""
    differ = " + ".join(f"bit_count({a}.{w} ^ {b}.{w})" for w in _WORDS)
    return F.expr(f"100 * least({a}.size, {b}.size) >= {percent} * greatest({a}.size, {b}.size) and {100 + percent} * ({differ}) <= {100 - percent} * ({a}.size + {b}.size)")


def _pairs(one: DataFrame, two: DataFrame, percent: int, also: str) -> DataFrame:
    """Distinct pairs (rep, b) of the members of one and two that share a bucket and may fit."""
    both = one.alias("x").join(two.alias("y"), (F.col("x.key") == F.col("y.key")) & F.expr(also) & _may_fit("x", "y", percent))
    return scratch(both.select(F.least("x.rep", "y.rep").alias("rep"), F.greatest("x.rep", "y.rep").alias("b")).distinct())


def linked_components(mates: DataFrame, payloads: DataFrame, percent: int, set_of: SetOf) -> DataFrame:
    """(id, comp) of the items (key, rep, m) of buckets that have a link, in DataFrame functions only; payloads are (rep,
    payload).

    All pairs of small buckets are looked at, of others those with one member; then, where a bucket isn't one component,
    those of all members outside the largest with all others, or by a join on rare hashes in the largest buckets. Pairs
    that exact sizes or sketches rule out are not compared."""
    members = scratch(mates.join(sketches(payloads, set_of), "rep"))
    few, many = members.where(F.col("m") <= ALL_PAIRS), members.where(F.col("m") > ALL_PAIRS)
    pivots = many.join(many.groupBy("key").agg(F.min("rep").alias("rep")), ["key", "rep"], "left_semi")
    pairs = _pairs(few, few, percent, "x.rep < y.rep").union(_pairs(many, pivots, percent, "x.rep <> y.rep")).distinct()
    edges = scratch(_confirm(pairs, payloads, percent, set_of))
    comps = components(edges)
    now = scratch(many.withColumn("n", F.lit(0)).join(comps, many.rep == comps.id, "left").withColumn("comp", F.coalesce("comp", "rep")).drop("id"))
    open_ = scratch(now.join(_per_bucket(now).select("key", "main"), "key"))
    small = open_.where(F.col("m") <= MOST_PAIRS)
    more = _pairs(small.where("comp <> main"), small, percent, "x.comp <> y.comp")
    if more.limit(1).count():
        edges = scratch(edges.union(_confirm(more, payloads, percent, set_of)))
        comps = components(edges)
    large = open_.where(F.col("m") > MOST_PAIRS)
    if large.limit(1).count():
        more = _by_rare_hashes(large.select("key", "rep", "n", "comp").distinct(), payloads, percent, set_of)
        if more.limit(1).count():
            comps = components(edges.union(more))
    return comps
