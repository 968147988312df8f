"""Sequence alignment with affine gaps on pairs that share k-mers, and alignments through reference residues."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions import vectors as vx

#: Cells of the tables of pairs that are aligned at once.
CELLS = 4 << 20
_LOW = -1e18


def kmer_set(seq: str | Column, k: int) -> Column:
    """Distinct substrings of k characters; a shorter sequence is one."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - k + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(k))))


def kmer_pairs(items: DataFrame, key: str, seq: str, k: int = 3, percent: int = 40) -> DataFrame:
    """(a, b) with a < b: all pairs of items that share at least `percent` of the k-mers of the one that has more.

    Pairs meet through the k-mers that few items have: of an item's n, ordered by how many items have them, the first
    n - ceil(percent n / 100) + 1. Any pair with so much in common shares one of these, so none is lost, and k-mers that
    nearly all items have propose nothing. Candidates are confirmed on whole sets. Null keys and sequences and empty
    sequences are in no pair."""
    sets = items.where(f"{key} is not null and length({seq}) > 0").select(F.col(key).alias("id"), kmer_set(seq, k).alias("set"))
    each = sets.select("id", F.size("set").alias("n"), F.explode("set").alias("x"))
    spread = each.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(spread, "x").withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("df", "x")))
    rare = ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("x", "id", "n")
    left, right = rare.toDF("x", "a", "na"), rare.toDF("x", "b", "nb")
    near = (F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    found = left.join(right, "x").where(near).select("a", "b").distinct()
    both = found.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return both.where(100 * F.size(F.array_intersect("sa", "sb")) >= percent * F.greatest(F.size("sa"), F.size("sb"))).select("a", "b")


def substitution(match: float = 5.0, mismatch: float = -4.0) -> np.ndarray:
    """Scores of all pairs of code points up to 255; others count as one more letter."""
    return np.where(np.eye(257, dtype=bool), match, mismatch)


def align(first: list[str], second: list[str], scores: np.ndarray, opening: float = 10.0, extension: float = 0.5, local: bool = False, band: int | None = None) -> list[tuple[float, str, str]]:
    """(score, aligned first, aligned second) of pairs of sequences, all at once.

    A gap of n letters costs opening + (n - 1) extension, with opening >= extension. Tables are kept along diagonals:
    place k of row i is column i + k - band, and only places within the band (and the difference in length) exist;
    without a band all do. Of a local alignment the letters outside are opposite gaps."""
    sizes = np.array([[len(a), len(b)] for a, b in zip(first, second, strict=True)], dtype=np.int64)
    n, rows, columns = len(first), int(sizes[:, 0].max(initial=0)), int(sizes[:, 1].max(initial=0))
    reach = max(rows, columns) if band is None else band + int(np.abs(sizes[:, 0] - sizes[:, 1]).max(initial=0))
    width = 2 * reach + 1
    codes = np.full((2, n, max(rows, columns) + 1), 256, dtype=np.int64)
    for s, texts in enumerate((first, second)):
        for p, t in enumerate(texts):
            codes[s, p, : len(t)] = [min(ord(c), 256) for c in t]
    k = np.arange(width)
    j = k - reach
    there = (j[None, :] >= 0) & (j[None, :] <= sizes[:, 1:])
    h = np.where(there, 0.0 if local else np.where(j > 0, -opening - extension * (j - 1.0), 0.0), _LOW)
    e = np.full((n, width), _LOW)
    moves = np.zeros((rows + 1, n, width), dtype=np.uint8)  # 1: down, 2: right, 3: diagonal; 4, 8: the gap goes on; 0: start
    moves[0] = 0 if local else np.where(j > 1, 2 + 8, np.where(j == 1, 2, 0))[None, :]
    best, place = np.where(sizes[:, 0] == 0, 0.0, _LOW), np.zeros((n, 2), dtype=np.int64)
    if local:
        best[:] = 0.0
    else:
        best = np.where(sizes[:, 0] == 0, h[np.arange(n), np.clip(sizes[:, 1] + reach, 0, width - 1)], _LOW)
    place[:, 1] = np.where(sizes[:, 0] == 0, sizes[:, 1] + reach, reach) if not local else reach
    for i in range(1, rows + 1):
        j = i + k - reach
        there = (j[None, :] >= 0) & (j[None, :] <= sizes[:, 1:]) & (i <= sizes[:, :1])
        up, up_gap = np.append(h[:, 1:], np.full((n, 1), _LOW), axis=1), np.append(e[:, 1:], np.full((n, 1), _LOW), axis=1)
        longer_down = up_gap - extension > up - opening
        e = np.where(there, np.where(longer_down, up_gap - extension, up - opening), _LOW)
        letter = codes[1][:, np.clip(j - 1, 0, codes.shape[2] - 1)]
        diagonal = np.where(there & (j[None, :] >= 1), h + scores[codes[0][:, i - 1][:, None], letter], _LOW)
        inner = np.maximum(diagonal, e)
        if local:
            inner = np.where(there, np.maximum(inner, 0.0), _LOW)
        # the best cell to the left that a gap can come from, each with what the gap would cost so far taken off
        carried = np.maximum.accumulate(inner + extension * k, axis=1)
        across = np.append(np.full((n, 1), _LOW), carried[:, :-1] - opening - extension * (k[1:] - 1.0), axis=1)
        h = np.where(there, np.maximum(inner, across), _LOW)
        before = np.append(np.full((n, 1), _LOW), inner[:, :-1], axis=1)
        longer_right = across > before - opening
        move = np.where(h == diagonal, 3, np.where(h == e, 1, 2))
        if local:
            move = np.where(h <= 0, 0, move)
        moves[i] = np.where(there, move + 4 * longer_down + 8 * longer_right, 0)
        if local:
            at = h.argmax(axis=1)
            top = h[np.arange(n), at]
            better = top > best
            best = np.where(better, top, best)
            place[better] = np.column_stack([np.full(n, i), at])[better]
        else:
            ends = sizes[:, 0] == i
            best = np.where(ends, h[np.arange(n), np.clip(sizes[:, 1] - i + reach, 0, width - 1)], best)
            place[ends] = np.column_stack([np.full(n, i), sizes[:, 1] - i + reach])[ends]
    return [(float(best[p]), *_traced(first[p], second[p], moves[:, p], int(place[p, 0]), int(place[p, 1]), reach, local)) for p in range(n)]


def _traced(a: str, b: str, moves: np.ndarray, i: int, k: int, reach: int, local: bool) -> tuple[str, str]:
    j = i + k - reach
    tail = ("-" * (len(b) - j) + a[i:], b[j:] + "-" * (len(a) - i)) if local else ("", "")
    one: list[str] = []
    two: list[str] = []
    gap = 0
    while True:
        code = int(moves[i, j - i + reach])
        move = gap or code & 3
        if not move:
            break
        if move == 3:
            i, j = i - 1, j - 1
            one.append(a[i])
            two.append(b[j])
        elif move == 1:
            gap = 1 if code & 4 else 0
            i -= 1
            one.append(a[i])
            two.append("-")
        else:
            gap = 2 if code & 8 else 0
            j -= 1
            one.append("-")
            two.append(b[j])
    head = (a[:i] + "-" * j, "-" * i + b[:j]) if local else ("", "")
    return head[0] + "".join(reversed(one)) + tail[0], head[1] + "".join(reversed(two)) + tail[1]


def _aligner(scores: np.ndarray, how: dict) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            longest = pdf[["sa", "sb"]].map(len).max(axis=1).to_numpy() if len(pdf) else np.zeros(0)
            order = np.argsort(longest, kind="stable")  # pairs of like size are aligned together
            at = 0
            while at < len(order):
                end = at + 1
                while end < len(order) and (end - at + 1) * (longest[order[end]] + 1) * (2 * longest[order[end]] + 1) <= CELLS:
                    end += 1
                part = pdf.iloc[order[at:end]]
                found = align(part["sa"].to_list(), part["sb"].to_list(), scores, **how)
                yield part[["a", "b"]].assign(score=[f[0] for f in found], aligned_a=[f[1] for f in found], aligned_b=[f[2] for f in found])
                at = end

    return run


def align_pairs(pairs: DataFrame, items: DataFrame, key: str, seq: str, scores: np.ndarray | None = None, opening: float = 10.0, extension: float = 0.5, local: bool = False, band: int | None = None) -> DataFrame:
    """(a, b, score, aligned_a, aligned_b) of pairs (a, b) of items; pairs of missing items and null sequences have no
    row. Pairs are dealt by both keys, so an item with many partners is no task's burden."""
    kind = items.schema[key].dataType.simpleString()
    known = items.where(f"{key} is not null and {seq} is not null").select(F.col(key).alias("id"), F.col(seq).alias("s"))
    both = pairs.select("a", "b").join(known.toDF("a", "sa"), "a").join(known.toDF("b", "sb"), "b").repartition("a", "b")
    how = {"opening": opening, "extension": extension, "local": local, "band": band}
    return both.select("a", "b", "sa", "sb").mapInPandas(_aligner(substitution() if scores is None else scores, how), f"a {kind}, b {kind}, score double, aligned_a string, aligned_b string")


def identity(a: str = "aligned_a", b: str = "aligned_b") -> Column:
    """The share of columns with the same letter among those of an alignment."""
    at = F.sequence(F.lit(1), F.length(a))
    same = F.aggregate(at, F.lit(0), lambda s, i: s + F.when((F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))) & (F.substring(a, i, F.lit(1)) != "-"), 1).otherwise(0))
    return F.when(F.length(a) > 0, same / F.length(a))


def reference_attention(residues: DataFrame, references: DataFrame) -> DataFrame:
    """(key, pos, ref, beta): for each reference residue (ref, rv), the softmax of minus the Manhattan distance over the
    residues (key, pos, vector) of an item. References are the few residues of one structure."""
    e = F.exp(-vx.l1(F.col("vector"), F.col("rv")))
    near = residues.join(F.broadcast(references.select("ref", F.col("vector").alias("rv"))), F.lit(True)).withColumn("e", e)
    return near.select("key", "pos", "ref", (F.col("e") / F.sum("e").over(Window.partitionBy("key", "ref"))).alias("beta"))


def reference_alignment(residues: DataFrame, references: DataFrame, pairs: DataFrame, gate: bool = False) -> DataFrame:
    """(a, b, dist): distance of the residues of two items, weighed by how both attend to the same reference residues.

    With `gate` the weight is multiplied by that of soft symmetric alignment, so that both must agree."""
    beta = reference_attention(residues, references)
    side = beta.groupBy("key", "pos").agg(F.sort_array(F.collect_list(F.struct("ref", "beta"))).alias("to")).join(residues, ["key", "pos"])
    a = side.select(F.col("key").alias("a"), F.col("pos").alias("i"), F.col("to").alias("to_a"), F.col("vector").alias("x"))
    b = side.select(F.col("key").alias("b"), F.col("pos").alias("j"), F.col("to").alias("to_b"), F.col("vector").alias("y"))
    met = pairs.select("a", "b").join(a, "a").join(b, "b").withColumn("d", vx.l1(F.col("x"), F.col("y")))
    through = F.aggregate(F.zip_with("to_a", "to_b", lambda p, q: p["beta"] * q["beta"]), F.lit(0.0), lambda s, v: s + v)
    w = met.select("a", "b", "i", "j", "d", through.alias("w"))
    if gate:
        e = F.exp(-F.col("d"))
        alpha, beta = e / F.sum(e).over(Window.partitionBy("a", "b", "i")), e / F.sum(e).over(Window.partitionBy("a", "b", "j"))
        w = w.withColumns({"al": alpha, "be": beta}).withColumn("w", F.col("w") * (F.col("al") + F.col("be") - F.col("al") * F.col("be")))
    return w.groupBy("a", "b").agg(F.try_divide(F.sum(F.col("w") * F.col("d")), F.sum("w")).alias("dist"))


def contact_pool(residues: DataFrame, references: DataFrame, contacts: DataFrame) -> DataFrame:
    """(key, ref, other, x): an item's map (key, i, j, m) of its residues, brought to reference residues by attention.

    x is the sum over i and j of beta(i, ref) m(i, j) beta(j, other): two joins with the few references of each residue,
    summed before the second."""
    beta = reference_attention(residues, references)
    first = contacts.join(beta.select("key", F.col("pos").alias("i"), "ref", "beta"), ["key", "i"]).groupBy("key", "ref", "j").agg(F.sum(F.col("m") * F.col("beta")).alias("m"))
    second = first.join(beta.select("key", F.col("pos").alias("j"), F.col("ref").alias("other"), "beta"), ["key", "j"])
    return second.groupBy("key", "ref", "other").agg(F.sum(F.col("m") * F.col("beta")).alias("x"))
