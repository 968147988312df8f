"""Removal of byte strings that occur more than once, by a Burrows-Wheeler transform with bounded intervals.

1. Every string of `length` bytes is filed under the smallest hash of the `GRAM`-byte strings in it, a property of its
   content alone. Neighbouring strings with the same smallest hash make one segment, so there are about 2 segments per
   window of 137 bytes, and equal strings are always in segments with equal hashes.
2. Segments whose hash occurs once, in them too, are dropped. Of segments with equal content one is kept, with its count.
3. The different contents of a hash are concatenated, the Burrows-Wheeler transform is built, and intervals are
   extended backwards breadth first: level l finds the suffix boundaries whose common prefix has l bytes. It stops at
   `length`; boundaries not reached by then have a common prefix of `length` bytes or more.
4. What is covered in a content holds for each of its occurrences; spans are merged by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm import kernel
from gridlark.llm.common import mark_members, scratch, text_blocks

#: Bytes of the strings whose hashes are compared.
GRAM = 64
#: Bytes of text that one transform sorts, about, and the most that the contents of one hash may have in it.
TRANSFORM = 1 << 20
BLOCK = 1 << 20
_SHIFT = 40
U64 = np.uint64
_BASE = int(np.random.Generator(np.random.PCG64(99)).integers(2**61, 2**62)) * 4 + 1
_INVERSE = pow(_BASE, -1, 2**64)


class _Hashes:
    """Hashes of any substring of a block, from one running sum."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(kernel.BYTE_CODES[data] * kernel.powers(_BASE, len(data)), out=self.total[1:])
        self.inverse = kernel.powers(_INVERSE, len(data) + 1)

    def runs(self, size: int) -> np.ndarray:
        """Of all substrings of a size."""
        return (self.total[size:] - self.total[:-size]) * self.inverse[: len(self.total) - size]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.total[ends] - self.total[starts]) * self.inverse[starts]


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    done = 1
    while 2 * done <= size:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (size - done)], x[size - done :]) if size > done else x


def _many_least(grams: np.ndarray, least: np.ndarray, size: int, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether the smallest hash of a segment stands in it at several places, so that it may repeat itself."""
    # of each place, the largest of the minima of the windows over it
    padding = np.zeros(size - 1, dtype=U64)
    widest = ~_sliding_min(~np.concatenate([padding, least, padding]), size)
    chosen = np.flatnonzero(widest == grams)
    low, high = np.searchsorted(chosen, first), np.searchsorted(chosen, first + count + size - 1)
    n = high - low
    at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
    same = grams[chosen[at]] == np.repeat(least[first], n)
    return np.bincount(np.repeat(np.arange(len(n)), n), weights=same, minlength=len(n)) > 1


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, start within the row, number of strings, smallest hash, content hash of all segments of a block, and
    whether a segment may repeat itself."""
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    if not sizes.sum():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none, none > 0
    hashes = _Hashes(data)
    grams = kernel.mix(hashes.runs(GRAM))
    least = _sliding_min(grams, length - GRAM + 1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes - offsets[:-1], sizes)
    lowest, least = least, least[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    content = kernel.mix(hashes.spans(start, start + count + (length - 1)) + count.astype(U64) * U64(0x9E3779B97F4A7C15))
    return row[first], start - offsets[row[first]], count, least[first].view(np.int64), content.view(np.int64), _many_least(grams, lowest, length - GRAM + 1, start, count)


def _segmenter(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text", BLOCK):
            row, start, count, least, content, own = segments(data, offsets, length)
            tag = rows.column("tag").to_numpy()
            yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(row)), pa.array((tag[row] << _SHIFT) + start), pa.array(count), pa.array(least), pa.array(content), pa.array(own)], names=["id", "at", "n", "least", "content", "own"])

    return run


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of 9-bit symbols in the order of their first `depth` symbols at least, by doubling."""
    n = len(text)
    padded = np.concatenate([text.astype(U64), np.zeros(7, dtype=U64)])
    key = np.zeros(n, dtype=U64)
    for j in range(7):
        key = (key << U64(9)) | padded[j : j + n]
    done = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.ones(n, dtype=np.int64)
        new[1:] = ranked[1:] != ranked[:-1]
        rank = np.empty(n, dtype=U64)
        rank[order] = np.cumsum(new).astype(U64)
        if done >= depth or new.all():
            return order
        key = rank << U64(32)
        key[: n - done] |= rank[done:]
        done *= 2


def repeated_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """True for each position whose first `depth` symbols also start elsewhere; symbol 0 separates and is never within.

    Breadth-first backward extension on the transform: an interval of suffixes that start with a string of l symbols
    gives the intervals of its extensions by one symbol in front. A boundary first reached at level l has a common
    prefix of l symbols; each is reached once, and its interval is extended further only then."""
    n = len(text)
    order = suffix_array(text, depth)
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, dtype=np.int64)
    step[by_symbol] = np.arange(n)
    below = np.zeros(n + 1, dtype=bool)  # boundaries with a common prefix under `depth`
    below[[0, n]] = True
    counts = np.bincount(text, minlength=257)
    high = np.cumsum(counts)[counts > 0]
    low = high - counts[counts > 0]
    below[high] = True
    for _ in range(1, depth):
        if not len(low):
            break
        size = high - low
        lone = size == 1
        at = low[lone]
        at = step[at[bwt[at] != 0]]
        new_low, new_high = at, at + 1
        if not lone.all():
            many, first = size[~lone], low[~lone]
            owner = np.repeat(np.arange(len(many)), many)
            at = np.arange(len(owner)) + np.repeat(first - (np.cumsum(many) - many), many)
            solid = bwt[at] != 0
            at, owner = at[solid], owner[solid]
            # a symbol's entries of an interval are neighbours after the step
            packed = np.sort((step[at].astype(U64) << U64(32)) | owner.astype(U64))
            to, owner = (packed >> U64(32)).astype(np.int64), packed & U64(0xFFFFFFFF)
            symbol = text[order[to]]
            cut = np.ones(len(to) + 1, dtype=bool)
            if len(to):
                cut[1:-1] = (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])
                edge = np.flatnonzero(cut)
                new_low = np.concatenate([new_low, to[edge[:-1]]])
                new_high = np.concatenate([new_high, to[edge[1:] - 1] + 1])
        fresh = ~below[new_high]
        low, high = new_low[fresh], new_high[fresh]
        below[high] = True
    found = np.zeros(n, dtype=bool)
    found[order] = ~below[:-1] | ~below[1:]
    return found


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of the runs of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


_COVERED = "least long, content long, first long, last long"


def _transform(length: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        pieces = [np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in table.column("piece")]
        sizes = np.array([len(p) + 1 for p in pieces], dtype=np.int64)
        ends = np.cumsum(sizes)
        text = np.zeros(int(ends[-1]), dtype=np.uint16)
        for p, e in zip(pieces, ends, strict=True):
            text[e - len(p) - 1 : e - 1] = p
            text[e - len(p) - 1 : e - 1] += 1
        found = repeated_suffixes(text, length)
        row, first, last = [], [], []
        for k, (p, e, whole) in enumerate(zip(pieces, ends, table.column("copies").to_numpy() > 1, strict=True)):
            n = len(p) - length + 1
            f, z = (np.array([0]), np.array([n - 1])) if whole else _runs(found[e - len(p) - 1 : e - len(p) - 1 + n])
            row.append(np.full(len(f), k))
            first.append(f)
            last.append(z)
        at = pa.array(np.concatenate(row))
        return pa.table({"least": table.column("least").take(at), "content": table.column("content").take(at), "first": pa.array(np.concatenate(first)), "last": pa.array(np.concatenate(last))})

    return run


def _cutter(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [t.as_buffer()[s : s + n + length - 1].to_pybytes() for t, s, n in zip(batch.column("text").cast(pa.binary()), batch.column("start").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("least"), batch.column("content"), batch.column("copies"), batch.column("wide"), pa.array(pieces, type=pa.binary())], names=["least", "content", "copies", "wide", "piece"])

    return run


def _windows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of segments whose hash has too many contents for one transform: each string by itself, under two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for least, content, copies, piece in zip(*(batch.column(c).to_pylist() for c in ("least", "content", "copies", "piece")), strict=True):
                data = np.frombuffer(piece, dtype=np.uint8)
                one = _Hashes(data).runs(length)
                n = len(one)
                two = kernel.mix(one ^ U64(0xA24BAED4963EE407)) + kernel.mix(_Hashes(data[::-1]).runs(length)[::-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, least)), pa.array(np.full(n, content)), pa.array(np.full(n, copies)), pa.array(np.arange(n)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["least", "content", "copies", "first", "one", "two"])

    return run


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, firsts, lasts in zip(batch.column("text").cast(pa.binary()), batch.column("firsts"), batch.column("lasts"), strict=True):
            data = text.as_buffer()
            size = len(data)
            removed, spans, at, kept, reach = 0, 0, 0, hashlib.sha256(), -1
            if firsts.is_valid:
                f, z = firsts.values.to_numpy(), lasts.values.to_numpy()
                for s, e in sorted(zip(f.tolist(), z.tolist(), strict=True)):
                    if s > reach:
                        kept.update(data[at if reach < 0 else reach : s])
                        spans, removed, reach = spans + 1, removed + e - s, e
                    elif e > reach:
                        removed, reach = removed + e - reach, e
            kept.update(data[max(reach, 0) :])
            out.append((size, removed, spans, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(id, tag, spans): arrays of byte spans [first, last) of documents (id, tag, text) covered by repeated strings.

    A document has a row for each of its segments with spans; they may overlap."""
    found = scratch(docs.mapInArrow(_segmenter(length), "id long, at long, n long, least long, content long, own boolean"))
    often = found.groupBy("least").agg(F.count(F.lit(1)).alias("c"), F.max("own").alias("own")).where("c > 1 or own").select("least")
    # aggregates are written before they are joined with the rows they count, so that Spark can split a hot key's rows
    often = scratch(found.drop("own").join(scratch(often), "least"))
    contents = scratch(often.groupBy("least", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "at", "n")).alias("rep")))
    per = scratch(contents.groupBy("least").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("rep.n") + (length - 1)).alias("size")))
    lone = contents.where("copies > 1").join(per.where("kinds = 1"), "least").select("least", "content", F.lit(0).cast("long").alias("first"), (F.col("rep.n") - 1).alias("last"))
    various = contents.join(per, "least").where("kinds > 1 or copies = 1").select("least", "content", "copies", "rep.id", "rep.n", (F.col("size") > TRANSFORM).alias("wide"), F.shiftright("rep.at", _SHIFT).alias("tag"), F.col("rep.at").bitwiseAND(F.lit((1 << _SHIFT) - 1)).alias("start"))
    various = scratch(various)
    texts = mark_members(docs, "id", various.select("id"), "wanted").where("wanted").drop("wanted")
    pieces = scratch(various.join(texts, ["id", "tag"]).select("text", "start", "n", "least", "content", "copies", "wide").mapInArrow(_cutter(length), "least long, content long, copies long, wide boolean, piece binary"))
    total = pieces.where("not wide").agg(F.sum(F.length("piece"))).first()[0] or 0
    n_buckets = 1 + total // TRANSFORM
    covered = pieces.where("not wide").withColumn("bucket", F.pmod(F.xxhash64("least"), F.lit(n_buckets))).groupBy("bucket").applyInArrow(_transform(length), _COVERED)
    single = pieces.where("wide").mapInArrow(_windows(length), "least long, content long, copies long, first long, one long, two long")
    twice = scratch(single.groupBy("one", "two").agg(F.sum("copies").alias("c")).where("c > 1").select("one", "two"))
    covered = covered.union(single.join(twice, ["one", "two"]).select("least", "content", "first", F.col("first").alias("last")))
    # one row for each content, neighbouring runs as one, so that each occurrence meets one row
    covered = covered.groupBy("least", "content").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    before = lambda i: F.get(F.col("runs"), i - 1)["last"]
    after = lambda i: F.get(F.col("runs"), i + 1)["first"]
    opens = F.filter("runs", lambda r, i: (i == 0) | (before(i) + 1 < r["first"]))
    closes = F.filter("runs", lambda r, i: (i == F.size("runs") - 1) | (r["last"] + 1 < after(i)))
    covered = covered.select("least", "content", F.zip_with(opens, closes, lambda a, b: F.struct(a["first"].alias("first"), b["last"].alias("last"))).alias("runs"))
    lone = lone.select("least", "content", F.array(F.struct("first", "last")).alias("runs"))
    start = F.col("at").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    return often.join(scratch(covered.union(lone)), ["least", "content"]).select("id", F.shiftright("at", _SHIFT).alias("tag"), F.transform("runs", lambda r: F.struct((start + r["first"]).alias("first"), (start + r["last"] + length).alias("last"))).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left).

    A byte goes if a string of `length` bytes over it also starts anywhere else in any document, the same included.
    Text is UTF-8; null counts as empty; texts under `length` bytes lose nothing; a text may be of any length that fits
    a task. Repeated rows are each other's repeats. A null id is a document like any other. Empty in, empty out."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.pmod(F.xxhash64(text), F.lit(1 << 22)).alias("tag"), text.alias("text"))
    docs = docs.select(F.coalesce("id", F.lit(-(2**63) + 1)).alias("id"), "tag", "text")
    by_doc = repeated_spans(docs, length).groupBy("id", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    by_doc = scratch(by_doc.select("id", "tag", F.col("spans.first").alias("firsts"), F.col("spans.last").alias("lasts")))
    marked = mark_members(docs, "id", by_doc.select("id"), "hit")
    out = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    cut = marked.where("hit").join(by_doc, ["id", "tag"], "left").select("id", "text", "firsts", "lasts").mapInArrow(_remover, out)
    whole = marked.where("not hit").select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return cut.union(whole).select(F.nullif("id", F.lit(-(2**63) + 1)).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")
