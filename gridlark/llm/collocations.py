"""Phrases that stand together more often than their parts would: exact counts, cut scores, maximal phrases.

1. Words, then pairs of frequent words, are counted, combined within each shard first. What is frequent goes to the tasks
   as a Bloom filter of bounded size; a full filter lets more through, the counts decide.
2. Every shard builds a trie of its phrases of 2 to `longest` words, level by level, with a count at each node. A phrase
   of which any pair is rare can't be frequent and gets no node. Tries are serialised in the order of their paths, cut by
   ranges of their first two words.
3. The parts of a range meet in a task, where equal paths are merged and their counts added.
4. A walk over the merged trie, in order, has all ancestors of a node on its stack: their counts are those of the left
   parts. The right part of a cut is where the suffix links lead, a join on the phrase without its first words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark.llm import kernel
from gridlark.llm.common import discard, scratch, text_blocks

#: Bytes that end a piece, and bytes between words.
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[*b".,;:!?", *range(10, 14)]] = True
_GAPS = _ENDS.copy()
_GAPS[[32, 9]] = True
#: Bytes of text that are cut into words at once, and words of a shard.
BLOCK, SHARD = 1 << 20, 2_000_000
#: Frequent pairs that a range of the merge has about, with all phrases that begin with them.
RANGE_PAIRS = 256
#: Shares that a language's phrases are ranked in first.
SHARES = 64
#: Bits for each key of a filter, and the most that a filter has (16 MiB), as powers of two.
KEY_BITS, LEAST_LOG, MOST_LOG = 16, 13, 27
_SALTS = np.array([0, 0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A], dtype=np.uint64)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class _Words:
    """The words of a block: a key of each that tells languages apart, the piece it is in, its language and bytes."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends, counts = kernel.word_spans(data, offsets, _GAPS)
        row = np.repeat(np.arange(len(counts)), counts)
        langs = pc.dictionary_encode(rows.column("lang"))
        self.lang = langs.indices.to_numpy()[row]
        self.names = langs.dictionary
        seeds = np.array([_seed(x) for x in self.names.to_pylist()], dtype=np.uint64)
        self.keys = kernel.mix(kernel.word_hashes(data, self.starts, self.ends) ^ seeds[self.lang]) if len(row) else np.zeros(0, dtype=np.uint64)
        ends_before = np.concatenate([[0], np.cumsum(_ENDS[data])])
        self.piece = ends_before[self.starts] + row

    def follows(self) -> np.ndarray:
        """Whether the next word is in the same piece."""
        return np.append(self.piece[1:] == self.piece[:-1], False) if len(self.piece) else np.zeros(0, dtype=bool)

    def pairs(self) -> np.ndarray:
        """Keys of each word and the next."""
        return kernel.mix(self.keys * _PAIR + np.append(self.keys[1:], np.uint64(0)))

    def texts(self, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Languages and lower-cased texts of words."""
        data, offsets = kernel.gathered(self.data, self.starts[at], self.ends[at])
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())
        return self.names.take(pa.array(self.lang[at])), words


class _Filter:
    """A Bloom filter in a task; None lets everything pass."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for salt in _SALTS:
            bit = kernel.mix(keys + salt) & self.mask
            found &= (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
        return found


def _filter_of(keys: DataFrame) -> _Filter:
    """The filter of a table's column `key`, combined on the executors; at most 2**MOST_LOG bits reach the driver."""
    log = min(MOST_LOG, max(LEAST_LOG, (KEY_BITS * max(1, keys.count()) - 1).bit_length()))
    mask = np.uint64((1 << log) - 1)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            k = rows.column("key").to_numpy().view(np.uint64)
            bit = np.unique(np.concatenate([kernel.mix(k + salt) & mask for salt in _SALTS]))
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], names=["w", "x"])

    found = keys.select("key").mapInArrow(slots, "w long, x long").groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    words = np.zeros(1 << (log - 6), dtype=np.uint64)
    words[found.column("w").to_numpy()] = found.column("x").to_numpy().view(np.uint64)
    return _Filter(words)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of one of each, and sums of their counts."""
    all_keys = np.concatenate(keys)
    found, first, at = np.unique(all_keys, return_index=True, return_inverse=True)
    return found, first, np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, key, n) of each shard, and a row without a word for all words of a language."""
    held: list[tuple] = []
    size = 0

    def shard() -> Iterator[pa.RecordBatch]:
        if held:
            keys, first, n = _summed([x[0] for x in held], [x[1] for x in held])
            lang, word = pa.concat_arrays([x[2] for x in held]).take(pa.array(first)), pa.concat_arrays([x[3] for x in held]).take(pa.array(first))
            yield pa.RecordBatch.from_arrays([lang, word, pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "word", "key", "n"])
            sums = pa.table({"lang": lang, "n": n}).group_by("lang").aggregate([("n", "sum")])
            yield pa.RecordBatch.from_arrays([sums["lang"].combine_chunks(), pa.nulls(len(sums), pa.string()), pa.nulls(len(sums), pa.int64()), sums["n_sum"].combine_chunks()], names=["lang", "word", "key", "n"])

    for rows, data, offsets in text_blocks(batches, "text", BLOCK):
        words = _Words(rows, data, offsets)
        keys, first, n = np.unique(words.keys, return_index=True, return_counts=True)
        held.append((keys, n, *words.texts(first)))
        size += len(keys)
        if size > SHARD:
            yield from shard()
            held, size = [], 0
    yield from shard()


def _pair_counter(frequent: _Filter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def shard() -> Iterator[pa.RecordBatch]:
            if size:
                keys, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

        for rows, data, offsets in text_blocks(batches, "text", BLOCK):
            words = _Words(rows, data, offsets)
            known = frequent.holds(words.keys)
            pairs = words.pairs()[words.follows() & known & np.append(known[1:], False)]
            held.append(pairs)
            size += len(pairs)
            if size > SHARD:
                yield from shard()
                held, size = [], 0
        yield from shard()

    return count


def trie_levels(words: np.ndarray, linked: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The count trie of a shard, level by level from depth 2: parent, word and count of each node, in order of paths.

    words: numbers from 0; linked: whether the next word may follow in a phrase. The parent of a node of depth 2 is a
    word, of others the place of a node in the level before."""
    n_words = int(words.max(initial=0)) + 1
    at, node = np.arange(len(words)), words
    for depth in range(2, longest + 1):
        go = linked[at + depth - 2]
        at, node = at[go], node[go]
        if not len(at):
            return
        found, node, counts = np.unique(node * n_words + words[at + depth - 1], return_inverse=True, return_counts=True)
        yield found // n_words, found % n_words, counts


def serialised(keys: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ranges: int) -> pa.RecordBatch:
    """A trie cut by ranges of its first two words: (range, parents, words, counts), lists with an item for each level.

    Ranges are of equal width over the hash of the two words, whose whole subtree goes with them."""
    out: dict[int, tuple[list, list, list]] = {}
    home = place = None
    for depth, (parent, word, count) in enumerate(levels, 2):
        if depth == 2:
            home = ((kernel.mix(keys[parent] * _PAIR + keys[word]) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            up = keys[parent]
        else:
            home, up = home[parent], place[parent].astype(np.int32)
        order = np.argsort(home, kind="stable")
        there, first = np.unique(home[order], return_index=True)
        place = np.empty(len(home), dtype=np.int64)
        place[order] = np.arange(len(home)) - np.repeat(first, np.diff(np.append(first, len(home))))
        for r, a, b in zip(there.tolist(), first, [*first[1:], len(home)], strict=True):
            row = out.setdefault(r, ([], [], []))
            for items, values in zip(row, (up, keys[word], count.astype(np.int64)), strict=True):
                items.append(values[order[a:b]].tobytes())
    columns = [pa.array([row[k] for row in out.values()], type=pa.list_(pa.binary())) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(list(out), type=pa.int64()), *columns], names=["range", "parents", "words", "counts"])


def _trie_builder(frequent: _Filter, pairs: _Filter, longest: int, ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def shard() -> Iterator[pa.RecordBatch]:
            if size:
                keys, ids = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
                yield serialised(keys, list(trie_levels(ids, np.concatenate([x[1] for x in held]), longest)), ranges)

        for rows, data, offsets in text_blocks(batches, "text", BLOCK):
            words = _Words(rows, data, offsets)
            known = frequent.holds(words.keys)
            linked = words.follows() & known & np.append(known[1:], False)
            linked[linked] = pairs.holds(words.pairs()[linked])
            used = linked.copy()
            used[1:] |= linked[:-1]
            held.append((words.keys[used], linked[used]))
            size += int(used.sum())
            if size > SHARD:
                yield from shard()
                held, size = [], 0
        yield from shard()

    return build


def merged_tries(tries: list[tuple[list[bytes], list[bytes], list[bytes]]], min_count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Paths (word keys, a row each) and counts of the nodes of all tries of a range, level by level in order of paths;
    nodes of less than min_count are left out."""
    paths: list[np.ndarray] = []
    for depth in range(2, 2 + max(len(t[0]) for t in tries)):
        paths = [p if len(t[0]) > depth - 2 else None for p, t in zip(paths or [None] * len(tries), tries, strict=True)] if depth > 2 else [np.zeros(0)] * len(tries)
        for k, (parents, words, _) in enumerate(tries):
            if paths[k] is not None:
                word = np.frombuffer(words[depth - 2], dtype=np.uint64)[:, None]
                up = np.frombuffer(parents[0], dtype=np.uint64)[:, None] if depth == 2 else paths[k][np.frombuffer(parents[depth - 2], dtype=np.int32)]
                paths[k] = np.hstack([up, word])
        every = np.concatenate([p for p in paths if p is not None])
        counts = np.concatenate([np.frombuffer(t[2][depth - 2], dtype=np.int64) for p, t in zip(paths, tries, strict=True) if p is not None])
        order = np.lexsort(every.T[::-1])
        every = every[order]
        first = np.flatnonzero(np.append(True, (every[1:] != every[:-1]).any(axis=1)))
        sums = np.add.reduceat(counts[order], first)
        keep = sums >= min_count
        yield every[first[keep]], sums[keep]


def _merger(min_count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for paths, n in merged_tries(held, min_count):
                ends = np.arange(len(paths) + 1, dtype=np.int32) * paths.shape[1]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(paths.ravel().view(np.int64))), pa.array(n)], names=["path", "n"])

        for rows in batches:
            for r, *trie in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if r != at and held:
                    yield from out()
                    held = []
                at = r
                held.append(tuple(trie))
        if held:
            yield from out()

    return merge


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `lefts`, the counts of a node's ancestors from the first word on, to nodes in the order of their paths."""
    stack: list[tuple[str, int]] = []
    lang = None
    for rows in batches:
        lefts = []
        for at, phrase, n in zip(rows.column("lang").to_pylist(), rows.column("phrase").to_pylist(), rows.column("n").to_pylist(), strict=True):
            while stack and (at != lang or not phrase.startswith(stack[-1][0])):
                stack.pop()
            lang = at
            lefts.append([m for _, m in stack])
            stack.append((phrase + " ", n))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lefts, type=pa.list_(pa.int64()))], names=[*rows.schema.names, "lefts"])


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Two tables in the shared folder: (lang, phrase, n) of all phrases of up to `longest` words with min_count
    occurrences or more, and (lang, total), the words of each language."""
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    counted = texts.mapInArrow(_count_words, "lang string, word string, key long, n long")
    words = scratch(counted.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.first("key").alias("key")).where(f"n >= {min_count} or word is null"))
    frequent = _filter_of(words.where("word is not null"))
    # this is only for the filter: pairs are counted anew, by their words, in the tries
    pairs = scratch(texts.mapInArrow(_pair_counter(frequent), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(f"n >= {min_count}"))
    ranges = max(16, pairs.count() // RANGE_PAIRS)
    tries = texts.mapInArrow(_trie_builder(frequent, _filter_of(pairs), longest, ranges), "range long, parents array<binary>, words array<binary>, counts array<binary>")
    merged = scratch(tries.repartition("range").sortWithinPartitions("range").mapInArrow(_merger(min_count), "path array<long>, n long"))
    spelled = merged.select("path", "n", F.posexplode("path").alias("at", "key")).join(words.where("word is not null").select("key", "lang", "word"), "key")
    phrases = spelled.groupBy("path", "n").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    nodes = scratch(phrases.select("lang", "phrase", "n").union(words.where("word is not null").select("lang", "word", "n")))
    totals = scratch(words.where("word is null").select("lang", F.col("n").alias("total")))
    discard(words, pairs, merged)
    return nodes, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split at [.,;:!?\\x0A-\\x0D] into pieces, those at spaces and tabs into words; null
    text is empty, null lang `und`. Candidates are phrases of 2 to `longest` words with a >= min_count occurrences within
    pieces, overlaps included. A cut has l and r, the counts of its parts, and the score floor(1000 a n / (l r)), n being
    all words of the language; the cut of least score counts, ties the shortest left part. A candidate inside a longer
    one that is as frequent is left out. Order: score and a descending, phrase ascending. Repeated rows count each time;
    without words or candidates there are no rows."""
    nodes, totals = phrase_counts(docs, text_col, lang_col, min_count, longest)
    words = F.split("phrase", " ")
    first = F.element_at(words, 1)
    ordered = nodes.repartitionByRange("lang", first).sortWithinPartitions("lang", words)
    walked = ordered.mapInArrow(_walk, "lang string, phrase string, n long, lefts array<long>").where("size(lefts) > 0")
    cuts = walked.select("lang", "phrase", F.col("n").alias("a"), F.posexplode("lefts").alias("k", "l"))
    rest = F.array_join(F.slice(words, F.col("k") + 2, F.size(words)), " ")
    parts = scratch(cuts.withColumn("rest", rest)).join(nodes.select(F.col("lang").alias("in_lang"), F.col("phrase").alias("part"), F.col("n").alias("r")), (F.col("lang") == F.col("in_lang")) & (F.col("rest") == F.col("part")))
    # up to 38 digits: exact
    score = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(total as decimal(18,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = parts.join(totals.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of")).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    size = F.size(words)
    inner = nodes.where(size > 2).select("lang", "n", F.explode(F.array(F.array_join(F.slice(words, 1, size - 1), " "), F.array_join(F.slice(words, 2, size - 1), " "))).alias("phrase"))
    # of all longer phrases around one, those with one word more are the most frequent
    around = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    maximal = best.join(around, ["lang", "phrase"], "left").where("longer is null or longer < a")
    rows = maximal.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    # the first of each share of a language's phrases, then the first of those
    shared = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    some = shared.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return last.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
