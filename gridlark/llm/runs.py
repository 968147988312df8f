"""Periodic runs of words: stretches that repeat a block at least four times.

A document's word ids are big integers, one for each bit of an id (a plane). At a lag q, planes are XORed with themselves
shifted by q and ORed: a zero is a word equal to the one q further on. ANDs with shifts that double leave the places
where enough zeros follow each other.

Which lags are worth it is known before. In a run of period q, a block of L words, L the power of two with
L / 2 < q <= L, comes back after exactly q words (a shorter return would make the period shorter), and it does so from at
least max(6, 4q) - L - q + 1 places. Blocks of 1, 2, 4, ... words are named by pairs of names, over many documents at
once; names that do not repeat end there. So a document has at most about sqrt(n) lags, and nearly all have none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm import kernel
from gridlark.llm.common import text_blocks

#: Bytes of text that are searched at once; one text is never cut.
BLOCK = 1 << 20
#: A run has at least this many words, and this many times its period.
LEAST, TIMES = 6, 4


def candidate_lags(ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and lags at which a run is possible. ids: numbers of the words, different in different rows; rows ascend."""
    at, name, size = np.arange(len(ids)), ids, 1
    found_rows, found_lags = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    while len(at):
        order = np.argsort(name, kind="stable")
        sorted_at, sorted_name = at[order], name[order]
        same = sorted_name[1:] == sorted_name[:-1]
        lag = (sorted_at[1:] - sorted_at[:-1])[same]
        fits = (2 * lag > size) & (lag <= size)
        if fits.any():
            lag, from_row = lag[fits], row[sorted_at[:-1][same][fits]]
            pairs, counts = np.unique(from_row * (len(ids) + 1) + lag, return_counts=True)
            pair_row, pair_lag = np.divmod(pairs, len(ids) + 1)
            enough = counts >= np.maximum(LEAST, TIMES * pair_lag) - size - pair_lag + 1
            found_rows.append(pair_row[enough])
            found_lags.append(pair_lag[enough])
        again = np.zeros(len(at), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        rank = np.zeros(len(at), dtype=np.int64)
        rank[1:] = np.cumsum(~same)
        keep = np.sort(order[again])  # in order of place
        named = np.empty(len(at), dtype=np.int64)
        named[order] = rank
        at, named = at[keep], named[keep]
        # the block at `at` and the one right after it make a block of twice the size
        after = np.minimum(np.searchsorted(at, at + size), max(len(at) - 1, 0))
        both = (at[after] == at + size) & (row[at[after]] == row[at]) if len(at) else np.zeros(0, dtype=bool)
        name, at, size = named[both] * (len(ids) + 1) + named[after[both]], at[both], 2 * size
    rows, lags = np.concatenate(found_rows), np.concatenate(found_lags)
    order = np.lexsort((lags, rows))
    return rows[order], lags[order]


def _bits(x: int, n: int) -> np.ndarray:
    """Places of the ones among the lowest n bits."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(n // 8 + 1, "little"), dtype=np.uint8), bitorder="little"))


def periodic_stretches(ids: np.ndarray, lags: list[int]) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a row's word numbers at ascending lags, by start, then period."""
    n = len(ids)
    _, ids = np.unique(ids, return_inverse=True)
    planes = [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(max(1, int(ids.max()).bit_length()))]
    runs: dict[tuple[int, int], int] = {}
    for q in lags:
        unequal = 0
        for plane in planes:
            unequal |= plane ^ (plane >> q)
        long = ~unequal & ((1 << (n - q)) - 1)
        need, have = max(LEAST - q, (TIMES - 1) * q), 1
        while have < need and long:
            step = min(have, need - have)
            long &= long >> step
            have += step
        if long:
            first, last = _bits(long & ~(long << 1), n), _bits(long & ~(long >> 1), n)
            for start, end in zip(first.tolist(), last.tolist(), strict=True):
                runs.setdefault((start, end - start + need + q), q)  # the same stretch at a smaller lag has the smaller period
    return sorted((start, length, q) for (start, length), q in runs.items())


def _finder() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text", BLOCK):
            starts, ends, counts = kernel.word_spans(data, offsets)
            row = np.repeat(np.arange(len(counts)), counts)
            hashes = kernel.exact_hashes(data, starts, ends)
            ids = kernel.mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            lag_rows, lags = candidate_lags(ids, row)
            keep = np.ones(len(starts), dtype=bool)
            first = np.cumsum(counts) - counts
            runs: list[list[dict]] = [[] for _ in counts]
            for r in np.unique(lag_rows):
                a, b = first[r], first[r] + counts[r]
                found = periodic_stretches(hashes[a:b], lags[np.searchsorted(lag_rows, r) : np.searchsorted(lag_rows, r, side="right")].tolist())
                runs[r] = [{"start": s, "length": n, "period": q} for s, n, q in found]
                for s, n, q in found:
                    keep[a + s + q : a + s + n] = False
            collapsed = kernel.joined_words(data, starts[keep], ends[keep], np.bincount(row[keep], minlength=len(counts)))
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(counts.astype(np.int64)), pa.array(runs, type=run_type), collapsed], names=["id", "n_words", "runs", "collapsed"])

    return find


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, runs (start, length, period in words, by start, then period), collapsed.

    Words are runs without \\x20 and \\x09-\\x0D, told apart as they are. A run is a stretch of smallest period q and of at
    least max(6, 4q) words that no neighbouring word extends. collapsed is the text without the words that any run holds
    after its first q, joined by one space. Null, empty or blank text has no words, no runs and an empty collapsed text.
    Rows are searched each by itself: null ids and repeated rows are like any other; empty in, empty out."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    found = texts.mapInArrow(_finder(), f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)
