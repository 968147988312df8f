"""Near-duplicate documents by min-max hashing, with links confirmed on the whole shingle sets.

Every permutation gives two signature values, its minimum and its maximum, so that hashing costs half. Bands of
signature values propose buckets, whose members are compared as in gridlark.llm.links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm import kernel
from gridlark.llm.common import mark_members, scratch, text_blocks
from gridlark.llm.links import shared_buckets, similar_components

#: Bytes of text that are hashed at once.
BLOCK = 1 << 20
_MULTIPLIERS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_max(values: np.ndarray, n_perms: int) -> np.ndarray:
    """The minima, then the maxima, of a set under n_perms permutations."""
    low = np.full(n_perms, np.uint64(2**64 - 1))
    high = np.zeros(n_perms, dtype=np.uint64)
    for at in range(0, len(values), 4096):
        seen = _MULTIPLIERS[:n_perms, None] * values[None, at : at + 4096]
        np.minimum(low, seen.min(axis=1), out=low)
        np.maximum(high, seen.max(axis=1), out=high)
    return np.concatenate([low, high])


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for rows, data, offsets in text_blocks(batches, "text", BLOCK):
        starts, ends, counts = kernel.word_spans(data, offsets)
        hashes, n = kernel.shingle_hashes(kernel.word_hashes(data, starts, ends), counts, width)
        yield rows, kernel.sets_of(hashes, n)


def _signer(width: int, bands: int, rows_per_band: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    n_perms = (bands * rows_per_band + 1) // 2

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for rows, sets in _blocks(batches, width):
            keys, low, high = [], [], []
            for s in sets:
                if len(s):
                    values = kernel.mix(min_max(s, n_perms)[: bands * rows_per_band]).reshape(rows_per_band, bands)
                    acc = salt.copy()
                    for v in values:
                        acc = kernel.mix(acc * np.uint64(31) + v)
                    keys.append(acc.view(np.int64))
                else:
                    keys.append(np.zeros(0, dtype=np.int64))
                low.append(s.sum(dtype=np.uint64))
                high.append(kernel.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
            ends = np.cumsum([0, *(len(k) for k in keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array(np.array([len(s) for s in sets], dtype=np.int64)), pa.array(np.array(low, dtype=np.uint64).view(np.int64)), pa.array(np.array(high, dtype=np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))],
                names=["id", "n", "low", "high", "keys"],
            )

    return sign


def _set_writer(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _blocks(batches, width):
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array([s.tobytes() for s in sets], type=pa.binary())], names=["rep", "payload"])

    return write


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 20, rows_per_band: int = 4) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Shingles are runs of `width` words after lower-casing A-Z (a shorter text is one shingle; null, empty or blank
    text has none and is linked with nothing). Two documents are linked when 100 * intersection >= percent * union.
    component_id is the smallest id reachable; kept says that it is the row's own. Rows that repeat an id are one
    document; a null id is linked with nothing, has no component and is kept. With the defaults a pair of similarity
    0.8 shares a band with probability 1 - 3e-5."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    signed = scratch(texts.mapInArrow(_signer(width, bands, rows_per_band), f"id {kind}, n long, low long, high long, keys array<long>"))
    # equal sets are one class, combined before the shuffle
    classes = scratch(signed.where("n > 0 and id is not null").groupBy("low", "high", "n").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")))
    mates = shared_buckets(classes)
    wanted = scratch(mates.select("rep").distinct())
    some = mark_members(texts, "id", wanted, "wanted").where("wanted").join(wanted, F.col("id") == F.col("rep"), "left_semi")
    sets = scratch(some.mapInArrow(_set_writer(width), f"rep {kind}, payload binary"))
    comps = similar_components(mates, sets, percent)
    named = classes.join(comps, classes.rep == comps.id, "left").select("low", "high", "n", F.coalesce("comp", "rep").alias("component"))
    linked = signed.select("id", "n", "low", "high").join(named, ["low", "high", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return linked.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
