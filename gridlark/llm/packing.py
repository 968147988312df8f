"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are dealt at random into shards of bounded size, and each shard is packed by itself: longest pieces first,
each into the open bin that it leaves fullest. If none has room, the bin of least cost is opened: the permitted length
with the least expected padding and attention a token used, given the pieces still to come and the room already open. At
the end every bin is downsized to the smallest permitted length that holds its contents."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import scratch

#: Permitted sequence lengths in tokens.
LENGTHS = (512, 1024, 2048, 4096)
#: Share of a token's cost that attention takes in the longest sequence; it falls with the length.
ATTENTION = 0.1
#: Pieces that one task packs at once, about.
SHARD = 50_000


def bin_cost(length: int, used: int, top: int) -> float:
    """Padding of a bin, and its attention: in proportion to the length squared, ATTENTION a token in the longest."""
    return length - used + ATTENTION * length * length / top


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the length of each bin. No piece may be over the largest length.

    A new bin for a piece of size s: each length L >= s is a candidate, with its cost a token used. It is taken to be
    filled by pieces still to come of at most L - s, as far as they have more tokens than the room already open. Ties
    take the shorter. Bins are kept sorted by room, so the fullest that fits is found by bisection."""
    lengths = tuple(sorted(lengths))
    top = lengths[-1]
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    after = [0] * (len(sizes) + 1)  # tokens of the pieces from a place in the order on
    for at in range(len(order) - 1, -1, -1):
        after[at] = after[at + 1] + sizes[order[at]]
    falling = [-sizes[k] for k in order]  # for bisection by size
    bins, offsets, used, open_room = [0] * len(sizes), [0] * len(sizes), [], 0
    room: list[tuple[int, int]] = []
    for at, k in enumerate(order):
        s = sizes[k]
        spot = bisect_left(room, (s, -1))
        if spot < len(room):
            left, b = room.pop(spot)
            open_room -= left
        else:
            best = None
            for length in lengths:
                if length >= s:
                    small = after[max(bisect_left(falling, s - length), at + 1)]  # tokens of pieces that fit into the rest
                    fill = min(length - s, max(small - open_room, 0))
                    cost = bin_cost(length, s + fill, top) / max(s + fill, 1)
                    best = min(best or (cost, length), (cost, length))
            b, left = len(used), best[1]
            used.append(0)
        bins[k], offsets[k] = b, used[b]
        used[b] += s
        if left - s:
            insort(room, (left - s, b))
            open_room += left - s
    final = [next(x for x in lengths if x >= u) for u in used]
    return bins, offsets, final


def _packer(lengths: tuple[int, ...]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("id", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        bins, offsets, final = best_fit(table.column("size").to_pylist(), lengths)
        return pa.table({"row": table.column("row"), "id": table.column("id"), "piece": table.column("piece"), "start": table.column("start"), "size": table.column("size"), "shard": table.column("shard"), "bin": pa.array(bins, pa.int64()), "offset": pa.array(offsets, pa.int64()), "capacity": pa.array([final[b] for b in bins], pa.int64())})

    return run


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, null as empty."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, tokens: Column | None = None, shard_pieces: int = SHARD) -> DataFrame:
    """One row per piece of a document: id, piece, start, n_tokens, bin_id, bin_offset, bin_capacity.

    `tokens` counts a text's tokens (words by default, with one end token). Texts over the largest length are cut
    into pieces of that length and a rest, so nothing is dropped; null and empty texts are one end token. Only ids and
    sizes are shuffled. Shards have about `shard_pieces` pieces whatever the input, so a task's memory is bounded.
    Repeated rows and null ids are packed like others; an empty table gives an empty result."""
    kind = docs.schema[id_col].dataType.simpleString()
    count = (word_count(F.col(text_col)) + 1 if tokens is None else tokens).cast("long")
    sized = scratch(docs.select(F.col(id_col).alias("id"), F.greatest(count, F.lit(1)).alias("n")).withColumn("row", F.monotonically_increasing_id()))
    top = max(lengths)
    pieces = sized.select("row", "id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / top).cast("long"))).alias("piece"))
    pieces = pieces.select("row", "id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece") * top).cast("long").alias("size"))
    n_shards = 1 + (pieces.count() // shard_pieces)
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(n_shards)))
    out = f"row long, id {kind}, piece long, start long, size long, shard long, bin long, offset long, capacity long"
    packed = pieces.groupBy("shard").applyInArrow(_packer(tuple(sorted(lengths))), out)
    return packed.select(F.col("id").alias(id_col), "piece", "start", F.col("size").alias("n_tokens"), F.concat_ws("-", "shard", "bin").alias("bin_id"), F.col("offset").alias("bin_offset"), F.col("capacity").alias("bin_capacity"))
