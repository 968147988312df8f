"""Seeded randomness that is the same in every engine: md5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(seed: int | Column, *keys: str | Column) -> Column:
    """A hexadecimal string by which rows are in random order."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws(":", seed.cast("string"), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) by seed and keys."""
    return F.conv(F.substring(shuffle_key(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
