"""Expressions on sequences: distances, k-mers, alphabets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The amino-acid alphabet in code order; letters that share another's code; the code of all others.
ALPHABET = "ARNDCQEGHILKMFPSTWYV"
SHARED = {"O": 11, "U": 4}
UNKNOWN = 20


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def _places(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    return F.zip_with(F.slice(chars(a), 1, n), F.slice(chars(b), 1, n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))


def hamming_fraction(a: Column, b: Column) -> Column:
    """Share of mismatches over places where neither has a gap, up to the shorter length; 1 if there are none."""
    solid = F.filter(_places(a, b), lambda p: (p.x != "-") & (p.y != "-"))
    return F.when(F.size(solid) == 0, 1.0).otherwise(F.size(F.filter(solid, lambda p: p.x != p.y)) / F.size(solid))


def aligned_identity(a: Column, b: Column) -> Column:
    """Share of equal places of two aligned rows, without those where both have a gap."""
    some = F.filter(_places(a, b), lambda p: (p.x != "-") | (p.y != "-"))
    return F.try_divide(F.size(F.filter(some, lambda p: p.x == p.y)), F.size(some))


def alphabet_codes(s: Column) -> Column:
    """Code of each letter; letters out of the alphabet share one code."""
    codes = {c: i for i, c in enumerate(ALPHABET)} | SHARED
    table = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    return F.transform(chars(F.upper(s)), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(UNKNOWN)))


def one_hot(codes: Column, size: int = UNKNOWN + 1) -> Column:
    """A row of 0 and 1 for each code."""
    return F.transform(codes, lambda c: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(c == i, 1).otherwise(0)))


def kmers(s: Column, low: int, high: int) -> Column:
    """All runs of low to high characters, lower-cased, with runs of white space as one blank."""
    s = F.regexp_replace(F.lower(s), r"\s+", " ")
    each = [F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
    return F.concat(*each)


def ungapped(s: Column) -> Column:
    return F.replace(s, F.lit("-"), F.lit(""))


def selected_columns(aligned: Column, positions: Column) -> Column:
    """The letters of an aligned row at 0-based positions, as a string."""
    return F.array_join(F.transform(positions, lambda p: F.substring(aligned, p + 1, F.lit(1))), "")
