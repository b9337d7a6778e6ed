"""Sizing and error rates of a Bloom filter over k-mers, as plain numbers and as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def filter_size(entries: float, occupancy: float, hashes: int = 1) -> int:
    """Bits for entries at an occupancy, padded to the next multiple of 64; a multiple itself gets 64 more."""
    bits = int(-entries * hashes / math.log(1 - occupancy))
    return bits + 64 - bits % 64


def hash_universe(weight: int, genome_size: int, patterns: int, given: int = 0, counted: int | None = None) -> int:
    """Expected number of entries: as given, as counted, or half of the possible codes of all patterns."""
    if given:
        return given
    if counted is not None:
        return counted
    return int(min(4**weight, 2 * genome_size) * 0.5 * patterns)


def filter_size_column(entries: Column, occupancy: float, hashes: int = 1) -> Column:
    bits = F.floor(F.round(-entries * hashes / F.log(F.lit(1.0 - occupancy)), 6)).cast("long")
    return bits + 64 - bits % 64


def false_positive_rate(occupancy: Column, hashes: Column) -> Column:
    return F.pow(occupancy, hashes)


def optimal_hashes(bits: Column, entries: Column) -> Column:
    return F.log(F.lit(2.0)) * bits / entries


def frame_match_probability(occupancy: Column, share: Column, hashes: Column) -> Column:
    """Probability that a random frame has all hashes set and at least one of an id's share of the slots."""
    return F.pow(occupancy, hashes) * (1 - F.pow(1 - share, hashes))


def slot(code: Column, size: int) -> Column:
    return F.pmod(code, F.lit(size))
