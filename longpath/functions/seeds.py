"""Spaced-seed patterns: symmetric masks with a growing gap in the middle."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession


def seed_patterns(preset: str, span: int, weight: int, count: int, seed: int = 123) -> list[str]:
    """count patterns of equal weight; the i-th has i zeros between its halves.

    Without a preset the left half is drawn: its first position is a one, the others are drawn until weight / 2 ones
    stand. The generator is Python's own, so drawn patterns are the same on every machine.
    """
    if preset:
        left, right = preset[: span // 2], preset[span // 2 :]
    else:
        rng, half, ones = random.Random(seed), span // 2, weight // 2
        if not 1 <= ones <= half:
            raise ValueError("the weight has to be between 2 and the span")
        left = ""
        while left.count("1") != ones:
            left = "1" + "".join(rng.choice("01") for _ in range(half - 1))
        right = left[::-1]
    return [left + "0" * i + right for i in range(count)]


def care_positions(pattern: str) -> list[int]:
    return [i for i, c in enumerate(pattern) if c == "1"]


def skip_positions(pattern: str) -> list[int]:
    return [i for i, c in enumerate(pattern) if c == "0"]


def seed_table(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """seed_ix, pattern, span, weight and the masked positions."""
    rows = [(i, p, len(p), p.count("1"), ",".join(map(str, skip_positions(p)))) for i, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "seed_ix int, pattern string, span int, weight int, skipped string")
