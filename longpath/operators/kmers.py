"""Tiles, spaced-seed codes of all their frames, and k-mer statistics.

A read of n bases has n div tile tiles; a tile's window reaches span - 1 bases into the next. Frame f of a window of L bases starts at
its base f, for f < L - span + 1; pattern i is i bases longer, so at the last i frames it has no new place and keeps
its last value. A code is the selected bases at two bits each (A, C, G, T = 0..3, the first highest), the smaller of both
strands.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longpath.functions.seeds import care_positions
from longpath.plans.config import PathConfig


def _base_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for i, c in enumerate("ACGT"):
        table[ord(c)] = table[ord(c.lower())] = i
    return table


BASE = _base_table()


@lru_cache(maxsize=64)
def _window_tables(pattern: str) -> list[np.ndarray]:
    """For each eight bases of a pattern, what they add to its code (the lower half) and to that of the other strand (the upper), by the sixteen bits of the bases."""
    care, bases = care_positions(pattern), np.arange(1 << 16, dtype=np.uint64)
    half, out = np.uint64(32 if len(care) <= 16 else 0), []
    for begin in range(0, len(pattern), 8):
        table = np.zeros(1 << 16, np.uint64)
        for r, p in enumerate(care):
            if begin <= p < begin + 8:
                b = bases >> np.uint64(2 * (7 - p + begin)) & np.uint64(3)
                table |= b << np.uint64(2 * (len(care) - 1 - r)) | (np.uint64(3) - b) << (half + np.uint64(2 * r))
        out.append(table)
    return out


def pattern_strands(bases: np.ndarray, patterns: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of each pattern, of up to 16 selected bases, at all positions of a sequence of base numbers, and those of the other strand."""
    padded = np.zeros(len(bases) + max(map(len, patterns), default=0) + 16, np.uint8)
    padded[: len(bases)] = bases
    two = padded[:-1] << 2 | padded[1:]
    four = two[:-2] << 4 | two[2:]
    eight = four[:-4].astype(np.intp) << 8 | four[4:]
    for pattern in patterns:
        n = max(len(bases) - len(pattern) + 1, 0)
        tables = _window_tables(pattern)
        both = tables[0].take(eight[:n])
        for k, table in enumerate(tables[1:], 1):
            both |= table.take(eight[8 * k : 8 * k + n])
        halves = both.view(np.uint32)
        yield halves[::2], halves[1::2]


def _long_strands(bases: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """As pattern_strands() for a pattern of more than 16 selected bases."""
    care = care_positions(pattern)
    n = max(len(bases) - len(pattern) + 1, 0)
    forward, reverse = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r, p in enumerate(care):
        b = bases[p : p + n].astype(np.int64)
        forward |= b << (2 * (len(care) - 1 - r))
        reverse |= (3 - b) << (2 * r)
    return forward, reverse


def both_strands(bases: np.ndarray, patterns: list[str]) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """Codes of each pattern at all positions of a sequence of base numbers, and those of the other strand."""
    return [_long_strands(bases, p) for p in patterns] if any(p.count("1") > 16 for p in patterns) else pattern_strands(bases, patterns)


def pattern_codes(bases: np.ndarray, patterns: list[str]) -> list[np.ndarray]:
    """Canonical codes of each pattern at all positions of a sequence of base numbers, by tables of eight bases."""
    return [np.minimum(forward, reverse).astype(np.int64) for forward, reverse in both_strands(bases, patterns)]


def position_codes(bases: np.ndarray, pattern: str) -> np.ndarray:
    """Canonical codes at all positions of a sequence of base numbers."""
    return pattern_codes(bases, [pattern])[0]


def frame_places(size: np.ndarray, config: PathConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences of so many bases that lie behind one another: the frames of each, where each frame begins, and the last frame of its tile."""
    tile, span = config.tile, config.span
    offset = np.cumsum(size) - size
    frames = np.maximum(np.minimum(size // tile * tile, size - span + 1), 0)
    tiles = -(-frames // tile)
    of = np.repeat(np.arange(len(size)), tiles)
    begin = (np.arange(len(of)) - np.repeat(np.cumsum(tiles) - tiles, tiles)) * tile
    last = np.repeat(offset[of] + np.minimum(size[of] - span, begin + tile - 1), np.minimum(tile, frames[of] - begin))
    return frames, np.arange(len(last)) + np.repeat(offset - np.cumsum(frames) + frames, frames), last


def frames_of(letters: np.ndarray, size: np.ndarray, config: PathConfig, patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A matrix frames x patterns of the codes of all tiles of sequences of so many letters (as bytes) that lie behind one another, and the number of frames of each."""
    frames, place, last = frame_places(size, config)
    out = np.empty((len(place), len(patterns)), np.int64)
    if len(place):
        for i, (codes, p) in enumerate(zip(pattern_codes(BASE[letters], patterns), patterns, strict=True)):
            more = len(p) - config.span
            out[:, i] = codes[np.minimum(place, last - more) if more else place]
    return out, frames


def frame_codes(seq: bytes, config: PathConfig, patterns: list[str]) -> np.ndarray:
    """A matrix frames x patterns of the codes of all tiles; frame f begins at base f, as tiles stand side by side."""
    return frames_of(np.frombuffer(seq, np.uint8), np.array([len(seq)]), config, patterns)[0]


def letters_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings as they lie behind one another, and the size of each (0 of null)."""
    column = column.cast(pa.binary()).fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8))[bounds[0] : bounds[-1]], np.diff(bounds)


def batches_of(column: pa.Array, letters: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """From which row to which (not included) about so many letters lie, at least a row each."""
    size = letters_of(column)[1]
    part = (np.cumsum(size) - size) // letters
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield a, b


def tile_codes(seq: bytes, config: PathConfig, patterns: list[str]) -> list[np.ndarray]:
    """For each tile a matrix frames x patterns of codes."""
    codes = frame_codes(seq, config, patterns)
    return [codes[t * config.tile : (t + 1) * config.tile] for t in range(len(seq) // config.tile)]


def tiles(reads: DataFrame, config: PathConfig) -> DataFrame:
    """read_ix, tile_ix and window of every tile of reads of plain letters (cut as bytes, which needs no walk along the read)."""
    n = F.floor(F.length("seq") / config.tile).cast("int")
    rows = reads.where(n > 0).select("read_ix", F.upper("seq").cast("binary").alias("seq"), F.explode(F.sequence(F.lit(0), n - 1)).alias("tile_ix"))
    return rows.select("read_ix", "tile_ix", F.substr("seq", F.col("tile_ix") * config.tile + 1, F.lit(config.tile + config.span - 1)).cast("string").alias("window"))


def frames(reads: DataFrame, config: PathConfig) -> DataFrame:
    """read_ix, tile_ix, frame_ix, seed_ix and code of every frame. Millions of rows a read set: for joins, not for output."""
    patterns = config.seeds

    def run(batches):
        for batch in batches:
            for read_ix, seq in zip(batch.column("read_ix").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                per_tile = tile_codes((seq or "").encode(), config, patterns)
                if not per_tile:
                    continue
                size = np.array([len(m) for m in per_tile])
                codes = np.concatenate(per_tile)
                h = codes.shape[1]
                tile_ix, frame_ix = np.repeat(np.arange(len(size)), size), np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
                columns = [np.full(codes.size, read_ix, np.int64), np.repeat(tile_ix, h).astype(np.int32), np.repeat(frame_ix, h).astype(np.int32), np.tile(np.arange(h, dtype=np.int32), len(codes)), codes.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["read_ix", "tile_ix", "frame_ix", "seed_ix", "code"])

    return even(reads.select("read_ix", "seq")).mapInArrow(run, "read_ix bigint, tile_ix int, frame_ix int, seed_ix int, code bigint")


def tile_summaries(reads: DataFrame, config: PathConfig) -> DataFrame:
    """read_ix, tile_ix, seed_ix, frames, and number, sum, least and most of the tile's codes; a tile is hashed in one place, so nothing is exchanged."""
    patterns = config.seeds

    def run(batches):
        for batch in batches:
            for read_ix, seq in zip(batch.column("read_ix").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                rows = []
                for t, m in enumerate(tile_codes((seq or "").encode(), config, patterns)):
                    if len(m):
                        m = np.sort(m, axis=0)
                        rows.append((np.full(m.shape[1], t), np.arange(m.shape[1]), np.full(m.shape[1], len(m)), 1 + (m[1:] != m[:-1]).sum(0), m.sum(0), m[0], m[-1]))
                if rows:
                    tile_ix, seed_ix, *rest = (np.concatenate(c) for c in zip(*rows, strict=True))
                    columns = [np.full(len(tile_ix), read_ix, np.int64), tile_ix.astype(np.int32), seed_ix.astype(np.int32), *(c.astype(np.int64) for c in rest)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["read_ix", "tile_ix", "seed_ix", "frames", "codes", "code_sum", "least", "most"])

    return even(reads.select("read_ix", "seq")).mapInArrow(run, "read_ix bigint, tile_ix int, seed_ix int, frames bigint, codes bigint, code_sum bigint, least bigint, most bigint")


def kmers(reads: DataFrame, config: PathConfig) -> DataFrame:
    """seed_ix and code at every position of every read, for statistics."""
    patterns = config.seeds

    def run(batches):
        for batch in batches:
            for seq in batch.column("seq").to_pylist():
                bases = BASE[np.frombuffer((seq or "").encode(), np.uint8)]
                for i, p in enumerate(patterns):
                    codes = position_codes(bases, p)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), i, np.int32)), pa.array(codes)], names=["seed_ix", "code"])

    return even(reads.select("seq")).mapInArrow(run, "seed_ix int, code bigint")


def even(df: DataFrame) -> DataFrame:
    """Dealt over all cores when there are fewer partitions than cores: hashing a read takes far longer than moving it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def code_counts(reads: DataFrame, config: PathConfig) -> DataFrame:
    """seed_ix, code and n: how often each code occurs."""
    return kmers(reads, config).groupBy("seed_ix", "code").agg(F.count("*").alias("n"))


def spectrum(reads: DataFrame, config: PathConfig, most: int = 10_000) -> DataFrame:
    """seed_ix, multiplicity (up to most) and the number of codes that occur so often."""
    return code_counts(reads, config).where(F.col("n") <= most).groupBy("seed_ix", F.col("n").cast("int").alias("multiplicity")).agg(F.count("*").alias("codes"))


def distinct_counts(reads: DataFrame, config: PathConfig) -> DataFrame:
    """seed_ix, total and f0 (exact number of distinct codes); expected_entries is the sum of f0."""
    per = code_counts(reads, config).groupBy("seed_ix").agg(F.sum("n").alias("total"), F.count("*").alias("f0"))
    from pyspark.sql import Window

    return per.withColumn("expected_entries", F.sum("f0").over(Window.partitionBy(F.lit(0))))  # a row a pattern


def distinct_counts_approx(reads: DataFrame, config: PathConfig, error: float = 0.02) -> DataFrame:
    """seed_ix, total and f0 by HyperLogLog: a bounded sketch a task instead of a shuffle of codes."""
    return kmers(reads, config).groupBy("seed_ix").agg(F.count("*").alias("total"), F.approx_count_distinct("code", error).alias("f0"))


def slots(reads: DataFrame, config: PathConfig, size: int) -> DataFrame:
    """slot and rank (number of smaller used slots) of the bit vector that all codes fill.

    Ranks are counted within ranges of slots and shifted by the ranges before, so no task sorts them all.
    """
    width = max(1, size // 4096)
    used = kmers(reads, config).select(F.pmod("code", F.lit(size)).alias("slot")).distinct().withColumn("part", F.floor(F.col("slot") / width))
    from pyspark.sql import Window

    sums = used.groupBy("part").agg(F.count("*").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # at most 4,097 rows
    rank = F.row_number().over(Window.partitionBy("part").orderBy("slot")) - 1
    return used.withColumn("in_part", rank).join(F.broadcast(before), "part").select("slot", (F.col("in_part") + F.col("before")).alias("rank"))
