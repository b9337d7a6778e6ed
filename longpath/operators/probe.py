"""The index of all reads and its probe, packed: arrays of codes cross the network, and numpy kernels do the rest.

A key is code * patterns + pattern. Keys are dealt to buckets by hash, so many that a bucket holds about ``bucket_rows`` frames.

1. A kernel over reads reduces each batch to (key, least block, number of blocks, frames) per bucket; one exchange by bucket, and the
   index row of a bucket holds its sorted keys, the least block (first writer) and the number of writers of each.
2. A kernel over reads sends each read's keys to their buckets, with their places. Buckets of more than ``bucket_rows``
   frames (a code that many reads share) are split by read, with their index rows copied to each part. There ids are looked up.
3. One exchange back by read; what is counted along tiles is counted in numpy.

A place is (tile * tile size + frame) * patterns + pattern. Numbers travel as bytes (binary columns of 8-byte integers, places of 4), which
are copied as a whole, where elements of array columns would be copied one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longpath.operators.index import running
from longpath.operators.kmers import even, frame_codes
from longpath.plans.config import PathConfig

INDEX = "bucket int, keys binary, ids binary, writers binary, frames bigint"
STEP = 1 << 21  # frames handled at once
MOST_BUCKETS = 1 << 16  # bounds what is exchanged a read and what is broadcast (a row a bucket); beyond, buckets grow instead


@dataclass(frozen=True)
class Extent:
    """Least and greatest read_ix, and the number of buckets for all frames of the reads."""

    low: int
    high: int
    buckets: int
    bucket_rows: int


def extent(reads: DataFrame, config: PathConfig, bucket_rows: int = 2_000_000) -> Extent:
    low, high, bases = reads.agg(F.min("read_ix"), F.max("read_ix"), F.sum(F.length("seq").cast("long"))).first()
    buckets = min(MOST_BUCKETS, max(reads.sparkSession.sparkContext.defaultParallelism, -(-(bases or 0) * config.patterns // bucket_rows)))
    return Extent(low or 0, high or 0, buckets, bucket_rows)


def based(reads: DataFrame, config: PathConfig, size: Extent) -> DataFrame:
    """read_ix, seq and before: the number of ids that reads of smaller read_ix take when all are inserted whole, in order."""
    ids = (F.floor(F.length("seq") / (config.tile * config.block)) + 1).cast("long")
    numbers = running(reads.select("read_ix", ids.alias("ids")), (size.low, size.high)).select("read_ix", "before")
    return reads.select("read_ix", "seq").join(numbers, "read_ix")


def _keys(seq: str | None, config: PathConfig, patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all frames of a read, and their places."""
    codes, h = frame_codes((seq or "").encode(), config, patterns), len(patterns)
    return (codes * h + np.arange(h)).ravel(), np.arange(codes.size)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that gathers keys by bucket, the buckets, and where each begins."""
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket.astype(np.int16) if buckets < 1 << 15 else bucket, kind="stable")
    cut = _cuts(bucket[order])
    return order, bucket[order][cut[:-1]], cut


def _once_a_block(keys: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (block, key) and how often each stands; block does not descend."""
    if not len(keys):
        return (np.empty(0, np.int64),) * 3
    bits = int(keys.max()).bit_length()
    if bits + int(block[-1] - block[0]).bit_length() < 63:
        both = np.sort((block - block[0]) << bits | keys)
        keys, block = both & ((1 << bits) - 1), (both >> bits) + block[0]
    else:
        order = np.lexsort((keys, block))
        keys, block = keys[order], block[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(new)
    return keys[at], block[at], np.diff(np.append(at, len(keys)))


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of values between each two bounds."""
    values = np.ascontiguousarray(values)
    if values.nbytes >= 1 << 31:
        raise OverflowError("more than 2 GB of frames in one batch")
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _flat(column: pa.ChunkedArray | pa.Array, kind: type = np.int64) -> np.ndarray:
    """All values of a packed column."""
    parts = []
    for a in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(a):
            offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
            if offsets[-1] > offsets[0]:
                parts.append(np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind))
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _cuts(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)])) if len(sorted_values) else np.zeros(1, np.int64)


def _merged(keys: np.ndarray, ids: np.ndarray, writers: np.ndarray, frames: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with least id, and sums of writers and frames."""
    order = np.argsort(keys)  # of equal keys any order gives the same
    keys = keys[order]
    at = _cuts(keys)[:-1]
    if not len(at):
        return (np.empty(0, np.int64),) * 4
    return keys[at], np.minimum.reduceat(ids[order], at), np.add.reduceat(writers[order], at), np.add.reduceat(frames[order], at)


def occurrences(reads: DataFrame, config: PathConfig, size: Extent, reduce: bool = True, step: int = STEP) -> DataFrame:
    """bucket, keys, ids (blocks), writers and frames: what about step frames of reads (read_ix, seq, before) write, key by key, or block by block."""
    patterns = config.seeds

    def packed(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns = tuple(np.concatenate(c) for c in zip(*parts, strict=True))
        columns = _merged(*columns) if reduce else columns
        order, bucket, cut = _by_bucket(columns[0], size.buckets)
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *[_packed(c[order], cut) for c in columns]], names=["bucket", "keys", "ids", "writers", "frames"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for seq, before in zip(batch.column("seq"), batch.column("before").to_pylist(), strict=True):
                keys, places = _keys(seq.as_py(), config, patterns)
                keys, block, frames = _once_a_block(keys, before + 1 + places // (len(patterns) * config.tile * config.block))
                for i in range(0, len(keys), step):  # a very long read in pieces
                    piece = slice(i, i + step)
                    parts.append((keys[piece], block[piece], np.ones(len(keys[piece]), np.int64), frames[piece]))
                    held += len(keys[piece])
                    if held >= step:
                        yield from packed(parts)
                        parts, held = [], 0
        if parts:
            yield from packed(parts)

    return even(reads).mapInArrow(run, "bucket int, keys binary, ids binary, writers binary, frames binary")


def first_writers(written: DataFrame) -> DataFrame:
    """The index row of each bucket, from occurrences()."""

    def run(table: pa.Table) -> pa.Table:
        keys, ids, writers, frames = _merged(*(_flat(table.column(c)) for c in ("keys", "ids", "writers", "frames")))
        cut = np.array([0, len(keys)])
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "keys": _packed(keys, cut), "ids": _packed(ids, cut), "writers": _packed(writers, cut), "frames": [int(frames.sum())]})

    return written.groupBy("bucket").applyInArrow(run, INDEX)


def solid(index: DataFrame, least: int = 2) -> DataFrame:
    """Index rows with only the codes that at least so many blocks wrote."""

    def run(batches):
        for batch in batches:
            for bucket, k, i, w, frames in zip(*(batch.column(c) for c in ("bucket", "keys", "ids", "writers", "frames")), strict=True):
                keys, ids, writers = (np.frombuffer(x.as_py(), np.int64) for x in (k, i, w))
                kept = writers >= least
                cut = np.array([0, kept.sum()])
                yield pa.RecordBatch.from_arrays([pa.array([bucket.as_py()], pa.int32()), *(_packed(c[kept], cut) for c in (keys, ids, writers)), pa.array([frames.as_py()], pa.int64())], names=["bucket", "keys", "ids", "writers", "frames"])

    return index.mapInArrow(run, INDEX)


def entries(index: DataFrame, config: PathConfig) -> DataFrame:
    """seed_ix, code, id and n of index rows."""
    h = config.patterns

    def run(batches):
        for batch in batches:
            keys, ids, writers = (_flat(batch.column(c)) for c in ("keys", "ids", "writers"))
            for i in range(0, len(keys), 1 << 16):
                k = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array((k % h).astype(np.int32)), pa.array(k // h), pa.array(ids[i : i + (1 << 16)]), pa.array(writers[i : i + (1 << 16)])], names=["seed_ix", "code", "id", "n"])

    return index.select("keys", "ids", "writers").mapInArrow(run, "seed_ix int, code bigint, id bigint, n bigint")


def sent(reads: DataFrame, config: PathConfig, size: Extent) -> DataFrame:
    """bucket, read_ix, keys and places of each read's frames."""
    patterns = config.seeds

    def run(batches):
        for batch in batches:
            for read_ix, seq in zip(batch.column("read_ix").to_pylist(), batch.column("seq"), strict=True):
                every, at = _keys(seq.as_py(), config, patterns)
                for i in range(0, len(every), STEP):
                    keys, places = every[i : i + STEP], at[i : i + STEP].astype(np.int32)
                    order, bucket, cut = _by_bucket(keys, size.buckets)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(np.full(len(bucket), read_ix), pa.int64()), _packed(keys[order], cut), _packed(places[order], cut)], names=["bucket", "read_ix", "keys", "places"])

    return even(reads.select("read_ix", "seq")).mapInArrow(run, "bucket int, read_ix bigint, keys binary, places binary")


def answered(reads: DataFrame, index: DataFrame, config: PathConfig, size: Extent) -> DataFrame:
    """read_ix, places, ids (0 for none) and hits (ids that are not 0): the frames of reads, looked up in index rows (of the same number of buckets)."""
    bucket_rows = size.bucket_rows
    splits = index.select("bucket", F.greatest(F.lit(1), F.ceil(F.col("frames") / bucket_rows)).cast("int").alias("parts"))
    asked = sent(reads, config, size).join(F.broadcast(splits), "bucket", "left")  # a row a bucket
    asked = asked.select("bucket", F.pmod(F.xxhash64("read_ix"), F.coalesce("parts", F.lit(1)).cast("long")).cast("int").alias("part"), "read_ix", "keys", "places")
    parts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("frames") / bucket_rows)).cast("int") - 1)
    known = index.select("bucket", F.explode(parts).alias("part"), "keys", "ids")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, have, ids = (_flat(c) for c in (left.column("keys"), right.column("keys"), right.column("ids")))
        if len(have):
            at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            found = np.where(have[at] == keys, ids[at], 0)
        else:
            found = np.zeros(len(keys), np.int64)
        bounds = np.concatenate(([0], np.cumsum(pc.binary_length(left.column("keys")).to_numpy().astype(np.int64)))) // 8
        hits = np.concatenate(([0], np.cumsum(found != 0)))[bounds]
        return pa.table({"read_ix": left.column("read_ix"), "places": left.column("places"), "ids": _packed(found, bounds), "hits": pa.array(np.diff(hits), pa.int64())})

    return asked.groupBy("bucket", "part").cogroup(known.groupBy("bucket", "part")).applyInArrow(run, "read_ix bigint, places binary, ids binary, hits bigint")


def by_read(found: DataFrame, f: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], ddl: str) -> DataFrame:
    """read_ix and the columns that f makes of a read's places (sorted) and ids. found: of answered(), or ``units.Answers``."""
    if not isinstance(found, DataFrame):
        return found.by_read(f, ddl)

    def run(table: pa.Table) -> pa.Table:
        places, ids = _flat(table.column("places"), np.int32).astype(np.int64), _flat(table.column("ids"))
        order = np.argsort(places)
        columns = f(places[order], ids[order])
        n = len(next(iter(columns.values())))
        return pa.table({"read_ix": pa.array(np.full(n, table.column("read_ix")[0].as_py()), pa.int64()), **columns})

    return found.drop("hits").groupBy("read_ix").applyInArrow(run, f"read_ix bigint, {ddl}")


def tile_id_counts(found: DataFrame, config: PathConfig) -> DataFrame:
    """read_ix, tile_ix, id and n: frames that hit an id, once a frame."""
    h, tile = config.patterns, config.tile

    def f(places: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
        at = np.flatnonzero(ids)
        frame, ids = places[at] // h, ids[at]
        order = np.lexsort((frame, ids, frame // tile))
        frame, ids = frame[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = (frame[1:] != frame[:-1]) | (ids[1:] != ids[:-1])
        of, ids = frame[new] // tile, ids[new]
        start = np.ones(len(ids), bool)
        start[1:] = (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])
        cut = np.flatnonzero(start)
        return {"tile_ix": of[cut].astype(np.int32), "id": ids[cut], "n": np.diff(np.append(cut, len(ids)))}

    return by_read(found, f, "tile_ix int, id bigint, n bigint")


def tile_probe(found: DataFrame, config: PathConfig) -> DataFrame:
    """read_ix, tile_ix, seed_ix, frames, and number, least, most and sum of the (distinct) ids that frames hit."""
    h, tile = config.patterns, config.tile

    def f(places: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
        seed, of = places % h, places // h // tile
        order = np.lexsort((ids, seed, of))
        seed, of, ids = seed[order], of[order], ids[order]
        start = np.ones(len(ids), bool)
        start[1:] = (of[1:] != of[:-1]) | (seed[1:] != seed[:-1])
        new = start.copy()
        new[1:] |= ids[1:] != ids[:-1]
        cut = np.flatnonzero(start)
        size = np.diff(np.append(cut, len(ids)))
        return {"tile_ix": of[cut].astype(np.int32), "seed_ix": seed[cut].astype(np.int32), "frames": size, "ids": np.add.reduceat(new.astype(np.int64), cut), "least": ids[cut], "most": ids[cut + size - 1], "id_sum": np.add.reduceat(ids, cut)}

    return by_read(found, f, "tile_ix int, seed_ix int, frames bigint, ids bigint, least bigint, most bigint, id_sum bigint")


def frame_membership(found: DataFrame, config: PathConfig) -> DataFrame:
    """read_ix, tile_ix, frames, and how many of them have all patterns in the index."""
    h, tile = config.patterns, config.tile

    def f(places: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
        full = (ids.reshape(-1, h) != 0).all(1)
        of = places[::h] // h // tile
        cut = _cuts(of)
        return {"tile_ix": of[cut[:-1]].astype(np.int32), "frames": np.diff(cut), "full_frames": np.add.reduceat(full.astype(np.int64), cut[:-1])}

    return by_read(found, f, "tile_ix int, frames bigint, full_frames bigint")


def counters(found: DataFrame, config: PathConfig) -> DataFrame:
    """One row: queries (frames), hits and misses (slots); nothing goes back to its read."""
    slots, hits = F.sum(F.expr("length(ids) div 8")), F.sum("hits")
    return found.agg((slots / config.patterns).cast("long").alias("queries"), hits.alias("hits"), (slots - hits).alias("misses"))


def lookup(found: DataFrame, config: PathConfig, allowed_misses: int = 0) -> DataFrame:
    """read_ix, tile_ix, and how many frames have at most so many patterns without an id, with their number of different ids (once a frame)."""
    h, tile = config.patterns, config.tile

    def f(places: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
        per_frame = np.sort(ids.reshape(-1, h), axis=1)
        known = (per_frame != 0).sum(1) >= h - allowed_misses
        different = (per_frame[:, :1] != 0).sum(1) + ((per_frame[:, 1:] != per_frame[:, :-1]) & (per_frame[:, 1:] != 0)).sum(1)
        of = places[::h] // h // tile
        cut = _cuts(of)
        return {"tile_ix": of[cut[:-1]].astype(np.int32), "frames": np.add.reduceat(known.astype(np.int64), cut[:-1]), "ids": np.add.reduceat(np.where(known, different, 0), cut[:-1])}

    return by_read(found, f, "tile_ix int, frames bigint, ids bigint")
