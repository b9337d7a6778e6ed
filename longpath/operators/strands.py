"""An index that knows strands: each id carries the strand on which its block has the k-mer.

A code is the smaller of both strands; its strand is 1 if that is the reverse complement (0 for a palindrome). A value is 2 * block + strand. Of a frame's keys at most ``per_frame``
are inserted, those whose hash with the value is least (of equals the first pattern): an order as good as random, and the same wherever it is taken. Of all values
written to a key the one of least hash stays, as in ``reduce``, whose merges, lookups and bounds hold here as well.

A read that is looked up agrees with a value if both have the code on the same strand; a read from the other strand of the same place has it on the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longpath.functions.arrays import ordered
from longpath.operators.index import running
from longpath.operators.kmers import BASE, batches_of, both_strands, frame_places, letters_of
from longpath.operators.probe import STEP, _bucket
from longpath.operators.reduce import WRITTEN, _answered, _asked, found_ids, ids_taken, keys_and_ids, least_writers, merged_index, weight, written_rows
from longpath.plans.config import PathConfig
from longpath.sources.files import drop_stored, stored


def stranded_frames(letters: np.ndarray, size: np.ndarray, config: PathConfig, patterns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and strands (frames x patterns) of all frames of sequences of so many letters that lie behind one another, each frame's tile, and the frames of each sequence; a pattern's last place stands for the places it lacks."""
    frames, place, last = frame_places(size, config)
    keys, strands, h, bases = np.empty((len(place), len(patterns)), np.int64), np.empty((len(place), len(patterns)), bool), len(patterns), BASE[letters]
    if len(place):
        for i, ((forward, reverse), p) in enumerate(zip(both_strands(bases, patterns), patterns, strict=True)):
            at = np.minimum(place, last - (len(p) - config.span))
            a, b = forward[at], reverse[at]
            keys[:, i], strands[:, i] = np.minimum(a, b).astype(np.int64) * h + i, b < a
    return keys, strands, (np.arange(len(place)) - np.repeat(np.cumsum(frames) - frames, frames)) // config.tile, frames


def stranded_keys(seq: str | None, config: PathConfig, patterns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of one read."""
    letters = np.frombuffer((seq or "").encode(), np.uint8)
    return stranded_frames(letters, np.array([len(letters)]), config, patterns)[:3]


def numbered(reads: DataFrame, config: PathConfig) -> DataFrame:
    """before (ids taken by reads of smaller read_ix) and seq of reads (read_ix, seq)."""
    before = running(reads.select("read_ix", ids_taken(config).alias("ids"))).select("read_ix", "before")
    return reads.select("read_ix", "seq").join(before, "read_ix").select("before", "seq")


def insert(reads: DataFrame, config: PathConfig, buckets: int, per_frame: int) -> DataFrame:
    """The index (slot, keys, ids: values) of reads (read_ix, seq), inserted whole in the order of read_ix."""
    return merged_index(_written(numbered(reads, config), config, buckets, per_frame))


def slices(reads: DataFrame, config: PathConfig, buckets: int, per_frame: int, rounds: int) -> Iterator[DataFrame]:
    """The index of insert() in so many slices, which have no slot in common; each hashes the reads anew and exchanges its own keys only."""
    rows = stored(numbered(reads, config), "numbered")
    for turn in range(rounds):
        yield merged_index(_written(rows, config, buckets, per_frame, turn, rounds))
    drop_stored(rows)


def _written(reads: DataFrame, config: PathConfig, buckets: int, per_frame: int, turn: int = 0, rounds: int = 1) -> DataFrame:
    """WRITTEN rows of what reads (before, seq) write; of several rounds a turn has the slots of its own."""
    patterns, h = config.seeds, config.patterns

    def packed(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        yield written_rows(*least_writers(*(np.concatenate(c) for c in zip(*parts, strict=True))))

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for first, end in batches_of(batch.column("seq")):
                every, strand, tile, frames = stranded_frames(*letters_of(batch.column("seq").slice(first, end - first)), config, patterns)
                block = np.repeat(batch.column("before").slice(first, end - first).to_numpy(zero_copy_only=False).astype(np.int64), frames) + 1 + tile // config.block
                for i in range(0, len(every), STEP // h):
                    keys = every[i : i + STEP // h]
                    values = 2 * block[i : i + STEP // h][:, None] + strand[i : i + STEP // h]
                    if per_frame < h:
                        chosen = np.argsort(weight(keys, values), axis=1, kind="stable")[:, :per_frame]
                        keys, values = (np.take_along_axis(x, chosen, 1) for x in (keys, values))
                    keys, values = keys.ravel(), values.ravel()
                    slot = _bucket(keys, buckets)
                    on = slice(None) if rounds == 1 else np.flatnonzero(slot % rounds == turn)
                    parts.append(least_writers(slot[on], keys[on], values[on]))
                    held += len(parts[-1][0])
                    if held >= STEP:
                        yield from packed(parts)
                        parts, held = [], 0
        if parts:
            yield from packed(parts)

    return reads.mapInArrow(run, WRITTEN)


def lookups(reads: DataFrame, index: DataFrame, config: PathConfig, buckets: int) -> DataFrame:
    """read_ix, frames, and hits on the same and on the other strand of reads (unit, read_ix, seq)."""
    return counted(reads, _answered(_asked(reads.withColumn("space", F.lit(0).cast("long")), config, buckets), index), config)


def counted(reads: DataFrame, answers: DataFrame, config: PathConfig) -> DataFrame:
    """lookups(), from the answers (``reduce.ANSWERS``) to the reads' units."""
    patterns = config.seeds

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        have, values = keys_and_ids(right)
        order = ordered(have)
        have, values = have[order], values[order]
        keys, strand, _, frames = stranded_frames(*letters_of(left.column("seq").combine_chunks()), config, patterns)
        told = found_ids(keys, have, values)  # no value is 0
        hit = told != 0
        same = (hit & ((told & 1) == strand)).sum(1)
        sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], np.cumsum(frames)))]) for x in (same, hit.sum(1) - same)]
        return pa.table([left.column("read_ix").cast(pa.int64()), *map(pa.array, (frames, *sums))], names=["read_ix", "frames", "same", "other"])

    return reads.select("unit", "read_ix", "seq").groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(count, "read_ix bigint, frames bigint, same bigint, other bigint")
