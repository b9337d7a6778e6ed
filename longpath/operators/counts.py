"""Exact counts of codes and of the blocks that write them, over packed exchanges in slices.

A key is a pattern's number and a code, scattered by an odd factor (which can be undone), so equal ranges of keys hold about equal numbers. A range of 2 ** shift keys is a bucket.
Kernels over reads sort the keys of a batch, count equal ones, and send each bucket the gaps between them as bytes of seven bits: about two bytes a key instead of a row.
Buckets are dealt to ``rounds`` slices. A round hashes all reads anew, exchanges the keys of its slice, and stores what the buckets make of them; its shuffle files go when it is
written. So the disk holds one slice at a time, for more hashing, and every key is counted in exactly one round.

What is summed by id goes packed as well: each bucket sends ranges of ids the gaps between its ids, and a range adds them up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longpath.operators.kmers import BASE, even, pattern_codes
from longpath.operators.probe import _cuts, _keys, _packed
from longpath.plans.config import PathConfig
from longpath.sources.files import stored

ODD = 0x9E3779B97F4A7C15
STEP = 1 << 22  # keys of one batch
BLOCKS = 1 << 16  # a batch ends before its blocks span more, so that two bytes hold one
IDS, SLOTS = 1 << 16, 1 << 16  # ids and slots of one exchanged range
WRITTEN = "bucket int, size int, base bigint, width int, keys binary, ids binary, counts binary, frames binary"


@dataclass(frozen=True)
class Layout:
    """Bits of a code, bits of a bucket's keys, and the number of rounds (a power of two)."""

    bits: int
    shift: int
    rounds: int

    def keys(self, codes: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
        scattered = (codes.astype(np.uint64) * np.uint64(ODD)) & np.uint64((1 << self.bits) - 1)
        return scattered.astype(np.int64) | (np.int64(seed) if isinstance(seed, int) else seed) << self.bits

    def codes(self, keys: np.ndarray) -> np.ndarray:
        whole = 1 << self.bits
        return ((keys.astype(np.uint64) * np.uint64(pow(ODD, -1, whole))) & np.uint64(whole - 1)).astype(np.int64)

    def seed(self, bucket: int) -> int:
        return bucket >> (self.bits - self.shift)


def layout(reads: DataFrame, config: PathConfig, bucket_rows: int = 2_000_000, round_rows: int = 1 << 25, most_rounds: int = 8) -> Layout:
    """For all codes of reads (seq): buckets of about bucket_rows keys, and rounds of round_rows or, if that would take more than most_rounds, so many."""
    n = reads.agg(F.sum(F.length("seq").cast("long"))).first()[0] or 0
    power = lambda x: max(x - 1, 0).bit_length()
    rounds, bits = min(power(-(-n * config.patterns // round_rows)), power(most_rounds)), 2 * config.weight
    split = min(max(power(-(-n // bucket_rows)), rounds, 2), 14, bits)
    return Layout(bits, bits - split, 1 << min(rounds, split))


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values (not negative) as bytes of seven bits, the lowest first, with the eighth bit set on all but the last; and where each begins, and the end."""
    size, most, bits = np.ones(len(values), np.int64), int(values.max()) if len(values) else 0, 7
    while most >> bits:
        size += values >= 1 << bits
        bits += 7
    cut = np.concatenate(([0], np.cumsum(size)))
    out, at, rest, left = np.zeros(cut[-1], np.uint8), cut[:-1], values, size
    while len(at):
        out[at] = (rest & 127) | (left > 1) * 128
        more = left > 1
        at, rest, left = at[more] + 1, rest[more] >> 7, left[more] - 1
    return out, cut


def unvarints(data: np.ndarray) -> np.ndarray:
    end = np.flatnonzero(data < 128) + 1
    start = np.concatenate(([0], end[:-1])) if len(end) else end
    out, on, bits = (data[start] & 127).astype(np.int64), np.arange(len(start)), 7
    while len(on):
        on = on[start[on] + bits // 7 < end[on]]
        out[on] |= (data[start[on] + bits // 7] & 127).astype(np.int64) << bits
        bits += 7
    return out


def _bytes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), np.uint8) for x in column]
    return np.concatenate(parts) if parts else np.empty(0, np.uint8)


def gaps(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Ascending values between each two cuts as varints: the first, and the steps from each to the next."""
    step = np.diff(values, prepend=0)
    step[cut[:-1]] = values[cut[:-1]]
    data, at = varints(step)
    return _packed(data, at[cut])


def ungaps(column: pa.ChunkedArray | pa.Array, size: np.ndarray) -> np.ndarray:
    """The values of all rows of gaps(), which have so many each."""
    step = unvarints(_bytes(column))
    total, first = np.cumsum(step), np.cumsum(size) - size
    return total - np.repeat(total[first] - step[first], size) if len(size) else step


def _narrow(values: np.ndarray, cut: np.ndarray) -> tuple[pa.Array, int]:
    """values in as many bytes as the greatest takes, and that number."""
    width = max(2, (int(values.max()).bit_length() + 7) // 8 if len(values) else 0)
    data = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width])
    return _packed(data.ravel(), cut * width), width


def _wide(column: pa.ChunkedArray | pa.Array, width: np.ndarray, base: np.ndarray) -> np.ndarray:
    out = []
    for x, w, b in zip(column, width.tolist(), base.tolist(), strict=True):
        data = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, w)
        full = np.zeros((len(data), 8), np.uint8)
        full[:, :w] = data
        out.append(full.view("<i8").ravel() + b)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _row(bucket: np.ndarray, cut: np.ndarray, keys: np.ndarray, base: int, ids: np.ndarray | None, counts: np.ndarray | None, frames: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(bucket), pa.binary())
    packed, width = (none, 0) if ids is None else _narrow(ids, cut)
    many = lambda c: none if c is None else (lambda data, at: _packed(data, at[cut]))(*varints(c - 1))
    fixed = [pa.array(bucket.astype(np.int32)), pa.array(np.diff(cut).astype(np.int32)), pa.array(np.full(len(bucket), base)), pa.array(np.full(len(bucket), width, np.int32))]
    return pa.RecordBatch.from_arrays([*fixed, gaps(keys, cut), packed, many(counts), many(frames)], names=[c.split()[0] for c in WRITTEN.split(", ")])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    cut = _cuts(keys)
    return keys[cut[:-1]], np.diff(cut)


def occurrences(reads: DataFrame, config: PathConfig, form: Layout, turn: int) -> DataFrame:
    """WRITTEN rows of the codes at all positions of reads (seq) that this turn counts: keys, and counts of their places."""
    patterns = config.seeds

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for bases in joined(batch.column("seq")):
                for i, (codes, whole) in enumerate(codes_of(*bases, patterns)):
                    keys = form.keys(codes[whole], i)
                    held.append(keys[(keys >> form.shift) & (form.rounds - 1) == turn])
                    size += len(held[-1])
                if size >= STEP:
                    yield from flushed(held)
                    held, size = [], 0
        if size:
            yield from flushed(held)

    def flushed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, n = _counted(np.concatenate(held))
        cut = _cuts(keys >> form.shift)
        yield _row((keys >> form.shift)[cut[:-1]], cut, keys & ((1 << form.shift) - 1), 0, None, n, None)

    return even(reads.select("seq")).mapInArrow(run, WRITTEN)


def joined(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Base numbers of sequences behind one another, of about size together, and for each the end of its own sequence."""
    parts, held = [], 0
    for seq in column:
        if not seq.is_valid:
            continue
        bases = BASE[np.frombuffer(seq.as_buffer(), np.uint8)]
        parts.append(bases)
        held += len(bases)
        if held >= size:
            yield np.concatenate(parts), np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
            parts, held = [], 0
    if held:
        yield np.concatenate(parts), np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])


def read_codes(batches: Iterator[pa.RecordBatch], patterns: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """A pattern's number and its codes at all positions of some sequences, until all patterns and sequences had their turn."""
    for batch in batches:
        for bases in joined(batch.column("seq")):
            for i, (codes, whole) in enumerate(codes_of(*bases, patterns)):
                yield i, codes[whole]


def codes_of(bases: np.ndarray, end: np.ndarray, patterns: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of each pattern at all positions, and whether the pattern ends within the sequence that it begins in."""
    for codes, p in zip(pattern_codes(bases, patterns), patterns, strict=True):
        yield codes, np.arange(len(codes)) + len(p) <= end[: len(codes)]


def in_rounds(form: Layout, written: Callable[[int], DataFrame], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What make() makes of written() of all turns, stored turn by turn; the shuffle files of each go before the next."""
    parts = [stored(make(written(turn)), "counts") for turn in range(form.rounds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_bucket(form: Layout, f: Callable[[int, np.ndarray, np.ndarray], dict[str, np.ndarray]], ddl: str) -> Callable[[DataFrame], DataFrame]:
    """f(pattern, keys, counts) of each bucket: distinct keys, ascending, and how often they occur."""

    def run(table: pa.Table) -> pa.Table:
        keys = ungaps(table.column("keys"), table.column("size").to_numpy().astype(np.int64))
        counts = unvarints(_bytes(table.column("counts"))) + 1
        if table.num_rows > 1:
            order = np.argsort(keys)
            keys = keys[order]
            cut = _cuts(keys)[:-1]
            keys, counts = keys[cut], np.add.reduceat(counts[order], cut)
        bucket = table.column("bucket")[0].as_py()
        out = f(form.seed(bucket), keys | bucket << form.shift, counts)
        n = len(next(iter(out.values())))
        return pa.table({"seed_ix": pa.array(np.full(n, form.seed(bucket), np.int32)), **out})

    return lambda written: written.select("bucket", "size", "keys", "counts").groupBy("bucket").applyInArrow(run, f"seed_ix int, {ddl}")


def spectrum(reads: DataFrame, config: PathConfig, most: int = 10_000, form: Layout | None = None) -> DataFrame:
    """seed_ix, multiplicity (up to most) and the number of codes that occur so often."""
    form = form or layout(reads, config)

    def f(seed: int, keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        value, n = _counted(counts[counts <= most])
        return {"multiplicity": value.astype(np.int32), "codes": n}

    found = in_rounds(form, lambda turn: occurrences(reads, config, form, turn), by_bucket(form, f, "multiplicity int, codes bigint"))
    return found.groupBy("seed_ix", "multiplicity").agg(F.sum("codes").alias("codes"))


def distinct_counts(reads: DataFrame, config: PathConfig, form: Layout | None = None) -> DataFrame:
    """seed_ix, total and f0 (exact number of distinct codes); expected_entries is the sum of f0."""
    from pyspark.sql import Window

    form = form or layout(reads, config)

    def f(seed: int, keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        return {"total": np.array([counts.sum()]), "f0": np.array([len(keys)])}

    found = in_rounds(form, lambda turn: occurrences(reads, config, form, turn), by_bucket(form, f, "total bigint, f0 bigint"))
    per = found.groupBy("seed_ix").agg(F.sum("total").alias("total"), F.sum("f0").alias("f0"))
    return per.withColumn("expected_entries", F.sum("f0").over(Window.partitionBy(F.lit(0))))  # a row a pattern


def range_counts(reads: DataFrame, config: PathConfig, width: int, form: Layout | None = None) -> DataFrame:
    """seed_ix, code_range (of 2 ** width codes), and number, sum and occurrences of the distinct codes in it."""
    form = form or layout(reads, config)

    def f(seed: int, keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        codes = form.codes(keys)
        order = np.argsort(codes >> width, kind="stable")
        codes, counts = codes[order], counts[order]
        cut = _cuts(codes >> width)
        return {"code_range": (codes >> width)[cut[:-1]].astype(np.int32), "codes": np.diff(cut), "code_sum": np.add.reduceat(codes, cut[:-1]), "total": np.add.reduceat(counts, cut[:-1])}

    found = in_rounds(form, lambda turn: occurrences(reads, config, form, turn), lambda w: by_bucket(form, f, "code_range int, codes bigint, code_sum bigint, total bigint")(w).groupBy("seed_ix", "code_range").agg(*(F.sum(c).alias(c) for c in ("codes", "code_sum", "total"))))
    return found.groupBy("seed_ix", "code_range").agg(*(F.sum(c).alias(c) for c in ("codes", "code_sum", "total")))


def slot_sums(reads: DataFrame, config: PathConfig, size: int, width: int) -> DataFrame:
    """seed_ix, slot_range (of width slots), n and slot_sum of the slots (code modulo size) at all positions of reads (seq): a row a range and task is exchanged."""
    patterns = config.seeds

    def run(batches):
        ranges = -(-size // width)
        n, total = np.zeros((len(patterns), ranges), np.int64), np.zeros((len(patterns), ranges), np.int64)
        for i, codes in read_codes(batches, patterns):
            slot = np.sort(codes % size)
            cut = _cuts(slot // width)
            if len(slot):
                at = slot[cut[:-1]] // width
                n[i, at] += np.diff(cut)
                total[i, at] += np.add.reduceat(slot, cut[:-1])
        seed, at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seed.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(n[seed, at]), pa.array(total[seed, at])], names=["seed_ix", "slot_range", "n", "slot_sum"])

    rows = even(reads.select("seq")).mapInArrow(run, "seed_ix int, slot_range int, n bigint, slot_sum bigint")
    return rows.groupBy("seed_ix", "slot_range").agg(F.sum("n").alias("n"), F.sum("slot_sum").alias("slot_sum"))


def used_slots(reads: DataFrame, config: PathConfig, size: int, hold: int = 512) -> DataFrame:
    """range (of SLOTS slots) and bits (packed) of the slots (code modulo size) that any code of reads (seq) uses. A task hands its ranges on when it holds so many."""
    patterns = config.seeds

    def packed(pages: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int64()), pa.array([np.packbits(x).tobytes() for x in pages.values()], pa.binary())], names=["range", "bits"])

    def run(batches):
        pages: dict[int, np.ndarray] = {}
        for _, codes in read_codes(batches, patterns):
            slot = np.sort(codes % size)
            cut = _cuts(slot // SLOTS)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                page = int(slot[a]) // SLOTS
                if page not in pages:
                    pages[page] = np.zeros(SLOTS, bool)
                pages[page][slot[a:b] - page * SLOTS] = True
            if len(pages) > hold:
                yield packed(pages)
                pages = {}
        if pages:
            yield packed(pages)

    def either(table: pa.Table) -> pa.Table:
        found = np.bitwise_or.reduce(_bytes(table.column("bits")).reshape(table.num_rows, -1), axis=0)
        return pa.table({"range": table.column("range").slice(0, 1), "bits": pa.array([found.tobytes()], pa.binary())})

    return even(reads.select("seq")).mapInArrow(run, "range bigint, bits binary").groupBy("range").applyInArrow(either, "range bigint, bits binary")


def slots(reads: DataFrame, config: PathConfig, size: int) -> DataFrame:
    """slot and rank (number of smaller used slots) of the bit vector that all codes fill; ranks count within ranges and are shifted by the ranges before."""
    from pyspark.sql import Window

    used = stored(used_slots(reads, config, size), "slots")

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("range"), pa.array([int(np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8)).sum()) for x in batch.column("bits")], pa.int64())], names=["range", "n"])

    def run(batches):
        for batch in batches:
            for page, x, before in zip(batch.column("range").to_pylist(), batch.column("bits"), batch.column("before").to_pylist(), strict=True):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8)))
                yield pa.RecordBatch.from_arrays([pa.array(at + page * SLOTS), pa.array(np.arange(len(at)) + before)], names=["slot", "rank"])

    sums = used.mapInArrow(count, "range bigint, n bigint")
    before = sums.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row a range
    return used.join(F.broadcast(before), "range").select("range", "bits", "before").mapInArrow(run, "slot bigint, rank bigint")


def hashed(codes: np.ndarray) -> np.ndarray:
    """F.xxhash64 of bigint codes."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
    x = turned(turned(codes.astype(np.uint64) * two, 31) * one ^ (five + np.uint64(42 + 8)), 27) * one + four
    x = (x ^ x >> np.uint64(33)) * two
    x = (x ^ x >> np.uint64(29)) * three
    return x ^ x >> np.uint64(32)


def distinct_counts_approx(reads: DataFrame, config: PathConfig, error: float = 0.02) -> DataFrame:
    """seed_ix, total and f0 by HyperLogLog.

    A register of the sketch keeps the rarest hash among the codes that fall to it, so of each register only the code of least rest of its hash has to reach Spark's sketch: a task hands
    on a code a register and pattern, and the estimate is the one that all codes would give.
    """
    import math

    patterns, bits = config.seeds, max(4, math.ceil(2 * math.log2(1.106 / error)))
    bits += 2  # finer than any register of that error: more codes than needed

    def run(batches):
        best = [(np.full(1 << bits, np.iinfo(np.uint64).max), np.zeros(1 << bits, np.int64)) for _ in patterns]
        total, seen = np.zeros(len(patterns), np.int64), [np.zeros(1 << bits, bool) for _ in patterns]
        for i, codes in read_codes(batches, patterns):
            total[i] += len(codes)
            x = hashed(codes)
            rest, code = best[i]
            register = (x >> np.uint64(64 - bits)).astype(np.int64)
            low = x << np.uint64(bits)
            better = np.flatnonzero((low < rest[register]) | ~seen[i][register])
            better = better[np.argsort(low[better], kind="stable")[::-1]]  # of equal registers the last, the least, stays
            rest[register[better]], code[register[better]] = low[better], codes[better]
            seen[i][register[better]] = True
        for i in range(len(patterns)):
            at = np.flatnonzero(seen[i])
            if len(at):
                share = np.zeros(len(at), np.int64)
                share[0] = total[i]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(best[i][1][at]), pa.array(share)], names=["seed_ix", "code", "n"])

    rows = even(reads.select("seq")).mapInArrow(run, "seed_ix int, code bigint, n bigint")
    return rows.groupBy("seed_ix").agg(F.sum("n").alias("total"), F.approx_count_distinct("code", error).alias("f0"))
