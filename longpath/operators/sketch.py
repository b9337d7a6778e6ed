"""The index in sketch form: a bit vector of used slots with a rank directory, and an array of ids with a saturation bit.

A key's slot is its number modulo ``size``. Slots are cut into parts of ``PART``; a part is one row: its bits, the number of set bits before each ``BLOCK`` of them, the number of
set bits before the part, and an id for each set bit, at its rank. An id is the least block that wrote the slot, as 31 bits; the upper bit says that more than ``most`` blocks
wrote it, so it stands for none of them. A part takes PART / 8 bytes for bits, PART / 128 for the directory and 4 a used slot: at occupancy o that is
(1.0625 / 8) / o + 4 bytes a used slot, 5.3 at 0.1. Keys that share a slot share its id; a key that was never written finds its slot used with probability o,
so a frame of h patterns that has none of its keys written is found with probability o ** h (``bloom.false_positive_rate``).

A task reduces all that it writes to an entry a slot before anything is exchanged, if a vector of the slots fits it (``DENSE``; else batch by batch), and a task has about ``BASES``
of reads. So exchanged are a few bytes a slot and task, fewer than a byte a base. A unit of reads asks for each of its slots once, by bits or by gaps, and what comes back are two bits a slot, in the order asked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longpath.operators.counts import _narrow, _wide, gaps, ungaps
from longpath.operators.index import running
from longpath.operators.kmers import BASE, pattern_codes
from longpath.operators.probe import STEP, _cuts
from longpath.operators.reduce import UNIT, ids_taken
from longpath.plans.config import PathConfig
from longpath.sources.files import stored

PART, BLOCK = 1 << 16, 512
DENSE = 1 << 26  # slots of which a task may hold a vector, of five bytes each
BASES = 1 << 26  # of the reads that one task writes
HASHED = 1 << 16  # bases hashed at once
SATURATED = np.uint32(1 << 31)
WRITTEN = "part bigint, size int, base bigint, width int, slots binary, ids binary"
SKETCH = "part bigint, used bigint, bits binary, directory binary, ids binary"


def _by_part(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of sorted slots, and where each begins."""
    part = slots // PART
    cut = _cuts(part)
    return part[cut[:-1]], cut


def _least(slots: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct slots, ascending, the least block of each and its number of blocks; blocks do not descend."""
    new = np.ones(len(blocks), bool)
    new[1:] = blocks[1:] != blocks[:-1]
    number, bits = np.cumsum(new) - 1, len(blocks).bit_length()
    both = np.sort(slots << bits | number)
    if len(both):
        both = both[_cuts(both)[:-1]]  # a block counts once a slot
    cut = _cuts(both >> bits)
    return both[cut[:-1]] >> bits, blocks[new][both[cut[:-1]] & ((1 << bits) - 1)], np.diff(cut)


def _entries(slots: np.ndarray, ids: np.ndarray, writers: np.ndarray, most: int) -> pa.RecordBatch:
    """WRITTEN rows, one a part, of ascending slots: gaps between them, and id and writers (up to most + 1) in one number of few bytes."""
    part, cut = _by_part(slots)
    base = int(ids.min())
    packed, width = _narrow((ids - base) * (most + 1) + np.minimum(writers, most + 1) - 1, cut)
    n = len(part)
    columns = [pa.array(part), pa.array(np.diff(cut).astype(np.int32)), pa.array(np.full(n, base, np.int64)), pa.array(np.full(n, width, np.int32)), gaps(slots % PART, cut), packed]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WRITTEN.split(", ")])


def _frame_slots(seqs: list[bytes], config: PathConfig, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots of all frames of sequences, and the frames of each: as ``kmers.frame_codes`` has them, of some sequences behind one another at once."""
    patterns, h, ends = config.seeds, config.patterns, np.cumsum([len(x) for x in seqs])
    first = 0
    while first < len(seqs):
        last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + HASHED, "right")), first + 1)
        bases, n = BASE[np.frombuffer(b"".join(seqs[first:last]), np.uint8)], np.array([len(x) for x in seqs[first:last]])
        frames = np.maximum(np.minimum(n // config.tile * config.tile, n - config.span + 1), 0)
        place = np.arange(frames.sum()) - np.repeat(np.cumsum(frames) - frames, frames)
        begin = np.repeat(np.cumsum(n) - n, frames)
        end = begin + np.minimum(np.repeat(n, frames), (place // config.tile + 1) * config.tile + config.span - 1)
        out = np.empty((len(place), h), np.int64)
        if len(place):
            for i, (codes, p) in enumerate(zip(pattern_codes(bases, patterns), patterns, strict=True)):
                out[:, i] = codes[np.minimum(begin + place, end - len(p))] * h + i
        yield (out % size).ravel(), frames
        first = last


def _written(reads: DataFrame, config: PathConfig, size: int, most: int) -> DataFrame:
    """WRITTEN rows of what tasks write, of reads (seq, before)."""
    h = config.patterns

    def reduced(reads: list[tuple]) -> Iterator[tuple]:
        reads.sort()
        slots, frames = (np.concatenate(c) for c in zip(*_frame_slots([x for _, x in reads], config, size), strict=True))
        place = np.arange(len(slots) // h) - np.repeat(np.cumsum(frames) - frames, frames)
        block = np.repeat(np.repeat(np.array([n for n, _ in reads], np.int64), frames) + 1 + place // (config.tile * config.block), h)
        i = 0
        while i < len(slots):  # at once, but for a long read
            j = len(slots) if len(slots) - i < 2 * STEP else int(np.searchsorted(block, block[i + STEP], "right"))  # with whole blocks
            yield _least(slots[i:j], block[i:j])
            i = j

    def steps(batches) -> Iterator[tuple]:
        held, n = [], 0
        for batch in batches:
            for seq, before in zip(batch.column("seq").cast(pa.binary()).to_pylist(), batch.column("before").to_pylist(), strict=True):
                if seq:
                    held.append((before, seq))
                    n += len(seq) * h
                if n >= STEP:
                    yield from reduced(held)
                    held, n = [], 0
        if held:
            yield from reduced(held)

    def run(batches):
        if size > DENSE:
            for slots, ids, writers in steps(batches):
                yield _entries(slots, ids, writers, most)
            return
        least, count = np.full(size, SATURATED), np.zeros(size, np.uint8 if most < 255 else np.int64)
        for slots, ids, writers in steps(batches):
            if ids.max() >= 1 << 31:
                raise OverflowError("ids of a sketch have 31 bits")
            least[slots] = np.minimum(least[slots], ids.astype(np.uint32))
            count[slots] = np.minimum(count[slots] + writers, most + 1)
        for i in range(0, size, 16 * PART):
            slots = np.flatnonzero(count[i : i + 16 * PART]) + i
            if len(slots):
                yield _entries(slots, least[slots].astype(np.int64), count[slots].astype(np.int64), most)

    return reads.select("seq", "before").mapInArrow(run, WRITTEN)


def sketch(reads: DataFrame, config: PathConfig, size: int, most: int) -> DataFrame:
    """SKETCH rows, and before (set bits before the part), after all reads (read_ix, seq) were inserted whole in the order of read_ix. Parts without a used slot have no row. The rows are stored."""
    numbers = running(reads.select("read_ix", ids_taken(config).alias("ids"))).select("read_ix", "before")
    bases = reads.agg(F.sum(F.length("seq").cast("long"))).first()[0] or 0

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        least, count = np.full(PART, np.iinfo(np.int64).max), np.zeros(PART, np.int64)
        for row in table.to_batches(max_chunksize=1):
            slots = ungaps(row.column("slots"), row.column("size").to_numpy().astype(np.int64))
            both = _wide(row.column("ids"), row.column("width").to_numpy(), np.zeros(1, np.int64))
            least[slots] = np.minimum(least[slots], both // (most + 1) + row.column("base")[0].as_py())
            count[slots] += both % (most + 1) + 1
        bits = count > 0
        ids = least[bits]
        if ids.max() >= 1 << 31:
            raise OverflowError("ids of a sketch have 31 bits")
        directory = np.concatenate(([0], np.cumsum(bits.reshape(-1, BLOCK).sum(1))[:-1])).astype(np.int32)
        values = ids.astype(np.uint32) | np.where(count[bits] > most, SATURATED, np.uint32(0))
        row = {"part": [part], "used": [len(ids)], "bits": [np.packbits(bits, bitorder="little").tobytes()], "directory": [directory.tobytes()], "ids": [values.tobytes()]}
        return pa.table({k: pa.array(v, pa.int64() if k in ("part", "used") else pa.binary()) for k, v in row.items()})

    numbered = reads.select("read_ix", "seq").join(numbers, "read_ix")
    if size <= DENSE:
        numbered = numbered.coalesce(max(-(-bases // BASES), 1))
    rows = stored(_written(numbered, config, size, most).groupBy("part").applyInArrow(run, SKETCH), "sketch")
    counts = rows.select("part", "used")
    before = counts.select("part", (F.sum("used").over(Window.orderBy("part")) - F.col("used")).alias("before"))  # two numbers a part
    return rows.join(F.broadcast(before), "part")


def probe(bits: bytes, directory: bytes, ids: bytes, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of slots of a part (from 0): their rank within the part (-1: not used), id (0: not used) and whether saturated."""
    raw, count, values = np.frombuffer(bits, np.uint8), np.frombuffer(directory, np.int32), np.frombuffer(ids, np.uint32)
    used = (raw[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
    of = slots // BLOCK
    blocks = np.unpackbits(raw.reshape(-1, BLOCK // 8)[of], axis=1, bitorder="little")
    inside = (blocks * (np.arange(BLOCK) < (slots % BLOCK)[:, None])).sum(1, dtype=np.int64)
    rank = np.where(used, count[of] + inside, -1)
    found = np.where(used, values[np.maximum(rank, 0)], np.uint32(0)) if len(values) else np.zeros(len(slots), np.uint32)
    return rank, (found & ~SATURATED).astype(np.int64), (found & SATURATED) != 0


def slots_of(rows: DataFrame) -> DataFrame:
    """slot, rank, id and saturated of every used slot, read from the structure."""

    def run(batches):
        for batch in batches:
            for part, before, bits, directory, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "bits", "directory", "ids")), strict=True):
                every = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
                for i in range(0, len(every), 1 << 12):
                    slots = every[i : i + (1 << 12)]
                    rank, value, full = probe(bits, directory, ids, slots)
                    yield pa.RecordBatch.from_arrays([pa.array(slots + part * PART), pa.array(rank + before), pa.array(value), pa.array(full)], names=["slot", "rank", "id", "saturated"])

    return rows.select("part", "before", "bits", "directory", "ids").mapInArrow(run, "slot bigint, rank bigint, id bigint, saturated boolean")


def in_units(reads: DataFrame, size: int) -> DataFrame:
    """unit, read_ix and seq of reads (read_ix, seq), stored: neighbours in a task, of as many bases as a sketch of so many slots has use for. No sequence is exchanged."""
    bases = max(size // 2, 1) if size <= DENSE else UNIT

    def run(batches):
        unit, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            units = []
            for n in batch.column("seq").cast(pa.binary()):
                if held >= bases:
                    unit, held = unit + 1, 0
                units.append(unit)
                held += len(n.as_buffer()) if n.is_valid else 0
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), batch.column("read_ix"), batch.column("seq")], names=["unit", "read_ix", "seq"])

    kind = reads.schema["read_ix"].dataType.simpleString()
    return stored(reads.select("read_ix", "seq").mapInArrow(run, f"unit bigint, read_ix {kind}, seq string"), "units")


def _distinct(slots: Iterable[np.ndarray], size: int) -> np.ndarray:
    if size > DENSE:
        return np.unique(np.concatenate([np.empty(0, np.int64), *slots]))
    seen = np.zeros(size, bool)
    for x in slots:
        seen[x] = True
    return np.flatnonzero(seen)


def _asked(part: int, unit: int, slots: np.ndarray) -> dict:
    """A row of ascending slots (from 0) of a part: bits if there are many, else gaps."""
    if len(slots) > PART // 8:
        bits = np.zeros(PART, bool)
        bits[slots] = True
        data = np.packbits(bits).tobytes()
    else:
        data = gaps(slots, np.array([0, len(slots)]))[0].as_py()
    return {"part": part, "unit": unit, "size": len(slots), "slots": data}


def _mark(bits: np.ndarray, size: int, data: bytes) -> None:
    """Sets what a row of _asked() has."""
    if size > PART // 8:
        bits |= np.unpackbits(np.frombuffer(data, np.uint8)).view(bool)
    else:
        bits[ungaps(pa.array([data], pa.binary()), np.array([size]))] = True


def _twos(values: np.ndarray) -> bytes:
    """Values below four, four a byte."""
    wide = np.zeros((-(-len(values) // 4), 4), np.uint8)
    wide.ravel()[: len(values)] = values
    return (wide[:, 0] | wide[:, 1] << 2 | wide[:, 2] << 4 | wide[:, 3] << 6).tobytes()


def _untwos(data: bytes, n: int) -> np.ndarray:
    return (np.frombuffer(data, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()[:n]


def lookups(reads: DataFrame, rows: DataFrame, config: PathConfig, size: int) -> DataFrame:
    """read_ix, frames, full_frames (all slots used), hits (used slots that aren't saturated) and saturated (slots) of reads (unit, read_ix, seq).

    Units ask for each of their slots once, wherever their reads lie; best are those of in_units(). Answers are stored.
    """
    h, kind = config.patterns, np.uint32 if size < 1 << 32 else np.int64

    def asked(unit: int, seqs: list) -> Iterator[pa.RecordBatch]:
        slots = _distinct((x for x, _ in _frame_slots(seqs, config, size)), size)
        part, cut = _by_part(slots)
        found = [_asked(p, unit, slots[a:b] - p * PART) for p, a, b in zip(part.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_pylist(found, pa.schema([("part", pa.int64()), ("unit", pa.int64()), ("size", pa.int32()), ("slots", pa.binary())]))

    def ask(batches):
        now, seqs = None, []
        for batch in batches:
            for unit, seq in zip(batch.column("unit").to_pylist(), batch.column("seq").cast(pa.binary()).to_pylist(), strict=True):
                if seqs and unit != now:
                    yield from asked(now, seqs)
                    seqs = []
                now = unit
                seqs.append(seq or b"")
        if seqs:
            yield from asked(now, seqs)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            part, bits, ids = (right.column(c)[0].as_py() for c in ("part", "bits", "ids"))
            state = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
            state[state > 0] += (np.frombuffer(ids, np.uint32) & SATURATED) != 0
            left = left.sort_by("unit")
            cut = _cuts(left.column("unit").to_numpy())
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                some, wanted = left.slice(a, b - a), np.zeros(PART, bool)
                for n, data in zip(some.column("size").to_pylist(), some.column("slots").to_pylist(), strict=True):
                    _mark(wanted, n, data)
                out.append({"unit": some.column("unit")[0].as_py(), "part": part, "states": _twos(state[wanted])})
        return pa.Table.from_pylist(out, pa.schema([("unit", pa.int64()), ("part", pa.int64()), ("states", pa.binary())]))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        seqs = [x or b"" for x in left.column("seq").cast(pa.binary()).to_pylist()]
        slots = [(x.astype(kind), frames) for x, frames in _frame_slots(seqs, config, size)]
        have = _distinct((x for x, _ in slots), size)
        part, cut = _by_part(have)
        state, found = np.zeros(len(have), np.uint8), dict(zip(right.column("part").to_pylist(), right.column("states").to_pylist(), strict=True))
        for p, a, b in zip(part.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if p in found:
                state[a:b] = _untwos(found[p], b - a)
        if size <= DENSE:
            every = np.zeros(size, np.uint8)
            every[have] = state
        out = [np.empty((0, 4), np.int64)]
        for x, frames in slots:
            value = (every[x] if size <= DENSE else state[np.searchsorted(have, x)]).reshape(-1, h)
            sums = np.stack([(value != 0).all(1), (value == 1).sum(1), (value == 2).sum(1)], axis=1)
            sums, end = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(sums, axis=0)]), np.cumsum(frames)
            out.append(np.column_stack([frames, sums[end] - sums[end - frames]]))
        return pa.table([left.column("read_ix").cast(pa.int64()), *(pa.array(c) for c in np.concatenate(out).T)], names=["read_ix", "frames", "full_frames", "hits", "saturated"])

    asks = reads.select("unit", "seq").mapInArrow(ask, "part bigint, unit bigint, size int, slots binary")
    answers = stored(asks.groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(answer, "unit bigint, part bigint, states binary"), "answers")
    return reads.select("unit", "read_ix", "seq").groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(count, "read_ix bigint, frames bigint, full_frames bigint, hits bigint, saturated bigint")
