"""Selection by ranges and merges: against slow models, and against one fold on simulated reads of a genome."""

import random
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from longpath.operators import reduce, select, tiles
from longpath.operators.kmers import tile_codes
from longpath.plans.config import SMALL
from longpath.plans.queries import _clean

DATA = "/root/testdata/sf0.001"


def slow_insert(pieces, config):
    """(key -> block) after all pieces were inserted whole: of a key's blocks the one of least weight."""
    index, base = {}, 0
    for _, seq in pieces:
        for t, m in enumerate(tile_codes(seq.encode(), config, config.seeds)):
            block = base + 1 + t // config.block
            for row in m.tolist():
                for i, code in enumerate(row):
                    key = code * config.patterns + i
                    w = (((key ^ block) & 0xFFFFFFFF) * 1103515245 & 0xFFFFFFFF, block)
                    index[key] = min(index.get(key, w), w)
        base += len(seq) // (config.tile * config.block) + 1
    return {k: b for k, (_, b) in index.items()}


def slow_judge(seq, index, config):
    candidates, best, on = [], [], []
    for m in tile_codes(seq.encode(), config, config.seeds):
        hits = defaultdict(int)
        for row in m.tolist():
            for b in {index.get(code * config.patterns + i, 0) for i, code in enumerate(row)} - {0}:
                hits[b] += 1
        c = {b: n for b, n in hits.items() if n > 2}
        candidates.append(c)
        best.append(min(hits, key=lambda b: (-hits[b], b)) if hits else 0)
        on.append(max(c.values(), default=0) > config.hits)
    if not any(on):
        return "untrimmed", 0, len(on) - 1
    best, on = tiles.smooth(best, on, candidates, config)
    return tiles.decide(best, on, config)


def slow_reduce(reads, config, shard_of, parts):
    shards = [[] for _ in range(parts)]
    for s in range(parts):
        own = [(r, x) for r, x in reads if shard_of[r] == s]
        for (r, x), d in zip(own, select.fold(select.Selection(config), [(r, x.encode()) for r, x in own]), strict=True):
            if d[2] == "untrimmed":
                shards[s].append((r, 0, x, True))
            elif d[2] == "trimmed":
                a, b = d[3] * config.tile, select._end(d[4], d[6], len(x), config)
                shards[s].append((r, a, x[a:b], False))
    while len(shards) > 1:
        merged = []
        for i in range(0, len(shards), 2):
            first, second = shards[i], shards[i + 1] if i + 1 < len(shards) else []
            # ids are numbered on over the earlier pieces of all pairs
            before = [p for j in range(0, i, 2) for p in shards[j]]
            index = slow_insert_from([(r, x) for r, _, x, _ in first], [(r, x) for r, _, x, _ in before], config)
            out = list(first)
            for r, a, x, whole in second:
                what, t, u = slow_judge(x, index, config)
                if what == "untrimmed":
                    out.append((r, a, x, whole))
                elif what == "trimmed":
                    end = select._end(u, len(x) // config.tile, len(x), config)
                    out.append((r, a + t * config.tile, x[t * config.tile : end], False))
            merged.append(out)
        shards = merged
    return sorted((r, whole, a, x) for r, a, x, whole in shards[0])


def slow_insert_from(pieces, before, config):
    shift = sum(len(x) // (config.tile * config.block) + 1 for _, x in before)
    index = {}
    for _, seq in pieces:
        for t, m in enumerate(tile_codes(seq.encode(), config, config.seeds)):
            block = shift + 1 + t // config.block
            for row in m.tolist():
                for i, code in enumerate(row):
                    key = code * config.patterns + i
                    w = (((key ^ block) & 0xFFFFFFFF) * 1103515245 & 0xFFFFFFFF, block)
                    index[key] = min(index.get(key, w), w)
        shift += len(seq) // (config.tile * config.block) + 1
    return {k: b for k, (_, b) in index.items()}


def genome_reads(seed, size=60_000, coverage=12, errors=0.03):
    rng = np.random.default_rng(seed)
    genome = rng.integers(0, 4, size)
    reads, spans, total = [], [], 0
    while total < coverage * size:
        n = int(rng.integers(3000, 9000))
        at = int(rng.integers(0, size - n))
        read = genome[at : at + n].copy()
        wrong = rng.random(n) < errors
        read[wrong] = (read[wrong] + rng.integers(1, 4, wrong.sum())) % 4
        flip = rng.random() < 0.5
        read = 3 - read[::-1] if flip else read
        reads.append((len(reads), "".join("ACGT"[b] for b in read)))
        spans.append((at, n, flip))
        total += n
    return reads, spans, size


CONFIG = replace(SMALL, min_length=0, tile=250, block=4, min_unassigned=5)


def covered(pieces, spans, size):
    seen = np.zeros(size, bool)
    for r, start, n in pieces:
        at, length, flip = spans[r]
        a = at + (length - start - n if flip else start)
        seen[a : a + n] = True
    return seen.mean()


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_reduced_equals_the_slow_model(spark, parts):
    reads, _, _ = genome_reads(1, size=30_000, coverage=8)
    table = spark.createDataFrame(reads, "read_ix long, seq string").repartition(3)
    shard_of = {r["read_ix"]: r["shard"] for r in reduce.in_units(table, CONFIG, parts).collect()}
    got = sorted((r["read_ix"], r["whole"], r["start"], r["seq"]) for r in reduce.reduced(table, CONFIG, parts, bucket_rows=20_000).collect())
    assert got == slow_reduce(reads, CONFIG, shard_of, parts)


def test_reduced_is_like_one_fold(spark):
    """On 60 kb at 12-fold coverage: bases within 15 % of one fold's, coverage of the genome within 3 %, no range with more than 2/parts of the reads."""
    reads, spans, size = genome_reads(2)
    table = spark.createDataFrame(reads, "read_ix long, seq string").repartition(3)
    one, many = ([(r["read_ix"], r["start"], len(r["seq"])) for r in reduce.reduced(table, CONFIG, n).collect()] for n in (1, 8))
    bases = [sum(n for *_, n in x) for x in (one, many)]
    share = [covered(x, spans, size) for x in (one, many)]
    assert abs(bases[1] / bases[0] - 1) <= 0.15 and share[1] >= share[0] - 0.03, (bases, share, size)
    counts = [r["count"] for r in reduce.in_units(table, CONFIG, 8).groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) <= 2 * len(reads) / 8


def test_a_prefix_has_the_same_result(spark):
    """The fate of a read hangs on no later one, if ranges are cut alike."""
    reads, _, _ = genome_reads(3, size=20_000, coverage=6)
    table = spark.createDataFrame(reads, "read_ix long, seq string")
    whole = {r["read_ix"]: r["seq"] for r in reduce.reduced(table, CONFIG, 1).collect()}
    half = {r["read_ix"]: r["seq"] for r in reduce.reduced(table.where("read_ix < 10"), CONFIG, 1).collect()}
    assert half == {r: x for r, x in whole.items() if r < 10}


def test_paths_reach_their_target(spark):
    reads, spans, size = genome_reads(4, size=20_000, coverage=16)
    config = replace(CONFIG, genome_size=size, ratio=0.9, max_paths=3)
    table = spark.createDataFrame([(r, f"r{r}", x, "I" * len(x)) for r, x in reads], "read_ix long, id string, seq string, qual string")
    paths = reduce.reduced_paths(table, config, 2)
    rows = paths.collect()
    last = -1
    for p in (1, 2, 3):
        own = sorted((r["read_ix"], len(r["seq"])) for r in rows if r["path_no"] == p)
        assert own[0][0] > last and sum(n for _, n in own) > config.target_bases >= sum(n for _, n in own[:-1])
        last = own[-1][0]
    pieces = reduce.emitted(table, paths).collect()
    assert {(r["path_no"], r["seq"]) for r in pieces} == {(r["path_no"], r["seq"]) for r in rows} and all(len(r["seq"]) == len(r["qual"]) for r in pieces)


def test_index_is_the_same_in_any_grouping(spark):
    reads = _clean(spark, DATA).select("read_ix", "seq").limit(12)
    reads = spark.createDataFrame(reads.collect(), reads.schema)
    rows = sorted((r["read_ix"], r["seq"]) for r in reads.collect())
    slow = slow_insert(rows, SMALL)
    for buckets, parts in ((1, 1), (3, 5)):
        got = {}
        for r in reduce.insert(reads.repartition(parts), SMALL, buckets).collect():
            got |= dict(zip(np.frombuffer(r["keys"], np.int64).tolist(), np.frombuffer(r["ids"], np.int64).tolist(), strict=True))
        assert got == slow


def test_nothing_to_select(spark):
    table = spark.createDataFrame([], "read_ix long, seq string")
    assert reduce.reduced(table, CONFIG, 4).count() == 0 and reduce.reduced_paths(table, replace(CONFIG, genome_size=10), 2).count() == 0
    assert reduce.reduced(spark.createDataFrame([(5, ""), (6, "ACGT"), (9, None)], "read_ix long, seq string"), CONFIG, 2).where(F.lit(True)).count() == 0


def test_an_index_in_slices_is_the_whole_in_few_bytes(spark, tmp_path):
    """The slices of a snapshot have every key once, a turn exchanges its own keys, and keys and ids take far less than two numbers of eight bytes."""
    from longpath.operators import units
    from longpath.operators.snapshot import IndexStore

    rng = random.Random(4)
    reads = spark.createDataFrame([(3 * i, "".join(rng.choice("ACGT") for _ in range(700))) for i in range(40)], "read_ix long, seq string")
    unpacked = lambda rows: sorted((int(k), int(v)) for r in rows.collect() for k, v in zip(np.frombuffer(r["keys"], np.int64), np.frombuffer(r["ids"], np.int64), strict=True))
    want = unpacked(reduce.insert(reads, SMALL, 5))
    rows = reduce.spaced(reads, SMALL).cache()
    turns = [reduce._written(rows, SMALL, 5, t, 2) for t in range(2)]
    sizes = [t.agg(F.sum("size"), F.sum(F.length("keys") + F.length("ids"))).first() for t in turns]
    assert all(0 < n for n, _ in sizes) and sum(b for _, b in sizes) < 10 * sum(n for n, _ in sizes)
    store = IndexStore(spark, f"file://{tmp_path}/index", most=100)
    store.write_slices(0, reduce.slices(reads, SMALL, 5, 2), {})
    assert store.versions() == [0] and unpacked(store.index(0)) == want
    sums = {}
    for k, v in want:
        n, c = sums.get(v, (0, 0))
        sums[v] = n + 1, c + k // SMALL.patterns
    assert {r.id: (r.slots, r.code_sum) for r in units.entry_sums(store.rows(0), SMALL, 2).collect()} == sums


def test_least_writers_in_one_sort_and_in_four():
    rng = np.random.default_rng(3)
    for spaces in (1, 3):
        keys, block, space = rng.integers(0, 50, 900), rng.integers(1, 40, 900), rng.integers(0, spaces, 900)
        slot = space * 7 + keys % 7
        want = {}
        for s, k, b in zip(slot.tolist(), keys.tolist(), block.tolist(), strict=True):
            x = (int(reduce.weight(np.array([k]), np.array([b]))[0]), b)
            want[s, k] = min(want.get((s, k), x), x)
        assert list(zip(*(c.tolist() for c in reduce.least_writers(slot, keys, block)), strict=True)) == [(s, k, want[s, k][1]) for s, k in sorted(want)]


def test_lookups_in_rounds_are_those_of_one(spark):
    """A turn asks and answers its own slots, gaps take fewer bytes than keys of eight, and all turns together give the answers of one."""
    rng = random.Random(5)
    reads = spark.createDataFrame([(i, i // 4, "".join(rng.choice("AC") for _ in range(600))) for i in range(16)], "read_ix long, unit long, seq string")
    first, later = reads.where("read_ix < 8"), reads.where("read_ix >= 8").withColumn("space", F.lit(0).cast("long"))
    unpacked = lambda rows: sorted((u, k, i) for r in rows.toArrow().to_batches() for u, k, i in zip(np.repeat(r.column("unit").to_numpy(), r.column("size").to_numpy()).tolist(), *(c.tolist() for c in reduce.keys_and_ids(r)), strict=True))
    want = unpacked(reduce._answered(reduce._asked(later, SMALL, 6), reduce.insert(first, SMALL, 6)))
    assert want and unpacked(reduce.answers_in_rounds(later, reduce.slices(first, SMALL, 6, 3), SMALL, 6, 3)) == want
    asked = reduce._asked(later, SMALL, 6, 1, 3)
    assert {r.slot % 3 for r in asked.collect()} == {1}
    n, b = asked.agg(F.sum("size"), F.sum(F.length("keys"))).first()
    assert b < 6 * n
