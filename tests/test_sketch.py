"""The sketch of an index against dictionaries, and its false hits against the rate that its occupancy gives."""

import numpy as np

from longpath.operators import reduce, sketch
from longpath.operators.kmers import tile_codes
from tests.test_reduce import CONFIG

H = CONFIG.patterns


def made(seed, n, size=3000):
    rng = np.random.default_rng(seed)
    return [(i, "".join(rng.choice(list("ACGT"), size))) for i in range(n)]


def slow(reads, size):
    out, before = {}, 0
    for _, x in reads:
        for t, m in enumerate(tile_codes(x.encode(), CONFIG, CONFIG.seeds)):
            for s in {(c * H + i) % size for row in m.tolist() for i, c in enumerate(row)}:
                out.setdefault(s, set()).add(before + 1 + t // CONFIG.block)
        before += len(x) // (CONFIG.tile * CONFIG.block) + 1
    return out


def test_slots_ranks_ids_and_saturation(spark):
    reads = made(1, 5)
    reads += [(5, reads[0][1]), (6, reads[0][1]), (7, "A" * 3000), (8, "ACG"), (9, "")]
    table = spark.createDataFrame([*reads, (10, None)], "read_ix long, seq string").repartition(3)
    for size in (2_500_003, 20_011):
        want = slow(reads, size)
        got = sketch.slots_of(sketch.sketch(table, CONFIG, size, 2)).collect()
        assert {r["slot"]: (r["rank"], r["id"], r["saturated"]) for r in got} == {s: (i, min(want[s]), len(want[s]) > 2) for i, s in enumerate(sorted(want))}
        assert len(got) == len(want) and any(r["saturated"] for r in got)


def test_bytes_a_slot_and_false_hits(spark):
    """At an occupancy of about 0.1: bytes as the docstring says, and other reads' frames found at the rate of occupancy ** patterns."""
    table = spark.createDataFrame(made(2, 12), "read_ix long, seq string")
    size = 1_000_003
    rows = sketch.sketch(table, CONFIG, size, 3)
    row = rows.collect()
    used = sum(r["used"] for r in row)
    assert sum(len(r["bits"]) + len(r["directory"]) + len(r["ids"]) for r in row) == len(row) * sketch.PART * 17 // 128 + 4 * used
    strangers = reduce.in_units(spark.createDataFrame(made(3, 40), "read_ix long, seq string"), CONFIG, 2)
    found = sketch.lookups(strangers, rows, CONFIG, size).groupBy().sum("frames", "full_frames").first()
    rate = (used / size) ** H
    assert 0.08 < used / size < 0.12 and 0.8 * rate < found[1] / found[0] < 1.25 * rate
    own = sketch.lookups(reduce.in_units(table, CONFIG, 3), rows, CONFIG, size).collect()
    assert len(own) == 12 and all(r["full_frames"] == r["frames"] for r in own)  # what was written is found


def test_nothing(spark):
    table = spark.createDataFrame([], "read_ix long, seq string")
    rows = sketch.sketch(table, CONFIG, 1000, 1)
    assert sketch.slots_of(rows).count() == 0
    some = reduce.in_units(spark.createDataFrame(made(1, 2), "read_ix long, seq string"), CONFIG, 1)
    assert [(r["full_frames"], r["hits"]) for r in sketch.lookups(some, rows, CONFIG, 1000).collect()] == [(0, 0)] * 2


def shuffled(spark):
    """Bytes that this session has written for exchanges so far."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    none = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_exchanges_take_few_bytes_a_base(spark):
    """600,000 bases of reads written to 1,000,003 slots, and as many looked up: before, some 24 bytes a key were exchanged for either."""
    from longpath.plans.config import SMALL

    table = spark.createDataFrame(made(4, 60, 20_000), "read_ix long, seq string").repartition(4).cache()
    reads = table.where("read_ix >= 30")
    dealt = reduce.in_units(reads, SMALL, 1).cache()
    dealt.count()
    before = shuffled(spark)
    rows = sketch.sketch(table.where("read_ix < 30"), SMALL, 1_000_003, 3)
    assert sketch.lookups(dealt, rows, SMALL, 1_000_003).count() == 30
    assert shuffled(spark) - before < 15 * 1_200_000
    got = sketch.lookups(dealt, rows, SMALL, 1_000_003).orderBy("read_ix").collect()
    assert got == sketch.lookups(sketch.in_units(reads, 1_000_003), rows, SMALL, 1_000_003).orderBy("read_ix").collect()


def test_lookups_are_those_of_a_dictionary(spark):
    """With a vector of slots and, for more slots, without; units whose reads lie in several partitions; asked by gaps and by bits."""
    reads = made(5, 3, 2400)
    reads += [(3, reads[0][1]), (4, reads[0][1][:1500]), (5, "A" * 700)]
    table = spark.createDataFrame(reads, "read_ix long, seq string")
    asked = [(r + 10, x) for r, x in reads[2:]] + [(20, made(6, 1, 5000)[0][1]), (21, reads[1][1][500:] + reads[0][1]), (22, ""), (23, "ACG"), (24, None)]
    dealt = spark.createDataFrame([(r % 2, r, x) for r, x in asked], "unit long, read_ix long, seq string").repartition(4)
    for size in (20_011, 2_500_003, sketch.DENSE + 3):
        have = {s: 1 + (len(blocks) > 2) for s, blocks in slow(reads, size).items()}
        want = []
        for r, x in asked:
            frames = [[have.get((c * H + i) % size, 0) for i, c in enumerate(row)] for m in tile_codes((x or "").encode(), CONFIG, CONFIG.seeds) for row in m.tolist()]
            want.append((r, len(frames), sum(all(f) for f in frames), sum(f.count(1) for f in frames), sum(f.count(2) for f in frames)))
        got = sketch.lookups(dealt, sketch.sketch(table, CONFIG, size, 2), CONFIG, size).collect()
        assert sorted(map(tuple, got)) == want
