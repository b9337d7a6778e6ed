"""The index with strands: reversed reads hit with the other strand; values against a dictionary."""

import numpy as np

from longpath.operators import reduce, strands
from longpath.operators.kmers import tile_codes
from tests.test_reduce import CONFIG


def turned(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def made(seed, n, size=2600):
    rng = np.random.default_rng(seed)
    return [(i, "".join(rng.choice(list("ACGT"), size))) for i in range(n)]


def test_keys_are_those_of_the_plain_index():
    seq = made(1, 1)[0][1]
    keys, strand, tile = strands.stranded_keys(seq, CONFIG, CONFIG.seeds)
    assert (keys == np.concatenate(tile_codes(seq.encode(), CONFIG, CONFIG.seeds)) * CONFIG.patterns + np.arange(CONFIG.patterns)).all()
    assert tile.max() == len(seq) // CONFIG.tile - 1 and 0.4 < strand.mean() < 0.6
    assert len(strands.stranded_keys(None, CONFIG, CONFIG.seeds)[0]) == len(strands.stranded_keys("ACG", CONFIG, CONFIG.seeds)[0]) == 0


def test_values_and_the_maximum_of_a_frame(spark):
    reads = made(2, 4) + [(4, made(2, 1)[0][1]), (5, "A" * 800), (6, None)]
    table = spark.createDataFrame(reads, "read_ix long, seq string").repartition(3)
    for per_frame in (1, 3):
        want, before = {}, 0
        for _, x in reads[:-1]:
            keys, strand, tile = strands.stranded_keys(x, CONFIG, CONFIG.seeds)
            for k, s, t in zip(keys.tolist(), strand.tolist(), tile.tolist(), strict=True):
                values = [2 * (before + 1 + t // CONFIG.block) + b for b in s]
                order = sorted(range(len(k)), key=lambda i: ((((k[i] ^ values[i]) & 0xFFFFFFFF) * reduce.HASH) & 0xFFFFFFFF, i))
                for i in order[:per_frame]:
                    w = ((((k[i] ^ values[i]) & 0xFFFFFFFF) * reduce.HASH) & 0xFFFFFFFF, values[i])
                    want[k[i]] = min(want.get(k[i], w), w)
            before += len(x) // (CONFIG.tile * CONFIG.block) + 1
        got = {}
        for r in strands.insert(table, CONFIG, 5, per_frame).collect():
            got |= dict(zip(np.frombuffer(r["keys"], np.int64).tolist(), np.frombuffer(r["ids"], np.int64).tolist(), strict=True))
        assert got == {k: v for k, (_, v) in want.items()}


def test_reversed_reads_hit_the_other_strand(spark):
    reads = made(3, 6)
    index = strands.insert(spark.createDataFrame(reads, "read_ix long, seq string"), CONFIG, 3, 3)
    asked = [(r, turned(x) if r % 2 else x) for r, x in reads] + [(9, made(4, 1)[0][1]), (10, "")]
    got = {r["read_ix"]: r for r in strands.lookups(reduce.in_units(spark.createDataFrame(asked, "read_ix long, seq string"), CONFIG, 2), index, CONFIG, 3).collect()}
    assert set(got) == {*range(6), 9, 10} and got[10]["frames"] == 0
    for r in range(6):  # a turned read's frames lie elsewhere, but nearly all of its codes are known
        near, far = ("other", "same") if r % 2 else ("same", "other")
        assert got[r][near] > 0.9 * 3 * got[r]["frames"] and got[r][far] < 0.02 * 3 * got[r]["frames"]
    assert got[9]["same"] + got[9]["other"] < 10


def test_slices_are_the_whole_index(spark):
    reads = spark.createDataFrame(made(6, 4), "read_ix long, seq string")
    rows = lambda t: [(r.slot, bytes(r["keys"]), bytes(r["ids"])) for r in t.collect()]
    parts = [rows(t) for t in strands.slices(reads, CONFIG, 6, 2, 2)]
    assert all(parts) and sorted(sum(parts, [])) == sorted(rows(strands.insert(reads, CONFIG, 6, 2)))
