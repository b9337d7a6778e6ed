import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from longpath.operators import counts, kmers
from longpath.plans.config import SMALL


@pytest.fixture(scope="module")
def reads(spark):
    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(4000))
    seqs = [genome[(at := rng.randrange(3000)) : at + rng.randrange(20, 900)] for _ in range(60)] + ["ACGT" * 200, "", "ACGTACGTACGTACGTACGTAC", None]
    return spark.createDataFrame(list(enumerate(seqs)), "read_ix long, seq string").cache()


def test_varints_and_gaps_come_back():
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.integers(0, 1 << b, 200) for b in (1, 7, 8, 14, 15, 40, 62)] + [np.array([0, 127, 128, 16383, 16384, (1 << 62) - 1])])
    data, cut = counts.varints(values)
    assert np.array_equal(counts.unvarints(data), values) and cut[-1] == len(data)
    cut = np.array([0, 300, 301, 1406])
    parts = [np.sort(values[a:b]) for a, b in zip(cut, cut[1:])]
    assert np.array_equal(counts.ungaps(counts.gaps(np.concatenate(parts), cut), np.diff(cut)), np.concatenate(parts))
    assert not len(counts.unvarints(counts.varints(np.empty(0, np.int64))[0]))


def test_keys_give_their_codes_back():
    form, codes = counts.Layout(32, 20, 4), np.random.default_rng(1).integers(0, 1 << 32, 1000)
    keys = form.keys(codes, 2)
    assert np.array_equal(form.codes(keys), codes) and set((keys >> form.shift).tolist()) <= {b for b in range(3 << 12) if form.seed(b) == 2}


@pytest.mark.parametrize("rounds", [1, 8])
def test_counts_in_rounds_are_those_of_rows(spark, reads, rounds):
    rows = Counter((r.seed_ix, r.code) for r in kmers.kmers(reads, SMALL).collect())
    form = counts.Layout(32, 28, rounds)
    got = {(r.seed_ix, r.multiplicity): r.codes for r in counts.spectrum(reads, SMALL, 10_000, form).collect()}
    assert got == Counter((seed, n) for (seed, _), n in rows.items())
    assert {r.seed_ix: (r.total, r.f0) for r in counts.distinct_counts(reads, SMALL, form).collect()} == {s: (sum(n for (x, _), n in rows.items() if x == s), sum(x == s for x, _ in rows)) for s in range(3)}
    want = Counter()
    for (seed, code), n in rows.items():
        for c, v in (("codes", 1), ("code_sum", code), ("total", n)):
            want[seed, code >> 22, c] += v
    assert {(r.seed_ix, r.code_range, c): r[c] for r in counts.range_counts(reads, SMALL, 22, form).collect() for c in ("codes", "code_sum", "total")} == want


def test_counts_send_no_row_a_code(spark, reads):
    """What reaches Spark's rows from the kernels is a row a bucket, register or range, not a row a code."""
    codes = kmers.kmers(reads, SMALL).count()
    assert counts.occurrences(reads, SMALL, counts.Layout(32, 30, 1), 0).count() <= 12 * spark.sparkContext.defaultParallelism < codes
    plans = [f(reads, SMALL)._jdf.queryExecution().toString() for f in (counts.spectrum, counts.distinct_counts)]
    assert not any("MapInArrow" in p and "code#" in p for p in plans)


def test_slots_and_sketch_are_those_of_rows(spark, reads):
    rows = kmers.kmers(reads, SMALL)
    for size in (1003, 1_000_003):
        used = sorted({r.code % size for r in rows.collect()})
        assert sorted((r.slot, r["rank"]) for r in counts.slots(reads, SMALL, size).collect()) == [(s, i) for i, s in enumerate(used)]
        want = Counter()
        for r in rows.collect():
            want[r.seed_ix, r.code % size // 10, "n"] += 1
            want[r.seed_ix, r.code % size // 10, "s"] += r.code % size
        assert {(r.seed_ix, r.slot_range, k): v for r in counts.slot_sums(reads, SMALL, size, 10).collect() for k, v in (("n", r.n), ("s", r.slot_sum))} == +want | {k: v for k, v in want.items() if not v}
    for error in (0.02, 0.05, 0.2):
        plain = {(r.seed_ix, r.total, r.f0) for r in kmers.distinct_counts_approx(reads, SMALL, error).collect()}
        assert {(r.seed_ix, r.total, r.f0) for r in counts.distinct_counts_approx(reads, SMALL, error).collect()} == plain
    sample = spark.range(100).select((F.col("id") * 123456789).alias("c"), F.xxhash64((F.col("id") * 123456789).alias("c")).alias("h")).collect()
    assert np.array_equal(counts.hashed(np.array([r.c for r in sample])).astype(np.int64), np.array([r.h for r in sample]))
