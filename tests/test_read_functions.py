import math

import pytest
from pyspark.sql import functions as F

from longpath.functions import bloom, quality
from longpath.functions.seeds import care_positions, seed_patterns, skip_positions
from longpath.operators import qc
from longpath.plans.config import SMALL, PathConfig


def scores(spark, quals):
    df = spark.createDataFrame([(q,) for q in quals], "qual string")
    df = df.withColumn("s", quality.error_sums(F.col("qual")))
    return [(r.m, r.d) for r in df.select(quality.mean_phred(F.col("s"), F.length("qual")).alias("m"), quality.half_delta(F.col("s"), F.length("qual")).alias("d")).collect()]


def test_quality(spark):
    assert scores(spark, ["IIII5555", "IIII", "IIIII", ""]) == [(22, 20), (40, 0), (40, 1), (None, 0)]
    df = spark.createDataFrame([("!5I",)], "qual string")
    row = df.select(quality.scores(F.col("qual")).alias("s"), quality.error_sum(F.col("qual")).alias("e")).first()
    assert row.s == [0, 20, 40] and row.e == pytest.approx(1.0101)


def test_seeds():
    assert SMALL.seeds == ["1011011110110111101101", "10110111101010111101101", "101101111010010111101101"]
    drawn = seed_patterns("", 22, 16, 3)
    assert drawn == seed_patterns("", 22, 16, 3) and all(p.count("1") == 16 and p == p[::-1] and p[0] == "1" for p in drawn) and [len(p) for p in drawn] == [22, 23, 24]
    assert sorted(care_positions("101") + skip_positions("101")) == [0, 1, 2]


def test_config():
    for bad in ({"span": 21}, {"weight": 15}, {"span": 0}, {"tile": 0}):
        with pytest.raises(ValueError):
            PathConfig(**bad)
    assert PathConfig(genome_size=1000).target_bases == 900 and PathConfig().golden().min_length == 0


def test_sizes(spark):
    assert bloom.filter_size(1000, 0.1) % 64 == 0
    n = next(n for n in range(1, 10000) if int(-n / math.log(0.9)) % 64 == 0)
    assert bloom.filter_size(n, 0.1) == int(-n / math.log(0.9)) + 64
    assert bloom.hash_universe(16, 3_000_000_000, 3) == int(4**16 * 1.5) and bloom.hash_universe(16, 1000, 3) == 3000
    assert bloom.hash_universe(16, 1000, 3, given=5) == 5 and bloom.hash_universe(16, 1000, 3, counted=7) == 7
    df = spark.createDataFrame([(1000,), (123456,)], "n long")
    assert [r[0] for r in df.select(bloom.filter_size_column(F.col("n"), 0.1)).collect()] == [bloom.filter_size(1000, 0.1), bloom.filter_size(123456, 0.1)]


def test_quality_control(spark):
    good, low, uneven = "5" * 600, "$" * 600, "I" * 300 + "$" * 300
    rows = [(0, "a", "ACGT" * 150, good), (1, "b", "ACGT" * 100, good[:400]), (2, "c", "ACGT" * 150, low), (3, "d", "ACGT" * 150, uneven), (4, "e", "ACGN" * 150, good), (5, "f", "acgt" * 150, good)]
    reads = spark.createDataFrame(rows, "read_ix long, id string, seq string, qual string")
    assert [r.id for r in qc.passing(reads, SMALL).orderBy("read_ix").collect()] == ["a", "f"]
    assert [r.id for r in qc.passing(reads, SMALL, spark.createDataFrame([("a",)], "id string")).collect()] == ["f"]
    c = qc.counters(reads, SMALL).first()
    assert (c.reads, c.too_short, c.low_phred, c.high_delta, c.bad_alphabet, c.passed) == (6, 1, 2, 1, 1, 2)
    assert qc.passing(reads.limit(0), SMALL).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 6])
def test_threshold_is_the_lower_median(spark, n):
    quals = [chr(33 + 12 + i) * 600 for i in range(n)]
    reads = spark.createDataFrame([(i, str(i), "ACGT" * 150, q) for i, q in enumerate(quals)], "read_ix long, id string, seq string, qual string")
    want = sorted((12 + i for i in range(n)), reverse=True)[n // 2]
    assert qc.phred_threshold(reads, SMALL).first()[0] == want
    poor = reads.withColumn("qual", F.repeat(F.lit("%"), 600))
    assert qc.phred_threshold(poor, SMALL).first()[0] == 10
    assert qc.phred_threshold(reads, PathConfig(min_phred=17)).first()[0] == 17
