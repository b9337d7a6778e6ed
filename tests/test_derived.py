"""The step from documents to reads, and what measures them: kernels over Arrow batches, each text handled once."""

import re

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__
from longpath.functions import quality
from longpath.operators import tiles
from longpath.sources import derived


def test_reads_are_translated_once_in_a_kernel(spark, tmp_path):
    rows = [(1, "The quick, brown fox"), (13, "äÉñ x"), (22, "odd Ünit é!"), (3, "日本 abc €"), (4, ""), (5, None), (None, "No number"), (11, "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = derived.derived_reads(spark, str(tmp_path))
    low, n = F.lower("text"), F.length("text")
    qual = F.translate(low, derived.FROM, derived.TO_QUAL)
    half = F.concat(F.substr(qual, F.lit(1), F.floor(n / 2).cast("int")), F.repeat(F.lit("$"), (n - F.floor(n / 2)).cast("int")))
    qual = F.when(F.col("doc_id") % 13 == 0, F.repeat(F.lit("%"), n)).when(F.col("doc_id") % 11 == 0, half).otherwise(qual)
    want = spark.createDataFrame(rows, "doc_id bigint, text string").select(F.col("doc_id").alias("read_ix"), F.concat(F.lit("r"), F.col("doc_id")).alias("id"), F.translate(low, derived.FROM, derived.TO_SEQ).alias("seq"), qual.alias("qual"))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    plan = found.where(F.length("seq") > 3).select("read_ix", F.length("seq"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\btranslate\(", plan) and plan.count("lower(") == 1


def test_error_sums_of_odd_qualities(spark):
    rows = [("+5?",), ("",), (None,), ("é€+",)]
    got = [tuple(x[0]) for x in spark.createDataFrame(rows, "q string").coalesce(1).select(quality.error_sums(F.col("q"))).collect()]
    table = 10.0 ** (-(np.arange(256) - 33) / 10.0)
    for (total, first), (q,) in zip(got, rows, strict=True):
        e = table[np.frombuffer((q or "").encode("latin-1", "replace"), np.uint8)]
        assert (total, first) == (e.sum(), e[: len(e) // 2].sum())


def test_candidates_become_objects_slice_by_slice():
    found = pa.array([[1] * 5, None, [], [2] * 40, [3], [4] * 9, [5]], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), found], names=["read_ix", "found"])
    parts = list(tiles.sliced(batch, "found", 10))
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
    assert len(parts) > 3 and all(p.num_rows == 1 or sum(len(x or ()) for x in p.column("found").to_pylist()) <= 10 for p in parts)
    assert not list(tiles.sliced(batch.slice(0, 0), "found"))


def test_scores_of_empty_and_odd_texts_as_in_sql(spark, tmp_path):
    rows = [(1, ""), (2, "ΟΔΟΣ ΣΑΣ."), (3, "İstanbul ÉÑ ſK"), (4, None), (13, ""), (13, "日本 x"), (11, "odd 🙂🙂"), (22, ""), (None, "plain\n")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in __spark_entry__.queries()["phred_decode"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["phred_decode"]).fetchall()
    assert sorted(found) == sorted(want) and (-34, 3) in [r[:2] for r in found]


def test_plain_reads_are_filtered_in_the_kernel(spark, tmp_path):
    rows = [(1, "the quick"), (2, "the qui"), (3, "a b?c d e f"), (4, "äÉñ xüß"), (5, "äÉñ xüßé"), (6, None), (None, "no number"), (7, "日本 abc def"), (8, ""), (9, "tab\tab there"), (10, "ACGT <> acgt"), (11, "line\nline")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = derived.derived_reads(spark, str(tmp_path)).where((F.length("seq") >= 8) & ~F.col("seq").rlike(quality.BAD_BASE))
    found = derived.derived_reads(spark, str(tmp_path), 8)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and want.count() > 3
    assert "rlike" not in found._jdf.queryExecution().executedPlan().toString().lower()
