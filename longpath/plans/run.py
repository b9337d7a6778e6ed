"""A whole run from FASTQ to paths on disk, with its parameters, counters and warnings.

Layout of the output folder: parameters.json/ (one line), silver/path_no=<n>/ (FASTQ text), golden/path_no=<n>/ (FASTA text),
stats/ (a CSV row a path and round), counters/ (one CSV row of quality control).
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from longpath.functions.quality import error_sum, path_phred
from longpath.operators.qc import observed_passing, passing
from longpath.operators.reduce import emitted, reduced, reduced_paths
from longpath.operators.select import greedy_select, path_stats, pieces
from longpath.plans.config import PathConfig
from longpath.plans.pipeline import silver_union
from longpath.sources import fastq
from longpath.sources.files import delete, drop_stored, input_bytes, stored


def _one_file(df: DataFrame, folder: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)  # a few rows


def checked(passed: int) -> None:
    if not passed:
        raise ValueError("no read passed the checks of quality and length; try a lower score or minimum length")


def shortfall(config: PathConfig, last_path: int) -> list[str]:
    """A warning if fewer than max_paths paths were begun."""
    if last_path >= config.max_paths:
        return []
    return [f"expected {config.max_paths} silver paths, got {last_path}: the reads may be sorted by place, or the genome size too large"]


def _by_ranges(reads: DataFrame, config: PathConfig, folder: str, stats: str, rollover: bool, fasta: bool, ranges: int) -> int:
    """A round by ranges and merges: no task visits more than one range. Its statistics are those of what is emitted."""
    kept = reduced_paths(reads, config, ranges) if rollover else reduced(reads, config, ranges).withColumn("path_no", F.lit(1))
    found = stored(emitted(reads, kept.select("path_no", "read_ix", "whole", "start", "seq")), "emitted")
    fastq.write_paths(found, folder, fasta)
    own = found.groupBy("path_no").agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"), F.sum(error_sum(F.col("qual"))).alias("errors"))
    _one_file(own.select("path_no", "reads", "bases", path_phred(F.col("errors"), F.col("bases")).alias("avg_phred")), stats)
    last = found.agg(F.max("path_no")).first()[0] or 1
    drop_stored(found)
    return last


def _round(reads: DataFrame, config: PathConfig, folder: str, stats: str, rollover: bool, fasta: bool, shards: int) -> int:
    """Selects and writes one round's paths and their statistics; returns the number of the last path begun."""
    decisions = greedy_select(reads, config, rollover, shards).persist()
    try:
        found = pieces(reads, decisions, config)
        fastq.write_paths(found, folder, fasta)
        _one_file(path_stats(found, decisions), stats)
        return decisions.agg(F.max("path_no")).first()[0] or 1
    finally:
        decisions.unpersist()


def run_paths(spark: SparkSession, reads: str, out: str, config: PathConfig, exclude: str | None = None, shards: int = 1, keep_silver: bool = False, ranges: int = 0) -> dict:
    """Both rounds over a FASTQ input; returns counters, the number of silver paths and warnings. Raises ValueError if no read passes.

    The input is read once for quality control, its counters being observed on the way (and its first long reads before, for the median score). With ranges
    both rounds go by ranges and merges instead of one fold.
    """
    config.for_run()
    path = reads if fastq.exists(reads) else fastq.find_reads(reads)
    source = fastq.read_fastq(spark, path)
    names = fastq.read_exclusions(spark, exclude) if exclude else None
    seen = Observation("quality control")
    good = stored(observed_passing(source, config, seen), "passing")
    report = seen.get
    _one_file(spark.createDataFrame([tuple(report.values())], ", ".join(f"{k} bigint" for k in report)), f"{out}/counters")
    checked(report["passed"])
    spark.createDataFrame([(json.dumps(asdict(config) | {"reads": path, "input_bytes": input_bytes(spark, path)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/parameters.json")
    if names is not None:
        good = good.join(names.select("id"), "id", "left_anti").select(*good.columns)
    silver = f"{out}/silver"
    last = _by_ranges(good, config, silver, f"{out}/stats/silver", True, False, ranges) if ranges else _round(good, config, silver, f"{out}/stats/silver", True, False, shards)
    second = config.golden()
    written = fastq.read_paths(spark, silver)
    union = silver_union(written.select("path_no", "read_ix", F.col("id").alias("header"), "seq", "qual"))
    again = stored(passing(union, second), "passing")
    if ranges:
        _by_ranges(again, second, f"{out}/golden", f"{out}/stats/golden", False, True, ranges)
    else:
        _round(again, second, f"{out}/golden", f"{out}/stats/golden", False, True, 1)
    drop_stored(good, again)
    if not keep_silver:
        clean(spark, out)
    return report | {"silver_paths": last, "warnings": shortfall(config, last)}


def clean(spark: SparkSession, out: str) -> None:
    """Deletes the silver paths; the golden path, statistics and parameters stay."""
    delete(spark, f"{out}/silver")
