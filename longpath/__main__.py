"""Command line: python -m longpath path --reads reads.fq --genome-size 3e9 --out folder (also: clean, version, help)."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from longpath import __version__
from longpath.plans.config import PathConfig
from longpath.plans.run import clean, run_paths


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="longpath", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    path = commands.add_parser("path", help="select silver paths and the golden path of a read set")
    path.add_argument("--reads", required=True, help="a FASTQ file, a folder of them, or a name without .fq or .fastq")
    path.add_argument("--out", required=True, help="folder for silver/, golden/, stats/ and parameters.json")
    path.add_argument("--exclude", help="a list of read names to leave out")
    path.add_argument("--genome-size", type=float, required=True)
    path.add_argument("--keep-silver", action="store_true", help="leave the silver paths where they are")
    path.add_argument("--shards", type=int, default=1, help="independent folds of the first round")
    path.add_argument("--ranges", type=int, default=0, help="select by so many ranges of reads and merges of them, instead of one fold")
    default = PathConfig()
    for name in ("min_length", "min_phred", "max_delta", "tile", "block", "span", "weight", "patterns", "hits", "min_unassigned", "max_assigned", "max_paths"):
        path.add_argument(f"--{name.replace('_', '-')}", type=int, default=getattr(default, name))
    path.add_argument("--ratio", type=float, default=default.ratio)
    path.add_argument("--preset", default=default.preset)
    gone = commands.add_parser("clean", help="delete the silver paths of a finished run")
    gone.add_argument("--out", required=True)
    commands.add_parser("version")
    commands.add_parser("help")
    return out


def main(arguments: list[str] | None = None) -> int:
    options = parser().parse_args(arguments)
    if options.command == "version":
        print(f"longpath {__version__}")
        return 0
    if options.command == "help":
        parser().print_help()
        return 0
    spark = SparkSession.builder.appName(f"longpath {options.command}").getOrCreate()
    if options.command == "clean":
        clean(spark, options.out)
        return 0
    try:
        config = PathConfig(**{k: v for k, v in vars(options).items() if k in PathConfig.__dataclass_fields__ and k != "genome_size"}, genome_size=int(options.genome_size))
        print(json.dumps(asdict(config)), file=sys.stderr)
        report = run_paths(spark, options.reads, options.out, config, options.exclude, options.shards, options.keep_silver, options.ranges)
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    for line in report["warnings"]:
        print(f"warning: {line}", file=sys.stderr)
    print(json.dumps({k: v for k, v in report.items() if k != "warnings"}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
