import random

import pytest

from longpath.plans.config import SMALL
from longpath.sources import fastq
from longpath.streaming.select import select_stream
from longpath.operators import select


def records(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.randint(1, 400)
        qual = "".join(chr(33 + rng.randint(0, 40)) for _ in range(k))
        out.append((f"r{i}", "".join(rng.choice("ACGT") for _ in range(k)), ("@" + qual[1:]) if i % 3 == 0 else qual))  # a quality may begin with @
    return out


def text(rows, comment=""):
    return "".join(f"@{i}{comment}\n{s}\n+\n{q}\n" for i, s, q in rows)


@pytest.mark.parametrize("split", [150, 1000, 1 << 20])
def test_splits_do_not_matter(spark, tmp_path, split):
    rows = records(120)
    (tmp_path / "a.fq").write_text(text(rows[:70], " ch=5"))
    (tmp_path / "b.fastq").write_text(text(rows[70:]).rstrip("\n"))
    got = fastq.read_fastq(spark, str(tmp_path), split).orderBy("read_ix").collect()
    assert [(r.id, r.seq, r.qual) for r in got] == rows and len({r.read_ix for r in got}) == len(rows)


def test_other_formats_fail(spark, tmp_path):
    (tmp_path / "x.fq").write_text(">r1\nACGT\n")
    with pytest.raises(Exception, match="FASTQ"):
        fastq.read_fastq(spark, str(tmp_path / "x.fq")).collect()
    (tmp_path / "y.fq").write_text(text(records(3)) + "@r9\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="malformed"):
        fastq.read_fastq(spark, str(tmp_path / "y.fq")).collect()


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.fq").write_text("")
    assert fastq.read_fastq(spark, str(tmp_path / "e.fq")).count() == 0


def test_discovery_and_exclusions(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("")
    assert fastq.find_reads(str(tmp_path / "r")).endswith("r.fastq")
    (tmp_path / "r.fq").write_text("")
    assert fastq.find_reads(str(tmp_path / "r")).endswith("r.fq")
    with pytest.raises(FileNotFoundError):
        fastq.find_reads(str(tmp_path / "none"))
    (tmp_path / "names").write_text("a b\n\n c\ta\n")
    assert sorted(r.id for r in fastq.read_exclusions(spark, str(tmp_path / "names")).collect()) == ["a", "b", "c"]


def test_written_paths_read_back(spark, tmp_path):
    rows = [(1 + i % 2, i, f"h{i}", "ACGT" * (i + 1), "IIII" * (i + 1)) for i in range(6)]
    df = spark.createDataFrame(rows, "path_no int, read_ix long, header string, seq string, qual string")
    fastq.write_paths(df, str(tmp_path / "q"), fasta=False)
    for p in (1, 2):
        got = "".join(f.read_text() for f in sorted((tmp_path / "q" / f"path_no={p}").glob("*.txt")))
        assert got == text([(r[2], r[3], r[4]) for r in rows if r[0] == p])
    fastq.write_paths(df, str(tmp_path / "a"), fasta=True)
    assert "".join(f.read_text() for f in sorted((tmp_path / "a" / "path_no=1").glob("*.txt"))).startswith(">h0\nACGT\n>h2\n")


def test_stream_selects_like_the_batch(spark, tmp_path):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randint(600, 1500))) for _ in range(20)]
    reads = [(i, s) for i, s in enumerate(seqs + seqs[:8])]
    want = sorted(map(tuple, select.greedy_select(spark.createDataFrame(reads, "read_ix long, seq string"), SMALL).collect()))
    for k in range(4):
        spark.createDataFrame(reads[k * 7 : k * 7 + 7], "read_ix long, seq string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("read_ix long, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = select_stream(stream, SMALL).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_command_line_runs_both_rounds(spark, tmp_path, capsys):
    import json

    from longpath.__main__ import main

    rng = random.Random(3)
    genome = "".join(rng.choice("ACGT") for _ in range(30_000))
    rows = []
    for i in range(60):
        a = rng.randrange(0, 27_000)
        s = genome[a : a + rng.randint(1500, 3000)]
        rows.append((f"r{i}", s, "5" * len(s)))
    (tmp_path / "reads.fq").write_text(text(rows))
    (tmp_path / "names").write_text("r1 r2\n")
    out = tmp_path / "out"
    run = ["path", "--reads", str(tmp_path / "reads"), "--out", str(out), "--genome-size", "3e4", "--min-length", "1000", "--tile", "100", "--block", "2", "--min-unassigned", "3", "--exclude", str(tmp_path / "names"), "--keep-silver"]
    assert main(run) == 0
    said = capsys.readouterr()
    report = json.loads(said.out)
    assert report["reads"] == 60 and report["passed"] == 60 and report["silver_paths"] < 5 and "expected 5 silver paths" in said.err
    golden = "".join(f.read_text() for f in (out / "golden" / "path_no=1").glob("*.txt"))
    silver = "".join(f.read_text() for f in (out / "silver").glob("*/*.txt"))
    assert golden.count(">r") > 3 and "@r1_" not in silver and "@r3" in silver
    assert json.loads("".join(f.read_text() for f in (out / "parameters.json").glob("*.txt")))["genome_size"] == 30_000
    assert list((out / "stats" / "golden").glob("*.csv")) and list((out / "counters").glob("*.csv"))
    assert main(["clean", "--out", str(out)]) == 0 and not (out / "silver").exists() and (out / "golden").exists()
    by_ranges = [str(tmp_path / "ranges") if x == str(out) else x for x in run]
    assert main([*by_ranges, "--ranges", "2", "--max-paths", "2"]) == 0
    assert json.loads(capsys.readouterr().out)["passed"] == 60 and list((tmp_path / "ranges" / "stats" / "golden").glob("*.csv"))
    again = "".join(f.read_text() for f in (tmp_path / "ranges" / "golden" / "path_no=1").glob("*.txt"))
    assert again.count(">r") > 3 and 0.7 < len(again) / len(golden) < 1.4
    assert main([*run[:6], "0", "--min-length", "1000"]) == 1 and "genome size" in capsys.readouterr().err
    assert main([*run[:7], "--min-length", "100000"]) == 1 and "no read passed" in capsys.readouterr().err
    assert main(["version"]) == 0 and main(["help"]) == 0


def test_a_run_needs_a_genome_size():
    from longpath.plans.config import PathConfig

    with pytest.raises(ValueError, match="genome size"):
        PathConfig().for_run()
    with pytest.raises(ValueError, match="at most 31"):
        PathConfig(preset="", span=40, weight=31)
    with pytest.raises(ValueError, match="positive"):
        PathConfig(preset="", span=0)
