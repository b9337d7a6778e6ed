"""FASTQ and FASTA: a splittable reader, and writers.

The reader is a Python data source: a file is cut at byte ranges; a task finds the first record that begins in its range
(a line with @, whose second next line begins with + and whose sequence and quality have one length) and reads up to the first record of
the next range. read_ix is the record's byte offset, with the number of the file (by name) above it, so it grows in
input order and does not depend on the cuts. A record that doesn't follow the format fails the read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "read_ix bigint, id string, seq string, qual string"
FILE_SHIFT = 44  # a file may have 16 TB


class ByteRange(InputPartition):
    def __init__(self, path: str, number: int, begin: int, end: int):
        self.path, self.number, self.begin, self.end = path, number, begin, end


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _line(f, at: int) -> tuple[bytes, int]:
    """The line that begins at a position, without its end, and where the next begins."""
    f.seek(at)
    out = b""
    while True:
        part = f.read(1 << 16)
        n = part.find(b"\n")
        if n >= 0:
            return (out + part[:n]).removesuffix(b"\r"), at + len(out) + n + 1
        out += part
        if not part:
            return out.removesuffix(b"\r"), at + len(out)


def first_record(f, begin: int, size: int) -> int:
    """Where the first record at or after a position begins."""
    at = begin
    if at:
        _, at = _line(f, at - 1)
    while at < size:
        head, b = _line(f, at)
        if head.startswith(b"@"):
            seq, c = _line(f, b)
            plus, d = _line(f, c)
            qual, _ = _line(f, d)
            if plus.startswith(b"+") and len(seq) == len(qual):
                return at
        if begin == 0 and head.strip():
            raise ValueError("not a FASTQ file: the first record is malformed")
        at = b
    return size


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", 64 << 20))
        self.suffixes = tuple(options.get("suffixes", ".fq,.fastq").split(","))

    def partitions(self) -> list[ByteRange]:
        from pyarrow import fs

        system, path = _filesystem(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and x.base_name.endswith(self.suffixes)]
        out = []
        for number, x in enumerate(sorted(files, key=lambda x: x.path)):
            out += [ByteRange(x.path, number, a, min(a + self.split, x.size)) for a in range(0, x.size, self.split)]
        return out or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = _filesystem(self.path)
        with system.open_input_file(partition.path) as f:
            size = f.size()
            at, last = first_record(f, partition.begin, size), partition.end
            f.seek(at)
            lines = _lines(f)
            while at < last:
                head = next(lines, b"")
                if not head.strip():
                    if at >= size or not head:
                        return
                    at += len(head)
                    continue
                record = [head, *(next(lines, b"") for _ in range(3))]
                text = [x.rstrip(b"\r\n") for x in record]
                if not text[0].startswith(b"@") or not text[2].startswith(b"+") or len(text[1]) != len(text[3]):
                    raise ValueError(f"malformed FASTQ record at byte {at} of {partition.path}")
                name = text[0][1:].split()
                yield (partition.number << FILE_SHIFT) + at, (name[0] if name else b"").decode(), text[1].decode(), text[3].decode()
                at += sum(map(len, record))


def _lines(f) -> Iterator[bytes]:
    rest = b""
    while part := f.read(1 << 20):
        whole = (rest + part).split(b"\n")
        rest = whole.pop()
        for x in whole:
            yield x + b"\n"
    if rest:
        yield rest


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, path: str, split_bytes: int = 64 << 20, suffixes: str = ".fq,.fastq") -> DataFrame:
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("splitbytes", split_bytes).option("suffixes", suffixes).load(path)


def read_paths(spark: SparkSession, folder: str) -> DataFrame:
    """path_no and the reads of FASTQ paths that write_paths() wrote, path by path (a few)."""
    system, path = _filesystem(folder)
    from pyarrow import fs

    numbers = sorted(int(x.base_name.split("=")[1]) for x in system.get_file_info(fs.FileSelector(path)) if x.base_name.startswith("path_no="))
    out = None
    for n in numbers:
        rows = read_fastq(spark, f"{folder}/path_no={n}", suffixes=".txt").select(F.lit(n).alias("path_no"), "read_ix", "id", "seq", "qual")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], f"path_no int, {SCHEMA}")


def write_fastq(rows: DataFrame, folder: str) -> None:
    """Rows (header, seq, qual) as FASTQ text, a file a partition."""
    fastq_text(rows).write.mode("overwrite").text(folder)


def exists(path: str) -> bool:
    """Whether a file or folder is there."""
    from pyarrow import fs

    system, found = _filesystem(path)
    return system.get_file_info(found).type != fs.FileType.NotFound


def find_reads(prefix: str) -> str:
    """prefix.fq if it exists, else prefix.fastq."""
    from pyarrow import fs

    for suffix in (".fq", ".fastq"):
        system, path = _filesystem(prefix + suffix)
        if system.get_file_info(path).type == fs.FileType.File:
            return prefix + suffix
    raise FileNotFoundError(f"neither {prefix}.fq nor {prefix}.fastq")


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """id of every name in a list separated by white space."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("id")).where("id <> ''").distinct()


def fasta_text(rows: DataFrame) -> DataFrame:
    """value: the FASTA record of each row (header, seq)."""
    return rows.select(F.concat_ws("\n", F.concat(F.lit(">"), F.col("header")), "seq").alias("value"))


def fastq_text(rows: DataFrame) -> DataFrame:
    """value: the FASTQ record of each row (header, seq, qual)."""
    return rows.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("header")), "seq", F.lit("+"), "qual").alias("value"))


def write_paths(pieces: DataFrame, folder: str, fasta: bool) -> None:
    """Pieces (path_no, order, header, seq, qual) as text below path_no=<n>/, in order within each path."""
    rows = pieces.repartitionByRange("path_no", "read_ix").sortWithinPartitions("path_no", "read_ix")
    value = F.concat_ws("\n", F.concat(F.lit(">"), F.col("header")), "seq") if fasta else F.concat_ws("\n", F.concat(F.lit("@"), F.col("header")), "seq", F.lit("+"), "qual")
    rows.select("path_no", value.alias("value")).write.mode("overwrite").partitionBy("path_no").text(folder)
