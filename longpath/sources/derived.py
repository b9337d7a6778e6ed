"""Reads derived from the documents table by character translation, the test input of the read operators.

Characters are translated in a kernel over Arrow batches, by a table of 256 bytes: each text once. As column expressions Spark would translate it anew wherever a filter, a decision or a cut mentions it, at some 50 ns a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FROM = "etaoinshrdlcumwfgypbvkjxqz .,!%*&$|#éóèñçêüäößí\n"
TO_SEQ = ("ACGT" * 12)[: len(FROM)]
TO_QUAL = "".join(chr(43 + 5 * i % 21) for i in range(len(FROM)))


HANDED = 1 << 20  # characters handed on at once


def _byte_table(to: str) -> bytes:
    """By code point below 256, which all of FROM are, what becomes of it."""
    table = bytearray(range(256))
    for a, b in zip(FROM, to, strict=True):
        table[ord(a)] = ord(b)
    return bytes(table)


def translated(text: str, table: bytes) -> bytes:
    """text with its characters below 256 replaced, as UTF-8."""
    try:
        out = text.encode("latin-1").translate(table)
        return out if out.isascii() else out.decode("latin-1").encode()
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        low = codes < 256
        codes[low] = np.frombuffer(table, np.uint8)[codes[low]]
        return codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def _translate(batches: Iterator[pa.RecordBatch], least: int | None = None) -> Iterator[pa.RecordBatch]:
    """read_ix, seq and qual of batches (read_ix, low), handed on every HANDED characters; with least only reads of so many characters at least that are all bases."""
    to_seq, to_qual = _byte_table(TO_SEQ), _byte_table(TO_QUAL)
    if least is not None:
        batches = (batch.filter(_plain(batch.column("low"), least, to_seq)) for batch in batches)
    for batch in batches:
        numbers, seqs, quals, begin, held = batch.column("read_ix"), [], [], 0, 0
        for i, (number, low) in enumerate(zip(numbers.to_pylist(), batch.column("low"), strict=True)):
            if not low.is_valid:
                seqs.append(None)
                quals.append(None)
            else:
                text = low.as_buffer().to_pybytes().decode("utf-8", "surrogateescape")
                n, qual = len(text), None
                if number is not None and number % 13 == 0:
                    qual = b"%" * n
                elif number is not None and number % 11 == 0:
                    qual = translated(text[: n // 2], to_qual) + b"$" * (n - n // 2)
                seqs.append(translated(text, to_seq))
                quals.append(translated(text, to_qual) if qual is None else qual)
                held += n
            if held >= HANDED or i == batch.num_rows - 1:
                made = [pa.array(c, pa.binary()).view(pa.string()) for c in (seqs, quals)]
                yield pa.RecordBatch.from_arrays([numbers.slice(begin, i + 1 - begin), *made], names=["read_ix", "seq", "qual"])
                seqs, quals, begin, held = [], [], i + 1, 0


def _plain(column: pa.Array, least: int, to_seq: bytes) -> pa.Array:
    """Which texts have so many characters at least, all of which become bases."""
    base = bytes(c for c in range(256) if to_seq[c] in b"ACGTacgt")
    out = []
    for x in column:
        raw = x.as_buffer().to_pybytes() if x.is_valid else b""
        if not raw.isascii():
            raw = raw.decode("utf-8", "surrogateescape").encode("latin-1", "replace")  # no base becomes of ?
        out.append(x.is_valid and len(raw) >= least and not raw.translate(None, base))
    return pa.array(out, pa.bool_())


def derived_reads(spark: SparkSession, sf_dir: str, least: int | None = None) -> DataFrame:
    """read_ix, id, seq and qual of every document; a few have low quality throughout or in their second half. With least only of those of so many characters at least that are all bases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # a small file of one row group would keep all work in one task
        docs = docs.repartition(cores)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def made(batches):
        return _translate(batches, least)

    simple = F.replace(F.replace("text", F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i"))  # each character by itself, as in SQL: Java minds the end of a word, and makes two of the last
    rows = docs.select(F.col("doc_id").alias("read_ix"), F.lower(simple).alias("low")).mapInArrow(made, f"read_ix {kind}, seq string, qual string")
    return rows.select("read_ix", F.concat(F.lit("r"), F.col("read_ix")).alias("id"), "seq", "qual")


def reads_sql() -> str:
    """The same reads in DuckDB's SQL, as a WITH item named reads."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    q = f"translate(low, {quote(FROM)}, {quote(TO_QUAL)})"
    return f"""reads AS (
  SELECT doc_id AS read_ix, 'r' || doc_id AS id, translate(low, {quote(FROM)}, {quote(TO_SEQ)}) AS seq,
    CASE WHEN doc_id % 13 = 0 THEN repeat('%', length(low)) WHEN doc_id % 11 = 0 THEN substr({q}, 1, length(low) // 2) || repeat('$', length(low) - length(low) // 2) ELSE {q} END AS qual
  FROM (SELECT doc_id, lower(text) AS low FROM documents))"""
