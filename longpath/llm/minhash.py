"""MinHash near-duplicates: many universal hash minima, banding, signature verification, exact confirmation, components.

A text's set holds its distinct shingles of ``shingle`` words (A-Z lower-cased, words split at ASCII white space); a text
of fewer words is one shingle; a text without words (or null) has the empty set and links with nothing. Two texts link when
100 * |intersection| >= ``percent`` * |union|.

1. A worker hashes words and shingles and takes, for each of bands * rows multiply-shift functions, the minimum over the
   set. Texts of equal sets (128-bit digest) are one class, which the further steps see once.
2. Banding: classes that agree on all minima of a band share a bucket. With 32 bands of 4 a pair of similarity 0.75
   shares none with probability 5e-6.
3. Within a bucket pairs are not listed all: the class of least id is compared with every member, so a group of near copies costs about
   one comparison a member. Components of these links follow.
4. What is left are pairs of a bucket whose members are in different components. The members of buckets that hold
   several components are joined exactly, whatever bucket they met in: with a global order of shingles (rarer ones first, by a
   bounded table of counts) two sets that link share a shingle among the first quarter of both, at places that leave room for
   the overlap needed (prefix and positional filter). For each such shingle the members outside of its largest component meet
   those of other components. Texts that only share a frequent passage never meet, and no pair of a component is listed.
5. A candidate pair is checked by set sizes, then by signatures (one byte a minimum, agreement well below the threshold gives up),
   then by counting the intersection of both full sets.
6. Components by alternating large-star and small-star.

component_id is the least id that a row reaches, itself included; kept says that it is its own. Rows of equal texts,
repeated ids included, share a class. Rows with a null id take part with their text but are no component's name; a class
that has no other id gets a null component_id. Rows of an empty set are their own component. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longpath.llm.common import drop_stored, kernel, stored
from longpath.llm.components import components
from longpath.llm.words import Texts, U, constants, mix, white_space, windows


def shingles(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    t = Texts(batch.column("text"), white_space(), True)
    h = t.h1
    w = windows(h, k, 9)
    out = []
    for a, n in zip(t.first[:-1].tolist(), t.count.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(w[a : a + n - k + 1]))
        elif n:
            c = constants(300 + n, n)
            out.append(mix(np.array([np.bitwise_xor.reduce(mix(h[a : a + n] * c)) + U(n)], U)))
        else:
            out.append(np.empty(0, U))
    return out


class Minima:
    """bands * rows hash minima of sets, by multiply-shift functions x -> (a x + b) mod 2^64, of which the upper half counts."""

    def __init__(self, bands: int, rows: int, seed: int):
        self.bands, self.rows = bands, rows
        self.a, self.b = constants(seed, bands * rows)[:, None], constants(seed + 1, bands * rows)[:, None]

    def signature(self, s: np.ndarray, step: int = 512) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, U)
        for i in range(0, len(s), step):
            np.minimum(low, (self.a * s[None, i : i + step] + self.b).min(1), out=low)
        return (low >> U(32)).astype(np.uint32)

    def buckets(self, signature: np.ndarray) -> np.ndarray:
        rows = signature.reshape(self.bands, self.rows).astype(U)
        return mix((mix(rows + U(1)) * constants(77, self.rows)[None, :]).sum(1, dtype=U) + np.arange(self.bands, dtype=U)).astype(np.int64)


def sketches(docs: DataFrame, shingle: int, bands: int, rows: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """id, h (hash of the text), n (set size), cls (16-byte digest of the set, null if empty), sig (a byte a minimum) and buckets of each text."""

    def make():
        minima = Minima(bands, rows, seed)

        def f(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {x: [] for x in ("n", "cls", "sig", "buckets")}
            for s in shingles(batch, shingle):
                out["n"].append(len(s))
                if len(s):
                    sig = minima.signature(s)
                    out["cls"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    out["sig"].append((sig & np.uint32(255)).astype(np.uint8).tobytes())
                    out["buckets"].append(minima.buckets(sig))
                else:
                    for x in ("cls", "sig", "buckets"):
                        out[x].append(None)
            return {"id": batch.column("id"), "h": batch.column("h"), **out}

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    return kernel(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")), make, f"id {kind}, h bigint, n bigint, cls binary, sig binary, buckets array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """node and set (sorted hashes) of wanted (node, id, cls), from the whole texts of those ids.

    The join is by exchange at every size, as wanted grows with the corpus.
    """
    texts = docs.select(F.col(id_col).alias("t_id"), F.col(text_col).alias("text")).join(wanted.hint("merge"), F.col("t_id").eqNullSafe(F.col("id")))

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            got = zip(batch.column("node").to_pylist(), batch.column("cls").to_pylist(), shingles(batch, shingle), strict=True)
            same = [(n, s.tobytes()) for n, c, s in got if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == c]  # an id may have several texts
            return {"node": [n for n, _ in same], "set": [s for _, s in same]}

        return f

    found = stored(kernel(texts.select("node", "cls", "text"), make, "node bigint, set binary"), "sets")
    return found if found.count() == wanted.count() else stored(found.dropDuplicates(["node"]), "sets")  # repeated rows


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, floor: float) -> DataFrame:
    """pairs (a, b, with sig_a, sig_b) that link: agreement of signatures at least floor, then full sets."""

    def sift(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= floor))

    def count(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                s, t = (s, t) if len(s) <= len(t) else (t, s)
                both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = pairs.mapInArrow(sift, "a bigint, b bigint")
    near = near.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return near.mapInArrow(count, "a bigint, b bigint")


def _counts(sets: DataFrame, bits: int) -> np.ndarray:
    """How many sets have a shingle of each value of its lower bits: 2^bits numbers, whatever the size of the corpus."""

    def run(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("set").to_pylist()), U)
            total += np.bincount((flat & U((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    found = sets.select("set").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, np.int64)
    out[np.asarray(found.column("slot"))] = np.asarray(found.column("n"))
    return out


def prefixes(sets: DataFrame, percent: int, bits: int = 18) -> DataFrame:
    """token, node, root, n and place of the first tokens of each set (node, root, set), rarer ones first, that a linked set must share."""
    counts = _counts(sets, bits)

    def run(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for node, root, x in zip(*(batch.column(c) for c in ("node", "root", "set")), strict=True):
                s = np.frombuffer(x.as_buffer(), U)
                n = len(s)
                need = -(-n * percent // 100)  # a set that links shares at least so many
                first = np.lexsort((s, counts[(s & U((1 << bits) - 1)).astype(np.int64)]))[: n - need + 1]
                for column, v in zip(columns, (s[first].astype(np.int64), np.full(len(first), node.as_py()), np.full(len(first), root.as_py()), np.full(len(first), n), np.arange(len(first))), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for c in columns], names=["token", "node", "root", "n", "place"])

    return sets.mapInArrow(run, "token bigint, node bigint, root bigint, n bigint, place bigint")


def across(tokens: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a < b of nodes of different roots that share a token where both leave room for the overlap."""
    per_root = tokens.groupBy("token", "root").agg(F.count("*").alias("c"))
    main = per_root.groupBy("token").agg(F.max_by("root", "c").alias("main"), F.count("*").alias("roots")).where("roots > 1").select("token", "main")
    mixed = stored(tokens.join(main, "token"), "mixed-tokens")
    one, other = mixed.where("root <> main").select("token", F.col("node").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("place").alias("px")), mixed
    room = F.least(F.col("nx") - F.col("px"), F.col("n") - F.col("place")) * (100 + percent) >= (F.col("nx") + F.col("n")) * percent
    met = one.join(other.drop("main"), "token").where((F.col("rx") != F.col("root")) & room)
    return met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def _classified(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and cls, id, h (of its least row) and root of every class."""
    sketch = stored(sketches(docs, shingle, bands, rows, seed, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sketches")
    # classes, numbered in the order of their least ids
    least = F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("h").alias("h"), F.col("row").alias("row"))).alias("head")
    heads = sketch.where("cls is not null").groupBy("cls").agg(least).select("cls", "head.*")
    heads = heads.repartitionByRange("last", "id", "row").sortWithinPartitions("last", "id", "row").withColumn("node", F.monotonically_increasing_id())
    heads = stored(heads.select("cls", "id", "h", "row", "node"), "classes")
    placed = sketch.select("row", "buckets").join(heads.select("row", "node"), "row").select("node", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).where("size > 1")
    placed = stored(placed.join(shared.select("bucket", "pivot"), "bucket"), "buckets")  # classes that share a bucket
    involved = stored(heads.join(placed.select("node").distinct(), "node"), "involved")
    sigs = stored(sketch.select("row", "n", "sig").join(involved.select("row", "node"), "row").drop("row"), "signatures")
    sets = full_sets(docs, involved.select("node", "id", "cls"), shingle, id_col, text_col)
    # more than five deviations below the threshold, so that hardly any link is given up
    floor = percent / 100 - 5.5 * (percent / 100 * (1 - percent / 100) / (bands * rows)) ** 0.5

    def linked(pairs: DataFrame) -> DataFrame:
        left, right = (sigs.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab")
        sized = pairs.join(left, "a").join(right, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        return confirmed(sized, sets, percent, floor)

    def rooted(nodes: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
        return nodes.join(roots.select(F.col("node").alias(node), F.col("root").alias(root)), node, "left").withColumn(root, F.coalesce(root, node))

    links = stored(linked(placed.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()), "links")
    roots = stored(components(links), "roots")
    where = rooted(rooted(placed, roots, "node", "root"), roots, "pivot", "main")
    several = where.where("root <> main").select("bucket").distinct()
    members = where.join(several, "bucket", "left_semi").select("node", "root").distinct()
    mixed = stored(sets.join(members, "node"), "mixed-sets")
    tokens = stored(prefixes(mixed, percent), "tokens")
    more = stored(linked(across(tokens, percent)), "links")
    if not more.isEmpty():
        roots = stored(components(links.unionByName(more)), "roots")
    drop_stored(placed, involved, sigs, sets, mixed, tokens, links, more)
    return sketch, rooted(heads.select("cls", "id", "h", "node"), roots, "node", "root")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, seed: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept of every row of docs."""
    sketch, names = _classified(docs, id_col, text_col, shingle, percent, bands, rows, seed)
    least_id = names.groupBy("root").agg(F.min("id").alias("component_id"))
    verdict = names.join(least_id, "root").select("cls", "component_id")
    out = sketch.select("id", "n", "cls").join(verdict, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs with one row of each component: the one of least id (a null id comes last) and, of several texts of that id, of least hash.

    Texts without words are their own components: of rows of equal id one stays, with a null id all.
    """
    sketch, names = _classified(docs, id_col, text_col, **settings)
    head = F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("h").alias("h"))).alias("head")
    blank = sketch.where("cls is null").select("id", "h")
    kept = names.groupBy("root").agg(head).select("head.id", "head.h").unionByName(blank.where("id is not null")).select(F.col("id").alias("kept_id"), F.col("h").alias("kept_h"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    left = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("h") == F.col("kept_h")), "left_semi").dropDuplicates(["id", "h"])
    unnamed = rows.where("id is null").join(blank.where("id is null").select(F.col("h").alias("kept_h")).distinct(), F.col("h") == F.col("kept_h"), "left_semi")
    return left.unionByName(unnamed).select("doc.*")
