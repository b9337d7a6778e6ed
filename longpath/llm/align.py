"""Cross-tokenizer alignment by an associative monoid of fragments.

Two tokenizers cut the same bytes (a space and the text). Byte places where tokens of both end are cuts; the tokens between two cuts are a
group, and an A and a B token whose byte ranges overlap are a link. A fragment stands for a byte range of a text: an open
prefix (its tokens up to its first cut), closed groups, and an open suffix (its tokens after its last cut); without a cut all
is prefix. Fragments compose: the first one's suffix and the second one's prefix make a group, if each has a cut, else an
open part grows. That is associative, so the fragments of a long text are composed by a tree over tasks, ``FAN`` neighbours
at a time, whose open parts are small; the text of its groups is as long as the text itself. Texts of one byte range are closed where they are tokenized.

Links are counted as (A id, B id) pairs of a text. Their counts over the corpus come by partial aggregation, and go back by broadcast up to ``SMALL`` distinct pairs,
else by a join that Spark splits where a pair is frequent.

A text is tokenized whole, in one task. Null and empty texts, and texts whose tokens do not give back their bytes (characters that a
tokenizer replaces), have no tokens: zeros, and '' for groups. Rows count by themselves, whatever their id: repeated and null ids give a row each.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longpath.llm.common import kernel, schema_of, stored

CHUNK, FAN, SMALL = 1 << 16, 8, 1 << 21
BITS = 24  # of a B id within a pair
FRAGMENT = "row bigint, id {kind}, part int, parts int, cut boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, head binary, tail binary, closed binary, pairs binary, counts binary"


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """A tokenizer: ids of texts, and the bytes of each id."""

    def __init__(self, raw: list[bytes], encode):
        self.raw, self.encode = raw, encode
        self.size = np.array([len(x) for x in raw], np.int64)
        digits = [str(i).encode() for i in range(len(raw))]
        self.width = np.array([len(d) for d in digits], np.int64)
        self.digits = np.zeros((len(raw), max(map(len, digits), default=0) + 1), np.uint8)  # and room for a separator
        for i, d in enumerate(digits):
            self.digits[i, : len(d)] = np.frombuffer(d, np.uint8)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


@lru_cache(maxsize=2)
def byte_level(path: str) -> Side:
    """A byte-level BPE file; control strings inside texts are plain text. Merges that follow the order of ids, the usual case, are done by ranks, which is faster."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model, added = found["model"], {x["id"] for x in found["added_tokens"]}
    alphabet = byte_alphabet()
    raw = [b""] * (max(model["vocab"].values()) + 1)
    ranks = {}
    for piece, i in model["vocab"].items():
        if all(c in alphabet for c in piece):
            raw[i] = bytes(alphabet[c] for c in piece)
            if i not in added:
                ranks[raw[i]] = i
    merged = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in model["merges"]]
    if merged == sorted(set(merged)) and set(merged) | {ranks[bytes([b])] for b in range(256)} == set(ranks.values()):
        import public_tokenizers
        import tiktoken

        by_rank = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Side(raw, lambda texts: [by_rank.encode_ordinary(t) for t in texts])
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return Side(raw, lambda texts: [e.ids for e in found.encode_batch(texts, add_special_tokens=False)])


@lru_cache(maxsize=2)
def piece_level(path: str) -> Side:
    """A SentencePiece file: pieces in UTF-8 with spaces for U+2581, byte pieces as their bytes."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    n = found.get_piece_size()
    raw = [bytes([int(p[3:5], 16)]) if found.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, found.id_to_piece(i)) for i in range(n))]
    return Side(raw, lambda texts: found.encode(texts, num_threads=1))


def paths() -> tuple[str, str]:
    """The installed public vocabularies, the defaults of the path parameters."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def group_text(a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, ends: np.ndarray, left: Side, right: Side) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each range of groups; ga and gb are group numbers, ends the number of groups up to each range's end."""
    n = len(a) + len(b)
    per_a, per_b = np.bincount(ga, minlength=int(ends[-1])), np.bincount(gb, minlength=int(ends[-1]))
    first = np.cumsum(per_a + per_b) - per_a - per_b  # place of each group's first token
    at_a = first[ga] + np.arange(len(a)) - (np.cumsum(per_a) - per_a)[ga]
    at_b = (first + per_a)[gb] + np.arange(len(b)) - (np.cumsum(per_b) - per_b)[gb]
    room = max(left.digits.shape[1], right.digits.shape[1])
    cells, width = np.zeros((n, room), np.uint8), np.empty(n, np.int64)
    cells[at_a, : left.digits.shape[1]], width[at_a] = left.digits[a], left.width[a]
    cells[at_b, : right.digits.shape[1]], width[at_b] = right.digits[b], right.width[b]
    mark = np.full(n, ord(","), np.uint8)
    mark[(first + per_a - 1)[per_a > 0]] = ord("|")
    mark[first + per_a + per_b - 1] = ord(";")
    cells[np.arange(n), width] = mark
    flat = cells.ravel()[np.flatnonzero((np.arange(room) <= width[:, None]).ravel())].tobytes()
    size = np.concatenate(([0], np.cumsum(width + 1)))
    cut = size[np.concatenate(([0], (first + per_a + per_b)[ends - 1]))].tolist()
    return [flat[x : y - 1] for x, y in zip(cut, cut[1:], strict=False)]


def packed_pairs(pairs: np.ndarray) -> bytes:
    """Pairs in four bytes each if all ids are below 2^16, else in eight."""
    if len(pairs) and int(max((pairs >> BITS).max(), (pairs & ((1 << BITS) - 1)).max())) < 1 << 16:
        return ((pairs >> BITS) << 16 | pairs & 0xFFFF).astype(np.uint32).tobytes()
    return pairs.tobytes()


def pairs_of(pairs, counts) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and counts from their bytes."""
    n = np.frombuffer(counts, np.int32)
    x = np.frombuffer(pairs, np.uint8)
    if len(x) == 4 * len(n):
        x = x.view(np.uint32).astype(np.int64)
        return (x >> 16) << BITS | x & 0xFFFF, n
    return x.view(np.int64), n


def closed(a: np.ndarray, ea: np.ndarray, b: np.ndarray, eb: np.ndarray, bounds: np.ndarray, left: Side, right: Side) -> dict[str, list | np.ndarray]:
    """Groups and links of consecutive non-empty byte ranges that end (at bounds) where tokens of both end; ea and eb are the tokens' end places."""
    both = eb[np.minimum(np.searchsorted(eb, ea), len(eb) - 1)] == ea
    cuts = ea[both]
    groups = np.searchsorted(cuts, bounds, "right")
    text = group_text(a, np.cumsum(both) - both, b, np.searchsorted(cuts, eb, "left"), groups, left, right)
    places = np.union1d(ea, eb)  # between two places stand one A and one B token, and no two stretches have the same two
    of = np.searchsorted(bounds, places, "left")
    pair = a[np.searchsorted(ea, places)].astype(np.int64) << BITS | b[np.searchsorted(eb, places)]
    if (bits := int(pair.max()).bit_length()) + len(bounds).bit_length() < 63:  # one sort of both
        both = np.sort(of << bits | pair)
        of, pair = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.lexsort((pair, of))
        of, pair = of[order], pair[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(pair)))
    cut = np.searchsorted(of[at], np.arange(1, len(bounds)))
    return {
        "closed": text, "n_groups": np.diff(groups, prepend=0), "n_links": np.bincount(of, minlength=len(bounds)),
        "pairs": [packed_pairs(x) for x in np.split(pair[at], cut)], "counts": [x.astype(np.int32).tobytes() for x in np.split(counts, cut)],
    }


def _open(a: np.ndarray, ea: np.ndarray, b: np.ndarray, eb: np.ndarray) -> bytes:
    return np.concatenate(([len(a), len(b)], a, ea, b, eb)).astype(np.int64).tobytes()


def _opened(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(raw, np.int64)
    m, n = int(x[0]), int(x[1])
    return x[2 : 2 + m], x[2 + m : 2 + 2 * m], x[2 + 2 * m : 2 + 2 * m + n], x[2 + 2 * m + n :]


def _and(x: bytes, y: bytes) -> bytes:
    """The open parts x and y one after another."""
    return _open(*(np.concatenate(c) for c in zip(_opened(x), _opened(y), strict=True)))


NOTHING = _open(*(np.empty(0, np.int64),) * 4)
EMPTY = {"cut": False, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "head": NOTHING, "tail": NOTHING, "closed": b"", "pairs": b"", "counts": b""}  # the neutral fragment


def fragment(a: np.ndarray, ea: np.ndarray, b: np.ndarray, eb: np.ndarray, left: Side, right: Side) -> dict:
    """The fragment of the tokens that end in one byte range."""
    out = EMPTY | {"n_a": len(a), "n_b": len(b)}
    cuts = np.intersect1d(ea, eb, assume_unique=True)
    if not len(cuts):
        return out | {"head": _open(a, ea, b, eb)}
    (a0, a1), (b0, b1) = (np.searchsorted(e, [cuts[0], cuts[-1]], "right") for e in (ea, eb))
    out |= {"cut": True, "head": _open(a[:a0], ea[:a0], b[:b0], eb[:b0]), "tail": _open(a[a1:], ea[a1:], b[b1:], eb[b1:])}
    return out | _one(closed(a[a0:a1], ea[a0:a1], b[b0:b1], eb[b0:b1], cuts[-1:], left, right)) if a1 > a0 else out


def _one(found: dict) -> dict:
    return {k: v[0] if isinstance(v, list) else int(v[0]) for k, v in found.items()}


def _sum(parts: list[dict]) -> dict:
    """Closed parts one after another."""
    held = [pairs_of(p["pairs"], p["counts"]) for p in parts]
    pairs, where = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    counts = np.bincount(where, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int32)
    return {"n_groups": sum(p["n_groups"] for p in parts), "n_links": sum(p["n_links"] for p in parts), "closed": b";".join(p["closed"] for p in parts if p["closed"]), "pairs": packed_pairs(pairs), "counts": counts.tobytes()}


def compose(x: dict, y: dict, left: Side, right: Side) -> dict:
    """The fragment of two neighbouring byte ranges."""
    out = {"cut": x["cut"] or y["cut"], "n_a": x["n_a"] + y["n_a"], "n_b": x["n_b"] + y["n_b"]}
    if not x["cut"]:
        return {k: y[k] for k in EMPTY} | out | {"head": _and(x["head"], y["head"])}
    if not y["cut"]:
        return {k: x[k] for k in EMPTY} | out | {"tail": _and(x["tail"], y["head"])}
    a, ea, b, eb = _opened(_and(x["tail"], y["head"]))
    middle = _one(closed(a, ea, b, eb, ea[-1:], left, right))
    return out | {"head": x["head"], "tail": y["tail"]} | _sum([x, middle, y])


def finished(x: dict, left: Side, right: Side, digest: bool) -> dict:
    """The fragment of a whole text: its prefix is a group, its suffix is empty."""
    a, ea, b, eb = _opened(x["head"])
    first = [_one(closed(a, ea, b, eb, ea[-1:], left, right))] if len(a) else []
    x = x | {"head": NOTHING, "cut": True} | _sum([*first, x])
    return x | {"closed": _digest(x["closed"])} if digest else x


def _digest(groups: bytes) -> bytes:
    return hashlib.sha256(groups).hexdigest().encode()


def fragments(rows: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK, digest: bool = False) -> DataFrame:
    """Of rows (row, id, text) a row a byte range of a text (FRAGMENT): the whole of a text up to chunk bytes, finished; the ranges of
    longer ones, to be composed. With digest finished ones hold the hex SHA-256 of their groups instead of the groups."""
    ddl = FRAGMENT.format(kind=rows.schema["id"].dataType.simpleString())
    names = [c.name for c in schema_of(ddl)]

    def make():
        left, right = byte_level(path_a), piece_level(path_b)

        def f(batch: pa.RecordBatch) -> dict:
            rows, ids, texts = (batch.column(c).to_pylist() for c in ("row", "id", "text"))
            filled = [i for i, t in enumerate(texts) if t]
            out, whole = [], []
            tokens = zip(left.encode([" " + texts[i] for i in filled]), right.encode([texts[i] for i in filled]), strict=True)
            found = {i: x for i, x in zip(filled, tokens, strict=True)}
            for i, (row, name, text) in enumerate(zip(rows, ids, texts, strict=True)):
                own = {"row": row, "id": name, "part": 0, "parts": 1}
                raw = (" " + text).encode() if text else b""
                x, y = found.get(i, ([], []))
                if not raw or left.joined(x) != raw or right.joined(y) != raw:
                    out.append(EMPTY | own)
                elif len(raw) <= chunk:
                    whole.append((own, x, y, len(raw)))
                else:
                    a, b = np.array(x, np.int64), np.array(y, np.int64)
                    ea, eb = np.cumsum(left.size[a]), np.cumsum(right.size[b])
                    parts = -(-len(raw) // chunk)
                    for k in range(parts):
                        (a0, a1), (b0, b1) = (np.searchsorted(e, [k * chunk, (k + 1) * chunk], "right") for e in (ea, eb))
                        out.append(own | fragment(a[a0:a1], ea[a0:a1], b[b0:b1], eb[b0:b1], left, right) | {"part": k, "parts": parts})
            if whole:
                owns, xs, ys, sizes = zip(*whole, strict=True)
                a, b = (np.concatenate([np.array(x, np.int64) for x in side]) for side in (xs, ys))
                done = closed(a, np.cumsum(left.size[a]), b, np.cumsum(right.size[b]), np.cumsum(sizes), left, right)
                if digest:
                    done["closed"] = [_digest(x) for x in done["closed"]]
                for j, own in enumerate(owns):
                    out.append(EMPTY | own | {k: v[j] for k, v in done.items()} | {"cut": True, "n_a": len(xs[j]), "n_b": len(ys[j])})
            return {c: [x[c] for x in out] for c in names}

        return f

    return kernel(rows.select("row", "id", "text"), make, ddl)


def composed(found: DataFrame, path_a: str, path_b: str, digest: bool = False, fan: int = FAN) -> DataFrame:
    """The finished fragment of each text whose ranges are given, by a tree of compositions."""

    def step(table: pa.Table) -> pa.Table:
        left, right = byte_level(path_a), piece_level(path_b)
        table = table.drop_columns("of")
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        out = rows[0]
        for r in rows[1:]:
            out = out | compose(out, r, left, right)
        out |= {"part": rows[0]["part"] // fan, "parts": -(-rows[0]["parts"] // fan)}
        if out["parts"] == 1:
            out = finished(out, left, right, digest)
        return pa.Table.from_pylist([out], schema=table.schema)

    ddl = FRAGMENT.format(kind=found.schema["id"].dataType.simpleString())
    done = found.limit(0)
    while (found.agg(F.max("parts")).first()[0] or 1) > 1:
        now = stored(found.withColumn("of", F.floor(F.col("part") / fan)).groupBy("row", "of").applyInArrow(step, ddl), "fragments")
        done, found = done.unionByName(now.where("parts = 1")), now.where("parts > 1")
    return done


def pair_counts(found: DataFrame, hold: int = 1 << 22) -> DataFrame:
    """pair and n: the links of the corpus that hold each pair, and best: no pair of the same B id has more."""

    def run(batches):
        held, size = [], 0

        def flushed():
            pairs, where = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(np.bincount(where, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64))], names=["pair", "n"])

        for batch in batches:
            for p, n in zip(batch.column("pairs"), batch.column("counts"), strict=True):
                held.append(pairs_of(p.as_buffer(), n.as_buffer()))
                size += len(held[-1][0])
                if size >= hold:
                    yield flushed()
                    held, size = [], 0
        if size:
            yield flushed()

    total = found.select("pairs", "counts").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    most = total.groupBy((F.col("pair") % (1 << BITS)).alias("b")).agg(F.max("n").alias("most"))
    return total.withColumn("b", F.col("pair") % (1 << BITS)).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def weighed(found: DataFrame, counts: DataFrame, small: int = SMALL) -> DataFrame:
    """row, n_best (links whose pair is best) and count_sum (counts of all links' pairs) of finished fragments."""
    if counts.count() <= small:
        table = counts.toArrow()
        pairs, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pairs)
        sent = counts.sparkSession.sparkContext.broadcast((pairs[order], n[order], best[order]))

        def run(batches):
            pairs, n, best = sent.value
            for batch in batches:
                rows = []
                for p, c in zip(batch.column("pairs"), batch.column("counts"), strict=True):
                    p, c = pairs_of(p.as_buffer(), c.as_buffer())
                    at, c = np.searchsorted(pairs, p), c.astype(np.int64)
                    rows.append((int(c[best[at]].sum()), int((c * n[at]).sum())))
                yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ((), ())))], names=["row", "n_best", "count_sum"])

        return found.select("row", "pairs", "counts").mapInArrow(run, "row bigint, n_best bigint, count_sum bigint")

    def spread(batches):
        for batch in batches:
            for r, p, c in zip(batch.column("row").to_pylist(), batch.column("pairs"), batch.column("counts"), strict=True):
                pairs, c = pairs_of(p.as_buffer(), c.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), r, np.int64)), pa.array(pairs), pa.array(c)], names=["row", "pair", "c"])

    links = found.select("row", "pairs", "counts").mapInArrow(spread, "row bigint, pair bigint, c int").join(counts, "pair")
    return links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("c")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("c") * F.col("n")).alias("count_sum"))


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, chunk: int = CHUNK, small: int = SMALL) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (`a1,a2|b1;a3|b2`, '' without tokens; with digest their hex SHA-256) of each row."""
    path_a, path_b = path_a or paths()[0], path_b or paths()[1]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = stored(fragments(rows, path_a, path_b, chunk, digest), "fragments")  # row numbers are read from here only
    done = found.where("parts = 1").unionByName(composed(found.where("parts > 1"), path_a, path_b, digest))
    counts = stored(pair_counts(done), "pairs")
    own = done.select("row", "id", "n_a", "n_b", "n_groups", "n_links", F.col("closed").cast("string").alias("groups")).join(weighed(done, counts, small), "row", "left")
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]  # a row without links has none
    return own.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *sums, "groups")
