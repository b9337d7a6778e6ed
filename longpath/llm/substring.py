"""Removal of long repeated passages by recompression.

A window is ``window`` consecutive words of one document; words are removed that a window covers whose words also start
earlier (in a document of smaller id, or earlier in the same one). The input alone decides.

Symbols. Each document's words become symbols, and for ``rounds`` rounds

* runs of one symbol become one symbol, named by (symbol, length) (in the first round; a later one would look too far);
* the alphabet is parted at random (a bit of symbol and round), and each neighbouring pair (left part, right part) becomes one symbol, named
  by its two symbols.

A name is a hash of what it stands for, so all tasks name runs and pairs alike without exchange, and equal
substrings get the same symbols inside, save near their ends. How near is tracked: with each symbol goes the stretch of words
that decided it (its own and its neighbours' as far as they were looked at). Where these words stand again, the same symbol
stands again. Every window is led by the least name among the symbols whose stretch it holds, so equal windows have
equal leaders at equal places. (A window that holds no stretch, in a long run of one word, is its own leader.) A leader is named by
its symbol and its stretch, which stands by chance more rarely than the symbol alone. The windows of one leader follow each other; the words they cover are the leader's span, a symbol of the next level, named by the
leader and its words (128 bits in all). A document has about one span for eight words.

Spark rounds. Each counts names over the corpus and leaves less to the next.

1. Leaders. A name that stands in one place only proves all windows of its span unique; such spans go.
   (Copies of a whole document count as one place. They are known by the digest of their words, have only repeated
   windows, and are not looked at further.)
2. Spans. Where the same span stands in an earlier document, all its windows are repeats: (start, length) intervals of
   the later one. If a leader has only one span in the corpus, the windows of its first place are first themselves. What stays open
   are first places of spans whose leader has several: around the ends of passages.
3. Open windows, by their words (128 bits): those of later documents, or later in one document, are repeats.

Then the words that repeats cover are cut, and the rest is digested. Windows in the midst of a passage are never listed.

Null texts have no words. Rows of equal ids are ordered by an internal row number, so of equal rows one stays;
rows with a null id come after all others. Documents of fewer words than a window lose nothing and repeat nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longpath.llm.common import drop_stored, kernel, stored
from longpath.llm.words import Texts, U, constants, mix, white_space

ROUNDS = 2


def recompress(h: np.ndarray, border: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of word hashes after so many rounds: name, first word, and first word and end of the deciding stretch.

    border marks words that begin a document; nothing joins across them, and a symbol that was decided by a border has a
    stretch that reaches beyond its document. Stretches begin, and end, in the order of their symbols.
    """
    n = len(h)
    name, start, low, high = h.copy(), np.arange(n), np.arange(n), np.arange(n) + 1
    edge = border.copy()  # the symbol begins a document
    for r in range(rounds):
        if len(name) < 2:
            break
        if r == 0:  # runs: equal neighbours become one symbol; each symbol looked at both its neighbours
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | edge[1:]
            at = np.flatnonzero(new)
            length = np.diff(np.append(at, len(name)))
            low, high = at - 1, at + length + 1
            name = np.where(length > 1, mix(name[at] * U(3) + mix(length.astype(U))), name[at])
            start, edge = start[at], edge[at]
        # pairs: a symbol of the left part joins a following one of the right part
        side = (mix(name + constants(700 + r, 1)) >> U(63)).astype(bool)
        first = np.zeros(len(name), bool)
        first[:-1] = ~side[:-1] & side[1:] & ~edge[1:]
        second = np.zeros(len(name), bool)
        second[1:] = first[:-1]
        lo, hi = low.copy(), high.copy()
        lo[1:] = np.where(side[1:] & ~edge[1:], low[:-1], low[1:])  # right ones looked left
        hi[:-1] = np.where(~side[:-1] & ~edge[1:], high[1:], high[:-1])  # left ones looked right
        at = np.flatnonzero(~second)
        pair = first[at]
        mate = np.minimum(at + 1, len(name) - 1)
        name = np.where(pair, mix(mix(name[at] + U(17)) * U(5) + name[mate]), name[at])
        low, high = lo[at], np.where(pair, hi[mate], hi[at])
        start, edge = start[at], edge[at]
    return name, start, low, high


def hashed(h: np.ndarray, starts: np.ndarray, window: int, seed: int, size: np.ndarray | None = None, step: int = 1 << 15) -> np.ndarray:
    """A hash of the window (or of its first size words) at each start: sums of hashes of (word, place)."""
    c, place = constants(seed, window), np.arange(window)
    parts = []
    for i in range(0, len(starts), step):
        x = mix(h[np.minimum(starts[i : i + step, None] + place, len(h) - 1)] + c)
        parts.append(mix(x.sum(1, dtype=U, where=True if size is None else place < size[i : i + step, None])))
    return np.concatenate(parts) if parts else np.empty(0, U)


def leaders(name: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """The symbol of least name, the first of equals, whose stretch lies in each window; -1 without any."""
    if not len(name):
        return np.full(len(starts), -1)
    a = np.append(0, np.cumsum(np.bincount(low, minlength=n)))[starts]  # stretches that begin before the window
    b = np.cumsum(np.bincount(high, minlength=n + 1))[starts + window]  # stretches that end by its end
    out, size = np.full(len(starts), -1), b - a
    best, width = np.arange(len(name)), 1  # the least of width symbols from each on
    while True:
        at = np.flatnonzero((size >= width) & (size < 2 * width))
        if len(at):
            x, y = best[a[at]], best[b[at] - width]
            out[at] = np.where(name[x] <= name[y], x, y)
        if not (size >= 2 * width).any():
            return out
        x, y = best[:-width], best[width:]
        best, width = np.where(name[x] <= name[y], x, y), 2 * width


def spans(t: Texts, window: int) -> dict[str, np.ndarray]:
    """The spans of a slice of texts, in text order: text, lo (first window), n (windows), s (leader), b (words), again (not the first of its text)."""
    h1, h2, n = t.h1, t.h2, len(t.h1)
    none = np.empty(0, np.int64)
    text_of = np.repeat(np.arange(len(t.count)), t.count)
    starts = np.flatnonzero(text_of[: max(n - window + 1, 0)] == text_of[window - 1 :]) if n >= window else none
    if not len(starts):
        return {"text": none, "lo": none, "n": none, "s": none.astype(U), "b": none.astype(U), "again": none.astype(bool)}
    border = np.zeros(n + 1, bool)
    border[t.first] = True
    name, start, low, high = recompress(h1, border[:-1])
    of = text_of[start]
    ok = (low >= t.first[of]) & (high <= t.first[of + 1]) & (high - low <= window)
    name, low, high = name[ok], low[ok], high[ok]
    lead = leaders(name, low, high, starts, n, window)
    new = np.ones(len(starts), bool)
    new[1:] = (lead[1:] != lead[:-1]) | (lead[1:] < 0) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(starts)))
    lo, lead = starts[at], lead[at]
    led = lead >= 0
    offset, s = np.full(len(lo), window), hashed(h1, lo, window, 611)
    at = np.flatnonzero(led)
    x = lead[at]
    offset[at], s[at] = low[x] - lo[at], mix(name[x] + hashed(h1, low[x], window, 613, high[x] - low[x]))
    b = mix(hashed(h2, lo, window, 612) + mix(hashed(h2, lo + size - 1, window, 612) * U(3) + (size * 2 * window + offset).astype(U)))
    text = text_of[lo]
    order = np.lexsort((lo, b, s, text))
    again = np.zeros(len(lo), bool)
    x, y = order[1:], order[:-1]
    again[x] = (text[x] == text[y]) & (s[x] == s[y]) & (b[x] == b[y])
    return {"text": text, "lo": lo - t.first[text], "n": size, "s": s, "b": b, "again": again}


def structs(bounds: np.ndarray, **columns: np.ndarray) -> pa.Array:
    """An array of structs for each text, cut at bounds."""
    inner = pa.StructArray.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), inner)


SPANS = "array<struct<s:bigint,b:bigint,lo:int,n:int,again:boolean>>"
WINDOWS = "array<struct<start:int,w1:bigint,w2:bigint,again:boolean>>"


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def words_of(x) -> list[bytes]:
    return (x.as_py() or "").encode().split()


def covering(pairs: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Which of n places stand in an interval (first, end)."""
    mark = np.zeros(n + 1, np.int64)
    for a, b in pairs:
        mark += np.bincount(a, minlength=n + 1)[: n + 1] - np.bincount(b, minlength=n + 1)[: n + 1]
    return np.cumsum(mark)[:n] > 0


def intervals(x) -> tuple[np.ndarray, np.ndarray]:
    """First windows and numbers of windows of an array<struct<lo,n>>."""
    return np.asarray(x.values.field("lo")).astype(np.int64), np.asarray(x.values.field("n")).astype(np.int64)


def scanned(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """row, id, n_words, sha (of the words) and spans of every text."""

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            t = Texts(batch.column("text"), white_space(), False)
            x = spans(t, window)
            cut = np.searchsorted(x["text"], np.arange(batch.num_rows + 1))
            found = structs(cut, s=x["s"].astype(np.int64), b=x["b"].astype(np.int64), lo=x["lo"].astype(np.int32), n=x["n"].astype(np.int32), again=x["again"])
            return {"id": batch.column("id"), "n_words": pa.array(t.count), "sha": [digest(words_of(y)) for y in batch.column("text")], "spans": found}

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return kernel(rows, make, f"id {kind}, n_words bigint, sha string, spans {SPANS}").withColumn("row", F.monotonically_increasing_id())


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """wanted (id, sha, ...) with the text of its id; a worker still has to compare sha, as ids may repeat."""
    rows = docs.select(F.col(id_col).alias("t_id"), F.col(text_col).alias("text"))
    return rows.join(wanted, F.col("t_id").eqNullSafe(F.col("id"))).drop("t_id", "id")


def open_windows(docs: DataFrame, wanted: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """row, rank, start, w1, w2 and again (not the first of its text) of the windows in the spans of wanted (row, id, sha, rank, spans)."""

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            t = Texts(batch.column("text"), white_space(), False)
            starts, sizes = [], [0]
            for i, (first, n) in enumerate(zip(t.first[:-1].tolist(), t.count.tolist(), strict=True)):
                at = np.empty(0, np.int64)
                if digest(words_of(batch.column("text")[i])) == batch.column("sha")[i].as_py():
                    lo, size = intervals(batch.column("spans")[i])
                    at = np.flatnonzero(covering([(lo, lo + size)], n))
                starts.append(first + at)
                sizes.append(len(at))
            cut, at = np.cumsum(sizes), np.concatenate(starts) if starts else np.empty(0, np.int64)
            text = np.repeat(np.arange(batch.num_rows), sizes[1:])
            w1, w2 = hashed(t.h1, at, window, 611), hashed(t.h2, at, window, 612)
            order = np.lexsort((at, w2, w1, text))
            again, x, y = np.zeros(len(at), bool), order[1:], order[:-1]
            again[x] = (text[x] == text[y]) & (w1[x] == w1[y]) & (w2[x] == w2[y])
            found = structs(cut, start=(at - t.first[text]).astype(np.int32), w1=w1.astype(np.int64), w2=w2.astype(np.int64), again=again)
            return {"row": batch.column("row"), "rank": batch.column("rank"), "found": found}

        return f

    looked = kernel(_texts(docs, wanted, id_col, text_col), make, f"row bigint, rank bigint, found {WINDOWS}")
    return looked.select("row", "rank", F.inline("found"))


def repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What to cut: all rows (row, id, n_words, sha); later whole copies (row); and row, id, sha, cuts (intervals of repeated windows)."""
    scan = stored(scanned(docs, window, id_col, text_col), "spans")
    rows = stored(scan.select("row", "id", "n_words", "sha"), "rows")
    # row numbers in the order of ids: a partition's number and the place in it grow with the order
    ranked = rows.where(F.col("n_words") >= window).select("row", "id", "sha", F.col("id").isNull().alias("last"))
    ranked = ranked.repartitionByRange("last", "id", "row").sortWithinPartitions("last", "id", "row").withColumn("rank", F.monotonically_increasing_id())
    numbered = stored(ranked.drop("last"), "numbered")
    heads = numbered.groupBy("sha").agg(F.min("rank").alias("head"))
    ranked = stored(numbered.join(heads, "sha").select("row", "id", "sha", "rank", (F.col("rank") > F.col("head")).alias("copy")), "ranked")
    drop_stored(numbered)
    first = ranked.where("not copy")

    # leaders
    used = scan.select("row", F.xxhash64("sha").alias("doc"), F.inline(F.filter("spans", lambda x: ~x["again"])))
    place = F.xxhash64("doc", "b")
    shared = stored(used.groupBy("s").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("s"), "leaders")
    met = used.select("s", "b", "row", "lo", "n").join(shared, "s").join(first.select("row", "rank"), "row")
    met = stored(met.select("s", "b", "rank", "row", "lo", "n"), "met")
    again = stored(scan.select("row", F.inline(F.filter("spans", lambda x: x["again"]))).select("row", "lo", "n").join(first.select("row"), "row"), "again")
    drop_stored(scan, shared)

    # spans
    heads = met.groupBy("s", "b").agg(F.min("rank").alias("head"), F.max("rank").alias("last"))
    several = heads.groupBy("s").agg((F.min("b") < F.max("b")).alias("several"))
    heads = heads.join(several, "s").where(F.col("several") | (F.col("head") < F.col("last"))).select("s", "b", "head", "several")
    judged = met.join(heads, ["s", "b"]).select("row", "lo", "n", (F.col("rank") > F.col("head")).alias("later"), "several").where("later or several")
    judged = stored(judged.drop("several"), "judged")
    drop_stored(met)

    # open windows
    asked = judged.where("not later").groupBy("row").agg(F.collect_list(F.struct("lo", "n")).alias("spans")).join(first.drop("copy"), "row")
    asked = stored(open_windows(docs, asked, window, id_col, text_col), "windows")
    fresh = asked.where("not again")
    known = fresh.groupBy("w1", "w2").agg(F.min("rank").alias("head"), F.max("rank").alias("last")).where("head < last").select("w1", "w2", "head")
    later = fresh.join(known, ["w1", "w2"]).where("rank > head").select("row", "start").unionByName(asked.where("again").select("row", "start"))

    found = later.select("row", F.col("start").alias("lo"), F.lit(1).alias("n")).unionByName(judged.where("later").select("row", "lo", "n")).unionByName(again)
    cuts = stored(found.groupBy("row").agg(F.collect_list(F.struct("lo", "n")).alias("cuts")).join(first.select("row", "id", "sha"), "row"), "cuts")
    drop_stored(asked, judged, again)
    return rows, ranked.where("copy").select("row"), cuts


def deduplicated(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """id, n_words, n_removed and kept_sha256 of every row; with texts also the kept words of changed rows (kept; null: unchanged)."""
    rows, copies, cuts = repeats(docs, window, id_col, text_col)

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"row": [], "n_removed": [], "kept_sha": [], "kept": []}
            for row, sha, text, cut in zip(*(batch.column(c) for c in ("row", "sha", "text", "cuts")), strict=True):
                words = words_of(text)
                if digest(words) != sha.as_py():
                    continue
                lo, n = intervals(cut)
                gone = covering([(lo, lo + n + window - 1)], len(words))
                kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                for name, x in zip(out, (row.as_py(), int(gone.sum()), digest(kept), b" ".join(kept).decode() if texts else None), strict=True):
                    out[name].append(x)
            return out

        return f

    changed = kernel(_texts(docs, cuts, id_col, text_col), make, "row bigint, n_removed bigint, kept_sha string, kept string").dropDuplicates(["row"])
    nothing = digest([])
    out = rows.join(changed.unionByName(copies.select("row", F.lit(-1).cast("long").alias("n_removed"), F.lit(nothing).alias("kept_sha"), F.lit("" if texts else None).cast("string").alias("kept"))), "row", "left")
    removed = F.when(F.col("n_removed") == -1, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return out.select(F.col("id").alias(id_col), "n_words", removed.cast("long").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"), *(["kept"] if texts else []))
