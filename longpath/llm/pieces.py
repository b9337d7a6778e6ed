"""SentencePiece encoding and decoding with a batched numpy Viterbi pass.

A text is cut into units: a run of word-start marks (U+2581, one for each space) with the characters up to the next
mark, split further around characters that no piece longer than one character holds. No piece crosses a unit's border.
The distinct units of a slice of texts are grouped by length, and units of equal length advance together, one
end position at a time. At each position the hashes of all substrings that end there (differences of prefix sums) are looked up in the
sorted hashes of the pieces, the admissible arcs are scored, and the best arc of each unit is stored as backpointer.

The vocabulary is of the BPE kind: its encoder joins the best-scored neighbours first, which the sum of piece scores doesn't
express. So an arc's score is 1 if it is admissible after the piece that its start's backpointer holds, else 0:
two pieces may stand side by side exactly if joining from their characters alone ends in these two pieces. For every
prefix exactly one arc is admissible, so the maximum gives the encoder's own result, not an approximation (``admissible``
holds the proof). Vocabularies of the unigram kind are encoded by the usual sum of scores.

Characters outside the vocabulary become byte pieces (or the unknown piece if there are none). Null text: null ids;
empty text: no ids. decode() is the inverse for every text that has no U+2581 and no lone surrogate.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longpath.llm.common import kernel
from longpath.llm.words import U, constants, mix

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the model format
DECIDED = 1 << 18  # remembered decisions about pairs, of some 150 bytes each; what is dropped is decided anew


def _fields(raw: bytes):
    """(number, value) of a protocol-buffer message; nested messages and strings as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", raw[at : at + n])[0]
            at += n


def char_sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums, along the last axis, of mixed code points times powers of an odd number."""
    power = np.multiply.accumulate(np.concatenate(([U(1)], np.full(max(codes.shape[-1] - 1, 0), constants(41, 1)[0], U))))[: codes.shape[-1]]
    out = np.zeros((*codes.shape[:-1], codes.shape[-1] + 1), U)
    np.cumsum(mix(codes.astype(U) + U(77)) * power, axis=-1, out=out[..., 1:])
    return out


class Vocabulary:
    """The pieces of a model file, with sorted substring hashes and remembered pair decisions."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model_type, self.dummy_prefix, self.squeeze = 1, True, True
        for number, value in _fields(raw):
            if number == 1:
                part = dict(_fields(value))
                self.pieces.append(part.get(1, b"").decode())
                self.scores.append(part.get(2, 0.0))
                self.kinds.append(part.get(3, NORMAL))
            elif number == 2:
                self.model_type = dict(_fields(value)).get(3, 1)
            elif number == 3:
                part = dict(_fields(value))
                self.dummy_prefix, self.squeeze = bool(part.get(3, 1)), bool(part.get(4, 1))
                if part.get(2):
                    raise ValueError("models with a character map of their own aren't supported")
        self.is_bpe = self.model_type == 2
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        self.rank = {self.pieces[i]: (-self.scores[i], i) for i in usable}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.chars = {p for p in self.rank if len(p) == 1}
        self.inner = {c for p in self.rank if len(p) > 1 for c in p}
        self.longest = max(map(len, self.rank), default=1)
        self.starts_only = not any(MARK in p.lstrip(MARK) for p in self.rank)
        power = int(constants(41, 1)[0])
        self.down = [U(pow(pow(power, -1, 1 << 64), i, 1 << 64)) for i in range(64)]
        self._down: np.ndarray = np.array(self.down, U)
        keys, ids = [], []
        for p, (_, i) in self.rank.items():
            if not self.is_bpe or self.merged(p) == [p]:  # a piece that joining never ends in takes no part
                keys.append(int(char_sums(np.array([list(map(ord, p))]))[0, -1]) ^ len(p))
                ids.append(i)
        order = np.argsort(np.array(keys, U))
        self.keys, self.ids = np.array(keys, U)[order], np.array(ids, np.int64)[order]
        assert len(np.unique(self.keys)) == len(self.keys), "two pieces have one hash"
        self.score = np.array(self.scores)
        self.decided: dict[int, bool] = {}
        self.pair_at, self.pair_fits = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool)  # decisions at a slot of the pair's hash
        if self.inner - self.chars:
            raise ValueError("every character of a longer piece must be a piece too")
        top = (self.keys >> U(44)).astype(np.int64)
        self.probe = np.full(1 << 20, -1, np.int32)  # by a key's top bits, the first place of such keys
        self.probe[top[::-1]] = np.arange(len(top) - 1, -1, -1)
        self.crowd = int(np.bincount(top, minlength=1).max())
        self.forget()

    def down_powers(self, n: int) -> np.ndarray:
        if n > len(self._down):
            self._down = np.multiply.accumulate(np.concatenate(([U(1)], np.full(2 * n, self.down[1], U))))
        return self._down[:n]

    def merged(self, text: str) -> list[str]:
        """Joining from single characters: the best-scored neighbours first, leftmost of equals, till none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r[0] < best):
                    best, at = r[0], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def admissible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether joining from the characters of both pieces ends in just these two.

        If a text ends in piece a and the encoder gives b for the text b, then the encoder gives [..., a, b] for both together
        exactly if (a, b) is admissible: as long as nothing was joined across the border, the steps left of it are those
        of the left text alone and the steps right of it those of b alone; the first step across would join parts of a
        and b, at a moment that depends on the best-scored steps within a and b only. Decisions are remembered.
        """
        pair = left * np.int64(1 << 32) + right
        slot = ((pair.astype(U) * U(0x9E3779B97F4A7C15)) >> U(43)).astype(np.int64)
        out = self.pair_fits[slot]
        miss = np.flatnonzero(self.pair_at[slot] != pair)
        if len(miss):
            new, inverse = np.unique(pair[miss], return_inverse=True)
            fits = np.empty(len(new), bool)
            if len(self.decided) > DECIDED:
                self.decided.clear()
            for n, p in enumerate(new.tolist()):
                known = self.decided.get(p)
                if known is None:
                    a, b = self.pieces[p >> 32], self.pieces[p & 0xFFFFFFFF]
                    known = self.decided[p] = self.merged(a + b) == [a, b]
                fits[n] = known
            out[miss] = fits[inverse]
            self.pair_at[slot[miss]], self.pair_fits[slot[miss]] = pair[miss], out[miss]
            clash = self.pair_at[slot[miss]] != pair[miss]  # two new pairs of one slot: the later one stays
            self.pair_at[slot[miss][clash]] = -1
        return out

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys are among the sorted piece keys: indices of key that are found, and their places."""
        place = self.probe[(key >> U(44)).astype(np.int64)]
        at = np.flatnonzero(place >= 0)
        place, key = place[at].astype(np.int64), key[at]
        found = np.full(len(at), -1, np.int64)
        for i in range(self.crowd):
            here = np.minimum(place + i, len(self.keys) - 1)
            same = self.keys[here] == key
            found[same] = here[same]
        hit = found >= 0
        return at[hit], found[hit]

    def forget(self) -> None:
        """Drops the remembered units (sorted hashes, and the ids of all in one array)."""
        self.known, self.at, self.size, self.flat = np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of equal length, given as rows of code points that all are pieces: how many ids each has, and all ids."""
        n, size = codes.shape
        sums, down = char_sums(codes), self.down_powers(size + 1)
        last = np.full((n, size + 1), -1, np.int64)  # the piece that ends here
        back = np.zeros((n, size + 1), np.int64)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        for end in range(1, size + 1):
            starts = np.arange(max(0, end - self.longest), end)
            key = ((sums[:, end, None] - sums[:, starts]) * down[starts]) ^ (end - starts).astype(U)
            at, place = self.find(key.ravel())
            row, col, piece = at // len(starts), at % len(starts), self.ids[place]
            start = starts[col]
            if self.is_bpe:
                value = np.ones(len(row))
                inner = np.flatnonzero(start > 0)
                value[inner[~self.admissible(last[row[inner], start[inner]], piece[inner])]] = -np.inf
            else:
                value = best[row, start] + self.score[piece]
            table, which = np.full((n, len(starts)), -np.inf), np.full((n, len(starts)), -1, np.int64)
            table[row, col], which[row, col] = value, piece
            pick, rows = table.argmax(1), np.arange(n)
            best[:, end], back[:, end], last[:, end] = table[rows, pick], starts[pick], which[rows, pick]
        out, count = np.full((n, size), -1, np.int32), np.zeros(n, np.int64)
        where, rows = np.full(n, size), np.arange(n)
        while len(rows):
            count[rows] += 1
            out[rows, size - count[rows]] = last[rows, where[rows]]
            where[rows] = back[rows, where[rows]]
            rows = rows[where[rows] > 0]
        return count, out[out >= 0]

    def classes(self) -> np.ndarray:
        """By code point below 0x110000: 0 in no longer piece, 1 inside of units, 2 the mark."""
        if not hasattr(self, "_class"):
            self._class = np.zeros(0x110000, np.uint8)
            self._class[[ord(c) for c in self.inner]] = 1
            self._class[ord(MARK)] = 2
        return self._class

    def loose(self, char: str) -> list[int]:
        """Ids of a character that is in no piece longer than itself."""
        if char in self.rank:
            return [self.rank[char][1]]
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def normal(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        return (" " if self.dummy_prefix and text else "") + text

    def learn(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> None:
        """Adds the units at codes[start : start + size] to what is remembered."""
        keys, sizes, flats = [], [], []
        alone = (size == 1) & (self.classes()[codes[start]] == 0)
        for i in np.flatnonzero(alone).tolist():
            ids = self.loose(chr(codes[start[i]]))
            keys.append(key[i : i + 1])
            sizes.append(np.array([len(ids)]))
            flats.append(np.array(ids, np.int32))
        rest = np.flatnonzero(~alone)
        rest = rest[np.argsort(size[rest], kind="stable")]
        for same in np.split(rest, np.flatnonzero(np.diff(size[rest])) + 1) if len(rest) else []:
            long = int(size[same[0]])
            step = max(1, 2_000_000 // (long * (self.longest + 1)))
            for a in range(0, len(same), step):
                part = same[a : a + step]
                count, flat = self.viterbi(codes[start[part, None] + np.arange(long)])
                keys.append(key[part])
                sizes.append(count)
                flats.append(flat)
        new_size = np.concatenate(sizes)
        new_keys, new_at = np.concatenate(keys), len(self.flat) + np.cumsum(new_size) - new_size
        order = np.argsort(new_keys)
        where = np.searchsorted(self.known, new_keys[order])
        self.known = np.insert(self.known, where, new_keys[order])
        self.size, self.at = np.insert(self.size, where, new_size[order]), np.insert(self.at, where, new_at[order])
        self.flat = np.concatenate((self.flat, *flats))

    def encode(self, texts: list[str | None], remember: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has (0 for null), and the ids of all. At most remember units, and those of one call, are kept."""
        parts = [self.normal(t) if t else "" for t in texts]
        begin = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
        if not len(codes):
            return np.zeros(len(texts), np.int64), np.empty(0, np.int32)
        codes = np.where(codes == 32, np.uint32(ord(MARK)), codes)
        kind = self.classes()[codes]
        first = np.ones(len(codes), bool)
        was, now = kind[:-1], kind[1:]
        first[1:] = (now == 0) | (was == 0) | (((now == 2) & (was != 2)) if self.starts_only else False)
        first[begin[:-1][begin[:-1] < len(codes)]] = True
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(codes)))
        sums = char_sums(codes)
        key = mix((sums[start + size] - sums[start]) * self.down_powers(len(codes) + 1)[start] + size.astype(U))
        distinct, index, inverse = np.unique(key, return_index=True, return_inverse=True)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)] != distinct
            if len(self.known) + int(new.sum()) > remember:
                self.forget()
                new[:] = True
        if new.any():
            self.learn(codes, start[index[new]], size[index[new]], distinct[new])
        at = np.searchsorted(self.known, distinct)[inverse]
        count, source = self.size[at], self.at[at]
        run = np.cumsum(count) - count
        ids = self.flat[np.repeat(source - run, count) + np.arange(int(count.sum()))]
        total = np.concatenate(([0], np.cumsum(count)))
        return np.diff(total[np.searchsorted(start, begin)]), ids

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, byte pieces read as UTF-8, the mark of the prefix removed."""
        if not hasattr(self, "_raw"):
            self._raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        text = b"".join([self._raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def model_path() -> str:
    """The installed public model, the default of the path parameters."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, n_tokens and round_trip (whether decoding the ids gives the text back) of each text."""
    path = path or model_path()  # a file of the installation, at the same place on every machine

    def make():
        vocab = vocabulary(path)

        def f(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            sizes, flat = vocab.encode(texts)
            ends = np.cumsum(sizes)
            rows = [flat[e - n : e] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            same = [None if t is None else vocab.decode(x) == t for t, x in zip(texts, rows, strict=True)]
            for i in [i for i, x in enumerate(same) if x is False]:  # should two units ever share a hash
                vocab.forget()
                rows[i] = vocab.encode([texts[i]])[1]
                same[i] = vocab.decode(rows[i]) == texts[i]
            null = pa.array([t is None for t in texts], pa.bool_())
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows), pa.int32()), mask=null)
            return {id_col: batch.column(id_col), "ids": ids, "n_tokens": [None if t is None else len(x) for t, x in zip(texts, rows, strict=True)], "round_trip": same}

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    return kernel(docs.select(F.col(id_col), F.col(text_col).alias("text")), make, limit=1 << 19, ddl=f"`{id_col}` {kind}, ids array<int>, n_tokens bigint, round_trip boolean")


def decoded(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of each list of ids; null for null."""
    path = path or model_path()

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = [None if x.as_py() is None else vocab.decode(x.as_py()) for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
