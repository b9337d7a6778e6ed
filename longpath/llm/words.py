"""Words of many texts at once, as two 64-bit hashes each.

A text is UTF-8 bytes; a word is a maximal run of bytes outside a separator table. The two hashes together hold a short word's bytes, or are
a cryptographic hash of a long one, so no structure of words makes them collide. Equal words have equal hashes everywhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed * 1_000_003)) * U(0x9E3779B97F4A7C15)) | U(1)


def white_space() -> np.ndarray:
    """Separators: space and the control characters 9 to 13."""
    out = np.zeros(256, bool)
    out[[32, 9, 10, 11, 12, 13]] = True
    return out


def not_alphanumeric() -> np.ndarray:
    """Separators: every ASCII character but digits and letters; other bytes belong to words."""
    out = np.zeros(256, bool)
    out[:128] = True
    for a, b in ((48, 57), (65, 90), (97, 122)):
        out[a : b + 1] = False
    return out


MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
SHORT = 16
_long: dict[bytes, bytes] = {}


def hashed_words(data: bytes, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes and two hashes of the words between spaces of data, which begins with one space and ends with 16 at least.

    The bytes of a word of up to 16 are two numbers, mixed; a longer word is hashed by blake2b (of which ``most`` are remembered).
    """
    raw = np.frombuffer(data, np.uint8)
    gap = raw == 32
    turns = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = turns[0::2], turns[1::2]
    size = ends - starts
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the eight bytes from each place on
    low, high = eight[starts] & MASKS[np.minimum(size, 8)], eight[np.minimum(starts + 8, len(eight) - 1)] & MASKS[np.clip(size - 8, 0, 8)]
    c = constants(41, 4)
    h1 = mix(mix(low ^ c[0]) + high + size.astype(U) * c[1])
    h2 = mix(mix(high ^ c[2]) + low * c[3] + size.astype(U))
    for i in np.flatnonzero(size > SHORT).tolist():
        word = data[starts[i] : ends[i]]
        found = _long.get(word)
        if found is None:
            if len(_long) >= most:
                _long.clear()
            found = _long[word] = hashlib.blake2b(word, digest_size=16).digest()
        h1[i], h2[i] = np.frombuffer(found, U)
    return starts, h1, h2


class Texts:
    """The words of a slice of texts: the index of each text's first word, their counts, and two hashes of each word.

    Separators must hold the space. Texts are cut in stretches of about ``step`` bytes at separators, so the memory beside the hashes is bounded by
    ``step`` and the longest word.
    """

    def __init__(self, texts: pa.Array, separators: np.ndarray, fold: bool, step: int = 1 << 21):
        table = np.arange(256, dtype=np.uint8)
        if fold:
            table[65:91] += 32
        table[separators] = 32
        self._table, self._step = table.tobytes(), step
        self._found: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = np.zeros(len(texts), np.int64)
        waiting: list[bytes] = []
        begin = size = 0
        for i, x in enumerate(texts.fill_null("")):
            raw = x.as_buffer()
            if size + len(raw) > step:
                self._take(waiting, begin)
                waiting, begin, size = [], i, 0
            if len(raw) > step:
                for part in self._cut(raw):
                    self._take([part], i)
                begin = i + 1
            else:
                waiting.append(raw.to_pybytes())
                size += len(raw) + 1
        self._take(waiting, begin)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.h1, self.h2 = (np.concatenate([x[i] for x in self._found]) if self._found else np.empty(0, U) for i in (0, 1))
        self._found.clear()

    def _take(self, parts: list[bytes], at: int) -> None:
        """Hashes these texts (or a stretch of one), which are those from number at on."""
        if parts:
            starts, h1, h2 = hashed_words((b" " + b" ".join(parts) + b" " * SHORT).translate(self._table))
            ends = np.cumsum([len(x) + 1 for x in parts]) + 1
            self.count[at : at + len(parts)] += np.diff(np.searchsorted(starts, np.concatenate(([0], ends))))
            self._found.append((h1, h2))

    def _cut(self, raw: pa.Buffer):
        at, size = 0, len(raw)
        while at < size:
            end = min(at + self._step, size)
            part = raw.slice(at, end - at).to_pybytes().translate(self._table)
            while end < size:
                cut = part.rfind(b" ")
                if cut >= 0:
                    part, end = part[:cut], at + cut + 1
                    break
                end = min(at + 2 * (end - at), size)  # a word longer than the step
                part = raw.slice(at, end - at).to_pybytes().translate(self._table)
            yield part
            at = end


def windows(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of each k consecutive entries of h (len(h) - k + 1 of them, across texts too)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    c = constants(seed + 100, k)
    out = h[:n] * c[0]
    for i in range(1, k):
        out += mix(h[i : n + i] + c[i])
    return mix(out)
