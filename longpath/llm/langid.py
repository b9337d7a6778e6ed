"""Language identification by error-correcting output codes over character n-grams.

Every language gets a codeword of bits, chosen so that any two differ in many places. One binary classifier a bit (logistic
regression over hashed counts of letter 1-, 2- and 3-grams) is fitted on a bounded sample of labelled texts. A text's
bit margins are decoded by loss: the language whose codeword has the least summed logistic loss is predicted, its score
is the softmax of the negative mean losses, and ``ambiguous`` marks texts whose two best codewords are closer than
``margin``.

The sample (the only thing bounded) holds at most ``sample`` texts a language, those with the smallest hash of id. All
texts are predicted whole. A null text, or one without a letter, is ``und`` with score 0 and not ambiguous. Without
any training text every text is ``und``. Rows of one id are predicted one by one; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longpath.llm.common import kernel
from longpath.llm.words import constants

DIM = 1 << 12
SAMPLE = 400
_MAYBE_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether some character is in a Unicode letter category."""
    return bool(_MAYBE_LETTER.search(text)) and any(map(str.isalpha, text))


def _letters() -> np.ndarray:
    table = np.zeros(0x10000, np.uint32)
    for i in range(0x10000):
        if chr(i).isalpha():
            table[i] = i
    return table


_cache: dict[str, np.ndarray] = {}


def features(text: str) -> np.ndarray:
    """Counts of hashed letter n-grams of a whole text, scaled to length 1; runs of other characters are one gap."""
    if "letters" not in _cache:
        _cache["letters"], _cache["by"] = _letters(), (constants(31, 3) >> np.uint64(40)).astype(np.uint32) | 1
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(codes < 0x10000, _cache["letters"][np.minimum(codes, 0xFFFF)], codes)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = codes[keep]
    a, b, c = _cache["by"]
    shift = np.uint32(20)
    one = codes * a
    two = one[:-1] * np.uint32(31) + codes[1:] * b
    three = two[:-1] * np.uint32(31) + codes[2:] * c
    count = np.zeros(DIM, np.float32)
    for grams in (one[codes != 0], two, three):
        part = np.bincount((grams * np.uint32(0x9E3779B1)) >> shift, minlength=DIM).astype(np.float32)
        size = float(np.sqrt(part @ part))
        if size:
            count += part / size
    return count


def codebook(n: int, seed: int = 5) -> np.ndarray:
    """n codewords of +-1 bits: among random books of max(15, 8 log2 n) columns, the one with the largest least distance."""
    bits = max(15, int(8 * np.ceil(np.log2(max(n, 2)))))
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(200):
        book = rng.integers(0, 2, (n, bits)) * 2 - 1
        for j in range(bits):  # every bit must part the languages
            if n > 1 and abs(book[:, j].sum()) == n:
                book[j % n, j] *= -1
        near = min((int((book[i] != book[j]).sum()) for i in range(n) for j in range(i)), default=bits)
        if near > most:
            best, most = book, near
    return best


class Model:
    """Codewords of languages and a linear classifier for each bit."""

    def __init__(self, languages: list[str], book: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.book, self.weights, self.bias = languages, book, weights, bias

    @classmethod
    def fit(cls, texts: list[str], languages: list[str], rounds: int = 300, rate: float = 4.0, decay: float = 1e-5) -> Model:
        names = sorted(set(languages))
        book = codebook(len(names))
        x = np.stack([features(t) for t in texts]) if texts else np.zeros((0, DIM), np.float32)
        y = book[[names.index(v) for v in languages]].astype(np.float32) if texts else np.zeros((0, book.shape[1]), np.float32)
        weight = np.array([1 / languages.count(v) for v in names], np.float32)
        per_row = weight[[names.index(v) for v in languages]][:, None] / max(len(names), 1) if texts else 1
        w, b = np.zeros((DIM, book.shape[1]), np.float32), np.zeros(book.shape[1], np.float32)
        for _ in range(rounds if len(names) > 1 else 0):
            pull = y / (1 + np.exp(y * (x @ w + b))) * per_row
            w += rate * (x.T @ pull) - rate * decay * w
            b += rate * pull.sum(0)
        return cls(names, book, w, b)

    def predict(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0, False
        bits = features(text) @ self.weights + self.bias
        loss = np.logaddexp(0, -4 * self.book * bits).mean(1)
        likely = np.exp(loss.min() - loss)
        likely /= likely.sum()
        order = np.argsort(loss, kind="stable")
        close = len(order) > 1 and loss[order[1]] - loss[order[0]] < margin
        return self.languages[order[0]], float(likely[order[0]]), bool(close)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that no classifier learns from: crc32 of the id's text modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, groups: int = 256) -> Model:
    """A model of at most sample labelled texts a language, held-out documents left aside."""
    key = F.md5(F.concat_ws(":", F.lit("langid"), F.col("id").cast("string")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out("id")).withColumn("key", key)

    def least(keys: DataFrame, *group: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("key"))
        return keys.withColumn("rank", rank).where(F.col("rank") <= sample).drop("rank")

    # in two levels, so that no task gets the rows of all scan tasks: first the least keys of each group of scan tasks
    keys = least(rows.select("lang", "key", F.pmod(F.spark_partition_id(), F.lit(groups)).alias("group")), "lang", "group")
    last = least(keys.drop("group"), "lang").groupBy("lang").agg(F.max("key").alias("last"))
    bounds = [(r.lang, r.last) for r in last.collect()]  # a row a language
    if not bounds:
        return Model.fit([], [])
    bound = F.create_map(*[F.lit(x) for pair in sorted(bounds) for x in pair])
    chosen = rows.where((F.col("key") <= bound[F.col("lang")]) & F.col("text").isNotNull())
    # rows of one id share a key, so the bound is applied again; a few rows a language leave each task
    at = F.row_number().over(Window.partitionBy("lang").orderBy("key", F.md5(F.col("text").cast("binary"))))
    chosen = chosen.select("lang", "key", "text").withColumn("rank", at).where(F.col("rank") <= sample)
    found = sorted((r.lang, r.key, r.text) for r in chosen.collect())
    found = [r for r in found if has_letter(r[2])]
    return Model.fit([r[2] for r in found], [r[0] for r in found])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.15) -> DataFrame:
    """id, held_out, lang_pred, score and ambiguous of every text."""

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            got = [model.predict(x.as_py(), margin) for x in batch.column("text")]
            return {id_col: batch.column(id_col), "held_out": batch.column("held_out"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "ambiguous": [g[2] for g in got]}

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return kernel(rows, make, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """docs without those that have no letter, are ambiguous or below the score least; a model without languages rejects no text with a letter."""

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            texts = batch.column(text_col).to_pylist()
            if model.languages:
                keep = [lang != "und" and not close and score >= least for lang, score, close in (model.predict(x, 0.15) for x in texts)]
            else:
                keep = [bool(x) and has_letter(x) for x in texts]
            keep = pa.array(keep, pa.bool_())
            left = batch.filter(keep)
            return {n: left.column(n) for n in left.schema.names}

        return f

    return kernel(docs, make, docs.schema, text=text_col)
