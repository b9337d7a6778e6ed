"""Secret scans: fixed patterns, and strings that stay incompressible next to their surroundings.

Two kinds of findings come from one pass over whole texts:

* base spans: the three fixed patterns (an assignment to a secret's name, an access key id, a long hexadecimal run);
* novel spans: every run of token characters that follows a sensitive word closely is a candidate. Its marginal size is
  the number of bytes by which a zstandard frame of its surroundings grows when the candidate is added, the compressor
  being primed with a dictionary of identifiers and code. Names, paths and words are in the dictionary or the
  surroundings and cost little; random strings cost about their entropy. A candidate whose marginal size is at least
  ``novelty`` of its length and that mixes letters and digits is reported, once.

Rows: one per document, in code points. A null or empty text has no spans. Repeated rows give repeated results. Other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longpath.llm.common import kernel

KINDS = ("assign", "access", "hex", "novel")
# Fixed patterns. ASSIGN takes letters of the names in either case; runs that are too short are dropped afterwards for
# it, and never match for the others, whose runs are maximal.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Fixed words that make the text after them sensitive.
SENSITIVE = (
    "password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "access_key",
    "accesskey", "private_key", "privatekey", "credential", "authorization", "bearer", "client_secret", "signature",
)
CONTEXT = re.compile("(?ai:" + "|".join(SENSITIVE) + ")")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
# Fixed identifier and code dictionary.
DICTIONARY = """
password passwd secret token api_key apikey access_key private_key client_secret authorization bearer credential
username user_id session_id request response connection configuration environment variable parameter argument function
return import from class public private protected static final const let var string integer boolean object array length
config settings database host port localhost example.com http:// https:// www. .com .org .net index.html timeout retry
getElementById addEventListener toString valueOf hashCode equals createInstance initialize application controller service
manager factory builder handler listener provider repository component interface abstract implementation exception
true false null none undefined default value key name type data list dict map set get put post delete update insert select
where order group abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 changeme placeholder your_token_here
your_api_key_here xxxxxxxxxxxxxxxx example test sample dummy max_length min_length content-type application/json utf-8
"""


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    out = []
    low = text.lower() if low is None else low
    if any(x in low for x in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Novelty:
    """Marginal compressed sizes, given surroundings and the identifier dictionary."""

    def __init__(self, level: int = 3):
        import zstandard

        primed = zstandard.ZstdCompressionDict(DICTIONARY.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False)

    def marginal(self, before: str, candidate: str, after: str) -> int:
        around = (before + "\n" + after + "\n").encode("utf-8", "replace")
        return len(self.compressor.compress(around + candidate.encode())) - len(self.compressor.compress(around))


def novel_spans(text: str, low: str, novelty: Novelty, reach: int, around: int, least: float, shortest: int = 16) -> list[tuple[int, int, int]]:
    """Runs that begin at most reach characters behind a sensitive word, or from one inside on, and hold a novel piece; one span a run.

    Sensitive words inside a run part it into pieces (of shortest characters at least); each is measured once. The span goes from
    the first novel piece to the run's end.
    """
    if not any(x in low for x in SENSITIVE):
        return []
    out, done = [], 0  # done: the end of the last run looked at
    for m in CONTEXT.finditer(text):
        for c in CANDIDATE.finditer(text, max(m.end(), done), min(len(text), m.end() + reach + shortest)):  # a run's first characters
            begin = c.start()
            if begin > m.end() + reach:
                break
            done = end = RUN.match(text, begin).end()  # the run goes on behind the reach
            for cut, after in [*((k.start(), k.end()) for k in CONTEXT.finditer(text, begin, end)), (end, end)]:
                if cut - begin < shortest:
                    continue  # too short to be judged apart from what follows
                if DIGIT.search(text, begin, cut) and LETTER.search(text, begin, cut):
                    word = text[begin:cut]
                    before, behind = text[max(0, begin - around) : begin], text[cut : cut + around]
                    cost = novelty.marginal(before.replace(word, ""), word, behind.replace(word, ""))  # copies don't excuse it
                    if cost >= least * len(word):
                        out.append((begin, 3, end))
                        break
                begin = after
    return out


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 48, around: int = 256, novelty: float = 0.55) -> DataFrame:
    """id, spans array<struct<kind,start,end>> by start and then kind: all findings of each text (null text: none)."""

    def make():
        measure = Novelty()

        def f(batch: pa.RecordBatch) -> dict:
            found = []
            for x in batch.column("text"):
                text = x.as_py() or ""
                low = text.lower()
                spans = base_spans(text, low) + novel_spans(text, low, measure, reach, around, novelty)
                found.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)])
            return {id_col: batch.column(id_col), "spans": found}

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return kernel(rows, make, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def scan_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of secret_spans()."""

    def only(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        id_col, only("assign").alias("n_assign"), only("access").alias("n_access"), only("hex").alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[REDACTED]") -> str:
    """text with the union of spans replaced."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", reach: int = 48, around: int = 256, novelty: float = 0.55) -> DataFrame:
    """docs with every finding replaced by [REDACTED]; length_col, if there, becomes the new length. Null texts stay null."""

    def make():
        measure = Novelty()

        def f(batch: pa.RecordBatch) -> dict:
            out = {n: batch.column(n) for n in batch.schema.names}
            texts, lengths = [], []
            old = batch.column(length_col).to_pylist() if length_col in out else [None] * batch.num_rows
            for x, was in zip(batch.column(text_col), old, strict=True):
                text = x.as_py()
                spans = []
                if text:
                    low = text.lower()
                    spans = [(a, b) for a, _, b in base_spans(text, low) + novel_spans(text, low, measure, reach, around, novelty)]
                text = redact(text, spans) if spans else text
                texts.append(text)
                lengths.append(len(text) if spans else was)
            out[text_col] = texts
            if length_col in out:
                out[length_col] = lengths
            return out

        return f

    return kernel(docs, make, docs.schema, text=text_col)
