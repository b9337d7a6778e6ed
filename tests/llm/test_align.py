"""Alignment of two tokenizers against a brute-force version."""

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from longpath.llm import align, queries
from tests.llm.test_text_operators import by_row


@lru_cache
def both():
    a, b = align.paths()
    first = Tokenizer.from_file(a)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=b)


def tokens(text):
    first, second = both()
    alphabet = align.byte_alphabet()
    x = [(i, bytes(alphabet[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    y = []
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        y.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (x, y) if b"".join(t for _, t in x) == raw == b"".join(t for _, t in y) else ([], [])


def spans(side):
    out, at = [], 0
    for i, raw in side:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(texts):
    per = []
    for t in texts:
        x, y = tokens(t) if t else ([], [])
        x, y = spans(x), spans(y)
        links = [(a[0], b[0]) for a in x for b in y if a[1] < b[2] and b[1] < a[2]]
        cuts = sorted({a[2] for a in x} & {b[2] for b in y})
        groups = []
        for s, e in zip([0, *cuts], cuts, strict=False):
            groups.append(",".join(str(i) for i, _, z in x if s < z <= e) + "|" + ",".join(str(i) for i, _, z in y if s < z <= e))
        per.append((len(x), len(y), groups, links))
    total = Counter(p for *_, links in per for p in links)
    best = {}
    for (_, b), n in total.items():
        best[b] = max(best.get(b, 0), n)
    return [(na, nb, len(g), len(ls), sum(total[p] == best[p[1]] for p in ls), sum(total[p] for p in ls), ";".join(g)) for na, nb, g, ls in per]


TEXTS = ["", None, "a", " ", "  two  spaces\n\tand tabs ", "naïve ÉCOLE 日本語 🙂 text", "<|endoftext|> <s> </s> <0x0A>", "▁mark", "x" * 300, "Hello world, hello world! " * 9, "Hello world, hello world! " * 9, "don't 123456 e=mc²", "\r\n\x00\x85", "é" * 40, "日本語" * 30, "a﻿b"]


@pytest.mark.parametrize("chunk,small", [(1 << 16, 1 << 21), (16, 1 << 21), (5, 0), (1, 1 << 21)])
def test_aligned(spark, chunk, small):
    rows = [(i % 12 if i else None, t, 1, "x", 7) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a long, row string, id long").repartition(3)
    got = align.aligned(docs, chunk=chunk, small=small)
    expected = [(r[0], *x) for r, x in zip(rows, brute(TEXTS), strict=True)]
    assert sorted(by_row(got), key=repr) == sorted(expected, key=repr)


def test_digest(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for chunk in (1 << 16, 8):
        got = {r["doc_id"]: r["groups"] for r in align.aligned(docs, digest=True, chunk=chunk).collect()}
        assert got == {i: hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "" for i, x in enumerate(brute(TEXTS))}


def test_no_rows(spark):
    assert align.aligned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("ab é日\n", min_size=1, max_size=60), st.lists(st.integers(1, 90), min_size=2, max_size=6, unique=True), st.integers(0, 3))
def test_fragments_compose_in_any_order(text, cuts, seed):
    left, right = (f(p) for f, p in zip((align.byte_level, align.piece_level), align.paths(), strict=True))
    x, y = tokens(text)
    if not x:
        return
    a, b = (np.array([i for i, _ in side], np.int64) for side in (x, y))
    ea, eb = (np.cumsum([len(raw) for _, raw in side]) for side in (x, y))
    cuts = [0, *sorted(cuts), int(ea[-1]) + 90]
    parts = []
    for s, e in zip(cuts, cuts[1:], strict=False):
        (a0, a1), (b0, b1) = (np.searchsorted(z, [s, e], "right") for z in (ea, eb))
        parts.append(align.fragment(a[a0:a1], ea[a0:a1], b[b0:b1], eb[b0:b1], left, right))
    rng = np.random.default_rng(seed)
    while len(parts) > 1:
        i = int(rng.integers(len(parts) - 1))
        parts[i : i + 2] = [align.compose(parts[i], parts[i + 1], left, right)]
    assert align.finished(parts[0], left, right, False)["closed"].decode() == brute([text])[0][-1]


def test_registered_query_returns_every_row(spark):
    data = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op13_alignment(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in [x for x in docs if len(x["text"] or "") < 1500][:40]:
        na, nb, g, n, *_, groups = brute([d["text"]])[0]
        r = got[d["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (na, nb, g, n) and r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
