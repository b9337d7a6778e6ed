"""Minimizers, contigs in order and consensus against brute force and planted errors."""

import random

import numpy as np
import pytest

from longpath.operators import consensus, minimizers, scaffold
from longpath.operators.sampled import hashes

K, W = 15, 5


def turned(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def drawn(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def brute(seq, k, w):
    """{place: (code, strand)} by words."""
    number = lambda m: int("".join(str("ACGT".index(c)) for c in m), 4)
    seq = (seq or "").upper()
    found = []
    for p in range(len(seq) - k + 1):
        m = seq[p : p + k]
        if set(m) <= set("ACGT"):
            code = min(number(m), number(turned(m)))
            found.append((int(hashes(np.array([code]), 0)[0]), p, code, int(number(turned(m)) < number(m))))
        else:
            found.append(None)
    out = {}
    for i in range(max(len(found) - w + 1, 1)):
        window = [x for x in found[i : i + w] if x]
        if window:
            _, p, code, strand = min(window)
            out[p] = (code, strand)
    return out


@pytest.mark.parametrize("w,piece", [(1, 7), (5, 1 << 20), (5, 3), (8, 64), (37, 50)])
def test_minimizers(spark, w, piece):
    rng = random.Random(w)
    rows = [drawn(rng, n) for n in (0, 14, 15, 16, 18, 200, 997)] + ["A" * 120, "ACGT" * 40, drawn(rng, 60) + "N" + drawn(rng, 20) + "N" * 40 + drawn(rng, 90), drawn(rng, 80).lower(), None]
    got = {}
    for r in minimizers.minimizers(spark.createDataFrame(list(enumerate(rows)), "id long, seq string"), K, w, piece).collect():
        assert (r["id"], r["place"]) not in got  # named once, in whatever pieces
        got[r["id"], r["place"]] = (r["code"], r["strand"])
    assert got == {(i, p): v for i, x in enumerate(rows) for p, v in brute(x, K, w).items()}


def test_bounds(spark):
    empty = spark.createDataFrame([], "id long, seq string")
    assert minimizers.minimizers(empty, K, W).count() == 0
    for k, w in ((0, 1), (32, 1), (5, 0)):
        with pytest.raises(ValueError):
            minimizers.minimizers(empty, k, w)


def test_contigs_in_order(spark):
    """Pieces of two genomes, some turned, are put in order by reads that run over them."""
    rng = random.Random(3)
    genomes = [drawn(rng, 6000), drawn(rng, 4000)]
    pieces, truth = [], []
    for g, genome in enumerate(genomes):
        for at in range(0, len(genome) - 450, 500):
            flip = rng.random() < 0.5
            truth.append((g, at, len(pieces), flip))
            pieces.append(turned(genome[at : at + 450]) if flip else genome[at : at + 450])
    pieces.append(drawn(rng, 400))  # no read knows it
    names = rng.sample(range(100, 200), len(pieces))
    reads = [genomes[g][a : a + 1300] for g in (0, 1) for a in range(0, len(genomes[g]) - 900, 150)]
    reads = [turned(x) if rng.random() < 0.5 else x for x in reads] + ["", None, drawn(rng, 500)]
    contigs = spark.createDataFrame(list(zip(names, pieces, strict=True)), "id long, seq string")
    met = minimizers.meetings(minimizers.minimizers(spark.createDataFrame(list(enumerate(reads)), "id long, seq string"), K, W), minimizers.unique(minimizers.minimizers(contigs, K, W)))
    found = scaffold.edges(met, contigs.selectExpr("id AS contig", "cast(length(seq) AS long) AS length"), K, 2, 2)
    assert all(r["gap"] == 50 for r in found.collect())
    got = {}
    for r in scaffold.chains(contigs.selectExpr("id AS contig"), scaffold.joins(found)).collect():
        got.setdefault(r["chain"], []).append((r["place"], r["contig"], r["turned"]))
    want = [[(names[-1], False)]] + [[(names[c], flip) for g, _, c, flip in truth if g == genome] for genome in (0, 1)]
    chains = [[x[1:] for x in sorted(c)] for c in got.values()]
    assert all([p for p, *_ in sorted(c)] == list(range(len(c))) for c in got.values())
    assert len(chains) == 3
    for chain in want:
        assert chain in chains or [(c, not flip) for c, flip in chain[::-1]] in chains


def walk(contigs, joined):
    """Chains by loops: {contig: (chain, place, turned)}."""
    at, rings = {}, set()
    for x, y in joined:
        at[x], at[y] = y, x
    for broken in (False, True):
        out = {}
        for c in contigs:
            best = None
            for state in (2 * c, 2 * c + 1):
                now, steps, passed = state, 0, []
                while now ^ 1 in at:
                    passed.append(min(now ^ 1, at[now ^ 1]))
                    now, steps = at[now ^ 1], steps + 1
                    if now == state:
                        rings.add(min(passed))
                        break
                this = (now ^ 1, steps, state % 2 == 0)
                best = this if best is None or this < best else best
            out[c] = best
        for x in rings if not broken else ():
            at.pop(at.pop(x))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_chains_and_rings(spark, seed):
    rng = random.Random(seed)
    contigs = list(range(40))
    ends = list(range(80))
    rng.shuffle(ends)
    joined = []
    while len(ends) > (8 if seed else 79):
        x, y = ends.pop(), ends.pop()
        if x // 2 != y // 2:
            joined.append((min(x, y), max(x, y)))
    joined += [] if seed else [(i, i + 1) for i in range(21, 60, 2)] + [(20, 61)]  # one ring
    if not seed:
        joined = joined[-21:]
    table = spark.createDataFrame(joined, "low_end long, high_end long")
    got = {r["contig"]: (r["chain"], r["place"], r["turned"]) for r in scaffold.chains(spark.createDataFrame([(c,) for c in contigs], "contig long"), table).collect()}
    assert got == walk(contigs, joined)


def test_planted_errors_are_corrected(spark):
    rng = random.Random(11)
    truth = [drawn(rng, 3000), drawn(rng, 1200)]

    def spoiled(seq, share):
        out = []
        for c in seq:
            x = rng.random()
            out.append(c if x > share else rng.choice("ACGT") if x > share * 0.6 else "" if x > share * 0.3 else c + rng.choice("ACGT"))
        return "".join(out)

    drafts = [(i, x[:150] + spoiled(x[150:-150], 0.01) + x[-150:]) for i, x in enumerate(truth)] + [(7, drawn(rng, 300)), (8, ""), (9, None)]
    reads = [spoiled(x[a : a + 900], 0.01) for x in truth for a in range(0, len(x) - 300, 40)]
    reads = list(enumerate([turned(x) if rng.random() < 0.5 else x for x in reads] + ["", None]))
    contigs, covering = (spark.createDataFrame(x, "id long, seq string").repartition(3) for x in (drafts, reads))
    met = minimizers.meetings(minimizers.minimizers(covering, K, W), minimizers.unique(minimizers.minimizers(contigs, K, W)))
    for width in (1 << 16, 100):
        changes = consensus.corrections(contigs, covering, met, K, 3, width)
        got = {r["id"]: (r["changes"], r["seq"]) for r in consensus.polished(contigs, changes).collect()}
        assert [got[i][1] for i in (0, 1)] == truth and all(got[i][0] > 3 for i in (0, 1))
        assert all(got[i] == (0, x) for i, x in drafts[2:])
        assert all(0 < r["votes"] <= r["voters"] for r in changes.collect())
    none = minimizers.meetings(minimizers.minimizers(covering.limit(0), K, W), minimizers.unique(minimizers.minimizers(contigs, K, W)))
    assert consensus.corrections(contigs, covering.limit(0), none, K).count() == 0


def test_minimizers_are_handed_on_in_bounded_batches():
    import pyarrow as pa

    rng = random.Random(8)
    seqs = ["".join(rng.choice("ACGT") for _ in range(300)).encode() for _ in range(20)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(20)), "first": [0] * 20, "early": [0] * 20, "seq": seqs})
    (whole,), parts = minimizers.found_in(batch, 24, 8, 1 << 20), list(minimizers.found_in(batch, 24, 8, 900))
    assert len(parts) == 7 and all(len(set(p.column("id").to_pylist())) <= 3 for p in parts)
    assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches([whole]).to_pylist()
