"""What the tokenizer remembers is bounded, and bounds change no ids."""

import pyarrow as pa

from longpath.llm import common, pieces


def test_forgotten_decisions_change_no_ids(monkeypatch):
    texts = [f"A small text number {i}, of unusual woooords like zq{i}xv." for i in range(60)]
    vocab = pieces.Vocabulary(open(pieces.model_path(), "rb").read())
    want = [vocab.encode([t])[1].tolist() for t in texts]
    monkeypatch.setattr(pieces, "DECIDED", 50)
    vocab = pieces.Vocabulary(open(pieces.model_path(), "rb").read())
    most, got = 0, []
    for t in texts:
        got.append(vocab.encode([t])[1].tolist())
        most = max(most, len(vocab.decided))
    assert got == want and most < 600


def test_kernels_give_memory_back(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, text string")
    out = common.kernel(rows, lambda: lambda batch: {"id": batch.column("id"), "n": pa.array([2] * batch.num_rows)}, "id bigint, n bigint")
    assert sorted(map(tuple, out.collect())) == [(1, 2), (2, 2)]
    common.give_back()
