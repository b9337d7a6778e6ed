"""The prefix trie and the formatting of conversations against brute force, on odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from longpath.llm import chat, trie

SCHEMA = "conv_id long, turn long, role string, text string, n long, depth string, shard int"


def rows_of(kind):
    rng = random.Random(kind)
    rows = []
    said = [(r, f"{w} {w}x " * k) for r in ("user", "assistant", "system") for w, k in (("a", 1), ("b", 2), ("", 0))]
    for c in rng.sample(range(200), 90):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, *rng.choice(said[: 2 + c % 8])))
    rows += [(20, t, "user", "same") for t in range(3)] + [(c, t, "user", "same") for c in range(300, 330) for t in range(c % 5)]
    rows += [(400, None, None, None), (400, 0, "user", None), (400, 0, None, "x y"), (400, 7, "user", "z"), (400, 7, "user", "z"), (None, 0, "user", "nobody"), (None, None, None, None)]
    rows += [(500, t, "user", f"long {t % 7}") for t in range(40)] + [(501, t, "user", f"long {t % 7}") for t in range(33)] + [(-5, 0, "user", "minus"), (10**15, 0, "user", "far away " * 3000)]
    return rows


def turn_key(row):
    role, text = row[2] or "", row[3] or ""
    return (row[1] is not None, row[1] or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16])


def by_conversation(rows):
    found = defaultdict(list)
    for r in sorted(rows, key=turn_key):
        found[r[0]].append((r[2] or "", r[3] or ""))
    return dict(found)


def brute_trie(rows):
    own = by_conversation([r for r in rows if r[0] is not None])
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(own.get(c - int(abs(c) % 20 * (1 if c > 0 else -1)), [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, s in sorted(seqs.items()):
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    children = defaultdict(set)
    for p in nodes:
        if p:
            children[p[:-1]].add(p)
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, cs in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1].split()) if p else 0
            leaves[p[:d]] += not children[p]
    return sorted(
        (cs[0], len(p), nodes[p[:-1]][0] if p else None, len(cs), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in cs if len(seqs[c]) == len(p)).encode()).hexdigest())
        for p, cs in nodes.items()
    )


@pytest.mark.parametrize("kind,shard,segment", [(1, 1024, 256), (2, 7, 256), (3, 16, 4), (4, 1, 3)])
def test_trie(spark, kind, shard, segment):
    rows = rows_of(kind)
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in trie.prefix_trie(table, shard, segment).collect())
    assert got == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    got = trie.prefix_trie(spark.createDataFrame([(21, 0, "user", "x", 1, "", 1)], SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute_trie([(21, 0, "user", "x")]), key=repr)


MARKS = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "a<", "|b", "\\|b", "<\\\\|", "<|", "\n<|im_end|>\n", "", None, "日本 <|endoftext|> 🙂"]


def chat_rows(kind):
    rng = random.Random(kind)
    rows = rows_of(kind)
    rows += [(600 + i, t, rng.choice(["user", "assistant", "assistant", "a\nb", "\\n<|", None]), rng.choice(MARKS)) for i in range(40) for t in range(rng.randint(1, 12))]
    return rows + [(c, t, "assistant" if t % 2 else "user", f"shared {t} " * 40) for c in range(700, 720) for t in range(3)]


def brute_chat(rows):
    out = []
    for c, turns in by_conversation(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        lines = [(chat.role_line(r), chat.escaped(t)) for r, t in turns]
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(r) + len(t) + 24 for r, t in lines)))
    return out


@pytest.mark.parametrize("kind,budget,part", [(1, 1 << 16, 4096), (2, 200, 4), (3, 1, 7)])
def test_formatted(spark, kind, budget, part):
    rows = chat_rows(kind)
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)
    got = chat.formatted(chat.with_injection(table), budget=budget, part=part).collect()
    expected = brute_chat(rows + [(-1, 0, "user", chat.INJECTED), (-1, 1, "assistant", chat.INJECTED)])
    assert sorted((tuple(r) for r in got), key=repr) == sorted(expected, key=repr)


def test_packs_share_turns_once(spark):
    rows = [(c, t, "user", f"turn {t} " * 30 if t < 3 else f"own {c}") for c in range(10) for t in range(4)]
    packs = chat.packed(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1), chat.model_path())
    nodes = [r for r in packs.collect() if r["tokens"]]
    assert len(nodes) <= 10 + 3 * len({r["pack"] for r in nodes})
    for r in nodes:  # positions go on from the ancestors, and intervals hold just their tokens
        assert sum(x["stop"] - x["start"] for x in r["attends"]) == r["position"] and len(r["tokens"]) == r["size"]


def test_escape():
    for text in MARKS:
        if text is not None:
            assert chat.unescaped(chat.escaped(text)) == text and "<|" not in chat.escaped(text) and chat.line_role(chat.role_line(text)) == text and "\n" not in chat.role_line(text)


def test_no_conversations(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0
