"""The prefix trie of conversations by vertical bitmaps.

Conversations are dealt to shards of about ``SHARD``. A shard has an index from (position, turn) to the bitset of its conversations that
have that turn there. Its part of the trie is found depth-first: the bitset of a node, intersected with the postings of the next position, yields its children;
their bits are counted, the lowest bit is the least member (bits are in the order of ids), and bits of conversations
of just that length are the list of those that end there. A child is taken by the lowest bit that no child has yet, so there is one
intersection a node.

A node's name is the sum over its turns of two hashes of position and turn digest, 128 bits together. Sums of names, members and end lists of all
shards give the whole trie. A conversation is the owner of the nodes whose least member it is, the lower end of its path. So what
a subtree holds is a sum over its members, and needs no walk up the trie: a childless node counts at its owner, and the words saved are
those of each member's turns, from the node down, that it doesn't own.

A conversation's turns are handled in stretches of ``SEGMENT``, each with the names and sums of what comes before and behind it, so
neither a conversation nor a shared first turn is ever gathered in a task. Only the digest of an end list is taken in one stream, as SHA-256 is; it
arrives as one sorted packed list a shard. Rows without a conversation id belong to none and are left out; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longpath.llm.common import stored
from longpath.llm.turns import WORDS, numbered
from longpath.llm.words import U, mix

SHARD, SEGMENT = 1024, 256
LOCAL = "shard int, depth bigint, x bigint, y bigint, up_x bigint, up_y bigint, least bigint, members bigint, words bigint, ends binary, leaves bigint, saved bigint"


def head_of(conv_id: Column) -> Column:
    return conv_id - conv_id % 20


def rebuilt(conversations: DataFrame, width: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, pos, digest, words) and all conversations (conv_id, n: rebuilt turns).

    Conversation c begins with the first h = crc32(c) % 4 turns of conversation c - c % 20 and goes on with its own turns after its first h.
    """
    own = stored(numbered(conversations.where("conv_id is not null"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words")), "turns")
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).withColumn("head", head_of(F.col("conv_id")))
    starts = own.where((F.col("pos") < 3) & (F.col("conv_id") == head_of(F.col("conv_id"))))
    starts = starts.groupBy(F.col("conv_id").alias("head")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("start"))  # three turns at most
    taken = convs.join(starts, "head", "left").select("conv_id", "n", "h", F.coalesce(F.slice("start", 1, F.col("h").cast("int")), F.array().cast("array<struct<pos:bigint,digest:binary,words:bigint>>")).alias("start"))
    taken = stored(taken.select("conv_id", "h", "start", F.size("start").cast("long").alias("k"), (F.size("start") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "heads")
    first = taken.select("conv_id", F.inline("start")).select("conv_id", "pos", "digest", "words")
    # what is left of a conversation is moved by k - h; both are functions of its id and head, and fit an exchange by (conversation, stretch)
    stretch = F.floor(F.col("pos") / width)
    reach = taken.select("conv_id", "h", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") + 3) / width))).alias("stretch"))
    rest = own.withColumn("stretch", stretch).join(reach, ["conv_id", "stretch"]).where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "digest", "words")
    return first.unionByName(rest), taken.select("conv_id", "n")


def _names(pos: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each turn at its position; digest holds two 64-bit numbers a row."""
    at = mix(pos.astype(U) * U(0x9E3779B97F4A7C15) + U(1))
    return mix(digest[:, 0] ^ at) + digest[:, 1], mix(digest[:, 1] + at) ^ mix(digest[:, 0])


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U).reshape(-1, 2)


def _segment_sums(table: pa.Table) -> pa.Table:
    """One stretch of a conversation: its names' sums, and words in all and before the first turn it owns."""
    pos, words = table.column("pos").to_numpy(), table.column("words").to_numpy()
    x, y = _names(pos, _digests(table.column("digest")))
    not_own = int(words[pos + 1 < table.column("own")[0].as_py()].sum())
    return pa.table({"conv_id": table.column("conv_id").slice(0, 1), "segment": table.column("segment").slice(0, 1), "x": [int(x.sum().astype(np.int64))], "y": [int(y.sum().astype(np.int64))], "not_own": [not_own]})


def _running(table: pa.Table) -> pa.Table:
    """For each stretch of a long conversation: the name sums of those before, and words not owned in those behind."""
    order = np.argsort(table.column("segment").to_numpy())
    x, y, w = (table.column(c).to_numpy()[order] for c in ("x", "y", "not_own"))
    with np.errstate(over="ignore"):
        return pa.table({"conv_id": table.column("conv_id"), "segment": table.column("segment").take(order), "x": np.cumsum(x) - x, "y": np.cumsum(y) - y, "behind": w.sum() - np.cumsum(w)})


def _shard(rows: pa.Table, width: int) -> pa.Table:
    """The nodes of one stretch of positions of one shard, with what its conversations add to them."""
    segment = rows.column("segment")[0].as_py()
    conv, pos = rows.column("conv_id").to_numpy(), rows.column("pos").to_numpy()
    order = np.lexsort((pos, conv))
    conv, pos = conv[order], pos[order]
    convs, first = np.unique(conv, return_index=True)
    n, own, leaf, behind, bx, by = (rows.column(c).to_numpy()[order][first] for c in ("n", "own", "leaf", "behind", "x", "y"))
    turn = pos >= 0  # a row of position -1 stands for the conversation itself
    index, words = np.searchsorted(convs, conv), rows.column("words").to_numpy()[order]
    digest = np.zeros((len(conv), 2), U)
    if turn.any():
        raw = rows.column("digest").take(pa.array(order[turn]))
        digest[turn] = _digests(raw)
    hx, hy = _names(pos, digest)
    at_turn, of_row = np.flatnonzero(turn), np.zeros(len(conv), np.int64)
    by_key = at_turn[np.lexsort((digest[at_turn, 1], digest[at_turn, 0], pos[at_turn]))]
    same = (pos[by_key][1:] == pos[by_key][:-1]) & (digest[by_key][1:] == digest[by_key][:-1]).all(1)
    of_row[by_key] = np.cumsum(np.concatenate(([0], ~same)))[: len(by_key)]
    postings = [0] * (int(of_row.max()) + 1)
    having, ending = {}, {}
    for r, i, p in zip(at_turn.tolist(), index[at_turn].tolist(), pos[at_turn].tolist(), strict=True):
        postings[of_row[r]] |= 1 << i
        having[p] = having.get(p, 0) | 1 << i
    for i, length in enumerate(n.tolist()):
        ending[length] = ending.get(length, 0) | 1 << i
    place = np.searchsorted(index[at_turn], np.arange(len(convs)))  # of each conversation's first turn here, among turns
    not_own = np.where(pos + 1 < own[index], words, 0)[at_turn]
    total = np.concatenate(([0], np.cumsum(not_own)))
    last = np.append(place[1:], len(at_turn))
    out: list[tuple] = []

    def members(bits: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(-(-len(convs) // 8), "little"), np.uint8), bitorder="little"))

    def emit(bits: int, depth: int, x: int, y: int, up: tuple[int, int], word: int) -> None:
        low = (bits & -bits).bit_length() - 1
        who = members(bits) if bits & (bits - 1) else np.array([low])
        ends = bits & ending.get(depth, 0)
        begin = np.minimum(place[who] + max(depth - 1 - segment * width, 0), last[who])  # the node's own turn and those below
        saved = int((total[last[who]] - total[begin] + behind[who]).sum())
        out.append((depth, x, y, *up, int(convs[low]), bits.bit_count(), word, convs[members(ends)].tobytes() if ends else None, int(leaf[who].sum()), saved))

    stack = []
    if segment == 0:
        every = (1 << len(convs)) - 1
        emit(every, 0, 0, 0, (None, None), 0)
        stack.append((every, 0, 0, 0))
    else:
        start: dict[tuple[int, int], int] = {}
        for i, name in enumerate(zip(bx.tolist(), by.tolist(), strict=True)):
            start[name] = start.get(name, 0) | 1 << i
        stack += [(bits, segment * width, *name) for name, bits in start.items()]
    signed = lambda v: ((v + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)
    hx, hy = hx[at_turn].tolist(), hy[at_turn].tolist()
    while stack:
        bits, depth, x, y = stack.pop()
        left = bits & having.get(depth, 0)
        while left:
            r = int(place[(left & -left).bit_length() - 1]) + depth - segment * width
            child = bits & postings[of_row[at_turn[r]]]
            left &= ~child
            cx, cy = signed(x + hx[r]), signed(y + hy[r])
            emit(child, depth + 1, cx, cy, (x, y), int(words[at_turn[r]]))
            stack.append((child, depth + 1, cx, cy))
    columns = dict(zip(("depth", "x", "y", "up_x", "up_y", "least", "members", "words", "ends", "leaves", "saved"), zip(*out, strict=True), strict=True))
    kinds = {"ends": pa.binary()}
    return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()] * len(out), pa.int32()), **{k: pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()}})


def _local(turns: DataFrame, convs: DataFrame, owners: DataFrame | None, width: int) -> DataFrame:
    """Nodes by shard (LOCAL); leaves and saved are right once owners (least, own, leaf: depth of the first node it owns, whether its last is childless) are known."""
    convs = convs.withColumns({"own": F.col("n") + 1, "leaf": F.lit(0).cast("long")}) if owners is None else (
        convs.join(owners.withColumnRenamed("least", "conv_id"), "conv_id", "left").withColumns({"own": F.coalesce("own", F.col("n") + 1), "leaf": F.coalesce("leaf", F.lit(0).cast("long"))}))
    each = convs.select("conv_id", "shard", "n", "own", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("n") - 1) / width), F.lit(0)))).alias("segment"))
    rows = turns.withColumn("segment", F.floor(F.col("pos") / width))
    long = rows.join(each.where(F.col("n") > width), ["conv_id", "segment"])
    sums = long.groupBy("conv_id", "segment").applyInArrow(_segment_sums, "conv_id bigint, segment bigint, x bigint, y bigint, not_own bigint")
    around = sums.groupBy("conv_id").applyInArrow(_running, "conv_id bigint, segment bigint, x bigint, y bigint, behind bigint")  # a row a stretch
    each = each.join(around, ["conv_id", "segment"], "left").na.fill(0, ["x", "y", "behind"])
    marks = each.where("segment = 0").withColumns({"pos": F.lit(-1).cast("long"), "digest": F.lit(None).cast("binary"), "words": F.lit(0).cast("long")})
    both = rows.join(each, ["conv_id", "segment"]).unionByName(marks)
    return both.groupBy("shard", "segment").applyInArrow(lambda rows: _shard(rows, width), LOCAL)


def _ends(local: DataFrame) -> DataFrame:
    """x, y and the digest of the ids that end at each node, ascending and comma-joined, streamed shard by shard (shards are ranges of ids)."""

    def run(batches):
        now, found = None, None
        for batch in batches:
            out = []
            for x, y, ends in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("ends"), strict=True):
                text = ",".join(map(str, np.frombuffer(ends.as_buffer(), np.int64).tolist())).encode()
                if now == (x, y):
                    found.update(b"," + text)
                    continue
                if now:
                    out.append((*now, found.hexdigest()))
                now, found = (x, y), hashlib.sha256(text)
            yield _digest_rows(out)
        if now:
            yield _digest_rows([(*now, found.hexdigest())])

    rows = local.where("ends is not null").select("x", "y", "shard", "ends").repartition("x", "y").sortWithinPartitions("x", "y", "shard")
    return rows.mapInArrow(run, "x bigint, y bigint, ends_sha256 string")


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    x, y, s = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(s, pa.string())], names=["x", "y", "ends_sha256"])


def trie(turns: DataFrame, convs: DataFrame, shard: int = SHARD, width: int = SEGMENT) -> DataFrame:
    """A row a node of the conversations convs (conv_id, n) with turns (conv_id, pos, digest, words); the root has the empty sequence.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. No conversation: no node.
    """
    parts = max(1, -(-convs.count() // shard))
    convs = stored(convs.repartitionByRange(parts, "conv_id").withColumn("shard", F.spark_partition_id()), "convs")
    turns = stored(turns, "rebuilt")
    first = stored(_local(turns, convs, None, width), "nodes")
    name, up = ["x", "y"], ["up_x", "up_y"]
    nodes = stored(first.groupBy("x", "y").agg(F.min("least").alias("least"), F.sum("members").alias("members"), F.first("depth").alias("depth"), F.first("up_x").alias("up_x"), F.first("up_y").alias("up_y")), "trie")
    below = nodes.where("depth > 0").groupBy(F.col("up_x").alias("x"), F.col("up_y").alias("y")).agg(F.count("*").alias("children"))
    nodes = nodes.join(below, name, "left").na.fill(0, ["children"])
    owners = nodes.groupBy("least").agg(F.min("depth").alias("own"), F.max((F.col("children") == 0).cast("long")).alias("leaf"))
    second = _local(turns, convs, owners, width).groupBy("x", "y").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    # a parent's owner is looked up within the shard of the child's owner, where a parent has few children
    known = first.select("shard", "x", "y", "least", "depth", *up).join(nodes.select("x", "y", F.col("least").alias("owner")), name)
    above = known.select("shard", F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("owner").alias("parent"))
    parents = known.where("least = owner and depth > 0").join(above, ["shard", *up]).select("x", "y", "parent")
    every = nodes.join(second, name).join(parents, name, "left").join(_ends(first), name, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return every.select(
        F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("children").cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, shard: int = SHARD, width: int = SEGMENT) -> DataFrame:
    """The trie of rebuilt conversations (conv_id, turn, role, text)."""
    return trie(*rebuilt(conversations, width), shard, width)


_STEP = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"  # eight bits of the public CRC-32
TRIE_SQL = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, substr(sha256(length(role)::VARCHAR || ':' || role || text), 1, 32)) AS s FROM turns GROUP BY conv_id),
counted AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: {_STEP}), 4294967295) % 4 AS h FROM own),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(list_slice(o.s, 1, c.h), []), list_slice(c.s, c.h + 1, len(c.s))) AS s FROM counted c LEFT JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20),
members AS (SELECT conv_id, len(s) AS n, d, list_slice(s, 1, d) AS p FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].text, '{WORDS}')) END AS words FROM members GROUP BY d, p),
below AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(children, 0) AS children FROM nodes LEFT JOIN below ON below.p = nodes.p)
SELECT a.conv_id, a.d AS depth, up.conv_id AS parent_conv_id, a.n AS n_convs, a.children AS n_children, t.n_leaves, t.saved_tokens, a.ends_sha256
FROM full_nodes a LEFT JOIN nodes up ON up.d = a.d - 1 AND up.p = list_slice(a.p, 1, a.d - 1)
JOIN (SELECT x.d, x.p, count(*) FILTER (WHERE y.children = 0) AS n_leaves, CAST(sum((y.n - 1) * y.words) AS BIGINT) AS saved_tokens
  FROM nodes x JOIN full_nodes y ON y.d >= x.d AND list_slice(y.p, 1, x.d) = x.p GROUP BY ALL) t ON t.d = a.d AND t.p = a.p
"""
