"""Exact top-k by inner product: columnar branch and bound.

Vectors are turned into whole numbers, floor(scale * x), and packed in blocks of vertical layout (all values of one
component together). Query blocks meet every candidate block: a stated query set against all rows, in blocks. For such a pair
scores grow component block by component block, the components of most energy first. What is still missing of
a score is at most the product of the lengths of both vectors' remaining parts (Cauchy-Schwarz); a pair whose score
plus that bound is below the query's k-th best so far is given up. The k-th best comes from earlier blocks of the task and from
lower bounds. When few pairs survive they are compacted into a list, and only their values are read.

Whole-number scores are summed in doubles while they stay below 2^53, else in 64-bit integers (the caller keeps scores within
them). Bounds carry a margin for rounding, so no result is lost. Ties go to the smaller id.

Queries go to the tasks in super-blocks of about ``super_rows`` rows at most, and of ``super_bytes`` bytes, each a broadcast of bounded size, one after the other;
candidates are never shuffled. Each task gives k rows a query, of which Spark keeps the k best. Only vectors of equal
dimension are compared. Null ids, null vectors, and vectors that hold null or a non-finite component take no part. Rows
with the query's own id are not its candidates. Repeated ids are candidates each. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT = float(1 << 53)


def usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & (F.size(vector) > 0)


def _pack(rows: DataFrame, scale: float, block_rows: int) -> DataFrame:
    """dim, ids and data (component-major int64) of blocks of rows (id, v)."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            v = batch.column("v")
            size = np.diff(np.asarray(v.offsets))
            flat, at = np.asarray(v.flatten()).astype(np.float64), np.concatenate(([0], np.cumsum(size)))
            out: tuple[list, list, list] = ([], [], [])
            for dim in np.unique(size).tolist():
                same = np.flatnonzero(size == dim)
                for a in range(0, len(same), block_rows):
                    part = same[a : a + block_rows]
                    x = np.floor(scale * flat[at[part, None] + np.arange(dim)]).astype(np.int64)
                    out[0].append(dim)
                    out[1].append(ids[part].tobytes())
                    out[2].append(np.ascontiguousarray(x.T).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["dim", "ids", "data"])

    return rows.mapInArrow(run, "dim int, ids binary, data binary")


class Best:
    """The k best of each query of a block so far: scores (descending) and ids."""

    def __init__(self, m: int, k: int):
        self.k = k
        self.score = np.full((m, k), -np.inf)
        self.id = np.full((m, k), np.iinfo(np.int64).max)

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        m = len(self.score)
        rows = np.concatenate((np.repeat(np.arange(m), self.k), row))
        scores, names = np.concatenate((self.score.ravel(), score)), np.concatenate((self.id.ravel(), ids))
        order = np.lexsort((names, -scores, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(m))[rows]
        keep = order[place < self.k]
        self.score, self.id = scores[keep].reshape(m, self.k), names[keep].reshape(m, self.k)


def search(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, best: Best, step: int = 16, few: float = 0.1) -> None:
    """Adds the candidates c (dim x n) that are among the best of the queries q (dim x m)."""
    dim, k = len(q), best.k
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dim
    kind = np.float64 if top < LIMIT else np.int64
    order = np.argsort(-(q.astype(np.float64) ** 2).sum(1), kind="stable")  # most energy first
    qf, cf = q[order].astype(kind), c[order].astype(kind)
    tail = lambda x: np.sqrt(np.concatenate((np.cumsum((x.astype(np.float64) ** 2)[::-1], axis=0)[::-1], np.zeros((1, x.shape[1])))))
    q_tail, c_tail = tail(qf), tail(cf)
    score = np.zeros((q.shape[1], c.shape[1]), kind)
    own = q_ids[:, None] == c_ids[None, :]
    alive = None
    for a in range(0, dim, step):
        b = min(a + step, dim)
        if alive is None:
            score += qf[a:b].T @ cf[a:b]
        else:
            part = score[alive[0], alive[1]]
            for d in range(a, b):
                part = part + qf[d, alive[0]] * cf[d, alive[1]]
            score[alive[0], alive[1]] = part
        if b == dim:
            break
        if alive is None:
            bound = q_tail[b][:, None] * c_tail[b][None, :] * (1 + 1e-9) + 0.5
            least = best.score[:, -1]
            if c.shape[1] > k:
                low = np.where(own, -np.inf, score - bound)
                least = np.maximum(least, np.partition(low, c.shape[1] - k, axis=1)[:, c.shape[1] - k])
            open_pairs = (score + bound >= least[:, None]) & ~own
            if open_pairs.mean() < few:
                alive = np.nonzero(open_pairs)
        else:
            bound = q_tail[b][alive[0]] * c_tail[b][alive[1]] * (1 + 1e-9) + 0.5
            left = score[alive[0], alive[1]] + bound >= best.score[alive[0], -1]
            alive = alive[0][left], alive[1][left]
    if alive is None:
        row, col = np.nonzero((score >= best.score[:, -1:]) & ~own)
        if len(row) > 8 * k * len(q_ids) and c.shape[1] > k:  # the first block: only what can be among its own best
            own_least = np.partition(np.where(own, -np.inf, score), c.shape[1] - k, axis=1)[:, c.shape[1] - k]
            row, col = np.nonzero((score >= np.maximum(own_least[:, None], best.score[:, -1:])) & ~own)
    else:
        row, col = alive
    best.add(row, c_ids[col], score[row, col].astype(np.float64) if kind is np.float64 else score[row, col])


def top_k(rows: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 512, block_rows: int = 2048, super_rows: int = 1 << 17, super_bytes: int = 1 << 28) -> DataFrame:
    """query_id, rank (from 1), the candidate's id and score, for each row for which queries holds."""
    base = rows.where(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), queries.alias("asked"))
    candidates = _pack(base.select("id", "v"), scale, block_rows)
    asked = base.where("asked").select("id", "v").distinct()
    n, dim = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    super_rows = max(1, min(super_rows, super_bytes // (8 * dim)))
    query_block = min(query_block, super_rows)
    blocks, supers = max(1, -(-n // query_block)), max(1, -(-n // super_rows))

    def find(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray, Best]] = {}
        for batch in batches:
            for dim, ids, data, qb, q_ids, q_data in zip(*(batch.column(c) for c in ("dim", "ids", "data", "qb", "q_ids", "q_data")), strict=True):
                d, key = dim.as_py(), qb.as_py()
                if key not in held:
                    names = np.frombuffer(q_ids.as_py(), np.int64)
                    held[key] = names, np.frombuffer(q_data.as_py(), np.int64).reshape(d, -1), Best(len(names), k)
                names, q, best = held[key]
                search(q, names, np.frombuffer(data.as_py(), np.int64).reshape(d, -1), np.frombuffer(ids.as_py(), np.int64), best)
        for names, _, best in held.values():
            found = best.score > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, found.sum(1))), pa.array(best.id[found]), pa.array(best.score[found].astype(np.int64))], names=["query_id", "id", "score"])

    parts = []
    for s in range(supers):
        block = F.pmod(F.xxhash64("id"), F.lit(blocks))
        mine = asked.where(F.pmod(block, F.lit(supers)) == s) if supers > 1 else asked
        packed = _pack(mine.repartition(max(1, blocks // supers), block), scale, query_block)
        packed = packed.select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.monotonically_increasing_id().alias("qb"))
        parts.append(candidates.join(F.broadcast(packed), "dim").mapInArrow(find, "query_id bigint, id bigint, score bigint"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
