"""Near-duplicate vectors by a forest of random-projection trees, with crowds of near copies taken out before.

Vectors link when their labels are equal and not null and their cosine (double precision) is at least ``least``.

1. Equal vectors of a label are one class, kept once with its size.
2. Crowds. A bounded sample of ``sample`` classes (of at most ``sample_bytes``) shows where many vectors lie close together: a
   sampled vector that links with ``crowd`` others of the sample is a centre, unless an earlier one covers it. A class within
   the linking angle of a centre is a member of the nearest such centre's crowd. All its links lie within twice that angle of the
   centre; classes there that are not members visit the crowd as guests. Members are compared with members and guests, block
   against block, so no link of a member is missed, and splits never run through a crowd. Within a crowd, classes in half of the linking angle of
   each other form balls, whose pairs all link (triangle inequality of angles) and are counted, not listed.
3. Forest, for all classes that are no members: ``trees`` trees of random splits at the median, with a spill of +-``spill`` quantiles
   going both ways. The upper levels get their quantiles from the sample; directions come from a seed, so tasks make them again
   instead of receiving them. Leaves of more than ``limit`` rows of a label are split on in Spark rounds, on quantiles of their own, whatever the size
   of the table. Classes are compared within leaves, and links found in several trees count once.
4. Union: components of balls and single classes by alternating large-star and small-star.

Every pair found is verified by its cosine, none below ``least`` links. Links of crowds are complete; in the forest a link is missed if every
tree parts it. Vectors that are null, zero, empty, hold null or non-finite components, or have a null label link with nothing and are their own
components. Null ids: counted as vectors, component_id is the least id there is. Repeated rows are vectors of their own, linked to each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longpath.llm.common import drop_stored, stored
from longpath.llm.components import components
from longpath.llm.topk import usable


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1, keepdims=True))


_directions: dict[tuple, np.ndarray] = {}


def direction(dim: int, *key: int) -> np.ndarray:
    """A random unit vector, the same wherever the key is the same."""
    if (dim, *key) not in _directions:
        if len(_directions) * dim > 1 << 21:
            _directions.clear()
        x = np.random.default_rng([dim, *(k & 0xFFFFFFFFFFFFFFFF for k in key)]).normal(size=dim)
        _directions[(dim, *key)] = x / np.sqrt(x @ x)
    return _directions[(dim, *key)]


class Tree:
    """Recursive random splits: each node has the quantiles 0.5 - spill, 0.5 + spill of its sample along its direction."""

    def __init__(self, sample: np.ndarray, leaf: int, spill: float, seed: int):
        self.dim, self.seed = sample.shape[1], seed
        self.nodes: list[tuple[float, float, int, int]] = []
        self.leaves = 0
        self.root = self._grow(sample, leaf, spill)

    def _grow(self, x: np.ndarray, leaf: int, spill: float) -> int:
        if len(x) > leaf:
            at = len(self.nodes)
            p = x @ direction(self.dim, self.seed, at)
            low, mid, high = np.quantile(p, [0.5 - spill, 0.5, 0.5 + spill])
            left, right = x[p < mid], x[p >= mid]
            if len(left) and len(right):
                self.nodes.append(None)
                self.nodes[at] = (low, high, self._grow(left, leaf, spill), self._grow(right, leaf, spill))
                return at
        self.leaves += 1
        return -self.leaves

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all rows; a row that spills is in several leaves."""
        rows, leaves, todo = [], [], [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -node))
                continue
            low, high, a, b = self.nodes[node]
            p = x[at] @ direction(self.dim, self.seed, node)
            todo.append((a, at[p <= high]))
            todo.append((b, at[p >= low]))
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def crowded(x: np.ndarray, least: float, crowd: int, strip: int = 512) -> np.ndarray:
    """Centres: vectors that link with crowd others, most links first, unless they link with an earlier centre."""
    links = np.concatenate([(x[i : i + strip] @ x.T >= least).sum(1) for i in range(0, len(x), strip)]) - 1
    covered, found = np.zeros(len(x), bool), []
    for i in np.argsort(-links, kind="stable"):
        if links[i] < crowd:
            break
        if not covered[i]:
            found.append(i)
            covered |= x @ x[i] >= least
    return x[found]


class Plan:
    """Centres by dimension and label, and trees by dimension, fitted on the sample: what every task knows."""

    def __init__(self, labels: list, vectors: list, total: int, least: float, crowd: int, trees: int, spill: float, leaf_rows: int, seed: int):
        self.angle = float(np.arccos(least))
        self.centres: dict[tuple[int, object], tuple[int, np.ndarray]] = {}  # with the number of the first
        self.trees: dict[int, list[Tree]] = {}
        by: dict[int, dict[object, list]] = {}
        for label, v in zip(labels, vectors, strict=True):
            by.setdefault(len(v), {}).setdefault(label, []).append(v)
        n = 0
        for dim, groups in sorted(by.items()):
            rest, share = [], []
            for label, part in sorted(groups.items(), key=lambda x: repr(x[0])):
                x = unit(np.array(part, np.float64))
                centres = crowded(x, least, crowd)
                if len(centres):
                    self.centres[dim, label] = n, centres
                    n += len(centres)
                    x = x[(x @ centres.T < least).all(1)]
                rest.append(x)
                share.append(len(x))
            rest, share = np.concatenate(rest), np.array(share) / max(sum(share), 1)
            # a leaf holds about leaf_rows rows of a label
            leaf = max(4, int(leaf_rows * len(vectors) / max(total, 1) / max(float(share @ share), 1e-3)))
            self.trees[dim] = [Tree(rest, leaf, spill, seed + i) for i in range(trees)] if len(rest) else []

    def crowds(self, dim: int, label: object, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The crowd each row is a member of (-1: none), and (row, crowd) of visits."""
        first, centres = self.centres.get((dim, label), (0, None))
        none = np.empty(0, np.int64)
        if centres is None:
            return np.full(len(x), -1), none, none
        away = np.arccos(np.clip(x @ centres.T, -1, 1))
        nearest = away.argmin(1)
        home = np.where(away[np.arange(len(x)), nearest] <= self.angle, nearest, -1)
        row, to = np.nonzero(away <= 2 * self.angle + 1e-6)
        # a pair of members of two crowds is compared in the one of smaller number
        visit = (to != home[row]) & ((home[row] < 0) | (to < home[row]))
        return np.where(home < 0, -1, home + first), row[visit], to[visit] + first


def _with(schema: T.StructType, **more: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in more.items()]])


def _crowds(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows (label, v, ...) with crowd and guest: once as they are (crowd -1: no member), and once for each visit."""

    def run(batches):
        for batch in batches:
            size = np.diff(np.asarray(batch.column("v").offsets))
            labels = batch.column("label").to_pylist()
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(size.tolist(), labels, strict=True)):
                groups.setdefault(key, []).append(i)
            at, crowd, guest = [], [], []
            for (dim, label), mine in groups.items():
                mine = np.array(mine)
                home, row, to = plan.crowds(dim, label, unit(matrix(batch.column("v").take(pa.array(mine)))))
                at += [mine, mine[row]]
                crowd += [home, to]
                guest += [np.zeros(len(mine), bool), np.ones(len(row), bool)]
            if at:
                out = batch.take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(crowd), pa.int64()), pa.array(np.concatenate(guest))], names=[*out.schema.names, "crowd", "guest"])

    return rows.mapInArrow(run, _with(rows.schema, crowd=T.LongType(), guest=T.BooleanType()))


def _placed(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows (v, ...) with cell (dimension, tree, leaf), once for each leaf."""

    def run(batches):
        for batch in batches:
            size = np.diff(np.asarray(batch.column("v").offsets))
            at, cell = [], []
            for dim in np.unique(size).tolist():
                same = np.flatnonzero(size == dim)
                x = unit(matrix(batch.column("v").take(pa.array(same))))
                for i, tree in enumerate(plan.trees.get(dim) or []):
                    row, leaf = tree.place(x)
                    at.append(same[row])
                    cell.append((np.int64(dim) * 1000 + i) * 100_000_000 + leaf)
                if not plan.trees.get(dim):  # a dimension that the sample missed
                    at.append(same)
                    cell.append(np.full(len(same), dim * 1000 * 100_000_000))
            if at:
                out = batch.take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cell))], names=[*out.schema.names, "cell"])

    return rows.mapInArrow(run, _with(rows.schema, cell=T.LongType()))


def _split_on(placed: DataFrame, limit: int, spill: float, rounds: int = 40) -> DataFrame:
    """placed, with every (label, cell) of more than limit rows split, round by round, at quantiles of its own rows."""
    done, rest = None, stored(placed, "leaves")
    for r in range(rounds):
        sizes = rest.groupBy("label", "cell").agg(F.count("*").alias("rows"))
        big = stored(sizes.where(F.col("rows") > limit).select("label", "cell"), "big-leaves")
        if big.isEmpty():
            break
        fine = rest.join(big, ["label", "cell"], "left_anti")
        done = fine if done is None else done.unionByName(fine)

        def project(batches, r=r):
            for batch in batches:
                size, cell = np.diff(np.asarray(batch.column("v").offsets)), np.asarray(batch.column("cell"))
                p = np.zeros(batch.num_rows)
                for dim in np.unique(size).tolist():
                    same = np.flatnonzero(size == dim)
                    x = unit(matrix(batch.column("v").take(pa.array(same))))
                    for c in np.unique(cell[same]):
                        mine = cell[same] == c
                        p[same[mine]] = x[mine] @ direction(dim, int(c), r)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "p"])

        rows = stored(rest.join(big, ["label", "cell"]).select(*rest.columns).mapInArrow(project, _with(rest.schema, p=T.DoubleType())), "projected")
        cut = rows.groupBy("label", "cell").agg(F.percentile_approx("p", [0.5 - spill, 0.5 + spill], 1000).alias("q"))
        sides = F.array_compact(F.array(F.when(F.col("p") <= F.col("q")[1], F.lit(0)), F.when(F.col("p") >= F.col("q")[0], F.lit(1))))
        halves = rows.join(cut, ["label", "cell"]).withColumn("side", F.explode(sides))
        rest = stored(halves.withColumn("cell", F.xxhash64("cell", F.lit(r), "side")).select(*rest.columns), "leaves")
    return rest if done is None else done.unionByName(rest)


def _forest_links(placed: DataFrame, least: float) -> DataFrame:
    """Distinct linked pairs (a, b) of nodes, a < b, with their sizes, from comparisons within (label, cell)."""

    def run(table: pa.Table) -> pa.Table:
        node, size, v = np.asarray(table.column("node")), np.asarray(table.column("size")), table.column("v").combine_chunks()
        a, b = [], []
        length = np.diff(np.asarray(v.offsets))
        for dim in np.unique(length).tolist():
            same = np.flatnonzero(length == dim)
            x = unit(matrix(v.take(pa.array(same))))
            for i in range(0, len(x), 512):
                p, q = np.nonzero(x[i : i + 512] @ x[i:].T >= least)
                keep = q > p
                a.append(same[i + p[keep]])
                b.append(same[i + q[keep]])
        a, b = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (a, b))
        turn = node[a] > node[b]
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        return pa.table({"a": node[a], "b": node[b], "size_a": size[a], "size_b": size[b]})

    return placed.groupBy("label", "cell").applyInArrow(run, "a bigint, b bigint, size_a bigint, size_b bigint").distinct()


def _balls(members: DataFrame, part: int, angle: float, heavy: int) -> DataFrame:
    """node, ball (its centre's node) and angle to the centre, within a crowd's parts of about part rows; a ball of fewer than heavy members is dissolved."""
    reach = np.cos(angle / 2 - 1e-6)

    def run(table: pa.Table) -> pa.Table:
        node, x = np.asarray(table.column("node")), unit(matrix(table.column("v").combine_chunks()))
        order = np.argsort(node, kind="stable")
        ball, off, free = np.full(len(node), -1), np.zeros(len(node)), np.ones(len(node), bool)
        for i in order:
            if free[i]:
                s = x @ x[i]
                mine = np.flatnonzero(free & (s >= reach))
                mine = mine if i in mine else np.append(mine, i)
                free[mine] = False
                if len(mine) < heavy:
                    ball[mine] = node[mine]
                    continue
                ball[mine], off[mine] = node[i], np.arccos(np.clip(s[mine], -1, 1))
                off[i] = 0
        return pa.table({"node": node, "ball": ball, "off": off})

    sizes = members.groupBy("crowd").agg(F.ceil(F.count("*") / part).cast("long").alias("parts"))
    parted = members.join(sizes, "crowd").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    # dealt anew: after the join on crowd alone, all parts of a crowd would stay in one task
    return parted.repartition("crowd", "part").groupBy("crowd", "part").applyInArrow(run, "node bigint, ball bigint, off double")


class Block:
    """Vectors ball by ball, the centre first, with each ball's radius and summed size; root is the ball's name at home."""

    def __init__(self, rows: pa.Table):
        ball, node = np.asarray(rows.column("ball")), np.asarray(rows.column("node"))
        order = np.lexsort((node != ball, ball))
        self.node, self.size, self.x = node[order], np.asarray(rows.column("size"))[order], unit(matrix(rows.column("v").combine_chunks()))[order]
        self.ball, self.start = np.unique(ball[order], return_index=True)
        self.end = np.append(self.start[1:], len(order))
        self.radius, self.weight = np.maximum.reduceat(np.asarray(rows.column("off"))[order], self.start), np.add.reduceat(self.size, self.start)
        self.centre, self.several = self.x[self.start], self.end - self.start > 1
        self.root, self.guest = np.asarray(rows.column("root"))[order][self.start], np.asarray(rows.column("guest"))[order][self.start].astype(bool)
        self.by_ball, self.by_node = np.zeros(len(self.ball), np.int64), np.zeros(len(order), np.int64)


def compare(left: Block, right: Block, least: float, strip: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Adds the links between two blocks (or within one) to their counts; returns edges that span the linked balls. Guests don't meet guests."""
    angle, own = float(np.arccos(least)), left is right
    group = np.arange(len(right.ball))  # balls of the right side that are connected so far
    lefts, rights = [], []
    for a in range(0, len(left.ball), strip):
        rows = slice(a, min(a + strip, len(left.ball)))
        s = left.centre[rows] @ right.centre.T
        linked = s >= least
        some = None
        if left.several[rows].any() or right.several.any():
            wide = left.several[rows][:, None] | right.several
            between, reach = np.arccos(np.clip(s, -1, 1)), left.radius[rows][:, None] + right.radius
            linked = np.where(wide, between + reach <= angle - 1e-6, linked)
            some = wide & ~linked & (between <= angle + reach + 1e-6)
        both = left.guest[rows][:, None] & right.guest
        if own:
            at = np.arange(rows.stop - a)
            both[at, a + at] = True
        linked &= ~both
        if some is not None:
            some &= ~both
        if linked.any():
            left.by_ball[rows] += linked @ right.weight
            if not own:
                right.by_ball += left.weight[rows] @ linked
        for i, j in zip(*np.nonzero(some), strict=True) if some is not None else ():
            p, q = slice(left.start[a + i], left.end[a + i]), slice(right.start[j], right.end[j])
            pairs = left.x[p] @ right.x[q].T >= least
            if pairs.any():
                linked[i, j] = True
                left.by_node[p] += pairs @ right.size[q]
                if not own:
                    right.by_node[q] += left.size[p] @ pairs
        for i in np.flatnonzero(linked.any(1)):
            to = np.flatnonzero(linked[i])
            names, first = np.unique(group[to], return_index=True)
            lefts.append(np.full(len(names), left.root[a + i]))
            rights.append(right.root[to[first]])
            if len(names) > 1:
                group[np.isin(group, names)] = names[0]
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (lefts, rights))


def _compared(rows: DataFrame, block: int, least: float) -> DataFrame:
    """Rows of three kinds: more links of a ball's every member, more links of a node, an edge from ball to other."""
    parts = rows.groupBy("crowd").agg(F.ceil(F.count("*") / block).cast("long").alias("parts"))
    rows = rows.join(parts, "crowd").withColumn("part", F.pmod(F.xxhash64("ball"), F.col("parts")))
    # every pair of parts meets once: part i goes to (i, j) for all j
    pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.select("crowd", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "ball", "root", "guest", "node", "off", "size", "v")

    def run(table: pa.Table) -> pa.Table:
        part, i, j = np.asarray(table.column("part")), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sides = [Block(table.take(pa.array(at))) for n in sorted({i, j}) if len(at := np.flatnonzero(part == n))]
        blocks = [] if i != j and len(sides) < 2 else sides
        a, b = compare(blocks[0], blocks[-1], least) if blocks else (np.empty(0, np.int64),) * 2
        out = [pa.table({"ball": a, "node": pa.nulls(len(a), pa.int64()), "more": np.zeros(len(a), np.int64), "other": b})]
        for x in {id(y): y for y in blocks}.values():
            for name, ids, more in (("ball", x.ball, np.where(x.guest, 0, x.by_ball)), ("node", x.ball, np.where(x.guest, x.by_ball, 0)), ("node", x.node, x.by_node)):
                at = np.flatnonzero(more)
                null = pa.nulls(len(at), pa.int64())
                out.append(pa.table({"ball": null, "node": null, "more": more[at], "other": null} | {name: ids[at]}))
        return pa.concat_tables(out)

    return pairs.repartition("crowd", "i", "j").groupBy("crowd", "i", "j").applyInArrow(run, "ball bigint, node bigint, more bigint, other bigint")


def near_duplicates(
    rows: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", trees: int = 6, spill: float = 0.1, leaf_rows: int = 256, limit: int = 2048,
    sample: int = 20_000, sample_bytes: int = 1 << 26, crowd: int = 8, part: int = 1024, block: int = 8192, heavy: int = 16, seed: int = 11,
) -> DataFrame:
    """id, n_links, component_id and kept of every row."""
    angle = float(np.arccos(least))
    fit = usable(vector_col) & F.exists(vector_col, lambda x: x != 0) & F.col(label_col).isNotNull()
    base = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"), F.coalesce(fit, F.lit(False)).alias("fit"))
    # equal vectors meet by two hashes of their values
    key = [F.xxhash64("label", "v").alias("k1"), F.xxhash64(F.lit("second"), "v", "label").alias("k2")]
    keyed = base.where("fit").select("id", "label", "v", *key)
    classes = keyed.groupBy("k1", "k2").agg(F.min("id").alias("least_id"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    total, dim = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    some = classes.orderBy(F.xxhash64("node"), "node").limit(min(sample, max(1, sample_bytes // (8 * (dim or 1))))).select("label", "v").toArrow()
    plan = Plan(some.column("label").to_pylist(), some.column("v").to_pylist(), total, least, crowd, trees, spill, leaf_rows, seed)

    met = stored(_crowds(classes.select("node", "label", "v", "size"), plan), "crowds")
    members, alone = met.where("not guest and crowd >= 0"), met.where("not guest and crowd < 0").select("node", "label", "v", "size")
    balls = stored(_balls(members.select("crowd", "node", "v"), part, angle, heavy), "balls")
    inside = members.join(balls, "node").select("crowd", "node", "v", "size", "ball", "off", F.col("ball").alias("root"), "guest")
    guests = met.where("guest").join(balls.select("node", "ball"), "node", "left").select("crowd", "node", "v", "size", F.col("node").alias("ball"), F.lit(0.0).alias("off"), F.coalesce("ball", "node").alias("root"), "guest")
    checked = stored(_compared(inside.unionByName(guests), block, least), "ball-checks")
    leaves = _split_on(_placed(alone, plan), limit, spill)
    links = stored(_forest_links(leaves, least), "forest-links")

    members = classes.join(balls, "node", "left").select("node", "k1", "k2", "size", "least_id", F.coalesce("ball", "node").alias("ball"))
    members = stored(members, "ball-members")
    drop_stored(met, balls)
    edges = checked.where("other is not null").select(F.col("ball").alias("a"), F.col("other").alias("b")).unionByName(links.select("a", "b"))
    roots = components(edges)
    centres = members.groupBy("ball").agg(F.sum("size").alias("weight"), F.min("least_id").alias("least_id"))
    whole = checked.where("ball is not null and other is null").groupBy("ball").agg(F.sum("more").alias("by_ball"))
    apart = checked.where("node is not null").select("node", "more").unionByName(links.select(F.col("a").alias("node"), F.col("size_b").alias("more"))).unionByName(links.select(F.col("b").alias("node"), F.col("size_a").alias("more")))
    single = apart.groupBy("node").agg(F.sum("more").alias("by_node"))
    comp = centres.join(roots.withColumnRenamed("node", "ball"), "ball", "left").withColumn("root", F.coalesce("root", "ball"))
    least_of = comp.groupBy("root").agg(F.min("least_id").alias("component_id"))
    comp = comp.join(least_of, "root").join(whole, "ball", "left").select("ball", "component_id", (F.col("weight") - 1 + F.coalesce("by_ball", F.lit(0))).alias("links"))
    verdict = members.join(comp, "ball").join(single, "node", "left").select("k1", "k2", "component_id", (F.col("links") + F.coalesce("by_node", F.lit(0))).alias("n_links"))
    linked = keyed.select("id", "k1", "k2").join(verdict, ["k1", "k2"]).select("id", "n_links", "component_id")
    unfit = base.where("not fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(unfit)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
