"""Similarity search by vantage points: a forest of shards, each a ball, with relaxed triangle pruning.

The tree has few, wide levels. On each level a hash sample of the rows is drawn; those closer than acos(JOIN) to each
other share a shard, and their mean is its vantage point (where it is far from one of them, they stay points
themselves). A row within the ball of angle acos(HOME) round its nearest point goes inside, to the shard of that point.
A row drawn that no other joins is a point on the last level only: it is looked at for every row and takes few in. A row outside all
balls goes on to the next level, where points are sampled from such rows only, and more densely; the last level
compares what is left in blocks of cells.

Triangle inequality: rows x and y whose angle is at most r, with y in the ball round p, have
angle(x, p) <= acos(HOME) + r. So x also visits every shard that has a point within acos(BALL) + factor * r, BALL being wider than HOME.
With factor 1 nothing is lost (products count with their error in float32); a smaller factor prunes more. In many dimensions x, y and p meet nearly at
right angles, cos(x, p) being close to cos(x, y) * cos(y, p), so half of r already loses next to nothing.
Inside a shard, rows form a vantage-point tree, split at quantiles of angles down to tiles, and two tiles are compared
only if their angles to every vantage point of the tree can differ by no more than factor * r.

What is left after the levels lies in cells, each row in that of its nearest point, and cells lie in blocks, one row of a
table each. Blocks meet in a product that reads the table again instead of shuffling a copy for each pair. Of two cells
only rows meet whose angles to the plane between the cells add up to at most min(1, 1.5 * factor) * r: for any e,
abs(asin(x . e) - asin(y . e)) <= angle(x, y), so from a factor of 2/3 on no pair is lost here.

Rows that meet are first multiplied in their first components after a fixed rotation, with the length of the rest as one
more (``Sieve``). By Cauchy and Schwarz that product is no smaller than the whole one, so it loses no pair.

Bounds: at most MOST_POINTS rows are drawn and broadcast a level (88 floats each, 46 MB); a task gets at most
two blocks of BLOCK rows of a shard, however large the shard (a shard that holds a third of all rows is cut
into blocks by a hash, every pair of blocks being one task). Every row is indexed; the sample only chooses
the points. Rows with the very same vector beyond the first few are kept out of the search (``split_copies``)
and come back by equality.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from notegrain.llm.vectors import latest_vectors, packed, unit, unpack
from notegrain.plans.shared import written

HOME, BALL, JOIN = 0.75, 0.65, 0.65
MOST_POINTS = 1 << 17
RATES, COARSE = (1 / 64, 1 / 8, 1 / 8), 1 << 14
"""Shares of the rows that are vantage points, level by level. Where the first share is more than COARSE points, a level of COARSE points goes before it: it takes the large clusters out, which few points find as well."""
BLOCK, LAST_BLOCK, SMALL = 16384, 32768, 4096
TILE, FAN = 512, 16
CELLS, STRIP = 32, 64
"""Cells of a last block; rows of a cell that meet another cell's rows at once."""
SLACK = 2e-5
"""Above the error of float32 products of unit vectors; closer calls are repeated in double precision."""


@dataclass(frozen=True)
class Plan:
    least: float
    factor: float

    @property
    def visit(self) -> float:
        return float(np.cos(min(np.pi, np.arccos(BALL) + self.factor * np.arccos(self.least)))) - SLACK

    @property
    def ring(self) -> float:
        return float(self.factor * np.arccos(self.least))

    @property
    def reach(self) -> float:
        return float(min(1, 1.5 * self.factor) * np.arccos(self.least))


def joined(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after joining the labels of each pair (a, b); the smallest stays."""
    while True:
        x, y = label[a], label[b]
        if not (open_ := x != y).any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        to = np.arange(n)
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def shards_of(points: np.ndarray) -> np.ndarray:
    """The shard of each vantage point."""
    n, label = len(points), np.arange(len(points))
    for i in range(0, n, 512):
        for j in range(i, n, 4096):
            at = np.flatnonzero(points[i : i + 512] @ points[j : j + 4096].T >= JOIN)
            if len(at):
                w = min(4096, n - j)
                label = joined(n, at // w + i, at % w + j, label)
    return label


def centres(points: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and their shards from rows drawn: of each shard of at least ``least`` rows the mean, or the rows where one of them is outside the ball round it."""
    label = shards_of(points)
    size = np.bincount(label, minlength=len(points))
    sums = np.zeros(points.shape)
    np.add.at(sums, label, points)
    mean = unit(np.where(size[:, None] > 0, sums, 1.0) + 1e-12)
    wide = np.zeros(len(points), bool)
    wide[label[np.einsum("ij,ij->i", points, mean[label]) < HOME]] = True
    one = np.flatnonzero((size >= least) & ~wide)
    own = np.flatnonzero((size >= least)[label] & wide[label])
    return np.concatenate([mean[one], points[own]]), np.concatenate([one, label[own]])


def places(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a mask with few true values, eight at a time."""
    flat = mask.reshape(-1)
    end = len(flat) // 8 * 8
    k = np.flatnonzero(flat[:end].view("u8") != 0)
    i, j = np.nonzero(flat[:end].reshape(-1, 8)[k])
    return np.r_[k[i] * 8 + j, np.flatnonzero(flat[end:]) + end]


@cache
def _rotation(d: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(1).normal(size=(d, d)))[0].astype("f4")


class Sieve:
    """Finds the pairs of rows of at least a similarity, and few others.

    The similarity of x and y is at most that of their first components plus the product of the lengths of the rest.
    Of unrelated rows fewer than 1 in 1,000 pairs pass with 14 of 88 components for 0.99, 20 for 0.95 and 42 for 0.78.
    Where many pass, rows are multiplied whole, and for some calls after that."""

    def __init__(self, u: np.ndarray, least: float, few: int = 512):
        self.least, self.front, self.rest, self.failed = least - SLACK, None, 0, 0
        d = u.shape[1]
        m = next((m for m in range(2, d) if m - (1 - least) * d >= 3.3 * m**0.5), d)
        if len(u) >= few and m < 0.6 * d:
            w = u @ _rotation(d)
            self.front = np.concatenate([w[:, :m], np.linalg.norm(w[:, m:], axis=1, keepdims=True)], 1)

    def pairs(self, left: np.ndarray, right: np.ndarray, here: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Flat places of pairs that may have the similarity, all that have it among them, and all products if rows were multiplied whole."""
        if self.front is not None and not self.rest and len(left) * len(right) >= 4096:
            at = places(self.front[here] @ self.front[there].T >= self.least)
            if len(at) <= len(left) * len(right) >> 8:
                self.failed = 0
                return at, None
            self.failed = min(self.failed + 1, 5)
            self.rest = 1 << self.failed
        self.rest = max(0, self.rest - 1)
        s = left @ right.T
        return places(s >= self.least), s


def _router(shared, shard: np.ndarray, visit: float, rows: int = 256, cells: int = 2048):
    """Gives each row its home and the shards it visits. Both lie among the few products of at least ``visit``, so these are all that is looked at."""
    visit = min(visit, HOME)

    def run(batches):
        points = shared.value
        buffer = np.empty((rows, cells), "f4")
        for b in batches:
            u = unit(unpack(b.column("v")))
            n = len(u)
            row, point, sim = [np.empty(0, "i8")], [np.empty(0, "i8")], [np.empty(0, "f4")]
            for i in range(0, n, rows):
                part = u[i : i + rows]
                for j in range(0, len(points), cells):
                    p = points[j : j + cells]
                    s = np.matmul(part, p.T, out=buffer if (len(part), len(p)) == buffer.shape else None)
                    at = places(s >= visit)
                    if len(at):
                        row.append(at // len(p) + i)
                        point.append(at % len(p) + j)
                        sim.append(s.reshape(-1)[at])
            row, point, sim = np.concatenate(row), np.concatenate(point), np.concatenate(sim)
            order = np.lexsort((point, -sim, row))
            row, point, sim = row[order], point[order], sim[order]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
            inside = first[sim[first] >= HOME]
            home = np.full(n, -1)
            home[row[inside]] = shard[point[inside]]
            pairs = np.unique(row << 32 | shard[point])
            row, cell = pairs >> 32, pairs & 0xFFFFFFFF
            visits = cell != home[row]
            row, cell = row[visits], cell[visits]
            also = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype("i4")), pa.array(cell))
            yield pa.RecordBatch.from_arrays([b.column("md5"), b.column("flag"), b.column("seen"), b.column("v"), pa.array(home), also], ["md5", "flag", "seen", "v", "home", "also"])

    return run


ROUTED = "md5 binary, flag int, seen boolean, v binary, home bigint, also array<bigint>"


def _levels(n: int, rates, coarse: int) -> tuple[float, ...]:
    return (coarse / n, *rates) if n * rates[0] > coarse else tuple(rates)


def _points(rows: DataFrame, share: float, level: int, most: int, pack_rows=None) -> np.ndarray:
    """The level's vantage points: rows drawn by a hash of their name, at most ``most``."""
    drawn = rows.filter(F.pmod(F.xxhash64("md5", F.lit(level)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    drawn = pack_rows(drawn) if pack_rows else drawn
    return unit(unpack(drawn.orderBy(F.xxhash64("md5", F.lit(level)), "md5").select("v").limit(most).toArrow().column("v")))


def _route(rows: DataFrame, points: np.ndarray, shard: np.ndarray, plan: Plan, label: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(points)
    return written(rows.mapInArrow(_router(shared, shard, plan.visit), ROUTED), label)


def index(signatures: DataFrame, plan: Plan, flags: DataFrame | None = None, rates=RATES, coarse: int = COARSE, most: int = MOST_POINTS, small: int = SMALL, **_) -> DataFrame:
    """The first level, a written table: md5, flag, seen, v of every file, its shard (home, -1 outside) and the shards it visits (also).

    ``flags`` (md5 packed, flag) limits the files to those it names."""
    vectors = latest_vectors(signatures)
    vectors = vectors.withColumn("flag", F.lit(0)) if flags is None else vectors.join(flags, "md5").select("md5", "v", "flag")
    vectors = vectors.withColumn("seen", F.lit(False))
    n = signatures.count()
    if n > small:
        points, shard = centres(_points(signatures, min(_levels(n, rates, coarse)[0], most / n), 0, most, packed))
        if len(points):
            return _route(vectors, points, shard, plan, "level0")
    return written(vectors.select("md5", "flag", "seen", "v", F.lit(-1).cast("bigint").alias("home"), F.array().cast("array<bigint>").alias("also")), "level0")


def compared(routed: DataFrame, plan: Plan, leaf, schema: str, rates=RATES, coarse: int = COARSE, most: int = MOST_POINTS, block: int = BLOCK, last_block: int = LAST_BLOCK, small: int = SMALL, lone: bool = True) -> DataFrame:
    """What ``leaf(md5, x, side, flag, many, cell)`` gives on each task's rows; every row is in every task that has to see it.

    ``routed`` is the first level; the further levels are built here. many: the row is in more than one task.
    lone: on the last level, points that no other row drawn joins are points too; without them that level is left out."""
    spark, parts, level = routed.sparkSession, [], 0
    rates = _levels(max(1, routed.count()), rates, coarse)
    rates = rates if lone else rates[:-1]
    while True:
        goes = F.when(F.col("home") >= 0, F.array_append("also", F.col("home"))).otherwise(F.col("also"))
        many = F.col("seen") | (F.size("also") > 0)
        parts.append(routed.filter((F.col("home") >= 0) | (F.size("also") > 0)).select(F.explode(goes).alias("shard"), many.alias("many"), "flag", "md5", "v").withColumn("shard", F.col("shard") + F.lit(level << 40)))
        left = routed.filter("home < 0").select("md5", "v", "flag", many.alias("seen"))
        n, level, points = left.count(), level + 1, ()
        while level < len(rates) and n > small and not len(points):
            points, shard = centres(_points(left, min(rates[level], most / n), level, most), 1 if lone and level == len(rates) - 1 else 2)
            level += not len(points)
        if not len(points):
            break
        routed = _route(left, points, shard, plan, f"level{level}")
    inner, full, rest = parts[0], [], None
    for p in parts[1:]:
        inner = inner.unionByName(p)
    if n > last_block:
        rest = _met(_cell_blocks(left, n, last_block, small), leaf, schema)
    else:
        full.append(_blocks(left.select(F.lit(len(rates) << 40).alias("shard"), F.col("seen").alias("many"), "flag", "md5", "v"), F.lit(1)))
    # at most (rows in shards) / block rows come back: one for each block's worth of a large shard
    big = [(r["shard"], -(-r["n"] // block)) for r in inner.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).collect()]
    if big:
        sizes = spark.createDataFrame(big, "shard bigint, cells bigint")
        full.append(_blocks(inner.join(F.broadcast(sizes), "shard"), F.col("cells")))
        inner = inner.join(F.broadcast(sizes), "shard", "left_anti")
    work = inner.select("shard", F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("side"), "many", "flag", "md5", "v")
    for f in full:
        work = work.unionByName(f)
    found = leaves(work, leaf, schema)
    return found if rest is None else found.unionByName(rest)


def _celled(shared, rows: int = 256):
    """Gives each row the number of its nearest point."""

    def run(batches):
        points = shared.value
        for b in batches:
            u = unit(unpack(b.column("v")))
            cell = np.concatenate([np.empty(0, "i8"), *[(u[i : i + rows] @ points.T).argmax(1) for i in range(0, len(u), rows)]]) if len(points) else np.zeros(len(u))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype("i4"))], [*b.schema.names, "cell"])

    return run


def _cell_blocks(left: DataFrame, n: int, last_block: int, small: int) -> DataFrame:
    """A written table with one row a block: block, and of its rows, cell after cell, md5, v, flag and cell as lists."""
    spark = left.sparkSession
    most = min(last_block, max(small, -(-n // 12)))  # rows of a block: few enough for some tens of tasks
    points = _points(left, min(1.0, min(COARSE, -(-n * CELLS // last_block)) / n), 99, COARSE)
    rows = written(left.mapInArrow(_celled(spark.sparkContext.broadcast(points)), "md5 binary, v binary, flag int, seen boolean, cell int").drop("seen"), "cells")
    # at most COARSE rows come back: one for each cell
    first, room, places = 0, most, []
    for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect():
        pieces = -(-r["n"] // most)
        if r["n"] > room and room < most:
            first, room = first + 1, most
        places.append((r["cell"], first, pieces))
        if pieces > 1:
            first, room = first + pieces, most
        else:
            room -= r["n"]
    rows = rows.join(F.broadcast(spark.createDataFrame(places, "cell int, first int, pieces int")), "cell")
    rows = rows.select((F.col("first") + F.pmod(F.xxhash64("md5", F.lit("piece")), F.col("pieces"))).cast("int").alias("block"), "md5", "v", "flag", "cell")

    def run(batches):
        kept: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(kept).combine_chunks()
            kept.clear()
            lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks()) for c in ("md5", "v", "flag", "cell")]
            return pa.RecordBatch.from_arrays([pa.array([t.column("block")[0].as_py()], pa.int32()), *lists], t.schema.names)

        for b in batches:
            k = b.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)] if len(k) else [0]
            for i, j in zip(cuts, cuts[1:]):
                if kept and kept[0].column("block")[0].as_py() != k[i]:
                    yield flush()
                kept.append(b.slice(i, j - i))
        if kept:
            yield flush()

    blocks = rows.repartition(first + 1, "block").sortWithinPartitions("block", "cell")
    return written(blocks.mapInArrow(run, "block int, md5 array<binary>, v array<binary>, flag array<int>, cell array<int>"), "blocks")


def _met(blocks: DataFrame, leaf, schema: str) -> DataFrame:
    """Runs ``leaf`` on each pair of blocks, and on each block with itself; a row is in more than one task."""
    names = ["md5", "v", "flag", "cell"]
    a, b = (blocks.select(*[F.col(c).alias(f"{c}_{x}") for c in ("block", *names)]) for x in "ab")
    # one of two orders, so that the work spreads evenly over the product
    once = (F.col("block_a") == F.col("block_b")) | ((F.col("block_a") < F.col("block_b")) == ((F.col("block_a") + F.col("block_b")) % 2 == 0))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                sides = "a" if row.column("block_a")[0].as_py() == row.column("block_b")[0].as_py() else "ab"
                lists = [[row.column(f"{c}_{x}").flatten() for x in sides] for c in names]
                md5 = np.array([m for x in lists[0] for m in x.to_pylist()], object)
                side = np.repeat(np.arange(len(sides)), [len(x) for x in lists[0]])
                flag, cell = (np.concatenate([x.to_numpy(zero_copy_only=False) for x in c]) for c in lists[2:])
                got = leaf(md5, np.concatenate([unpack(x) for x in lists[1]]), side, flag, np.ones(len(md5), bool), cell)
                if got is not None:
                    yield got

    return a.crossJoin(b).filter(once).mapInArrow(run, schema)


def _blocks(rows: DataFrame, cells) -> DataFrame:
    """Each row goes to all pairs of blocks that hold its own block."""
    own = F.pmod(F.xxhash64("md5", F.lit("block")), cells).cast("int")
    each = rows.withColumn("own", own).withColumn("cells", cells.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    return each.select("shard", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("many") | (F.col("cells") > 1)).alias("many"), "flag", "md5", "v")


def leaves(work: DataFrame, leaf, schema: str) -> DataFrame:
    """Runs ``leaf(md5, x, side, flag, many)`` on each task's rows and gives what it returns as a RecordBatch.

    Tasks are hashed over partitions and lie one after another in them, so a Python worker holds one task's
    rows at a time (at most two blocks) and small shards cost no call of their own."""
    keys = ["shard", "bi", "bj"]

    def run(batches):
        kept: list[list[np.ndarray]] = []

        def flush():
            columns = kept[0] if len(kept) == 1 else [np.concatenate(c) for c in zip(*kept)]
            kept.clear()
            return leaf(*columns)

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            columns = [np.array(b.column("md5").to_pylist(), object), unpack(b.column("v")), *[b.column(c).to_numpy(zero_copy_only=False) for c in ("side", "flag", "many")]]
            k = np.stack([b.column(c).to_numpy().astype("i8") for c in keys], 1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            for i, j in zip(cuts, cuts[1:]):
                now = tuple(k[i].tolist())
                if kept and now != last and (got := flush()) is not None:
                    yield got
                last = now
                kept.append([c[i:j] for c in columns])
        if kept and (got := flush()) is not None:
            yield got

    return work.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def tiles(u: np.ndarray, side: np.ndarray, ring: float, tile: int = TILE):
    """The pairs of tiles to compare: slices of an order, and that order. Each unordered pair of rows meets once
    (rows of one tile meet twice); of a two-block task only pairs across the blocks.

    Tiles are the leaves of a vantage-point tree: each node splits its rows by their angles to one of them, into at
    most FAN parts of equal size. Two leaves are left out if for any of these points their ranges of angles lie further apart than ``ring``."""
    open_, parts, points = [np.arange(len(u))], [], []
    while open_:
        rows = open_.pop()
        if len(rows) <= tile:
            parts += [p for k in (0, 1) if len(p := rows[side[rows] == k])]
            continue
        points.append(rows[len(rows) // 2])
        by = rows[np.argsort(-(u[rows] @ u[points[-1]]), kind="stable")]
        open_ += np.array_split(by, min(FAN, -(-len(by) // tile)))[::-1]
    order, end = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    cut = list(zip((end - [len(p) for p in parts]).tolist(), end.tolist()))
    far = np.zeros((len(parts), len(parts)), bool)
    if points:
        cos = u[order] @ u[points].T
        most, least = (f.reduceat(cos, [a for a, _ in cut]).astype("f8") for f in (np.maximum, np.minimum))
        low, high = np.arccos(np.minimum(most + SLACK, 1)), np.arccos(np.maximum(least - SLACK, -1))
        for k in range(len(points)):
            far |= low[None, :, k] - high[:, None, k] > ring + 1e-6
        far |= far.T
    across = len({int(side[p[0]]) for p in parts}) == 2
    kept = [(i, j) for i in range(len(cut)) for j in range(i, len(cut)) if not far[i, j] and (not across or side[parts[i][0]] != side[parts[j][0]])]
    return order, [(cut[i], cut[j]) for i, j in kept]


def cell_strips(u: np.ndarray, side: np.ndarray, cell: np.ndarray, reach: float, most: int, strip: int = STRIP):
    """Pairs of rows to compare, as ``meetings`` gives them; of two blocks only pairs across them.

    Rows of one cell meet all. Of two cells, with e from the mean of one to that of the other, x and y meet if asin(x . e)
    and asin(y . e) differ by no more than ``reach``: strips of one cell, in the order of that angle, meet the rows of the other that any of theirs can."""
    order = np.lexsort((cell, side))
    v, side, cell = u[order], side[order], cell[order]
    ends = [*(np.flatnonzero((side[1:] != side[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist(), len(u)]
    parts = [(i, min(i + most, b)) for a, b in zip([0, *ends], ends) for i in range(a, b, most)]
    mean, across = np.stack([v[a:b].mean(0) for a, b in parts]), side[0] != side[-1]
    by = mean @ v.T
    bound = lambda s, r: np.sin(np.clip(np.arcsin(np.clip(s, -1, 1)) + r, -np.pi / 2, np.pi / 2))
    for i, (a, b) in enumerate(parts):
        for j in range(i, len(parts)):
            c, d = parts[j]
            if across and side[a] == side[c]:
                continue
            length = float(np.linalg.norm(mean[j] - mean[i]))
            if cell[a] == cell[c] or length < 0.1:
                yield v[a:b], v[c:d], order[a:b], order[c:d], i == j
                continue
            high, low = (by[j, a:b] - by[i, a:b]) / length + SLACK, (by[j, c:d] - by[i, c:d]) / length - SLACK
            x, y = np.flatnonzero(high >= bound(low.min(), -reach) - SLACK), np.flatnonzero(low <= bound(high.max(), reach) + SLACK)
            if not len(x) or not len(y):
                continue
            high, low = np.arcsin(np.clip(high[x], -1, 1)), np.arcsin(np.clip(low[y], -1, 1))
            p, q = np.argsort(-high), np.argsort(low)
            x, y = x[p], y[q]
            upto = np.searchsorted(low[q], high[p[::strip]] + reach, "right")
            if upto.sum() * strip > 0.8 * (b - a) * (d - c):
                yield v[a:b], v[c:d], order[a:b], order[c:d], False
                continue
            left, right = v[x + a], v[y + c]
            at, to = order[x + a], order[y + c]
            for k, m in enumerate(upto.tolist()):
                if m:
                    yield left[k * strip : (k + 1) * strip], right[:m], at[k * strip : (k + 1) * strip], to[:m], False


def meetings(u: np.ndarray, side: np.ndarray, plan: Plan, cell: np.ndarray | None = None):
    """The pairs of rows to compare, part by part: vectors of some rows, vectors of some rows, the numbers of both, and whether both are the same rows."""
    if cell is not None:
        yield from cell_strips(u, side, cell, plan.reach, 2048)
        return
    order, pairs = tiles(u, side, plan.ring)
    v = u[order]
    for (a, b), (c, d) in pairs:
        yield v[a:b], v[c:d], order[a:b], order[c:d], a == c


def exact(x: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Similarity in double precision, rounded at 1e-12 so that equal pairs tie."""
    out = np.empty(len(i))
    for k in range(0, len(i), step):
        p, q = x[i[k : k + step]].astype("f8"), x[j[k : k + step]].astype("f8")
        out[k : k + step] = np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q))
    return np.round(out, 12)


def split_copies(routed: DataFrame, keep: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows to search, at most ``keep`` of each vector that more than six files share, and the other rows as
    (md5, heads): the first files, by md5, with that very vector. None if there are no others (the usual case)."""
    h = F.xxhash64("v")
    crowded = written(routed.groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 6"), "crowded")
    if crowded.isEmpty():
        return routed, None
    mine = routed.select("md5", "v").withColumn("h", h).join(crowded.select("h"), "h", "left_semi")
    first = mine.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("md5"))).filter(F.col("r") <= keep)
    heads = written(first.groupBy("v").agg(F.array_sort(F.collect_list("md5")).alias("heads"), F.lit(1).alias("one")), "heads")
    tails = written(mine.join(heads, "v").filter(~F.array_contains("heads", F.col("md5"))).select("md5", "heads"), "copies")
    return written(routed.join(tails, "md5", "left_anti"), "searched"), tails
