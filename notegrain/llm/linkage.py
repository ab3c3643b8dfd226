"""Similarity clusters by reciprocal nearest neighbours on a sparse graph.

Every round each cluster finds its best partner, and all clusters that are each other's best merge at once,
until no two clusters are as similar as the threshold. The sparse graph holds the pairs of at least the
threshold; it comes from the vantage-point shards and is written out only for groups too large for one matrix.

Two linkages. Average: a pair that the graph lacks counts as similarity 0; averages being reducible, merging
all mutual best pairs in parallel gives the sequential result. Single: a cluster's similarity is its best
link; here a cluster that points at one of a merging pair may join it in the same round, since its best link
belongs to the maximum spanning forest in any case, so a hub does not take a round for each of its spokes.
With single linkage the clusters at the end are the chains of pairs of at least the threshold.

A group too large for one matrix is clustered from the written table of its pairs, each round being a few joins:
every cluster's best partner, mutual pairs merged, similarities summed per pair of clusters. A cluster without a
partner of at least the threshold is done, since averages with merged clusters are no higher, and leaves with its
pairs. What is left of a group goes to one task as soon as it fits there.

Single linkage loses nothing when parts are merged first, so each shard's rows merge in their own task and
hand on one root a row. Only groups with a row that other tasks see as well (marked many) have to be joined
across tasks, where a row in two tasks links their roots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from notegrain.llm.vantage import SLACK, Plan, Sieve, _blocks, compared, exact, index, joined, leaves, meetings, split_copies, tiles
from notegrain.llm.vectors import WIDTH, name_of, unit, unpack
from notegrain.operators.components import components
from notegrain.plans.shared import dropped, written

LEAST = 0.78


def single_rounds(label: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Labels after all rounds of single linkage on the links (i, j, s): each round every cluster's best link is taken."""
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return label
        i, j, s, x, y = i[apart], j[apart], s[apart], x[apart], y[apart]
        x, y, w = np.r_[x, y], np.r_[y, x], np.r_[s, s]
        order = np.lexsort((y, -w, x))
        x, y = x[order], y[order]
        first = np.r_[True, x[1:] != x[:-1]]
        label = joined(len(label), x[first], y[first], label)


def task_labels(x: np.ndarray, side: np.ndarray, plan: Plan, cell: np.ndarray | None = None) -> np.ndarray:
    """Single-linkage labels of one task's rows.

    The task's links are merged tile by tile, and links inside a cluster are dropped as soon as they are seen,
    which single linkage allows; in a tile full of links each row's best partner in another cluster is merged, round by round, and only what is
    left is listed."""
    u = unit(x)
    label = np.arange(len(u))
    sieve = Sieve(u, plan.least)
    for left, right, here, there, same in meetings(u, side, plan, cell):
        one = label[here[0]]
        if label[there[0]] == one and (label[here] == one).all() and (label[there] == one).all():
            continue
        at, s = sieve.pairs(left, right, here, there)
        if s is not None and len(at) > 8 * sum(s.shape):
            while True:
                s[label[here][:, None] == label[there][None, :]] = -2
                mate = s.argmax(1)
                top = s[np.arange(len(s)), mate]
                sure = np.flatnonzero(top >= plan.least + SLACK)
                if not len(sure):
                    break
                label = single_rounds(label, here[sure], there[mate[sure]], top[sure])
            at = np.flatnonzero(s >= plan.least - SLACK)
        if not len(at):
            continue
        i, j = here[at // len(there)], there[at % len(there)]
        apart = label[i] != label[j]
        if apart.any():
            i, j = i[apart], j[apart]
            if s is None:
                w = exact(x, i, j)
            else:
                w = s.reshape(-1)[at[apart]].astype("f8")
                close = w < plan.least + SLACK
                w[close] = exact(x, i[close], j[close])
            keep = w >= plan.least
            label = single_rounds(label, i[keep], j[keep], w[keep])
    return label


def average_rounds(s: np.ndarray, least: float) -> np.ndarray:
    """Labels (the smallest member) after average linkage on the similarities ``s``; those below ``least`` count as 0.

    The matrix shrinks to the clusters left after each round. A best pair is always mutual: of the rows with
    the highest average the first one and its first partner are each other's first choice."""
    w = np.where(s >= least, s, 0).astype("f4")
    np.fill_diagonal(w, 0)
    return summed_rounds(w, np.ones(len(s), "f4"), least)


def summed_rounds(w: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """The same from clusters of the given sizes and the sums ``w`` of their similarities (0 within a cluster); uses up both."""
    label, name = np.arange(len(w)), np.arange(len(w))
    while len(w) > 1:
        mean = np.round(w / size[:, None] / size[None, :], 6)
        best = mean.argmax(1)
        here = np.arange(len(w))
        mutual = (mean[here, best] >= least) & (best[best] == here) & (here < best)
        lo, hi = here[mutual], best[mutual]
        if not len(lo):
            break
        w[lo] += w[hi]
        w[:, lo] += w[:, hi]
        w[lo, lo] = 0
        size[lo] += size[hi]
        to = np.arange(len(label))
        to[name[hi]] = name[lo]
        label = to[label]
        stay = np.ones(len(w), bool)
        stay[hi] = False
        w, size, name = w[np.ix_(stay, stay)], size[stay], name[stay]
    return label


def _describe(least: float, reps: int):
    def leaf(md5, x, side, flag, many):
        order = np.argsort(md5)
        md5, u = md5[order], unit(x[order])
        s = u @ u.T
        label = average_rounds(s, least)
        out = []
        for c in np.unique(label):
            i = np.flatnonzero(label == c)
            if len(i) < 2:
                continue
            inner = s[np.ix_(i, i)].astype("f8")
            total = np.round((inner.sum(1) - np.diag(inner)) / (len(i) - 1), 6)
            typical = i[np.lexsort((i, -total))[:reps]]
            out.append((md5[i[0]], len(i), [md5[t] for t in typical], round(float(1 - total.mean()), 6)))
        if not out:
            return None
        a, n, r, t = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(n, pa.int64()), pa.array(r, pa.list_(pa.binary())), pa.array(t, pa.float64())], ["cluster", "size", "reps", "tightness"])

    return leaf


def _members(least: float):
    def leaf(md5, x, side, flag, many):
        order = np.argsort(md5)
        md5, u = md5[order], unit(x[order])
        label, size = average_rounds(u @ u.T, least), np.zeros(len(md5), "i8")
        np.add.at(size, label, 1)
        keep = size[label] > 1
        return pa.RecordBatch.from_arrays([pa.array(md5[keep], pa.binary()), pa.array(md5[label[keep]], pa.binary())], ["md5", "cluster"]) if keep.any() else None

    return leaf


def _pairs(least: float):
    """A leaf that lists one task's pairs of at least ``least``; rings as wide as the pairs' angle lose none."""

    def leaf(md5, x, side, flag, many):
        if flag[0] and side.min() == side.max():  # one of two blocks is empty
            return None
        order, pairs = tiles(unit(x), side, float(np.arccos(least)))
        u, left, right, w = unit(x[order]), [], [], []
        for (a, b), (c, d) in pairs:
            s = u[a:b] @ u[c:d].T
            i, j = np.nonzero(s >= least - SLACK)
            i, j = i + a, j + c
            if a == c:
                i, j = i[i < j], j[i < j]
            k = exact(x, order[i], order[j])
            keep = k >= least
            left.append(order[i[keep]])
            right.append(order[j[keep]])
            w.append(k[keep])
        if not sum(map(len, w)):
            return None
        names = pa.array(md5, pa.binary())
        left, right = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_arrays([names.take(pa.array(left)), names.take(pa.array(right)), pa.array(np.concatenate(w))], ["x", "y", "s"])

    return leaf


def _finish(least: float):
    """Merges (hi, lo) of the rounds that are left for one group, from all its pairs of clusters."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        names = pc.unique(pa.chunked_array(rows.column("a").chunks + rows.column("b").chunks))
        names = names.take(pc.sort_indices(names))
        i, j = (pc.index_in(rows.column(c), value_set=names).to_numpy() for c in "ab")
        w, size = np.zeros((len(names), len(names))), np.ones(len(names))
        w[i, j] = w[j, i] = rows.column("w").to_numpy()
        size[i], size[j] = rows.column("na").to_numpy(), rows.column("nb").to_numpy()
        label = summed_rounds(w, size, least)
        gone = np.flatnonzero(label != np.arange(len(label)))
        return pa.table([names.take(pa.array(gone)), names.take(pa.array(label[gone]))], names=["hi", "lo"])

    return run


def _wide_members(rows: DataFrame, least: float, dense: int) -> DataFrame:
    """md5, cluster of the clusters of at least two files in groups of any size; ``rows``: md5, group_md5, v, n (files of the group).

    Files with the very same vector are one cluster from the start: nothing is more similar."""
    heads = written(rows.groupBy("group_md5", "v").agg(F.min("md5").alias("head"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n")), "distinct")
    merges = [rows.join(heads.select("group_md5", "v", "head"), ["group_md5", "v"]).filter("md5 <> head").select(F.col("md5").alias("hi"), F.col("head").alias("lo"))]
    cells = F.ceil(F.col("n") / max(1, dense // 4)).cast("int")
    each = heads.select(F.xxhash64("group_md5").alias("shard"), F.lit(False).alias("many"), F.lit(0).alias("flag"), F.col("head").alias("md5"), "v", "n")
    work = _blocks(each, cells).withColumn("flag", (F.col("bi") < F.col("bj")).cast("int"))
    found = leaves(work, _pairs(least), "x binary, y binary, s double").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "s")
    one = lambda c: heads.select(F.col("head").alias(c), F.col("size").alias("n" + c), *(["group_md5"] if c == "a" else []))
    edges = written(found.join(one("a"), "a").join(one("b"), "b").select("group_md5", "a", "b", "na", "nb", (F.col("s") * F.col("na") * F.col("nb")).alias("w")), "pairs")
    while True:
        mean = F.round(F.col("w") / F.col("na") / F.col("nb"), 6)
        near = edges.withColumn("mean", mean).filter(F.col("mean") >= least)
        ways = [near.select("group_md5", F.col(x).alias("x"), F.struct((-F.col("mean")).alias("m"), F.col(y).alias("y"), F.col("n" + x).alias("nx"), F.col("n" + y).alias("ny")).alias("to")) for x, y in ("ab", "ba")]
        best = best_ = written(ways[0].unionByName(ways[1]).groupBy("group_md5", "x").agg(F.min("to").alias("to")).select("group_md5", "x", "to.y", "to.nx", "to.ny"), "best")
        left = written(best.groupBy("group_md5").agg((F.count(F.lit(1)) <= max(2, dense // 2)).alias("fits")), "left")
        state = left.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("fits").cast("int")), F.lit(0))).first()
        if not state[0]:
            break
        best = best.join(left, "group_md5")
        # mutual: the pair is chosen from both ends
        pairs = best.filter("not fits").groupBy(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.count(F.lit(1)).alias("k"), F.first(F.col("nx") + F.col("ny")).alias("size")).filter("k = 2")
        pairs = written(pairs.select("lo", "hi", "size"), "merged")
        to = pairs.select(F.col("lo").alias("x"), F.col("lo").alias("now"), "size").unionByName(pairs.select(F.col("hi").alias("x"), F.col("lo").alias("now"), "size"))
        to = written(best.join(to, "x", "left").select("x", F.coalesce("now", "x").alias("now"), F.coalesce("size", "nx").alias("size"), "fits"), "now")
        end = lambda c: to.select(F.col("x").alias(c), F.col("now").alias("now_" + c), F.col("size").alias("size_" + c), *(["fits"] if c == "a" else []))
        open_ = edges.join(end("a"), "a").join(end("b"), "b").filter("now_a <> now_b")
        if state[1]:
            last = open_.filter("fits").select("group_md5", "a", "b", "na", "nb", "w")
            merges.append(written(last.groupBy("group_md5").applyInArrow(_finish(least), "hi binary, lo binary"), "merged"))
        if state[0] == state[1]:
            break
        merges.append(pairs.select("hi", "lo"))
        first = F.col("now_a") < F.col("now_b")
        pick = lambda c, x, y: F.when(first, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}"))
        moved = open_.filter("not fits").select("group_md5", pick("now", "a", "b").alias("a"), pick("now", "b", "a").alias("b"), pick("size", "a", "b").alias("na"), pick("size", "b", "a").alias("nb"), "w")
        old, edges = edges, written(moved.groupBy("group_md5", "a", "b", "na", "nb").agg(F.sum("w").alias("w")), "pairs")
        dropped(old, best_, left, to)
    links = merges[0]
    for m in merges[1:]:
        links = links.unionByName(m)
    return written(components(links.select(F.col("hi").alias("a"), F.col("lo").alias("b"))).select(F.col("node").alias("md5"), F.col("label").alias("cluster")), "members")


def _sums(md5, x, side, flag, many):
    return pa.RecordBatch.from_arrays([pa.array([unit(x, "f8").sum(0)], pa.list_(pa.float64())), pa.array([len(x)], pa.int64()), pa.array([min(md5)], pa.binary())], ["part", "n", "any"])


def _totals(batches):
    for b in batches:
        if b.num_rows:
            u, size = unit(unpack(b.column("v")), "f8"), b.column("size").to_numpy()
            all_ = b.column("whole").flatten().to_numpy().reshape(len(u), -1)
            total = np.round(((u * all_).sum(1) - 1) / (size - 1), 6)
            yield pa.RecordBatch.from_arrays([b.column("cluster"), b.column("size"), b.column("md5"), pa.array(total)], ["cluster", "size", "md5", "total"])


def _describe_wide(members: DataFrame, vectors: DataFrame, reps: int, block: int) -> DataFrame:
    """What _describe gives, for clusters of any size: a member's similarities to all others add up to its product with their sum."""
    rows = written(members.join(vectors.select("md5", "v"), "md5"), "members")
    part = F.pmod(F.xxhash64("md5"), F.ceil(F.col("n") / block)).cast("int")
    sized = rows.join(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "cluster")
    work = sized.select(F.xxhash64("cluster").alias("shard"), part.alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("side"), F.lit(False).alias("many"), F.lit(0).alias("flag"), "md5", "v")
    parts = leaves(work, _sums, "part array<double>, n bigint, any binary")
    parts = parts.join(members.withColumnRenamed("md5", "any"), "any")
    whole = parts.groupBy("cluster").agg(F.array(*[F.sum(F.col("part")[i]) for i in range(WIDTH)]).alias("whole"), F.sum("n").alias("size"))
    each = written(rows.join(whole, "cluster").select("cluster", "size", "md5", "v", "whole").mapInArrow(_totals, "cluster binary, size bigint, md5 binary, total double"), "totals")
    rank = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("total"), "md5"))
    typical = each.withColumn("r", rank).filter(F.col("r") <= reps).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "md5"))), lambda t: t["md5"]).alias("reps"))
    tight = each.groupBy("cluster").agg(F.max("size").alias("size"), F.round(1 - F.avg("total"), 6).alias("tightness"))
    return tight.join(typical, "cluster").select("cluster", "size", "reps", "tightness")


def _split(signatures: DataFrame, plan: Plan, dense: int, sizes: dict) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """All vectors; the work of groups of at most ``dense`` files, one task each; the rows of larger ones, None if there are none."""
    routed = index(signatures, plan, **sizes)
    found = written(_grouped(routed, plan, 2, **sizes), "groups")
    large = written(found.groupBy("group_md5").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > dense), "large")
    wide = None
    if not large.isEmpty():
        wide = written(found.join(large, "group_md5").join(routed.select("md5", "v"), "md5").select("md5", "group_md5", "v", "n"), "wide")
        found = found.join(large, "group_md5", "left_anti")
    work = found.join(routed.select("md5", "v"), "md5").select(F.xxhash64("group_md5").alias("shard"), F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("side"), F.lit(False).alias("many"), F.lit(0).alias("flag"), "md5", "v")
    return routed, work, wide


def clusters(signatures: DataFrame, least: float = LEAST, factor: float = 0.4, reps: int = 5, dense: int = 6144, **sizes) -> DataFrame:
    """cluster_md5, size, reps, tightness: average-linkage clusters of at least two files, their most typical members
    (highest mean similarity within, ties by md5) and 1 - their mean similarity.

    Clusters never cross single-linkage groups, so each group of at most ``dense`` files is clustered in one task
    (a matrix of 150 MB) and a larger one in distributed rounds over the table of its pairs; the clusters are the same."""
    routed, work, wide = _split(signatures, Plan(least, factor), dense, sizes)
    got = leaves(work, _describe(least, reps), "cluster binary, size bigint, reps array<binary>, tightness double")
    if wide is not None:
        got = got.unionByName(_describe_wide(_wide_members(wide, least, dense), routed, reps, dense))
    return got.select(name_of(F.col("cluster")).alias("cluster_md5"), "size", F.array_join(F.transform("reps", name_of), ";").alias("reps"), "tightness")


def cluster_members(signatures: DataFrame, least: float = LEAST, factor: float = 0.4, dense: int = 6144, **sizes) -> DataFrame:
    """md5, cluster_md5 of the clusters that ``clusters`` describes."""
    _, work, wide = _split(signatures, Plan(least, factor), dense, sizes)
    got = leaves(work, _members(least), "md5 binary, cluster binary")
    if wide is not None:
        got = got.unionByName(_wide_members(wide, least, dense))
    return got.select(name_of(F.col("md5")).alias("md5"), name_of(F.col("cluster")).alias("cluster_md5"))


def _leaf(plan: Plan, smallest: int):
    def leaf(md5, x, side, flag, many, cell=None):
        if len(md5) < 2:
            return None
        label = task_labels(x, side, plan, cell)
        root, back, size = np.unique(label, return_inverse=True, return_counts=True)
        if size.max() < 2:
            return None
        rank = np.empty(len(md5), "i8")
        rank[np.argsort(md5)] = np.arange(len(md5))
        names = np.sort(md5)
        low = np.full(len(root), len(md5))
        np.minimum.at(low, back, rank)
        open_ = np.zeros(len(root), bool)
        np.logical_or.at(open_, back, many | (flag > 0))
        keep = (size[back] >= smallest) | ((size[back] >= 2) & open_[back])
        b = back[keep]
        return pa.RecordBatch.from_arrays([pa.array(md5[keep], pa.binary()), pa.array(names[low[b]], pa.binary()), pa.array(open_[b])], ["md5", "root", "open"]) if keep.any() else None

    return leaf


def _grouped(routed: DataFrame, plan: Plan, smallest: int, **sizes) -> DataFrame:
    """md5, group_md5 (packed names) of the groups of at least ``smallest`` files (2 or more)."""
    core, tails = split_copies(routed, 1)
    head = F.element_at("heads", 1)
    if tails is not None:
        heads = tails.select(head.alias("md5"), F.lit(1).alias("one")).distinct()
        core = written(core.join(heads, "md5", "left").withColumn("flag", F.coalesce("one", "flag")).drop("one"), "heads")
    found = compared(core, plan, _leaf(plan, smallest), "md5 binary, root binary, open boolean", **sizes)
    if tails is not None:
        found = found.unionByName(tails.select("md5", head.alias("root"), F.lit(True).alias("open"))).unionByName(tails.select(head.alias("md5"), head.alias("root"), F.lit(True).alias("open")).distinct())
    found = written(found, "roots")
    rows = found.filter("open").groupBy("md5").agg(F.min("root").alias("base"), F.collect_set("root").alias("roots"))
    rows = written(rows, "open")
    edges = rows.filter(F.size("roots") > 1).select(F.col("base").alias("a"), F.explode("roots").alias("b"))
    labels = components(edges)
    named = rows.select("md5", "base").join(labels, F.col("base") == F.col("node"), "left").select("md5", F.coalesce("label", "base").alias("group_md5"))
    big = named.groupBy("group_md5").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= smallest).select("group_md5")
    across = named.join(big, "group_md5").select("md5", "group_md5")
    return found.filter("not open").select("md5", F.col("root").alias("group_md5")).unionByName(across)


def groups(signatures: DataFrame, least: float = LEAST, factor: float = 0.4, smallest: int = 3, **sizes) -> DataFrame:
    """md5, group_md5: single-linkage groups of at least ``smallest`` files (2 or more), named by their smallest md5.

    Files without a usable vector are in no group; an empty table gives no rows. Of more than six files with
    the same vector one is searched, and the others follow it."""
    plan = Plan(least, factor)
    both = _grouped(index(signatures, plan, **sizes), plan, smallest, **sizes)
    return both.select(name_of(F.col("md5")).alias("md5"), name_of(F.col("group_md5")).alias("group_md5"))
