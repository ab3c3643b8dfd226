"""The most similar vectors of every vector (vantage-point shards, see vantage.py)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from notegrain.llm.vantage import SLACK, Plan, compared, exact, index, meetings, split_copies
from notegrain.llm.vectors import name_of, unit


def _best(i, j, s, rank, k):
    """Of directed candidates the k best of each i: by similarity, then by md5."""
    order = np.lexsort((rank[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    place = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
    keep = place < k
    return i[keep], j[keep], s[keep]


def _leaf(plan: Plan, k: int, dense: int = 1 << 18, most: int = 1 << 21):
    def leaf(md5, x, side, flag, many, cell=None):
        if len(md5) < 2:
            return None
        u = unit(x)
        rank = np.empty(len(md5), "i8")
        rank[np.argsort(md5)] = np.arange(len(md5))
        held, count = [], 0

        def settle():
            nonlocal held, count
            i, j, s = (np.concatenate(c) for c in zip(*held))
            held, count = [_best(i, j, s, rank, k)], 0

        for left, right, here, there, same in meetings(u, side, plan, cell):
            s = left @ right.T
            if same:
                np.fill_diagonal(s, -2)
            p, q = np.nonzero(s >= plan.least - SLACK)
            if len(p) > dense and min(s.shape) > k:  # only what can be among the k best of its row or column
                row, col = np.partition(s, -k, axis=1)[:, -k], np.partition(s, -k, axis=0)[-k]
                keep = s[p, q] >= np.minimum(row[p], col[q]) - SLACK
                p, q = p[keep], q[keep]
            if same:
                p, q = p[p < q], q[p < q]
            if len(p):
                i, j = here[p], there[q]
                e = exact(x, i, j)
                i, j, e = i[e >= plan.least], j[e >= plan.least], e[e >= plan.least]
                held.append((np.r_[i, j], np.r_[j, i], np.r_[e, e]))
                count += len(i)
                if count > most:
                    settle()
        if not held:
            return None
        settle()
        i, j, s = held[0]
        return pa.RecordBatch.from_arrays([pa.array(md5[i], pa.binary()), pa.array(md5[j], pa.binary()), pa.array(s)], ["a", "b", "s"]) if len(i) else None

    return leaf


def nearest(signatures: DataFrame, k: int = 5, least: float = 0.95, factor: float = 0.5, **sizes) -> DataFrame:
    """a, near: for every file a (packed name) its at most k most similar other files of at least ``least`` as
    structs (d, b), d = -similarity, nearest first, ties by name.

    Files without a usable vector have no row, neither as a nor as b; an empty table gives no rows. Of more than
    six files with the same vector, k + 1 are searched and the others get the k first of them, which are their
    nearest by definition."""
    plan = Plan(least, factor)
    core, tails = split_copies(index(signatures, plan, **sizes), k + 1)
    found = compared(core, plan, _leaf(plan, k), "a binary, b binary, s double", **sizes)
    if tails is not None:
        found = found.unionByName(tails.select(F.col("md5").alias("a"), F.explode(F.slice("heads", 1, k)).alias("b"), F.lit(1.0).alias("s")))
    # a row has at most k entries from each task that sees it
    lists = found.groupBy("a").agg(F.collect_list(F.struct((-F.col("s")).alias("d"), "b")).alias("near"))
    return lists.select("a", F.slice(F.array_sort(F.array_distinct("near")), 1, k).alias("near"))


def similar_pairs(signatures: DataFrame, k: int = 5, least: float = 0.95, factor: float = 0.5, **sizes) -> DataFrame:
    """md5_a < md5_b: pairs of which at least one is among the k nearest of the other."""
    near = nearest(signatures, k, least, factor, **sizes).select("a", F.explode("near.b").alias("b"))
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.select(name_of(F.col("a")).alias("md5_a"), name_of(F.col("b")).alias("md5_b"))
