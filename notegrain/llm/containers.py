"""Filling containers of fixed capacity: a configuration program over the histogram of lengths.

A configuration says how many items of each length one container takes. The linear program wants the fewest
containers, in fractions, whose configurations hold all items. It is solved by multiplicative weights: a length has
a price that grows with its share still to be placed; each round prices out the best configuration by an exact
bounded knapsack (dynamic programming over the capacity) and takes it in the fraction that is due or that its
scarcest length allows. Any prices bound the number of containers from below (no container can be worth more than
the best configuration), and the best such bound is kept.

The fractions are then rounded down, single containers are added in the order of the fractions cut off as far as
items are left, and what remains goes into the rooms of these containers and into new ones, best fit, longest first,
for whole groups of equal containers at once. Where that needs more containers than the bound, the program is solved
again, a few times, with higher weights for lengths whose containers kept much room, and the fewest containers win.

All of this is on the histogram, at most ``capacity`` numbers, whatever the number of items. Items are then
numbered within their length, by counts over as many salts as the length needs to have about GROUP items a group,
and look up the containers that hold their numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from notegrain.plans.shared import written

ROUNDS, RATE, CHOICE, PASSES = 400, 4.0, 128, 6
GROUP, MOST_BROADCAST = 200_000, 1_000_000
Plan = list[tuple[dict[int, int], int]]
"""Configurations (length -> how many) and how many containers have them."""


def knapsack(sizes: np.ndarray, most: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size to take, at most ``most``, for the highest price within the capacity."""
    lots = []
    for i, (s, m) in enumerate(zip(sizes.tolist(), np.minimum(most, capacity // sizes).tolist())):
        k = 1
        while m > 0:
            take = min(k, m)
            lots.append((i, take, s * take))
            m, k = m - take, k * 2
    best, taken = np.zeros(capacity + 1), np.zeros((len(lots), capacity + 1), bool)
    for j, (i, take, room) in enumerate(lots):
        with_it = best[: capacity + 1 - room] + price[i] * take
        better = with_it > best[room:] + 1e-12
        taken[j, room:] = better
        best[room:][better] = with_it[better]
    out, at = np.zeros(len(sizes), int), int(best.argmax())
    for j in range(len(lots) - 1, -1, -1):
        if taken[j, at]:
            i, take, room = lots[j]
            out[i] += take
            at -= room
    return out


def best_fit(left: dict[int, int], capacity: int, begun: Plan = ()) -> Plan:
    """Best fit, longest first, on the histogram, into the rooms of the containers begun and into new ones: containers with equal contents move as one group."""
    open_: dict[int, list[tuple[tuple, int]]] = {}
    for config, count in begun:
        open_.setdefault(capacity - sum(s * k for s, k in config.items()), []).append((tuple(config.items()), count))
    for size in sorted(left, reverse=True):
        n = left[size]
        moved: dict[int, list[tuple[tuple, int]]] = {}
        for room in sorted(r for r in open_ if r >= size):
            each, kept = room // size, []
            for config, count in open_.pop(room):
                full = min(count, n // each)
                if full:
                    moved.setdefault(room - each * size, []).append((config + ((size, each),), full))
                    n, count = n - full * each, count - full
                if count and n:
                    moved.setdefault(room - n * size, []).append((config + ((size, n),), 1))
                    n, count = 0, count - 1
                if count:
                    kept.append((config, count))
            if kept:
                open_[room] = kept
            if not n:
                break
        each = capacity // size
        if n >= each:
            moved.setdefault(capacity - each * size, []).append((((size, each),), n // each))
            n %= each
        if n:
            moved.setdefault(capacity - n * size, []).append((((size, n),), 1))
        for room, some in moved.items():
            open_.setdefault(room, []).extend(some)

    def merged(config: tuple) -> dict[int, int]:
        out: dict[int, int] = {}
        for s, k in config:
            out[s] = out.get(s, 0) + k
        return out

    return [(merged(config), count) for some in open_.values() for config, count in some]


def program(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, weight: dict[int, float] | None = None) -> tuple[list[tuple[dict[int, int], float]], int]:
    """A fractional solution (configurations and how many containers have them) and a lower bound on the number of containers.

    A round's configuration is made of the CHOICE lengths that are furthest behind (of equal ones a spread choice),
    the bound of all lengths."""
    sizes = np.array(sorted(histogram, reverse=True), int)
    total = np.array([histogram[s] for s in sizes.tolist()], float)
    worth, spread = sizes / capacity, np.arange(len(sizes)) * 0.6180339887498949 % 1
    value = worth * np.array([(weight or {}).get(s, 1.0) for s in sizes.tolist()])
    left, taken, bound = total.copy(), [], 0.0
    for t in range(rounds):
        behind = left / total
        price = value * np.exp(RATE * (behind - behind.mean()))
        if t % max(1, rounds // 8) == 0:  # any container holds at most what the best one is worth
            best = knapsack(sizes, total.astype(int), price, capacity)
            bound = max(bound, float((price * total).sum() / (price * best).sum()))
        want = float((worth * left).sum())
        here = np.flatnonzero(left > 1e-9)
        if want < 1e-9 or not len(here):
            break
        due = want / (rounds - t)
        here = np.sort(here[np.lexsort((spread[here], -np.round(behind[here], 1)))[:CHOICE]])
        most = np.minimum(total[here], np.maximum(1, np.floor(left[here] / due + 1e-9))).astype(int)
        config = np.zeros(len(sizes), int)
        config[here] = knapsack(sizes[here], most, price[here], capacity)
        used = config > 0
        times = float(min(due, (left[used] / config[used]).min()))
        left[used] -= config[used] * times
        taken.append(({int(s): int(k) for s, k in zip(sizes[used], config[used])}, times))
    return taken, int(np.ceil(bound - 1e-6))


def rounded(fractions: list[tuple[dict[int, int], float]], histogram: dict[int, int]) -> tuple[Plan, dict[int, int]]:
    """Whole containers from the fractions, and the items that are left: fractions are rounded down, then single containers added, largest rest first."""
    left, counts = dict(histogram), []
    for config, x in fractions:
        counts.append(int(x + 1e-6))
        for s, k in config.items():
            left[s] -= counts[-1] * k
    spare = sum(x for _, x in fractions) - sum(counts)
    for i in sorted(range(len(counts)), key=lambda i: (counts[i] - fractions[i][1], i)):
        config = fractions[i][0]
        if spare >= 1 and all(left[s] >= k for s, k in config.items()):
            counts[i] += 1
            spare -= 1
            for s, k in config.items():
                left[s] -= k
    return [(config, n) for (config, _), n in zip(fractions, counts) if n], {s: n for s, n in left.items() if n}


def _dearer(plan: Plan, weight: dict[int, float], capacity: int) -> dict[int, float]:
    """Weights after raising those of lengths whose containers were left with much room."""
    room, items = {}, {}
    for config, n in plan:
        lost = capacity / sum(s * k for s, k in config.items())
        for s, k in config.items():
            room[s] = room.get(s, 0.0) + n * k * lost
            items[s] = items.get(s, 0) + n * k
    return {s: weight.get(s, 1.0) * min(room[s] / items[s], 2.0) for s in items}


def configurations(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> tuple[Plan, int]:
    """The plan for items of the given lengths (1 to capacity), and the program's lower bound on its containers."""
    used = lambda plan: sum(n for _, n in plan)
    best, bound, weight = [], 0, {}
    for _ in range(PASSES if histogram else 0):
        fractions, least = program(histogram, capacity, rounds, weight)
        bound, (begun, left) = max(bound, least), rounded(fractions, histogram)
        plan = best_fit(left, capacity, begun)
        best = plan if not best or used(plan) < used(best) else best
        if used(best) <= bound:
            break
        weight = _dearer(plan, weight, capacity)
    return best, bound


def _pieces(items: DataFrame, capacity: int, key: str, size: str) -> DataFrame:
    """key, first_unit, n_units: items as they are, longer ones as whole containers and a rest."""
    sized = written(items.filter(F.col(size) > 0).select(key, F.col(size).cast("bigint").alias("n")), "sizes")
    cap = F.lit(capacity)
    whole = sized.filter(F.col("n") >= cap).select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / cap) - 1)).alias("p")).select(key, (F.col("p") * cap).alias("first_unit"), cap.cast("bigint").alias("n_units"))
    rest = sized.filter(F.col("n") % cap > 0).select(key, (F.floor(F.col("n") / cap) * cap).alias("first_unit"), (F.col("n") % cap).alias("n_units"))
    return whole.unionByName(rest)


def _histogram(pieces: DataFrame) -> dict[int, int]:
    return {r["n_units"]: r["m"] for r in pieces.groupBy("n_units").agg(F.count(F.lit(1)).alias("m")).collect()}  # at most `capacity` rows


def summary(items: DataFrame, capacity: int = 2048, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """One row: n_containers of ``fill``, the program's lower_bound, n_units, and the share of unused space (null without items)."""
    histogram = _histogram(_pieces(items, capacity, key, size))
    plan, bound = configurations(histogram, capacity)
    used, units = sum(n for _, n in plan), sum(s * n for s, n in histogram.items())
    return items.sparkSession.createDataFrame([(used, bound, units, round(1 - units / (used * capacity), 6) if used else None)], "n_containers bigint, lower_bound bigint, n_units bigint, unused double")


def fill(items: DataFrame, capacity: int = 2048, key: str = "doc_id", size: str = "n_tokens", group: int = GROUP) -> DataFrame:
    """container_id, key, first_unit, n_units, at: every unit of every item in exactly one container.

    An item longer than the capacity is cut into whole containers and a rest, any other is never cut. Items of
    size null or below 1 take no space and have no row. Keys should be unique; equal keys are items of their own."""
    pieces = _pieces(items, capacity, key, size)
    histogram = _histogram(pieces)
    slots, base, seen = [], 0, dict.fromkeys(histogram, 0)
    for config, times in configurations(histogram, capacity)[0]:
        at = 0
        for s, k in sorted(config.items(), reverse=True):
            slots.append((s, seen[s], seen[s] + k * times, k, base, at))
            seen[s] += k * times
            at += k * s
        base += times
    spark = items.sparkSession
    salts = F.broadcast(spark.createDataFrame([(s, -(-n // group)) for s, n in histogram.items()], "n_units bigint, salts bigint"))  # at most `capacity` rows
    salted = pieces.join(salts, "n_units").withColumn("salt", F.pmod(F.xxhash64(key, "first_unit"), F.col("salts"))).drop("salts")
    counts = salted.groupBy("n_units", "salt").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(W.partitionBy("n_units").orderBy("salt"))
    table = F.broadcast(spark.createDataFrame(slots, "size bigint, lo bigint, hi bigint, each bigint, base bigint, off bigint"))  # at most `capacity` lengths in some hundreds of configurations
    before = counts.withColumn("before", upto - F.col("m")).join(table, (F.col("n_units") == F.col("size")) & (F.col("before") < F.col("hi")) & (F.col("before") + F.col("m") > F.col("lo"))).drop("m", "size")
    groups = len(slots) + sum(-(-n // group) for n in histogram.values())  # rows of ``before`` at most
    before = F.broadcast(before) if groups <= MOST_BROADCAST else before
    ranked = salted.withColumn("r", F.row_number().over(W.partitionBy("n_units", "salt").orderBy(key, "first_unit")) - 1)
    placed = ranked.join(before, ["n_units", "salt"]).withColumn("j", F.col("r") + F.col("before") - F.col("lo")).filter((F.col("j") >= 0) & (F.col("j") < F.col("hi") - F.col("lo")))
    return placed.select((F.col("base") + F.floor(F.col("j") / F.col("each"))).alias("container_id"), key, "first_unit", "n_units", (F.col("off") + (F.col("j") % F.col("each")) * F.col("n_units")).alias("at"))
