"""The heuristic clusters' sequential scan without a task that holds an island.

Where a cluster ends depends on where it starts and on the masses after that only.  So the scan is an orbit:
every possible start has one next start, and a start is known where the gap before it is wider than any
cluster can reach.  Masses go to buckets on a logarithmic scale with a halo as wide as a cluster can get.  A
first pass finds, for the few starts by which a bucket can be entered and for its known ones, the start by
which the orbit leaves it; pointer doubling over these finds the entries that are reached; a second pass
walks through each bucket from them.  Equal masses are one row with a count: a cluster can only start at the
first or the second of them.

Centres are settled in the same way, over clusters in place of masses; there the reach has no bound, so the
halo grows until every orbit leaves its bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .peaks import density_center, kde_argmax
from .storage import Step

#: Bands a cluster reaches at most: its mean rises by the harmonic numbers, below 30 for any table.
REACH = 32
_NODE = "value double, copy int"


def dealt(df: DataFrame, x: Column, band: float, width: int, below: int, above: int) -> DataFrame:
    """Rows with their own bucket ``home`` and every ``bucket`` that needs them; a bucket is ``width`` bands wide."""
    lo, hi = F.floor((x - above * band) / (width * band)), F.floor((x + below * band) / (width * band))
    return df.withColumn("home", F.floor(x / (width * band))).withColumn("bucket", F.explode(F.sequence(lo, hi)))


def reached(jumps: DataFrame) -> Step:
    """``value, copy``: all nodes that the exits of known starts lead to; ``jumps(value, copy, exit_value, exit_copy, known)``."""
    rest = jumps.where("exit_value IS NOT NULL").distinct()
    step = Step(rest.select("value", "copy", "exit_value", "exit_copy"))
    found = Step(rest.where("known").select(F.col("exit_value").alias("value"), F.col("exit_copy").alias("copy")).distinct())
    n = found.df.count()
    while True:
        on = found.df.join(step.df, ["value", "copy"]).select(F.col("exit_value").alias("value"), F.col("exit_copy").alias("copy"))
        more = Step(found.df.union(on).distinct())
        found.drop()
        found, before, n = more, n, more.df.count()
        if n == before:
            step.drop()
            return found
        two = step.df.select("value", "copy", F.col("exit_value").alias("v"), F.col("exit_copy").alias("c")).join(step.df.withColumnsRenamed({"value": "v", "copy": "c"}), ["v", "c"])
        twice = Step(two.select("value", "copy", "exit_value", "exit_copy"))
        step.drop()
        step = twice


class Masses:
    """Ascending distinct masses with counts, and the next start after each node ``2 * place + copy`` (copy 1: the second of equals)."""

    def __init__(self, values: np.ndarray, counts: np.ndarray, ppm: float):
        self.values, self.counts, n = values, counts, len(values)
        up = 1 + ppm * 1e-6
        base = values[0] if n else 0.0
        size, total = np.r_[0, np.cumsum(counts)], np.r_[0.0, np.cumsum((values - base) * counts)]
        place, copy = np.arange(2 * n) >> 1, np.arange(2 * n) & 1
        j = np.searchsorted(values, values[place] * up, "right")
        self.size = size[j] - size[place] - copy
        sums = total[j] - total[place] - copy * (values[place] - base)
        self.next = 2 * j
        self.real = counts[place] > copy
        live = np.flatnonzero(self.real & (j < n))
        while len(live):
            at = self.next[live] >> 1
            bound = (base + sums[live] / self.size[live]) * up
            live, at, bound = (a[values[at] <= bound] for a in (live, at, bound))
            self.size[live] += 1
            sums[live] += values[at] - base
            again = counts[at] > 1  # the second of equals lies within the bound, so it starts anew
            self.next[live] = np.where(again, 2 * at + 1, 2 * at + 2)
            after = np.minimum(at + 1, n - 1)
            go = ~again & (at + 1 < n) & (values[after] > bound)
            live = live[go]


def _bucket(table: pa.Table, key: int, band: float, width: int, ppm: float) -> tuple[Masses, np.ndarray, np.ndarray]:
    """The masses of a bucket, with its own nodes and its known starts as masks."""
    values = table.column("value").to_numpy()
    order = np.argsort(values)
    values, counts, home = values[order], table.column("n").to_numpy()[order], table.column("home").to_numpy()[order]
    scan = Masses(values, counts, ppm)
    own = np.repeat(home == key, 2)
    apart = np.r_[True, values[1:] > values[:-1] * (1 + 2 * ppm * 1e-6)]
    known = np.zeros(2 * len(values), bool)
    known[::2] = apart
    return scan, own & scan.real, known & own


def heuristic_clusters(peaks: DataFrame, ppm: float = 10, least: int = 3, mz: str = "mz", width: int = 64) -> DataFrame:
    """``first, skip, last, take, size``: the clusters of more than ``least`` points of :func:`.features.heuristic_scan` over all masses.

    A cluster holds the masses from ``first``, but ``skip`` of those equal to it, to ``last``, of which it
    takes ``take``.  A task holds the different masses of ``width`` bands and their halo.  Null, infinite and
    non-positive masses take no part.
    """
    band = math.log1p(ppm * 1e-6)
    m = F.col(mz)
    values = Step(peaks.where(m.isNotNull() & ~F.isnan(m) & (m > 0) & (m < float("inf"))).groupBy(m.cast("double").alias("value")).agg(F.count("*").alias("n")))
    rows = dealt(values.df, F.ln("value"), band, width, 4, REACH)

    def leave(key: tuple, table: pa.Table) -> pa.Table:
        at = key[0].as_py()
        scan, own, known = _bucket(table, at, band, width, ppm)
        exits = np.arange(2 * len(scan.values) + 2)
        exits[: 2 * len(scan.values)] = np.where(own, scan.next, exits[: 2 * len(scan.values)])
        while True:  # doubling inside the bucket
            on = exits[np.minimum(exits, len(exits) - 1)]
            if (on == exits).all():
                break
            exits = on
        near = own & (np.repeat(scan.values, 2) <= math.exp(at * width * band + (REACH + 1) * band))
        who = np.flatnonzero(known | near)
        to = exits[who]
        there = to < 2 * len(scan.values)
        value = np.where(there, scan.values[np.minimum(to >> 1, len(scan.values) - 1)], np.nan)
        return pa.table(
            {"value": scan.values[who >> 1], "copy": pa.array((who & 1).astype(np.int32)), "exit_value": pa.array(value, from_pandas=True), "exit_copy": pa.array((to & 1).astype(np.int32)), "known": known[who]}
        )

    ways = Step(rows.groupBy("bucket").applyInArrow(leave, f"{_NODE}, exit_value double, exit_copy int, known boolean"))
    entries = reached(ways.df)
    ways.drop()
    into = entries.df.select(F.floor(F.ln("value") / (width * band)).alias("bucket"), "value", F.lit(0).cast("long").alias("n"), F.col("copy").cast("long").alias("home"), F.lit(1).alias("side"))

    def walk(key: tuple, table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        scan, own, known = _bucket(table.filter(pa.array(side == 0)), key[0].as_py(), band, width, ppm)
        entered = table.filter(pa.array(side == 1))
        entry = 2 * np.searchsorted(scan.values, entered.column("value").to_numpy()) + entered.column("home").to_numpy()
        starts, todo = set(), [*np.flatnonzero(known).tolist(), *entry.tolist()]
        while todo:
            node = todo.pop()
            while node < len(own) and own[node] and node not in starts:
                starts.add(node)
                node = int(scan.next[node])
        kept = np.array(sorted(s for s in starts if scan.size[s] > least), np.int64)
        nxt = scan.next[kept]
        second = nxt & 1 == 1
        last = np.where(second, nxt >> 1, (nxt >> 1) - 1)
        return pa.table(
            {"first": scan.values[kept >> 1], "skip": pa.array((kept & 1).astype(np.int32)), "last": scan.values[last], "take": np.where(second, 1, scan.counts[last]), "size": scan.size[kept]}
        )

    held = rows.select("bucket", "value", "n", "home", F.lit(0).alias("side")).unionByName(into)
    return held.groupBy("bucket").applyInArrow(walk, "first double, skip int, last double, take long, size long")


def cluster_members(peaks: DataFrame, clusters: DataFrame, ppm: float = 10, mz: str = "mz") -> DataFrame:
    """``first, skip, value, n``: the different masses of each cluster and how many of each it holds."""
    wide = 2 * REACH * math.log1p(ppm * 1e-6)  # a cluster touches two buckets at most
    values = peaks.groupBy(F.col(mz).cast("double").alias("value")).agg(F.count("*").alias("n")).withColumn("bucket", F.floor(F.ln("value") / wide))
    spots = clusters.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor(F.ln("first") / wide), F.floor(F.ln("last") / wide)))))
    met = values.join(spots, "bucket").where("value >= first AND value <= last")
    n = F.when(F.col("value") == F.col("last"), F.col("take")).otherwise(F.col("n")) - F.when(F.col("value") == F.col("first"), F.col("skip")).otherwise(0)
    return met.select("first", "skip", "value", n.cast("long").alias("n")).where("n > 0")


class Centers:
    """Clusters in order with their centres, and for a start the settled centre and the next start."""

    def __init__(self, centers: list[float], values: list[np.ndarray], ppm: float, points: int):
        self.centers, self.values, self.ppm, self.points, self.known = centers, values, ppm, points, {}

    def step(self, i: int) -> tuple[float, int]:
        if i not in self.known:
            at, held, j = self.centers[i], self.values[i], i + 1
            while j < len(self.centers) and (self.centers[j] - at) / at * 1e6 < 2 * self.ppm:
                held = np.concatenate([held, self.values[j]])
                at, j = kde_argmax(held, self.points), j + 1
            self.known[i] = (at, j)
        return self.known[i]


def heuristic_centers(peaks: DataFrame, ppm: float = 10, least: int = 3, mz: str = "mz", points: int = 10_000, width: int = 256) -> DataFrame:
    """``center``: density centres of the heuristic clusters, those closer than twice ``ppm`` made one (:func:`.features.settle_centers`)."""
    band = math.log1p(ppm * 1e-6)
    clusters = Step(heuristic_clusters(peaks, ppm, least, mz))
    members = Step(cluster_members(peaks, clusters.df, ppm, mz))
    centers = density_center(members.df, ["first", "skip"], "value", "center", points, weight="n")
    lists = members.df.groupBy("first", "skip").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("m"))
    full = Step(lists.join(centers, ["first", "skip"]).join(clusters.df.select("first", "skip", "last"), ["first", "skip"]))
    clusters.drop()
    members.drop()

    def read(table: pa.Table) -> tuple[Centers, np.ndarray, np.ndarray, pa.Table]:
        table = table.sort_by([("first", "ascending"), ("skip", "ascending")]).combine_chunks()
        lists = [np.repeat([e["value"] for e in m], [e["n"] for e in m]) for m in table.column("m").to_pylist()]
        centers, last = table.column("center").to_numpy(), table.column("last").to_numpy()
        # no centre made of clusters before this one can reach it
        known = np.r_[True, (centers[1:] - last[:-1]) / last[:-1] * 1e6 >= 2 * ppm]
        return Centers(centers.tolist(), lists, ppm, points), known, table.column("home").to_numpy(), table

    def leaving(halo: int, entry: int):
        def leave(key: tuple, table: pa.Table) -> pa.Table:
            scan, known, home, table = read(table)
            first, copy, n = table.column("first").to_numpy(), table.column("skip").to_numpy(), len(home)
            early = known | (first <= np.exp((home * width + entry) * band))
            cut = table.column("last").to_numpy().max(initial=0.0) > math.exp(((key[0].as_py() + 1) * width + halo - 3) * band)
            out = []
            for i in np.flatnonzero(early & (home == key[0].as_py())).tolist():
                j = i
                while j < n and home[j] == home[i]:
                    j = scan.step(j)[1]
                # open: what lies beyond the halo may go on, or the next bucket doesn't look for this entry
                out.append((first[i], int(copy[i]), first[j] if j < n else None, int(copy[j]) if j < n else 0, bool(known[i]), bool(cut if j == n else not early[j])))
            kinds = (pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_())
            columns = list(zip(*out)) if out else [[]] * 6
            return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["value", "copy", "exit_value", "exit_copy", "known", "open"])

        return leave

    halo, entry = 4 * REACH, REACH // 2
    while True:
        rows = dealt(full.df, F.ln("first"), band, width, 2 * REACH, halo)
        kinds = f"{_NODE}, exit_value double, exit_copy int, known boolean, open boolean"
        ways = Step(rows.groupBy("bucket").applyInArrow(leaving(halo, entry), kinds), open=F.sum(F.col("open").cast("long")))
        if not ways.sums["open"]:
            break
        ways.drop()
        halo, entry = halo * 4, entry * 4
    entries = reached(ways.df)
    into = entries.df.select(F.col("value").alias("first"), F.col("copy").alias("skip"), F.lit(True).alias("entered"))
    held = full.df.join(into, ["first", "skip"], "left").withColumn("entered", F.coalesce("entered", F.lit(False)))

    def walk(key: tuple, table: pa.Table) -> pa.Table:
        scan, known, home, table = read(table)
        own = home == key[0].as_py()
        out, seen = [], set()
        for i in np.flatnonzero(own & (known | table.column("entered").to_numpy(zero_copy_only=False))).tolist():
            while i < len(own) and own[i] and i not in seen:
                seen.add(i)
                at, i = scan.step(i)
                out.append(at)
        return pa.table({"center": pa.array(out, pa.float64())})

    return dealt(held, F.ln("first"), band, width, 2 * REACH, halo).groupBy("bucket").applyInArrow(walk, "center double")
