"""Leiden communities of an edge table, by modularity with a resolution (Traag, Waltman and van Eck 2019).

Each level has three steps, all joins and grouped sums over the edges.  *Moves*: every node compares its
links to the communities about it; of those that gain, a part moves at once, a half at first and a quarter
of the part before whenever modularity would fall, down to the best single move, so modularity only rises.
*Refinement*: inside each community nodes merge anew from single ones, and only where both sides are well
linked within the community, so parts that hang together by nothing come apart.  *Aggregation*: refined
parts become nodes, which start in the community they came from.

What comes to the driver is one row of sums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running
from .storage import Step

#: Gains in units of twice the total weight below this are rounding.
LEAST_GAIN = 1e-12


def both_ways(edges: DataFrame, a: str = "a", b: str = "b", weight: str = "weight") -> DataFrame:
    """``a, b, w``: each pair of distinct ends in both directions, repeated pairs summed."""
    own = edges.where((F.col(a) != F.col(b)) & (F.col(weight) > 0)).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), F.col(weight).cast("double").alias("w"))
    # in one pass: what the edges are made from runs once
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return own.select(ways.alias("e"), "w").groupBy("e.a", "e.b").agg(F.sum("w").alias("w"))


class _Level:
    """Nodes of one level with their edges (both directions), and the resolution over twice the total weight."""

    def __init__(self, edges: Step, rate: float, twice: float):
        self.edges, self.rate, self.twice = edges, rate, twice

    def look(self, nodes: DataFrame, seed: int) -> tuple[Step, float, int]:
        """The nodes (``id, k, inner, c``) with their best move and its gain; modularity; how many gain.

        Communities are named after their smallest node; a node may also leave for one of its own.
        """
        sums = nodes.groupBy("c").agg(F.min("id").alias("name"), F.sum("k").alias("total"), F.count("*").alias("n"))
        named = nodes.join(sums, "c").select("id", "k", "inner", F.col("name").alias("c"), "total", "n")
        about = named.select(F.col("id").alias("b"), F.col("c").alias("to"), F.col("total").alias("to_total"))
        links = self.edges.df.join(about, "b").groupBy(F.col("a").alias("id"), "to").agg(F.sum("w").alias("w"), F.first("to_total").alias("to_total"))
        met = links.join(named.select("id", "k", "c"), "id")
        value = F.col("w") - self.rate * F.col("k") * F.col("to_total")
        best = met.groupBy("id").agg(
            F.sum(F.when(F.col("to") == F.col("c"), F.col("w"))).alias("own"), F.max(F.when(F.col("to") != F.col("c"), F.struct(value.alias("value"), (-F.col("to")).alias("to")))).alias("go")
        )
        own = F.coalesce("own", F.lit(0.0))
        stay = own - self.rate * F.col("k") * (F.col("total") - F.col("k"))
        joined = named.join(best, "id", "left").select("id", "k", "inner", "c", "total", own.alias("own"), stay.alias("stay"), F.col("go.value").alias("value"), (-F.col("go.to")).alias("to"), "n")
        alone = (F.col("n") > 1) & (F.coalesce("value", F.lit(float("-inf"))) < 0)
        gain = (F.when(alone, F.lit(0.0)).otherwise(F.col("value")) - F.col("stay")) / self.twice
        moved = joined.select("id", "k", "inner", "c", "own", "total", F.when(alone, -1 - F.col("id")).otherwise(F.col("to")).alias("to"), F.coalesce(gain, F.lit(0.0)).alias("gain"))
        step = Step(
            moved.withColumn("turn", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)),
            inside=F.sum(F.col("inner") + F.col("own")),
            squares=F.sum(F.col("k") * F.col("total")),
            n=F.sum((F.col("gain") > LEAST_GAIN).cast("long")),
        )
        return step, (step.sums["inside"] - self.rate * step.sums["squares"]) / self.twice, step.sums["n"]

    def settle(self, nodes: DataFrame, rounds: int) -> tuple[Step, int]:
        """Moves until no single node gains by one, for so many rounds at most, and how many rounds it took; the next level goes on with what is left."""
        state, quality, gaining = self.look(nodes, 0)
        turn, share = 0, 0.5
        while gaining and turn < rounds:
            turn += 1
            gains = F.col("gain") > LEAST_GAIN
            if share * gaining < 1:
                top = state.df.where(gains).orderBy(F.desc("gain"), "id").first()
                goes = gains & (F.col("id") == top["id"])
            else:
                goes = gains & (F.col("turn") < share)
            trial, better, left = self.look(state.df.select("id", "k", "inner", F.when(goes, F.col("to")).otherwise(F.col("c")).alias("c")), turn)
            if better > quality:
                state.drop()
                state, quality, gaining, share = trial, better, left, min(0.5, 2 * share)
            elif share * gaining < 1:
                trial.drop()  # even the best move is rounding
                break
            else:
                # the same nodes' draws stay, so a smaller share is a part of the moves that failed
                trial.drop()
                share /= 4
        return state, turn

    def refine(self, nodes: DataFrame, rounds: int) -> Step:
        """``id, k, inner, c, part``: well-linked parts of each community, named after a node.

        In a round, single nodes on the tails of a coin join the part on heads that they gain most by.
        """
        state = Step(nodes.withColumn("part", F.col("id")))
        for turn in range(rounds):
            now = state.df.drop("could")
            ends = now.select(F.col("id").alias("b"), F.col("c").alias("b_c"), F.col("part").alias("to"))
            inside = self.edges.df.join(now.select(F.col("id").alias("a"), "c", "part"), "a").join(ends, "b").where("c = b_c and part <> to")
            parts = now.groupBy("c", "part").agg(F.sum("k").alias("part_k"), F.count("*").alias("n"))
            totals = now.groupBy("c").agg(F.sum("k").alias("total"))
            cut = inside.groupBy("part").agg(F.sum("w").alias("cut"))
            heads = F.pmod(F.xxhash64("to", F.lit(turn)), F.lit(2)) == 0
            tails = F.pmod(F.xxhash64("part", F.lit(turn)), F.lit(2)) == 1
            fine = parts.join(totals, "c").join(cut, "part").where(F.col("cut") >= self.rate * F.col("part_k") * (F.col("total") - F.col("part_k")))
            links = inside.groupBy("part", "to").agg(F.sum("w").alias("w"))
            free = fine.where(F.col("n") == 1).select("part", "part_k")
            joins = links.join(free, "part").join(fine.select(F.col("part").alias("to"), F.col("part_k").alias("to_k")), "to")
            joins = joins.withColumn("gain", F.col("w") - self.rate * F.col("part_k") * F.col("to_k")).where(F.col("gain") > LEAST_GAIN * self.twice)
            chosen = joins.groupBy("part").agg(F.max(F.when(heads, F.struct("gain", (-F.col("to")).alias("to")))).alias("g")).select("part", F.lit(True).alias("could"), F.when(tails, -F.col("g.to")).alias("into"))
            new = Step(
                now.join(chosen, "part", "left").select("id", "k", "inner", "c", F.coalesce("into", "part").alias("part"), F.coalesce("could", F.lit(False)).alias("could")),
                could=F.sum(F.col("could").cast("long")),
            )
            state.drop()
            state = new
            if not new.sums["could"]:
                break
        return state


def leiden(edges: DataFrame, resolution: float = 1.0, *, nodes: DataFrame | None = None, rounds: int = 12, merges: int = 6, levels: int = 20) -> DataFrame:
    """``node, community``: communities numbered from 0, the largest first (ties by the smallest node).

    ``edges``: ``a, b, weight`` in either direction, each pair once or in parts; loops and weights that are
    not positive say nothing.  ``nodes`` (a column ``node``) adds nodes without edges, each of which is a
    community.  A level moves for ``rounds`` and refines for ``merges`` at most; what is left is
    taken up by the next, and levels end when no move gains or nothing merges.
    No edges and no nodes give no rows.
    """
    spark = edges.sparkSession
    links = Step(both_ways(edges))
    every = links.df.select(F.col("a").alias("id"))
    if nodes is not None:
        every = every.union(nodes.select(F.col("node").cast("long")))
    degrees = links.df.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    base = Step(every.distinct().join(degrees, "id", "left").select("id", F.coalesce("k", F.lit(0.0)).alias("k"), F.lit(0.0).alias("inner"), F.col("id").alias("c")))
    twice = links.df.agg(F.sum("w")).first()[0]
    out = base.df.select(F.col("id").alias("node"), F.col("id").alias("at"))
    if not twice:
        return running(out.select("node"), ["node"], out="community").select("node", (F.col("community") - 1).alias("community"))
    home, current = Step(out), base
    for _ in range(levels):
        level = _Level(links, resolution / twice, twice)
        n = current.df.count()
        settled, took = level.settle(current.df, rounds)
        if not took or settled.df.select("c").distinct().count() == n:
            break
        refined = level.refine(settled.df.select("id", "k", "inner", "c"), merges)
        parts = refined.df.drop("could")
        if parts.select("part").distinct().count() == n:
            break
        pair = links.df.join(parts.select(F.col("id").alias("a"), F.col("part").alias("pa")), "a").join(parts.select(F.col("id").alias("b"), F.col("part").alias("pb")), "b")
        summed = Step(pair.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("w").alias("w")))
        within = summed.df.where("a = b").select(F.col("a").alias("id"), F.col("w").alias("more"))
        merged = parts.groupBy(F.col("part").alias("id")).agg(F.sum("k").alias("k"), F.sum("inner").alias("inner"), F.first("c").alias("c"))
        new = Step(merged.join(within, "id", "left").select("id", "k", (F.col("inner") + F.coalesce("more", F.lit(0.0))).alias("inner"), "c"))
        moved = Step(home.df.join(parts.select(F.col("id").alias("at"), "part"), "at").select("node", F.col("part").alias("at")))
        slim = Step(summed.df.where("a <> b"))
        for old in (home, current, links, summed, settled, refined):
            old.drop()
        home, current, links = moved, new, slim
    found = home.df.join(settled.df.select(F.col("id").alias("at"), "c"), "at").select("node", "c")
    sizes = found.groupBy("c").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    number = running(sizes.select("c", (-F.col("n")).alias("order"), "first"), ["order", "first"], out="community")
    return found.join(number.select("c", (F.col("community") - 1).alias("community")), "c").select("node", "community")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0, node: str = "node", community: str = "community") -> DataFrame:
    """One row ``modularity`` of a labelling of all ends of ``edges(a, b, weight)``."""
    links = both_ways(edges)
    own = labels.select(F.col(node).cast("long").alias("a"), F.col(community).alias("ca"))
    met = links.join(own, "a").join(own.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b")
    sums = met.groupBy("ca").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    both = sums.agg(F.sum("inside").alias("inside"), F.sum("k").alias("twice"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    return both.select((F.col("inside") / F.col("twice") - resolution * F.col("squares") / F.col("twice") / F.col("twice")).alias("modularity"))
