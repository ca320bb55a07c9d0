"""Communities by modularity gain, and centralities: component by component within tasks where they fit there (parts), else as rounds of joins over checkpointed edges.

Communities: nodes move to the neighbouring community that gains most (ties: the smallest one), half of the nodes in a round, so
that neighbours seldom swap; a round that does not raise the modularity is taken back. When neither of two halves gains, communities become
the nodes of a smaller graph, until none gains. Centralities: Brandes' algorithm level by level, for a batch of sources at once:
frontiers with the numbers of shortest paths go forward, dependencies come back and are summed.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrus.operators import parts
from papyrus.operators.graph import checkpointed

#: Steps along an edge (sources x edges, both ways) of a chunk of sources that one task searches from.
WORK = 200_000_000


def _quality(edges: DataFrame, of: DataFrame, m2: float) -> float:
    """Modularity of a partition (node, grp, k: the weight at the node); edges: both directions, a loop once with twice its weight. Two numbers reach the driver."""
    grp = of.select("node", "grp")
    inside = edges.join(grp.toDF("src", "gs"), ["src"]).join(grp.toDF("dst", "gd"), ["dst"]).where("gs = gd").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inside"))
    sums = of.groupBy("grp").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("squares"))
    one = inside.join(F.broadcast(sums)).first()  # one row each
    return one["inside"] / m2 - (one["squares"] or 0.0) / m2**2


def _moved(edges: DataFrame, of: DataFrame, m2: float, half: int, salt: int) -> DataFrame:
    """of (node, grp, k) after the nodes of one half have each moved to the best community among their own and their neighbours'."""
    links = edges.where("src <> dst").join(of.select(F.col("node").alias("dst"), "grp"), ["dst"]).select(F.col("src").alias("node"), "grp", "weight")
    near = links.unionAll(of.select("node", "grp", F.lit(0.0))).groupBy("node", "grp").agg(F.sum("weight").alias("links"))  # with each node's own community
    sizes = of.groupBy("grp").agg(F.sum("k").alias("total"))
    scored = near.join(of.select("node", F.col("grp").alias("own"), "k"), ["node"]).join(sizes, ["grp"])
    stays = F.col("grp") == F.col("own")
    gain = F.col("links") - F.col("k") * (F.col("total") - F.when(stays, F.col("k")).otherwise(0.0)) / m2
    # The most gain first, then staying, then the smallest community. Sums of whole weights are exact, so gains that are equal compare equal.
    best = scored.groupBy("node").agg(F.max_by("grp", F.struct(gain.alias("gain"), stays.alias("stays"), (-F.col("grp")).alias("least"))).alias("best"), F.any_value("own").alias("own"), F.any_value("k").alias("k"))
    return best.select("node", F.when(F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(2)) == half, F.col("best")).otherwise(F.col("own")).alias("grp"), "k")


def communities(edges: DataFrame, most_levels: int = 20, most_rounds: int = 40) -> tuple[DataFrame, list[float]]:
    """(node, community), named by their smallest node, of edges (src, dst, weight; src <> dst, each pair once, whole weights); and the modularity after each level, which never falls.

    No community reaches over components, and what a move gains depends on its component and the weight of the whole graph alone.
    """
    one = checkpointed(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double")))
    m2 = one.agg(F.sum(2 * F.col("weight"))).first()[0]
    if not m2:
        return joined_communities(one, m2, most_levels, most_rounds)
    local, wide = parts.apart(one, checkpointed(parts.components(one)), "weight")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, least, levels = parts.grouped(rows, m2, most_levels, most_rounds)
        levels = levels + [levels[-1]] * (most_levels + 1 - len(levels))
        return pd.concat([parts.columns(node=nodes, community=least, level=np.full(len(nodes), -1), q=np.zeros(len(nodes))), parts.columns(node=np.zeros(len(levels), np.int64), community=np.zeros(len(levels), np.int64), level=np.arange(len(levels)), q=levels)])

    done = checkpointed(parts.each(local, ["part", "own"], run, "node long, community long, level int, q double"))
    sums = {r["level"]: r["q"] for r in done.where("level >= 0").groupBy("level").agg(F.sum("q").alias("q")).collect()}  # most_levels + 1 numbers
    history = [sums.get(k, 0.0) for k in range(most_levels + 1)]
    found, wide = done.where("level < 0").select("node", "community"), checkpointed(wide.select("src", "dst", "weight"))
    if not wide.isEmpty():
        more, steps = joined_communities(wide, m2, most_levels, most_rounds)
        found, history = found.unionByName(more), [h + steps[min(k, len(steps) - 1)] for k, h in enumerate(history)]
    while len(history) > 2 and history[-1] <= history[-2] + 1e-12:
        history.pop()
    return found, history


def joined_communities(one: DataFrame, m2: float | None, most_levels: int, most_rounds: int) -> tuple[DataFrame, list[float]]:
    """communities() by joins, of edges that may be some of a graph of weight m2 / 2."""
    now = checkpointed(one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    names = checkpointed(now.select(F.col("src").alias("node")).distinct().withColumn("grp", F.col("node")))
    history: list[float] = []
    for level in range(most_levels if m2 else 0):
        of = checkpointed(now.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")).select("node", F.col("node").alias("grp"), "k"))
        begun = best = _quality(now, of, m2)
        still = 0
        for turn in range(most_rounds):
            new = checkpointed(_moved(now, of, m2, turn % 2, level + turn // 2))
            q = _quality(now, new, m2)
            if q > best + 1e-12:
                of, best, still = new, q, 0
            else:
                still += 1  # taken back
                if still == 2:  # both halves
                    break
        if not history:
            history.append(begun)
        history.append(best)
        if best <= begun + 1e-12:
            break
        # Communities are named by their smallest member, then they are the nodes of the next level.
        head = of.groupBy("grp").agg(F.min("node").alias("head"))
        of = checkpointed(of.select("node", "grp").join(head, ["grp"]).select("node", F.col("head").alias("grp")))
        names = checkpointed(names.withColumnRenamed("grp", "old").join(of.toDF("old", "grp"), ["old"]).select("node", "grp"))
        now = checkpointed(now.join(of.toDF("src", "s"), ["src"]).join(of.toDF("dst", "d"), ["dst"]).groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("weight").alias("weight")))
    least = names.groupBy("grp").agg(F.min("node").alias("community"))
    return names.join(least, ["grp"]).select("node", "community"), history


def centralities(edges: DataFrame, sources: DataFrame | None = None, batch: int = 256) -> DataFrame:
    """(node, betweenness, closeness) over edges (src, dst; each pair once, no loops) without weights.

    betweenness: over all pairs of other nodes, the share of their shortest paths that run through the node, each pair once, divided by the
    (n - 1)(n - 2) / 2 pairs; closeness: (r - 1) / (sum of distances) * (r - 1) / (n - 1), r being the nodes that it reaches. With ``sources`` (node) only
    their paths count and betweenness is scaled up by n / sources, closeness is of the sources alone; without, all nodes are sources and the result is exact.

    A component that does not fit into a task goes by joins, ``batch`` sources at once: a table holds a row for each source of the batch and node that it has reached.
    """
    pairs = checkpointed(edges.select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).where("src <> dst").distinct())
    labels = checkpointed(parts.components(pairs))
    nodes, n = labels.select("node"), labels.count()
    starts = checkpointed(sources.select(F.col("node").cast("long")).distinct().join(nodes, ["node"])) if sources is not None else nodes
    total = n if sources is None else starts.count()
    marked = pairs if sources is None else pairs.join(starts.select(F.col("node").alias("src"), F.lit(True).alias("s")), ["src"], "left").join(starts.select(F.col("node").alias("dst"), F.lit(True).alias("d")), ["dst"], "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) if sources is not None else F.lit(True).alias(c) for c in ("s", "d")]
    local, wide = parts.apart(marked.select("src", "dst", *flags), labels, "s", "d")
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    dealt = local.join(sizes, ["component"]).withColumn("chunk", F.explode(parts.chunks(F.col("n"), F.col("m"), WORK))).withColumn("chunks", F.size(parts.chunks(F.col("n"), F.col("m"), WORK)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        net = parts.Net(rows)
        own = np.zeros(net.n, bool)
        for end, flag in (("src", "s"), ("dst", "d")):
            own[np.searchsorted(net.nodes, rows[end].to_numpy()[rows[flag].to_numpy(bool)])] = True
        own = np.flatnonzero(own)
        own = own[own % int(rows["chunks"].iloc[0]) == int(rows["chunk"].iloc[0])]
        through, near = parts.paths(net, own)
        close = np.full(net.n, -1.0)  # no source
        close[own] = near
        return pd.DataFrame({"node": net.nodes, "dep": through, "near": close})

    each = parts.each(dealt, ["part", "own", "chunk"], run, "node long, dep double, near double")
    through, close = [each.select("node", "dep")], [each.where(F.col("near") >= 0).select("node", "near")]
    wide = checkpointed(wide.select("src", "dst"))
    if not wide.isEmpty():
        ends = wide.select(F.col("src").alias("node")).union(wide.select("dst")).distinct()
        more = joined_paths(wide, starts.join(ends, ["node"]), batch)
        through, close = through + more[0], close + more[1]
    through = functools.reduce(DataFrame.unionByName, through).groupBy("node").agg(F.sum("dep").alias("dep"))
    close = functools.reduce(DataFrame.unionByName, close)
    scale = n / total / max(1, (n - 1) * (n - 2)) if total else 0.0
    return nodes.join(through, ["node"], "left").join(close, ["node"], "left").select("node", F.round(F.coalesce("dep", F.lit(0.0)) * scale, 9).alias("betweenness"), F.round(F.col("near") / max(1, n - 1), 9).alias("closeness"))


def joined_paths(pairs: DataFrame, starts: DataFrame, batch: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """centralities() by joins: tables of (node, dep), to be summed, and (node, near), before any scaling."""
    both = checkpointed(pairs.unionAll(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    total = starts.count()
    rounds = max(1, -(-total // batch))
    dealt = checkpointed(starts.withColumn("round", F.pmod(F.xxhash64("node"), F.lit(rounds))))
    through, close = [], []
    for k in range(rounds):
        # A table for each level, written once; what was reached before is their union.
        found = [checkpointed(dealt.where(F.col("round") == k).select(F.col("node").alias("source"), "node", F.lit(0).alias("d"), F.lit(1.0).alias("paths")))]
        while not found[-1].isEmpty():
            reached = functools.reduce(DataFrame.unionByName, found)
            sent = found[-1].select("source", F.col("node").alias("src"), "paths").join(both, ["src"]).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
            found.append(checkpointed(sent.join(reached, ["source", "node"], "left_anti").select("source", "node", F.lit(len(found)).alias("d"), "paths")))
        found.pop()
        if not found:
            continue
        reached = functools.reduce(DataFrame.unionByName, found)
        # Backwards: a node's dependency is the sum over its successors of its share of their paths times one plus theirs.
        owed = [found[-1].withColumn("dep", F.lit(0.0))]
        for level in reversed(found[:-1]):
            share = owed[-1].select("source", F.col("node").alias("src"), ((1 + F.col("dep")) / F.col("paths")).alias("unit")).join(both, ["src"]).groupBy("source", F.col("dst").alias("node")).agg(F.sum("unit").alias("unit"))
            owed.append(checkpointed(level.join(share, ["source", "node"], "left").select("source", "node", "d", "paths", (F.col("paths") * F.coalesce("unit", F.lit(0.0))).alias("dep"))))
        mine = functools.reduce(DataFrame.unionByName, owed).where("source <> node").groupBy("node").agg(F.sum("dep").alias("dep"))
        r = F.count("*") - 1
        near = reached.groupBy(F.col("source").alias("node")).agg(F.coalesce(F.try_divide(r * r, F.sum("d")), F.lit(0.0)).alias("near"))
        through.append(mine if rounds == 1 else checkpointed(mine))
        close.append(near if rounds == 1 else checkpointed(near))
    return through, close
