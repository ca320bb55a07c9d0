"""Graphs as edge tables (src, dst, weight), src < dst; everything by joins and aggregates."""

from __future__ import annotations

import functools
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrus.operators import parts
from papyrus.operators.triangles import triangles
from papyrus.session import shared_folder


def shared_item_edges(rows: DataFrame, node: str, item: str, least: int = 1) -> DataFrame:
    """Nodes that occur with the same item, weighted by how many items they share.

    Meant for items with few nodes each (order lines, a document's top terms): the pairs of an item are made.
    """
    of = rows.where(F.col(node).isNotNull() & F.col(item).isNotNull()).groupBy(item).agg(F.array_sort(F.collect_set(node)).alias("nodes")).where(F.size("nodes") > 1)
    each = of.select("nodes", F.posexplode("nodes").alias("pos", "src"))
    pairs = each.select("src", F.explode(F.slice("nodes", F.col("pos") + 2, F.size("nodes"))).alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def _ends(edges: DataFrame, *cols: str) -> DataFrame:
    return edges.select(F.col("src").alias("node"), *cols).unionAll(edges.select(F.col("dst").alias("node"), *cols))


def degrees(edges: DataFrame, k: int | None = None) -> DataFrame:
    """(node, degree, strength, centrality): centrality is degree over the other nodes' number."""
    d = _ends(edges, "weight").groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    n = d.agg(F.count("*").alias("nodes"))
    out = d.join(F.broadcast(n)).select("node", "degree", "strength", F.round(F.try_divide("degree", F.col("nodes") - 1), 6).alias("centrality"))
    return out.orderBy(F.col("degree").desc(), "node").limit(k) if k else out


def summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, total weight."""
    n = _ends(edges).select(F.count_distinct("node").alias("nodes"))
    m = edges.agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))
    return n.join(F.broadcast(m)).select("nodes", "edges", "weight", F.round(F.coalesce(F.try_divide(2.0 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0)), 6).alias("density"))


def clustering(edges: DataFrame, written: bool = False) -> DataFrame:
    """(node, degree, triangles, coefficient) of edges that are written once, unless they are already."""
    edges = edges if written else checkpointed(edges.select("src", "dst"))
    d = _ends(edges).groupBy("node").agg(F.count("*").alias("degree"))
    full = d.join(triangles(edges), ["node"], "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    pairs = F.col("degree") * (F.col("degree") - 1)
    return full.select("node", "degree", "triangles", F.round(F.coalesce(F.try_divide(2.0 * F.col("triangles"), pairs), F.lit(0.0)), 6).alias("coefficient"))


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: Q of a grouping (node, grp) by weights."""
    w = edges.join(groups.toDF("src", "gs"), ["src"]).join(groups.toDF("dst", "gd"), ["dst"])
    inside = w.groupBy(F.col("gs").alias("grp")).agg(F.sum(F.when(F.col("gs") == F.col("gd"), F.col("weight")).otherwise(0)).alias("inside"))
    strength = _ends(edges, "weight").join(groups, ["node"]).groupBy("grp").agg(F.sum("weight").alias("s"))
    m = edges.agg(F.sum("weight").alias("m"))
    full = strength.join(inside, ["grp"], "left").join(F.broadcast(m))
    part = F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("s") / (2 * F.col("m")), 2)
    return full.agg(F.round(F.sum(part), 6).alias("q"), F.count("*").alias("groups"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, written once to the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are joined to the least node of its neighbourhood. edges: src < dst."""
    least = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
    return edges.join(least, ["src"]).select(F.col("m").alias("src"), "dst").where("src < dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are joined to the smallest of those. edges: src < dst."""
    least = edges.groupBy("dst").agg(F.min("src").alias("m"))
    moved = edges.join(least, ["dst"]).where("src > m").select(F.col("m").alias("src"), F.col("src").alias("dst"))
    return moved.union(least.select(F.col("m").alias("src"), "dst")).distinct()


def label_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that is reached. Stars grow by turns until no edge changes; each round is checkpointed.

    No join is on a component's label: a giant component is many keys until it is a star, whose edges have different ends.
    """
    now = checkpointed(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    for _ in range(rounds):
        new = checkpointed(_small_star(_large_star(now)))
        done = new.count() == now.count() and new.join(now, ["src", "dst"], "left_anti").isEmpty()
        now = new
        if done:
            heads = now.select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
            return now.select(F.col("dst").alias("node"), F.col("src").alias("component")).union(heads)
    raise RuntimeError(f"no fixed point after {rounds} rounds")


#: Sources of a component that one search takes: a bit of a long each, in so many columns.
WORDS, WORD = 8, 64


def _both_ways(edges: DataFrame, *cols: str) -> DataFrame:
    return edges.select("src", "dst", *cols).unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols))


def eccentricities(both: DataFrame, sources: DataFrame, words: int = WORDS) -> DataFrame:
    """(component, node, ecc): how far the farthest node of its component is from each source. sources: node, component, at most words * WORD in each component.

    both: edges in both directions, without repeats. All sources are searched from at once, components side by side: a node keeps a bit
    for each source of its component that has reached it; a step sends the bits that were new to a node on to its neighbours and
    ORs them there. Of each step and component one row is kept: the sources that still reached a new node.
    """
    names, one = [f"w{k}" for k in range(words)], F.lit(1).cast("long")
    bit = F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1
    placed = checkpointed(sources.select("node", "component").withColumn("bit", bit))
    masks = [F.when(F.floor(F.col("bit") / WORD) == k, F.call_function("shiftleft", one, (F.col("bit") % WORD).cast("int"))).otherwise(F.lit(0).cast("long")).alias(f"w{k}") for k in range(words)]
    # A row for each node that was reached: the bits that it had before (s) and those that the last step brought (w).
    state, steps = checkpointed(placed.select("node", "component", *[F.lit(0).cast("long").alias(f"s{w}") for w in names], *masks)), []
    some = " OR ".join(f"{w} <> 0" for w in names)
    for step in itertools.count(1):
        sent = state.where(some).withColumnRenamed("node", "src").join(both, ["src"]).groupBy(F.col("dst").alias("node"), "component").agg(*[F.bit_or(w).alias(f"n{w}") for w in names])
        none = F.lit(0).cast("long")
        had = [F.coalesce(f"s{w}", none).bitwiseOR(F.coalesce(w, none)) for w in names]
        fresh = [F.coalesce(f"n{w}", none).bitwiseAND(F.bitwise_not(h)).alias(w) for w, h in zip(names, had, strict=True)]
        state = checkpointed(state.join(sent, ["node", "component"], "full").select("node", "component", *[h.alias(f"s{w}") for w, h in zip(names, had, strict=True)], *fresh))
        last = state.where(some)
        if last.isEmpty():
            break
        steps.append(last.groupBy("component").agg(F.lit(step).alias("d"), F.array(*[F.bit_or(w) for w in names]).alias("bits")))
    if not steps:
        return placed.select("component", "node", F.lit(0).alias("ecc"))
    reached = functools.reduce(DataFrame.unionByName, steps)
    hit = F.call_function("getbit", F.get("bits", F.floor(F.col("bit") / WORD).cast("int")), (F.col("bit") % WORD).cast("int")) == 1
    far = placed.join(reached, ["component"]).where(hit).groupBy("component", "node").agg(F.max("d").alias("d"))
    return placed.join(far, ["component", "node"], "left").select("component", "node", F.coalesce("d", F.lit(0)).alias("ecc"))


def levels(both: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, component, level): steps from the start of its component. starts: node, component, one for each component. The frontier grows by a join a step."""
    found = [checkpointed(starts.select("node", "component", F.lit(0).alias("level")))]  # a table for each level, written once
    while not found[-1].isEmpty():
        step = found[-1].select(F.col("node").alias("src"), "component", (F.col("level") + 1).alias("level")).join(both, ["src"]).select(F.col("dst").alias("node"), "component", "level").distinct()
        found.append(checkpointed(step.join(functools.reduce(DataFrame.unionByName, found).select("node"), ["node"], "left_anti")))
    return functools.reduce(DataFrame.unionByName, found)


def diameters(edges: DataFrame, words: int = WORDS) -> DataFrame:
    """(component, nodes, diameter) of each connected component, exact, for any number of nodes: within a task where a component fits there (parts), else by joins."""
    edges = checkpointed(edges)
    labels = checkpointed(parts.components(edges))
    local, wide = parts.apart(edges.where("src <> dst"), labels)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        net = parts.Net(rows)
        return pd.DataFrame({"component": [net.nodes[0]], "nodes": [net.n], "diameter": [parts.diameter(net)]})

    found = checkpointed(parts.each(local, ["part", "own"], run, "component long, nodes long, diameter int"))
    wide = checkpointed(wide.select("src", "dst"))
    return found if wide.isEmpty() else found.unionByName(joined_diameters(wide, words))


def joined_diameters(edges: DataFrame, words: int = WORDS) -> DataFrame:
    """diameters() by joins.

    Levels are counted from a node of highest degree of each component. A path between nodes of level i or less has 2 * i edges at most,
    so levels are searched from the farthest inwards, words * WORD nodes of each component's open level at a time, until the
    longest distance found reaches what the levels that are left could still give. Components are searched side by side.
    """
    both = checkpointed(_both_ways(edges.where("src <> dst")).distinct())
    labels = checkpointed(label_components(edges))
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    starts = labels.join(degree, ["node"]).groupBy("component").agg(F.min_by("node", F.struct(-F.col("d"), "node")).alias("node"))
    found, size = levels(both, starts), words * WORD
    # The nodes of a level in turns of at most ``size``: dealt by hash to parts of half of that, and numbered within those.
    parts = found.groupBy("component", "level").agg(F.ceil(F.count("*") / (size / 2)).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    within = Window.partitionBy("component", "level", "part").orderBy("node")
    numbered = found.join(parts, ["component", "level"]).withColumn("part", part).withColumn("turn", F.col("part") + F.col("parts") * F.floor((F.row_number().over(within) - 1) / size)).select("node", "component", "level", "turn")
    numbered = checkpointed(numbered)
    turns = checkpointed(numbered.groupBy("component", "level").agg(F.max("turn").alias("last_turn"))).withColumnRenamed("level", "open")
    state = checkpointed(found.groupBy("component").agg(F.count("*").alias("nodes"), F.max("level").alias("low"), F.max("level").alias("open")).withColumn("turn", F.lit(0).cast("long")))
    while True:
        going = state.where(F.col("low") < 2 * F.col("open"))
        if going.isEmpty():
            return state.select("component", "nodes", F.col("low").alias("diameter"))
        batch = numbered.join(going.select("component", F.col("open").alias("level"), "turn"), ["component", "level", "turn"])
        best = eccentricities(both, batch, words).groupBy("component").agg(F.max("ecc").alias("best"))
        more, searched = F.col("turn") < F.col("last_turn"), F.col("low") < 2 * F.col("open")
        after = state.join(best, ["component"], "left").join(turns, ["component", "open"], "left")
        state = checkpointed(after.select("component", "nodes", F.greatest("low", F.coalesce("best", "low")).alias("low"), F.when(searched & ~more, F.col("open") - 1).otherwise(F.col("open")).alias("open"), F.when(searched & more, F.col("turn") + 1).otherwise(F.lit(0)).alias("turn")))


def metrics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, connected, diameter (null if there are several components), average clustering coefficient."""
    edges = checkpointed(edges)
    labels = checkpointed(parts.components(edges))
    groups = labels.agg(F.count_distinct("component").alias("components"))
    single = groups.first()["components"] == 1  # one number; several components have no diameter, and none is searched for
    widest = diameters(edges).agg(F.max("diameter").alias("d")) if single else groups.select(F.lit(None).cast("int").alias("d"))
    mean = clustering(edges, written=True).agg(F.round(F.avg("coefficient"), 6).alias("clustering"))
    one = summary(edges).select("nodes", "edges").join(F.broadcast(groups)).join(F.broadcast(widest)).join(F.broadcast(mean))  # one row each
    return one.select("nodes", "edges", "components", (F.col("components") == 1).alias("connected"), F.col("d").alias("diameter"), "clustering")


def adjacency(edges: DataFrame, k: int = 20) -> DataFrame:
    """(node, neighbours) of the k nodes of highest degree, neighbours among them as a sorted list."""
    best = degrees(edges, k).select("node")
    among = edges.join(F.broadcast(best.toDF("src")), ["src"]).join(F.broadcast(best.toDF("dst")), ["dst"])
    both = among.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionAll(among.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    return both.groupBy("node").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("other")), ",").alias("neighbours"))


def top_per_type(rows: DataFrame, kind: str, name: str, k: int = 3) -> DataFrame:
    """(kind, name, n, rank): the k most frequent names of each kind, as a topic graph's nodes."""
    n = rows.groupBy(kind, name).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(F.col("n").desc(), name))).where(F.col("rank") <= k)
