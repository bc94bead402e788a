"""Connected components by randomised contraction.

Every round lets each node point at the neighbour (or itself) with the smallest seeded hash, rewrites the edges onto
those targets and drops loops and repeats.  A constant expected share of the nodes disappears per round, so chains,
stars and cliques all need a logarithmic number of rounds; a hub is only ever touched by partial aggregates and by
plain equi-joins, which AQE can split.  The per-round parent maps are then composed backwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgrid.workspace import Workspace


def _targets(edges: DataFrame, seed: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rank = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("x"))
    best = both.groupBy("u").agg(F.min(rank("v")).alias("b"))
    return best.select("u", F.least(F.col("b"), rank("u"))["x"].alias("p"))


def component_roots(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of any one orderable type -> ``(node, root)`` for every node that has an edge.

    ``root`` is some member of the component, the same for all of its nodes.  Null end points and loops are ignored;
    repeated edges do not matter.  An empty input gives an empty result.
    """
    spark = edges.sparkSession
    ws = Workspace(spark, "components")
    live = ws.keep(edges.select("u", "v").where("u is not null and v is not null and u != v").distinct(), "e0")
    parents: list[DataFrame] = []
    for k in range(max_rounds):
        if live.isEmpty():
            break
        parent = ws.keep(_targets(live, k), f"p{k}")
        parents.append(parent)
        left = ws.beside(parent.select(F.col("u").alias("a"), F.col("p").alias("pa")), f"p{k}")
        right = ws.beside(parent.select(F.col("u").alias("b"), F.col("p").alias("pb")), f"p{k}")
        moved = live.join(left, F.col("u") == F.col("a")).join(right, F.col("v") == F.col("b"))
        live = ws.keep(
            moved.where("pa != pb").select(F.least("pa", "pb").alias("u"), F.greatest("pa", "pb").alias("v")).distinct(),
            f"e{k + 1}",
        )
        ws.drop(f"e{k}")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not parents:
        return live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = parents[-1].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for k in range(len(parents) - 2, -1, -1):
        up = ws.beside(roots.select(F.col("node").alias("p"), F.col("root")), f"p{k + 1}")  # a row for each of that table
        roots = parents[k].join(up, "p", "left").select(F.col("u").alias("node"), F.coalesce("root", "p").alias("root"))
    return ws.keep(roots, "roots")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(node)`` and ``edges(u, v)`` -> ``(node, component)``, the smallest node of each component.

    Isolated nodes form their own component, edges to unknown nodes are ignored.
    """
    known = nodes.select("node").where("node is not null").distinct()
    inner = edges.join(known.select(F.col("node").alias("u")), "u", "left_semi")
    inner = inner.join(known.select(F.col("node").alias("v")), "v", "left_semi")
    roots = component_roots(inner.select("u", "v"))
    ws = Workspace(nodes.sparkSession, "named")
    least = ws.keep(roots.groupBy("root").agg(F.min("node").alias("component")), "least")
    named = ws.keep(roots.join(ws.beside(least, "least"), "root").select("node", "component"), "named")
    named = ws.beside(named, "named")
    return known.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def ordered_components(components: DataFrame) -> DataFrame:
    """Component sizes ranked by (size descending, smallest member)."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.orderBy(F.desc("size"), F.asc("component"))
