"""Connected components by contraction.

In every round each node hooks to the least of its neighbours and itself, and edges move
to the nodes that their ends hooked to; edges within one node vanish, and the others are
one for each pair. The first round goes by the nodes' own order, which resolves stars
around their smallest node at once; later rounds go by an order that is random and new
each time, so that a path of any numbering loses a constant share of its nodes, and the
number of rounds grows with the logarithm of the longest path. At the end the rounds'
hooks are composed, the last and smallest first.

A round is a map-side-combined minimum and two joins over the edges left: no adjacency
list is gathered, so a hub with a third of all edges only makes one skewed join key,
which adaptive execution splits. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.session import Scratch, cut

MAX_ROUNDS = 100


def _contracted(e: DataFrame, hooks: DataFrame) -> DataFrame:
    """Edges `(u, v)` between the nodes that the ends of `e` hooked to."""
    side = lambda c: hooks.select(F.col("u").alias(f"{c}_node"), F.col("to").alias(f"{c}_to"))
    both = e.join(side("u"), F.col("u") == F.col("u_node")).join(side("v"), F.col("v") == F.col("v_node")).where("u_to <> v_to")
    return both.select(F.greatest("u_to", "v_to").alias("u"), F.least("u_to", "v_to").alias("v")).distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """`(node, component)` for every node of an undirected edge table.

    `component` is the smallest node of the component in the column's own order. Self
    loops, repeated edges and edges with a null end are ignored (a node that has only
    those is absent). An empty edge table gives an empty result.
    """
    a, b = F.col(left), F.col(right)
    e = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    rows, levels = None, []
    with Scratch(edges.sparkSession, "components") as scratch:
        for i in range(MAX_ROUNDS):
            e = scratch.store(e, f"edges{i}", rows=rows)
            rows = e.count()
            if not rows:
                break
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            place = (lambda c, i=i: F.xxhash64(F.col(c), F.lit(i))) if i else F.col
            least = both.groupBy("u").agg(F.min_by("v", place("v")).alias("m"))
            to = F.when(place("m") < place("u"), F.col("m")).otherwise(F.col("u"))
            levels.append(scratch.store(least.select("u", to.alias("to")), f"hooks{i}", rows=2 * rows))
            e = _contracted(e, levels[-1])
        else:
            raise RuntimeError("connected components did not converge")
        if not levels:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
        found = levels[-1]
        for hooks in reversed(levels[:-1]):
            later = found.select(F.col("u").alias("at"), F.col("to").alias("root"))
            found = hooks.join(later, F.col("to") == F.col("at"), "left").select("u", F.coalesce("root", "to").alias("to"))
        if len(levels) == 1:  # hooked in the nodes' own order: the root is the smallest
            return cut(found.select(F.col("u").alias("node"), F.col("to").alias("component")))
        found = scratch.store(found, "found")
        least = found.groupBy("to").agg(F.min("u").alias("component")).withColumnRenamed("to", "root")
        return cut(found.join(least, F.col("to") == F.col("root")).select(F.col("u").alias("node"), "component"))


def extended(components: DataFrame, edges: DataFrame, left: str, right: str) -> DataFrame:
    """`components (node, component)` after more edges have come; only the edges between components are looked at.

    Nodes that had no edge before may be missing in `components`.
    """
    side = lambda c: components.select(F.col("node").alias(f"{c}_node"), F.col("component").alias(f"{c}_comp"))
    ends = edges.select(F.col(left).alias("l"), F.col(right).alias("r"))
    moved = ends.join(side("l"), F.col("l") == F.col("l_node"), "left").join(side("r"), F.col("r") == F.col("r_node"), "left")
    joined = connected_components(moved.select(F.coalesce("l_comp", "l").alias("l"), F.coalesce("r_comp", "r").alias("r")), "l", "r")
    if joined.isEmpty():
        return components
    to = joined.select(F.col("node").alias("at"), F.col("component").alias("to"))
    old = components.join(to, F.col("component") == F.col("at"), "left").select("node", F.coalesce("to", "component").alias("component"))
    return cut(old.unionByName(joined.join(components, "node", "left_anti").select("node", "component")))


def edited(components: DataFrame, edges: DataFrame, removed: DataFrame, added: DataFrame, left: str, right: str) -> DataFrame:
    """`components (node, component)` of `edges` after `removed` edges went and `added` ones came.

    `edges` are those that `components` are of, `removed` some of them; both may be given in
    either direction. Only components that lose an edge are taken apart: of the others no
    edge is read beyond its component's id. Then the additions merge what they connect. A
    node whose last edge went is not in the result.
    """
    ends = lambda e: e.where(F.col(left) != F.col(right)).select(F.least(left, right).alias("l"), F.greatest(left, right).alias("r")).distinct()
    gone = cut(ends(removed))
    at = components.select(F.col("node").alias("l"), "component")
    hit = cut(gone.join(at, "l").select("component").distinct())
    if hit.isEmpty():
        return extended(components, added, left, right)
    nodes = components.join(hit, "component", "left_semi").select(F.col("node").alias("l"))
    inside = ends(edges).join(nodes, "l", "left_semi").join(gone, ["l", "r"], "left_anti")  # both ends of an edge are in one component
    again = connected_components(inside, "l", "r")
    rest = components.join(hit, "component", "left_anti").select("node", "component")
    return extended(cut(rest.unionByName(again)), added, left, right)
