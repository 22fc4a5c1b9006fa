"""Components of similar sets, and the highest similarity in each, without all their pairs.

A group of near copies has as many pairs as the square of its size, but a tree connects it.
Sets are first compared with two pivots of each bucket of equal least hashes, which are of
different accounts, so that every set has one to be compared with; what that connects is
contracted. Where the sets of a sample still meet many others outside their components,
the same is done with the buckets of the prefix rows' tokens, with other pivots in each
round, as long as that halves the pairs. Then all pairs between components are compared.
So no link between components is lost, and what a group costs grows with its size.

The highest similarity is searched for from the best one known in each component on. Only
pairs above it are wanted, so prefixes are cut to it, and rows of a token meet by cells of
size and place: two cells are joined only if a pair whose first common token lies there can
be above the best. In a group whose pairs are all alike no cells meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.operators.components import connected_components, extended
from echotrace.operators.screening import parted
from echotrace.operators.simjoin import APART, KEYED, frequent_tokens, may_reach, near, prefix_rows, side, sketch_rows, verified, with_last
from echotrace.session import cut, keep

MANY, FEW = 16.0, 1_000_000.0  # pairs a set, and pairs at all, beyond which pivots of tokens come first
ROUNDS = 4  # most rounds of pivots of tokens
SAMPLE = 512  # sets whose pairs are counted to choose the way, never to leave any out


def _star(rows: DataFrame, threshold: float, salt: int) -> DataFrame:
    """Pairs of each row of a bucket with one of the bucket's two pivots, `rows (token, comp, ...KEYED)`.

    The pivots are a row of the bucket's first account and one of its last, in the columns'
    own order in the first round and in random orders later.
    """
    place = (lambda c: F.xxhash64(c, F.lit(salt))) if salt else F.col
    whole = F.struct(*KEYED, "comp")
    low, high = F.struct(place("acct"), place("ord")), F.struct(place("last"), -place("ord"))
    pivots = rows.groupBy("token").agg(F.min_by(whole, low).alias("p"), F.max_by(whole, high).alias("q"))
    both = rows.join(pivots, "token")
    same = lambda v: (F.col("acct") == F.col(f"{v}.acct")) & (F.col("last") == F.col("acct")) & (F.col(f"{v}.last") == F.col(f"{v}.acct"))
    both = both.select("token", *(F.col(c).alias(f"{c}_a") for c in (*KEYED, "comp")), F.when(same("p"), F.col("q")).otherwise(F.col("p")).alias("v"))
    both = both.select("*", *(F.col(f"v.{c}").alias(f"{c}_b") for c in (*KEYED, "comp"))).where("ord_a <> ord_b and comp_a <> comp_b")
    both = both.where(F.expr(APART)).where(may_reach(F.lit(float(threshold)))).where(near(F.lit(float(threshold))))
    return both.select(F.least("ord_a", "ord_b").alias("a"), F.greatest("ord_a", "ord_b").alias("b")).distinct()


def _with_components(sets: DataFrame, comps: DataFrame) -> DataFrame:
    """Sets with their component, themselves if they have none yet; sets without one are not shuffled."""
    node = comps.select(F.col("node").alias("ord"), F.col("component"))
    some, alone = parted(sets, node, "ord")
    met = some.join(node, "ord", "left").select(*sets.columns, F.coalesce("component", "ord").alias("comp"))
    return met.unionByName(alone.withColumn("comp", F.col("ord")))


def _joined(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    columns, t = (*KEYED, "comp"), F.lit(float(threshold))
    both = side(left, "a", *columns).join(side(right, "b", *columns), "token").where("comp_a <> comp_b")
    return both.where(F.expr(APART)).where(may_reach(t)).where(near(t))


def _load(keyed: DataFrame, sets: int, threshold: float) -> float:
    """About how many pairs between components `_between` would make, by the pairs of a bounded sample of sets."""
    every = max(1, sets // SAMPLE)
    few = F.broadcast(keyed.where(F.pmod(F.xxhash64("ord", F.lit(7)), F.lit(every)) == 0))
    return _joined(few, keyed, threshold).count() / 2 * every


def _between(keyed: DataFrame, threshold: float) -> DataFrame:
    return _joined(keyed, keyed, threshold).where("ord_a < ord_b").select(F.col("ord_a").alias("a"), F.col("ord_b").alias("b")).distinct()


def _above(keyed: DataFrame, best: DataFrame) -> DataFrame:
    """Pairs within a component whose similarity may exceed the component's best, of prefix rows with `component` and its `sim`."""
    rows = keyed.where(F.col("pos") <= F.col("n") - F.floor(F.col("n") * F.col("sim") + 1e-9))  # at least so many plus one are shared
    rows = cut(rows.select("token", *KEYED, "component", "sim"))
    cells = rows.groupBy("token", "component", "n", "pos").agg(F.first("sim").alias("sim"), F.count(F.lit(1)).alias("c"))
    cells = cut(cells)
    cell = lambda s: side(cells, s, "component", "n", "pos", "c")
    meet = cell("a").join(cell("b").withColumnRenamed("component_b", "component_a"), ["token", "component_a"]).join(best.select(F.col("component").alias("component_a"), "sim"), "component_a")
    meet = meet.where("n_a < n_b or n_a = n_b and pos_a <= pos_b").where("n_a <> n_b or pos_a <> pos_b or c_a > 1").where(may_reach(F.col("sim"), strictly=True))
    meet = meet.select("token", F.col("component_a").alias("component"), "n_a", "pos_a", "n_b", "pos_b")
    left = rows.select("token", "component", F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), *(F.col(c).alias(f"{c}_a") for c in ("ord", "acct", "last", "s0", "s1")))
    right = rows.select("token", "component", F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), "sim", *(F.col(c).alias(f"{c}_b") for c in ("ord", "acct", "last", "s0", "s1")))
    both = left.join(meet, ["token", "component", "n_a", "pos_a"]).join(right, ["token", "component", "n_b", "pos_b"])
    both = both.where("ord_a <> ord_b").where(F.expr(APART)).where(near(F.col("sim")))
    return both.select(F.least("ord_a", "ord_b").alias("a"), F.greatest("ord_a", "ord_b").alias("b")).distinct()


def _best(edges: DataFrame, comps: DataFrame) -> DataFrame:
    return edges.join(comps, F.col("a") == F.col("node")).groupBy("component").agg(F.max("sim").alias("sim"))


def linked_sets(sets: DataFrame, threshold: float, many: float = MANY, few: float = FEW) -> tuple[DataFrame, DataFrame]:
    """`(components, best)` of the graph of sets of different accounts with similarity at least `threshold`.

    `sets` is as for `similar_pairs`. `components (node, component)` has the sets that link
    to another, under the smallest of their component; `best (component, sim)` the highest
    similarity of a link. A set of several accounts counts as a link of similarity 1 within
    itself.
    """
    slim = with_last(sets)
    start = sketch_rows(slim).withColumn("comp", F.col("ord"))
    found = [cut(verified(_star(start, threshold, 0), sets, threshold).select("a", "b", "sim"))]
    comps, count, common = connected_components(found[0], "a", "b"), sets.count(), frequent_tokens(sets)
    keyed = prefix_rows(_with_components(slim, comps), threshold, common)
    pairs = _load(keyed, count, threshold)
    for salt in range(ROUNDS):
        if pairs <= max(few, many * count):
            break
        found.append(cut(verified(_star(keep(keyed), threshold, salt), sets, threshold).select("a", "b", "sim")))
        comps = extended(comps, found[-1], "a", "b")
        keyed = prefix_rows(_with_components(slim, comps), threshold, common)
        pairs, before = _load(keyed, count, threshold), pairs
        if pairs > before / 2:
            break
    found.append(cut(verified(_between(keyed, threshold), sets, threshold).select("a", "b", "sim")))
    comps = extended(comps, found[-1], "a", "b")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    if "last_acct" in sets.columns:
        own = sets.where("acct <> last_acct").select(F.col("ord").alias("a"), F.col("ord").alias("b"), F.lit(1.0).alias("sim"))
        edges = edges.unionByName(own)
    best = cut(_best(edges, comps))
    # better bests first: they cut the search, which then has to be whole
    known = comps.join(best, "component").where("sim < 1").select(F.col("node").alias("ord"), "component", "sim")
    linked = keep(parted(slim, known, "ord")[0].join(known, "ord"))
    more = cut(verified(_above(prefix_rows(linked, threshold, common), best), linked, threshold).select("a", "b", "sim"))
    return comps, _best(edges.unionByName(more), comps)
