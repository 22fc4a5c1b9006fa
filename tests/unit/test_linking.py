"""Components and best similarities without all pairs, against all pairs; places and neighbours in order."""

import random

import pytest
from pyspark.sql import functions as F

from echotrace.operators import clusters, linking, ranking, simjoin
from echotrace.operators.linking import linked_sets
from echotrace.session import temporary
from echotrace.sources.posts import approximate_benchmark_posts


def brute(rows, threshold):
    """`({ord: component}, {component: best})` of rows `(ord, acct, last, tokens)`."""
    best, root = {}, {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    links = []
    for i, (a, p, p2, x) in enumerate(rows):
        for b, q, q2, y in rows[:i]:
            sim = len(set(x) & set(y)) / len(set(x) | set(y))
            if sim >= threshold and (p != q or p != p2 or q != q2):
                links.append((a, b, sim))
                r, s = sorted((find(a), find(b)))
                root[s] = r
    comps = {x: find(x) for x in {x for a, b, _ in links for x in (a, b)}}
    for a, _, sim in links:
        best[comps[a]] = max(best.get(comps[a], 0), sim)
    for a, p, p2, _ in rows:
        if p != p2 and a in comps:
            best[comps[a]] = 1.0
    return comps, best


def sets(seed, n=260):
    """Groups of near copies of several sizes and kinds, by few accounts, among unrelated sets."""
    rng = random.Random(seed)
    rows = []
    for g in range(8):
        base = rng.sample(range(g * 40, g * 40 + 60), rng.randrange(6, 30))
        for _ in range(rng.choice([3, 10, 60])):
            own = set(base) - set(rng.sample(base, rng.randrange(0, 3))) | set(rng.sample(range(5000, 5400), rng.randrange(0, 4)))
            rows.append(own)
    rows += [set(rng.sample(range(9000), 12)) for _ in range(n - len(rows))]
    seen, out = set(), []
    for own in rows:
        if own and frozenset(own) not in seen:
            seen.add(frozenset(own))
            acct = rng.choice("abc")
            out.append((len(out), acct, acct if rng.random() < 0.95 else chr(ord(acct) + 1), sorted(own)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed, threshold, many", [(1, 0.8, 0.0), (2, 0.5, 0.0), (3, 0.7, 0.0), (4, 0.8, 1e9), (5, 0.65, 1.0)])
def test_linked_sets_equal_all_pairs(spark, seed, threshold, many):
    rows = sets(seed)
    with temporary(spark):
        comps, best = linked_sets(spark.createDataFrame(rows, "ord long, acct string, last_acct string, tokens array<long>"), threshold, many, 0.0)
        found, top = {r.node: r.component for r in comps.collect()}, {r.component: r.sim for r in best.collect()}
    want, sims = brute(rows, threshold)
    assert found == want
    mixed = {want[a] for a, p, q, _ in rows if p != q and a in want}
    assert {k: v for k, v in top.items() if k not in mixed} == {k: v for k, v in sims.items() if k not in mixed}


def test_a_large_group_of_near_copies_is_linear(spark, monkeypatch):
    """Of one group of 20,000 posts, each with ten common tokens and one of its own, at most a few pairs a post are looked at."""
    n, looked = 20_000, []
    real = simjoin.verified
    monkeypatch.setattr(linking, "verified", lambda pairs, *a: (looked.append(pairs.count()), real(pairs, *a))[1])
    posts = spark.range(n).select(
        F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), F.concat(F.lit("u"), (F.col("id") % 50).cast("string")).alias("account"), F.lit("https://a.example").alias("url"),
        F.lit("2024-01-01T00:00:00Z").alias("posted_at"), F.col("id").alias("posted_ms"), F.concat(F.lit("one two three four five six seven eight nine ten own"), F.col("id").cast("string")).alias("text"),
    )
    with temporary(spark):
        found = clusters.cluster_table(clusters.all_members(clusters.prepare(posts))).collect()
    assert [(r.cluster_id, r.similarity, r.post_count, r.account_count) for r in found] == [("C-001", 0.83, n, 50)]
    assert sum(looked) <= 4 * n


def test_benchmark_posts_by_pivots(spark):
    """The clusters of the benchmark's posts by the route for large groups."""
    posts = approximate_benchmark_posts(spark, 1000)
    with temporary(spark):
        own = clusters.hashed_sets(clusters.prepare(posts))
        comps, best = linked_sets(own, 0.8, 0.0, 0.0)
        assert comps.select("component").distinct().count() == 20 and comps.count() == 1000
        assert {round(r.sim, 4) for r in best.collect()} == {round(10 / 12, 4)}


def test_places_and_neighbours(spark):
    rng = random.Random(3)
    keys = [(rng.choice(["x", "y", None]), rng.randrange(50)) for _ in range(700)]
    df = spark.createDataFrame([(g, k, i) for i, (g, k) in enumerate(keys)], "g string, k long, i long").repartition(5)
    order = sorted((k, i) for i, (_, k) in enumerate(keys))
    with temporary(spark):
        placed = ranking.place_in_order(df, "at", ["k", "i"], 6)
        assert sorted((r["at"], r.k, r.i) for r in placed.collect()) == [(p, k, i) for p, (k, i) in enumerate(order, 1)]
        for block in (3, 64, 1 << 16):
            behind = {r["at"]: [x.i for x in r.next] for r in ranking.following(placed, "at", ["i"], 3, block).collect()}
            assert behind == {p: [i for _, i in order[p : p + 3]] for p in range(1, 701)}
        by = {}
        for r in ranking.place_in_group(df, "n", ["g"], ["k", "i"], 4).collect():
            by.setdefault(r.g, []).append((r.n, r.k, r.i))
        for g, rows in by.items():
            own = sorted((k, i) for i, (x, k) in enumerate(keys) if x == g)
            assert sorted(rows) == [(n, k, i) for n, (k, i) in enumerate(own, 1)]
        assert ranking.place_in_order(df.where("false"), "at", ["k"]).count() == 0
