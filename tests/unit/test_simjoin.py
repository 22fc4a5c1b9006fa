"""Prefix rows of parts with bitmaps: no pair is lost, and chance pairs of long sets are not compared."""

import random

import numpy as np
import pytest

from echotrace.operators import linking, simjoin
from echotrace.session import temporary

SCHEMA = "ord long, acct string, tokens array<long>"


def long_sets(seed, n=160):
    """Unrelated sets of up to 900 tokens out of 6,000, which share rare ones by chance, and copies of some with tokens changed or left out."""
    rng = random.Random(seed)
    rows = [set(rng.sample(range(6000), rng.choice([1, 5, 40, 130, 300, 900]))) for _ in range(n)]
    for own in rows[:40]:
        rest = rng.sample(sorted(own), round(len(own) * rng.choice([0.82, 0.9, 0.55, 0.7])))
        rows.append(set(rest) | set(rng.sample(range(6000, 9000), rng.randrange(0, 1 + len(own) // 20))))
    return [(i, rng.choice("abc"), sorted(x)) for i, x in enumerate(rows) if x]


def brute(rows, threshold):
    return {(a, b) for i, (b, q, y) in enumerate(rows) for a, p, x in rows[:i] if p != q and len(set(x) & set(y)) / len(set(x) | set(y)) >= threshold}


@pytest.mark.parametrize("threshold", [0.35, 0.5, 0.8, 1.0])
def test_parts_lose_no_pair(spark, threshold):
    rows = long_sets(5)
    with temporary(spark):
        found = simjoin.similar_pairs(spark.createDataFrame(rows, SCHEMA), threshold).select("a", "b").collect()
    assert sorted((r.a, r.b) for r in found) == sorted(brute(rows, threshold))


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_chance_pairs_are_left_out_inside_the_join(spark, monkeypatch, threshold):
    """What is verified are about the pairs that are similar, not the pairs that share a rare token."""
    rows, looked = long_sets(6), []
    for module in (linking, simjoin):
        monkeypatch.setattr(module, "verified", lambda pairs, *a, real=simjoin.verified: (looked.append(pairs.count()), real(pairs, *a))[1])
    with temporary(spark):
        sets = spark.createDataFrame(rows, SCHEMA)
        simjoin.similar_pairs(sets, threshold).count()
        pairs = looked.pop()
        linking.linked_sets(sets, threshold)
    want = len(brute(rows, threshold))
    assert want <= pairs <= 3 * want
    assert sum(looked) <= 3 * want + simjoin.SKETCHES * len(rows)  # and a pivot for each sketch of a set


@pytest.mark.parametrize("threshold", [0.35, 0.5, 0.8, 1.0])
def test_bitmaps_of_whole_sets_keep_every_similar_pair_and_few_others(spark, monkeypatch, threshold):
    rows, moved = long_sets(7), []
    monkeypatch.setattr(simjoin, "CHEAP", 0)
    monkeypatch.setattr(simjoin, "plausible", lambda *a, real=simjoin.plausible: (moved.append(real(*a)), moved[-1])[1])
    every = [(a, b) for b, *_ in rows for a, *_ in rows if a < b]
    with temporary(spark):
        sets = spark.createDataFrame(rows, SCHEMA)
        found = simjoin.verified(spark.createDataFrame(every, "a long, b long"), sets, threshold).select("a", "b").collect()
        passed = moved[0].count()
    own = {i: set(x) for i, _, x in rows}
    want = {(a, b) for a, b in every if len(own[a] & own[b]) / len(own[a] | own[b]) >= threshold}
    assert {(r.a, r.b) for r in found} == want and len(found) == len(want)
    assert len(want) <= passed <= 2 * len(want) + len(every) // 50


def test_frequent_tokens_are_bounded(spark):
    rows = [(i, "a", sorted({1, 2 + i % 2, 10 + i % 4, 100 + i})) for i in range(16)]
    with temporary(spark):
        sets = spark.createDataFrame(rows, SCHEMA)
        every, few = simjoin.frequent_tokens(sets), simjoin.frequent_tokens(sets, 3)
    assert (every[0].tolist(), every[1].tolist()) == ([1, 2, 3, 10, 11, 12, 13], [16, 8, 8, 4, 4, 4, 4])
    assert few[0].tolist() == [1, 2, 3] and few[1].dtype == np.int64


def test_sets_are_made_once(spark):
    rows, made = long_sets(9, 40), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    with temporary(spark):
        simjoin.similar_pairs(spark.createDataFrame(rows, SCHEMA).mapInArrow(counted, SCHEMA), 0.8).count()
    assert made.value == len(rows)
