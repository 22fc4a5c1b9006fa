"""What similar sets write and move: equal sets meet without pairs of tokens, and full sets are written for similar pairs only."""

import os
import random

import pytest
from pyspark.sql import functions as F

from echotrace import session
from echotrace.operators import simjoin
from echotrace.session import temporary

SCHEMA = "ord long, acct string, last_acct string, tokens array<long>"


@pytest.fixture
def written(monkeypatch):
    """The numbers of rows with tokens that the join writes."""
    rows = []

    def keep(df, *a, real=session.keep, **more):
        out = real(df, *a, **more)
        if "tokens" in df.columns:
            rows.append(out.count())
        return out

    monkeypatch.setattr(simjoin, "keep", keep)
    return rows


def test_equal_sets_meet_by_hash_and_only_they_are_written(spark, monkeypatch, written):
    rng = random.Random(3)
    groups = [rng.sample(range(1000), n) for n in (1, 3, 40, 300)]
    rows = [(10 * g + i, "ab"[i % 2], "c" if i == 6 else "ab"[i % 2], rng.sample(x, len(x))) for g, x in enumerate(groups) for i in range(7)]
    rows += [(1000 + i, "a", "a", rng.sample(range(5000), 20)) for i in range(50)]
    monkeypatch.setattr(simjoin, "verified", lambda *a: pytest.fail("tokens go to pairs"))
    with temporary(spark):
        found = simjoin.similar_pairs(spark.createDataFrame(rows, SCHEMA), 1.0, stored=True).collect()
    want = {(a, b, len(x), len(x), 1.0) for a, p, q, x in rows for b, r, s, y in rows if a < b and set(x) == set(y) and not p == q == r == s}
    assert sorted(map(tuple, found)) == sorted(want) and len(want) == 4 * 15
    assert written == [28]


def test_equal_sets_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(simjoin.F, "xxhash64", lambda *a: F.lit(7))
    rows = [(1, "a", "a", [1, 2]), (2, "b", "b", [2, 1]), (3, "b", "b", [1, 3]), (4, "a", "a", [3, 1]), (5, "a", "a", [9])]
    with temporary(spark):
        found = simjoin.equal_pairs(spark.createDataFrame(rows, SCHEMA)).select("a", "b").collect()
    assert sorted(map(tuple, found)) == [(1, 2), (3, 4)]


@pytest.mark.parametrize("stored", [False, True])
def test_sets_are_written_for_plausible_pairs_only(spark, monkeypatch, written, stored):
    """Sets in chance pairs are not written, and sets that are written already are not written again."""
    rng = random.Random(4)
    rows = [(i, "ab"[i % 2], "ab"[i % 2], sorted(rng.sample(range(2000), 60))) for i in range(200)]
    rows += [(1000 + i, "c", "c", sorted(rows[i][3][3:])) for i in range(12)]
    monkeypatch.setattr(simjoin, "CHEAP", 0)
    every = [(a, b) for a, *_ in rows for b, *_ in rows if a < b]
    with temporary(spark):
        sets = spark.createDataFrame(rows, SCHEMA)
        if stored:
            assert simjoin.similar_pairs(sets, 0.8, stored=True).count() == 12
        else:
            assert simjoin.verified(spark.createDataFrame(every, "a long, b long"), sets, 0.8).count() == 12
    assert len(written) == 1 and 24 <= written[0] <= 40


def test_hashes_of_many_sets_are_written_as_words_of_a_dictionary(spark):
    own = spark.range(0, 6000, 1, 1).select(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.xxhash64(F.floor(F.pow(F.pmod(F.xxhash64("id", i), F.lit(1 << 20)) / (1 << 20), 4) * 1_000_000))).alias("tokens"))  # frequent and rare ones
    size = lambda df: sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())
    with temporary(spark):
        plain, small = session.keep(own), session.keep(own, words=simjoin.WORD_BYTES)
        assert size(small) < 0.9 * size(plain)
        assert plain.exceptAll(small).isEmpty() and small.count() == 6000
