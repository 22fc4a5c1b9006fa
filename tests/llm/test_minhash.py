import random

import brute
import numpy as np
from pyspark.sql import functions as F

from echotrace.llm import minhash


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, base, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in base]


def corpus():
    rng = random.Random(5)
    rows, template = [], words(rng, 120)
    for i in range(220):  # copies around a template: links, chains and near misses
        rows.append((i, " ".join(edited(rng, template, rng.choice([0.005, 0.01, 0.02, 0.03, 0.05])))))
    passage = words(rng, 60)
    for i in range(300, 420):  # a shared passage and little else in common
        rows.append((i, " ".join(passage + words(rng, rng.randrange(5, 40)))))
    for i in range(500, 560):
        rows.append((i, " ".join(words(rng, rng.randrange(1, 9)))))
    rows += [(600 + i, "Same  text\there \n again") for i in range(30)] + [(631, "same text HERE again")]
    return rows + [(700, None), (701, ""), (702, " \t\n"), (703, "one"), (704, "ONE"), (705, "Übung macht"), (706, "übung macht")]


def test_components_equal_brute_force(spark):
    rows = corpus()
    for k in (4, 5):
        want = brute.near_duplicates(rows, k)
        found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 3, 20, 1000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        keep = a[: max(1, int(0.8 * len(a)))]
        both, size = len(keep) / len(a), 256
        close = np.mean(minhash.fast_sketch(a, size) == minhash.fast_sketch(keep, size))
        assert abs(close - both) < 0.16
        assert (minhash.fast_sketch(a, size) == minhash.fast_sketch(a[::-1].copy(), size)).all()


def test_odd_rows(spark):
    rows = [(1, "a b c d e", 7), (1, "a b c d e", 7), (None, "a b c d e", 7), (2, "a b c d e", None), (3, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int").withColumns({"rep": F.lit(1), "bands": F.lit("x")})
    found = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 4).collect())
    assert found == [(False, 1, 1, True), (False, 1, 1, True), (False, 2, 1, False), (False, 3, 3, True), (True, 0, None, True)]
    assert minhash.near_duplicates(docs.where("false"), 4).count() == 0
    kept = minhash.one_of_each(docs, 4)
    assert kept.columns == docs.columns and kept.count() == 4


def test_long_text(spark):
    text = " ".join(words(random.Random(2), 150_000))
    found = minhash.near_duplicates(spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string"), 5).collect()
    assert {r.component_id for r in found} == {1}


def test_bands_follow_the_threshold(spark):
    for percent in (*range(1, 101, 9), 50, 60, 69, 80):
        size, rows = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** (size // rows) <= 5e-8
    assert minhash.banding(80) == minhash.banding(95) == (128, 4)
    rows = []
    for i in range(0, 800, 2):  # pairs of 60 shingles each that share 40: exactly 50 %
        both, one, two = ([f"p{i}x{j}{s}" for j in range(n)] for s, n in (("a", 43), ("b", 20), ("c", 20)))
        rows += [(i, " ".join(both + one)), (i + 1, " ".join(both + two))]
    want = brute.near_duplicates(rows, 4, 50)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 50).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert sum(c != i for i, (_, c) in want.items()) == 400
