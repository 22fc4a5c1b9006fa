"""Ranked search against a brute-force ranking, and the parts of the index."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrace.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    terms = lambda t: TERM.findall((t or "").translate(FOLD))
    own = [(i, Counter(terms(t))) for i, t in docs]
    total, length = sum(1 for _, c in own if c), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = set()
    for item, text in set(items):
        scores = []
        for doc_id, c in own:
            score = 0
            for t in terms(text):
                if c[t]:
                    m = 25 + 75 * c.total() * total // length
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out |= {(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)}
    return out


def corpus(spark, n=400):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(120)] + ["Été", "日本", "naïve", "DON", "x1"]
    text = lambda: rng.choice([" ", "-", "\n", "_"]).join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(1, 60)))
    rows = [(i, text()) for i in range(n)] + [(1000 + i, "the same copy w3 w100") for i in range(n // 2)]
    rows += [(None, "w3 w100 w119"), (7, "w3 again"), (7, "w3 again"), (5000, None), (5001, ""), (5002, " ,.!"), (5003, " ".join(rng.choices(words, k=20_000)))]
    items = [(i, text()) for i in range(30)] + [(40, "the same copy"), (41, None), (42, ""), (43, "unknown"), (44, "w100 W100 w119 w119"), (45, "Été ÉTÉ 日本"), (45, "Été ÉTÉ 日本"), (None, "w7")]
    clash = {c: F.lit("x") for c in ("n", "tids", "query", "score", "leaf", "cluster", "bound", "lang")}
    return rows, items, spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash), spark.createDataFrame(items, "item_id long, text string").withColumns(clash)


@pytest.mark.parametrize("k, cluster_docs", [(10, 512), (3, 7)])
def test_search_equals_brute_force(spark, monkeypatch, k, cluster_docs):
    rows, items, docs, asked = corpus(spark)
    monkeypatch.setattr(lexical, "FIRST", 2)
    monkeypatch.setattr(lexical, "MORE", 3)
    found = lexical.search(docs.repartition(5), asked, k, cluster_docs=cluster_docs).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == brute(rows, items, k)


def test_search_in_blocks_of_queries(spark, monkeypatch):
    rows, items, docs, asked = corpus(spark, 60)
    monkeypatch.setattr(lexical, "QUERIES", 11)
    assert {tuple(r) for r in lexical.search(docs, asked, 4).collect()} == brute(rows, items, 4)


def test_search_of_empty_tables(spark):
    rows, items, docs, asked = corpus(spark, 20)
    for d, q in ((docs.where("false"), asked), (docs, asked.where("false")), (docs.withColumn("text", F.lit(None).cast("string")), asked)):
        found = lexical.search(d, q)
        assert found.count() == 0 and dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_bisection_parts_topics():
    """Documents of two vocabularies, dealt alternately, end in different halves; the margin halves the sample."""
    rng = np.random.default_rng(1)
    docs = [rng.choice(200, 30, replace=False) + 200 * (i % 2) for i in range(200)]
    tree = lexical.Bisection(3, 512).fit(docs)
    leaf = tree.leaves(np.concatenate(docs), np.repeat(np.arange(200), 30), 200) >> 2
    assert len(set(leaf[::2])) == len(set(leaf[1::2])) == 1 and leaf[0] != leaf[1]


def test_few_clusters_are_visited(spark):
    """With topics apart and k documents that stand out, a query visits a small part of the clusters."""
    rng = random.Random(2)
    rows = [(i, " ".join(f"t{i % 16}x{rng.randrange(300)}" for _ in range(40))) for i in range(4000)]
    index_terms = {f"t{t}x{j}": n for n, (t, j) in enumerate((t, j) for t in range(16) for j in range(300))}
    texts = [Counter(rows[i][1].split()) for i in range(0, 4000, 500)]
    from echotrace.session import Scratch

    seen = []
    real = lexical._visit
    lexical._visit = lambda index, visits, *a: (seen.append((visits.count(), index.count())), real(index, visits, *a))[1]
    try:
        with Scratch(spark, "test") as scratch:
            lexical._search(spark.createDataFrame(rows, "doc_id long, text string"), texts, index_terms, 1, scratch, "t", 4, 50)
    finally:
        lexical._visit = real
    assert sum(v for v, _ in seen) <= 0.2 * len(texts) * seen[0][1]
