"""Copies that the latent space keeps little of."""

import random

from echotrace.llm import lsa

DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def words(rng, n, kinds):
    return [f"w{int(kinds * rng.random() ** 3)}" for _ in range(n)]


def found(spark, docs, items):
    rows = lsa.contaminated(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], DOC), spark.createDataFrame([(i, " ".join(w)) for i, w in items], ITEM))
    return {(r.doc_id, k) for r in rows.collect() for k in r.item_ids}


def planted(rng, body, passage):
    at = rng.randrange(len(body))
    return body[:at] + passage + body[at:]


def test_frequent_passages_and_rare_neighbours(spark):
    rng = random.Random(21)
    items = [(k, [f"{w}i{k}" if rng.random() < 0.3 else w for w in words(rng, n, 900)]) for k, n in enumerate((15, 17, 24, 33, 40, 15, 16, 18))]
    docs, want = [], set()
    for i in range(900):
        body = words(rng, rng.randrange(40, 200), 4000)
        if i % 3 == 0:  # a third of the documents hold the first passages
            body = planted(rng, body, items[i // 3 % 5][1] if i % 2 else items[0][1])
            want.add((i, i // 3 % 5 if i % 2 else 0))
        elif i % 30 == 1:  # next to words that no other document has
            k = 5 + i // 30 % 3
            body = [f"own{i}x{j}" for j in range(60)]
            body[25:25] = items[k][1]
            want.add((i, k))
        docs.append((i, body))
    assert found(spark, docs, items) == want


def test_long_passages(spark):
    rng = random.Random(22)
    items = [(k, words(rng, rng.randrange(400, 601), 3000)) for k in range(60)]
    docs = [(i, planted(rng, words(rng, rng.randrange(100, 600), 3000), items[i][1]) if i < 60 else words(rng, 500, 3000)) for i in range(120)]
    assert found(spark, docs, items) == {(i, i) for i in range(60)}


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(23)
    items = [(k, words(rng, rng.randrange(15, 60), 3000)) for k in range(100)]
    docs, want = [], set()
    for i in range(600):
        k = i % 100
        passage = [rng.choice(words(rng, 1, 3000)) if rng.random() < (0.2, 0.3)[i % 2] else w for w in items[k][1]]
        docs.append((i, planted(rng, words(rng, rng.randrange(60, 300), 3000), passage)))
        if lsa.common_subsequence(items[k][1], passage) >= lsa.COVERED * len(passage):
            want.add((i, k))
    got = found(spark, docs, items)
    assert want <= got
    assert all(k == i % 100 for i, k in got)


def test_short_passages_count_word_for_word(spark):
    docs = [(0, "a red fox came by".split()), (1, "a red dog and a fox".split()), (2, "fox red".split()), (3, "x red fox".split())]
    assert found(spark, docs + [(9 + i, [f"n{i}"]) for i in range(20)], [(1, "red fox".split())]) >= {(0, 1), (3, 1)}


def test_words_strewn_over_a_long_text_are_no_copy(spark):
    rng = random.Random(24)
    passage = [f"c{i}" for i in range(24)]
    strewn = [x for w in passage for x in (w, *(f"f{rng.randrange(50)}" for _ in range(30)))]
    docs = [(0, strewn), (1, strewn + passage)] + [(2 + i, [f"f{rng.randrange(50)}" for _ in range(200)]) for i in range(60)]
    assert found(spark, docs, [(1, passage)]) == {(1, 1)}


def test_blocks_of_passages_and_odd_rows(spark, monkeypatch):
    rng = random.Random(25)
    items = [(k, words(rng, 30, 2000)) for k in range(40)]
    docs = [(i, planted(rng, words(rng, 80, 2000), items[i % 40][1]) if i % 2 else words(rng, 80, 2000)) for i in range(200)]
    want = found(spark, docs, items)
    assert want >= {(i, i % 40) for i in range(1, 200, 2)}
    monkeypatch.setattr(lsa, "BLOCK_BYTES", 1000)
    assert found(spark, docs, items) == want
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs] + [(1, "another text"), (None, " ".join(items[0][1])), (None, None), (700, "a\0b " * 90_000)], DOC).withColumn("item_id", lsa.F.lit(1))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], ITEM)
    kept = lsa.clean(frame, bench)
    assert kept.columns == frame.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted([(False, i) for i in range(0, 200, 2)] + [(False, 1), (True, 0), (False, 700)])
