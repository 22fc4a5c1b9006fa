"""Scores of fitted models against plain restatements, on odd rows, and what a fit may look at."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrace.llm import langid, toxicity

LETTERS = re.compile(r"[^\W\d_]+")
#: Null, empty, without letters, mixed case, other scripts, very long, and repeated.
ODD = [None, "", " \n\t ", "12 !? _", "VILEST Words", "ŉandß İx", "日本語 テキスト", "the " * 200_000 + "zorkan", "same text", "same text"]


def busy(frame):
    return frame.withColumns({c: F.lit("x") for c in ("score", "words", "label_id", "place", "r", "x")})


def toxic_rows():
    rng = random.Random(31)
    plain = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st")]
    rows = []
    for i in range(700):
        words = [rng.choice(plain) for _ in range(rng.randrange(3, 50))]
        bad = rng.random() < 0.2
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["vilest", "zorkan", "zorkit", "zorkul", "mucky"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def plain_score(weights, bias, text):
    """The logistic of the bias and of the weights of all words and word starts of the text, each counted once."""
    held = set()
    for w in LETTERS.findall((text or "").lower()):
        held |= {w} | {w[:n] + "*" for n in (4, 5, 6, 7) if n < len(w)}
    return 1 / (1 + math.exp(-(bias + sum(weights.get(k, 0.0) for k in held))))


def test_toxicity_scores_equal_plain_restatement(spark):
    rows = toxic_rows()
    odd = [(5000 + i, t) for i, t in enumerate(ODD)] + [(None, "zorkan"), (3, rows[3][1])]
    docs = busy(spark.createDataFrame([(i, t) for i, t, _ in rows] + odd, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, ~langid.held_out(3, 1))
    assert model.weights
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in toxicity.score(docs, model).collect())
    want = sorted((i is None, i or 0, plain_score(model.weights, model.bias, t)) for i, t in [(i, t) for i, t, _ in rows] + odd)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-12)
    assert toxicity.score(docs.where("false"), model).count() == 0
    # labels of held-out rows are never looked at, and rows in another order give the same model
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in reversed(rows)], "doc_id long, toxic int")
    again = toxicity.fit(docs.repartition(5), flipped, ~langid.held_out(3, 1))
    assert again.weights == pytest.approx(model.weights) and again.bias == pytest.approx(model.bias)


def plain_language(model, text):
    """Family of the greatest chance, then votes of all pairs within it, from the shares of 1- to 3-grams of code points."""
    words = LETTERS.findall((text or "").lower())
    if not words:
        return "und", 0.0
    share = np.zeros(4096)
    for w in words:
        marked = f"^{w}$"
        for n in (1, 2, 3):
            for i in range(len(marked) - n + 1):
                share[zlib.crc32(marked[i : i + n].encode("utf-32-le")) % 4096] += 1
    chance = 1 / (1 + np.exp(-model.slope * (share / share.sum() @ model.weights + model.bias)))
    k = len(model.families)
    f = int(np.argmax(chance[:k]))
    inside = [i for i, lang in enumerate(model.langs) if langid.family(lang) == model.families[f]]
    votes = {i: sum(chance[k + j] if a == i else 1 - chance[k + j] for j, (a, b) in enumerate(model.pairs) if i in (a, b)) for i in inside}
    best = max(inside, key=lambda i: (votes[i], -i))
    return model.langs[best], float(chance[f] / chance[:k].sum() * (votes[best] / (len(inside) - 1) if len(inside) > 1 else 1))


def test_language_predictions_equal_plain_restatement(spark):
    rng = random.Random(32)
    made = {"en": ["the", "and", "wh", "ing"], "de": ["sch", "ung", "der", "ei"], "nl": ["ij", "het", "oor", "een"], "fr": ["eau", "les", "ez"], "es": ["cion", "el", "ado"], "ja": ["日本", "語の", "です"]}
    rows = []
    for i in range(500):
        lang = rng.choice(sorted(made))
        rows.append((i, " ".join("".join(rng.choice(made[lang]) for _ in range(rng.randrange(1, 3))) for _ in range(15)), lang if rng.random() < 0.9 else None))
    rows += [(5000 + i, t, None) for i, t in enumerate(ODD)] + [(None, "the thing", None), (3, rows[3][1], rows[3][2])]
    docs = busy(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = langid.fit(docs, ~langid.held_out(4, 2))
    assert len(model.pairs) == 4 and len(model.families) == 3
    got = sorted((r.doc_id is None, r.doc_id or 0, r.lang_pred, r.score) for r in langid.identify(docs, model).collect())
    want = sorted((i is None, i or 0, *plain_language(model, t)) for i, t, _ in rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-6)
    assert langid.identify(docs.where("false"), model).count() == 0
    # languages of held-out rows are never looked at
    hidden = docs.withColumn("lang", F.when(langid.held_out(4, 2), F.lit("es")).otherwise(F.col("lang"))).repartition(5)
    again = langid.fit(hidden, ~langid.held_out(4, 2))
    assert again.langs == model.langs and np.allclose(again.weights, model.weights) and np.allclose(again.bias, model.bias)
