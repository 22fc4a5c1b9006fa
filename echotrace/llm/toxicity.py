"""Toxicity scores by weak supervision.

Voters come from labelled training rows: lexicon words and word-start patterns that stand
in toxic documents and hardly in others, and a voter that votes clean where all of that
is missing. A generative label model estimates by expectation-maximisation, with the given
label as one more and fallible voter, how each voter and the given label vote on toxic and
on clean documents, and from the residuals how voters correlate; a voter's evidence is
shared with those it correlates with. A logistic regression is trained on the posterior
labels and scores every document; its features are all words and word starts that stand
in `SUPPORT` toxic documents of the sample, and clearly more often there than in others,
whether or not they are voters.

Everything is fitted on the driver, on at most `sample` labelled documents, a third of
them toxic, those of the smallest hash of doc_id. Only distinct words of their texts are
gathered.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrace.llm.linear import fit_logistic
from echotrace.llm.slices import lean, prepare, record_batch, text_slices

SAMPLE = 6000
MEMO = 200_000
STARTS = (4, 5, 6, 7)
SUPPORT = 3  # toxic documents that a feature of the classifier stands in, counting copies once
FIRST_TRUST, LEAST_TRUST, MOST_TRUST = 0.95, 0.8, 0.99  # accuracy of the given label: where its estimate starts, and its bounds
RIDGE = 1.0
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def marks(word: str) -> tuple[str, ...]:
    """The features of a word: itself, and its starts with a star."""
    return (word, *(word[:n] + "*" for n in STARTS if len(word) > n))


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior probability of label 1 for rows of votes in -1 (clean), 0 (abstains), 1 (toxic).

    `start` has the given labels, one more voter that never abstains; its accuracy on each
    label is estimated like any other's, within bounds, so that evidence that stands alone in its
    documents does not fade. An abstaining voter says nothing. Rates carry half a vote of
    prior each, and a voter is taken to be no worse than chance.
    """
    n, m = votes.shape
    said = np.stack([votes == -1, votes == 1], axis=2).astype(np.float64)
    post = np.where(start > 0.5, FIRST_TRUST, 1 - FIRST_TRUST)
    for _ in range(rounds):
        on = (np.einsum("i,ijv->jv", post, said) + 0.5) / (post.sum() + 1)
        off = (np.einsum("i,ijv->jv", 1 - post, said) + 0.5) / ((1 - post).sum() + 1)
        right_on = np.clip(((post * start).sum() + FIRST_TRUST) / (post.sum() + 1), LEAST_TRUST, MOST_TRUST)
        right_off = np.clip((((1 - post) * (1 - start)).sum() + FIRST_TRUST) / ((1 - post).sum() + 1), LEAST_TRUST, MOST_TRUST)
        balance = float(np.clip(post.mean(), 1e-6, 1 - 1e-6))
        given = np.where(start > 0.5, np.log(right_on / (1 - right_off)), np.log((1 - right_on) / right_off))
        # what votes share beyond the label: correlations of their residuals
        rest = votes - post[:, None] * (on[:, 1] - on[:, 0]) - (1 - post)[:, None] * (off[:, 1] - off[:, 0])
        cov = rest.T @ rest / n
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(cov / np.outer(sd, sd), 0, 1)
        share = 1.0 / np.maximum(corr.sum(axis=1), 1.0)
        weight = np.log(on) - np.log(off)
        weight[:, 0], weight[:, 1] = np.minimum(weight[:, 0], 0), np.maximum(weight[:, 1], 0)
        evidence = np.einsum("ijv,jv->ij", said, weight) @ share
        new = 1 / (1 + np.exp(-np.clip(evidence + given + math.log(balance / (1 - balance)), -30, 30)))
        if np.abs(new - post).max() < 1e-4:
            return new
        post = new
    return post


@dataclass
class Model:
    """Weights of words and word starts."""

    weights: dict[str, float]
    bias: float
    seen: set[str] = field(default_factory=set)
    hits: dict[str, list[str]] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"seen": set(), "hits": {}}

    def score(self, text: str | None) -> float:
        words = words_of(text)
        fresh = words - self.seen
        if fresh:
            if len(self.seen) > MEMO:
                self.seen, self.hits, fresh = set(), {}, words
            for w in fresh:
                if known := [k for k in marks(w) if k in self.weights]:
                    self.hits[w] = known
            self.seen |= fresh
        found = words & self.hits.keys()
        held = {k for w in found for k in self.hits[w]}
        z = self.bias + math.fsum(self.weights[k] for k in held)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit(docs: DataFrame, labels: DataFrame, trains: Column, sample: int = SAMPLE) -> Model:
    """A model from the rows of `labels (doc_id, toxic)` where `trains` holds and toxic is 0 or 1."""
    prepare(docs.sparkSession)
    known = labels.where(trains & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("label_id is not null").groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Model({}, -5.0 if 1 not in counts else 5.0)
    want = {1: sample // 3, 0: sample - sample // 3}
    chance = F.when(F.col("toxic") == 1, F.lit(min(1.0, (1.5 * want[1] + 20) / counts[1]))).otherwise(F.lit(min(1.0, (1.5 * want[0] + 20) / counts[0])))
    place = F.pmod(F.xxhash64("label_id"), F.lit(1 << 40)) / float(1 << 40)
    some = known.withColumn("place", place).where(F.col("place") < chance)
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("toxic").orderBy("place", "label_id")))
    some = F.broadcast(some.where(F.col("r") <= F.when(F.col("toxic") == 1, want[1]).otherwise(want[0])).select("label_id", "toxic"))  # at most `sample` rows
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("words", pa.string())])

    def run(batches):
        for ids, toxic, texts in text_slices(batches, ("doc_id", "toxic", "text")):
            yield record_batch(schema, doc_id=ids, toxic=toxic, words=[" ".join(sorted(words_of(t))) for t in texts])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = own.join(some, own["doc_id"] == some["label_id"]).select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, words string").collect()
    got.sort()
    return fit_model([r["words"] for r in got], np.array([r["toxic"] for r in got]))


def copy_groups(texts: list[str]) -> list[int]:
    """A group number for each text; texts that share two of a pair of word minima are copies."""
    first: dict[tuple, int] = {}
    parent = list(range(len(texts)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, text in enumerate(texts):
        words = [w.encode() for w in text.split()] or [b""]
        lows = [min(zlib.crc32(w, seed) for w in words) for seed in (1, 2, 3, 4)]
        for key in ((1, *lows[:2]), (2, *lows[2:])):
            parent[find(i)] = find(first.setdefault(key, i))
    return [find(i) for i in range(len(texts))]


def cover(held: list[set[str]], groups: list[int]) -> list[str]:
    """Features that explain toxic documents, greedily: each adds documents that none before it has.

    A group of copies counts once, so that what copies merely share explains little. Of
    features that add about as much, a whole word is better than a start and a longer start
    better than a shorter one.
    """
    where: dict[str, set[int]] = {}
    for features, g in zip(held, groups):
        for k in features:
            where.setdefault(k, set()).add(g)
    total = len(set(groups))
    least = max(2, math.ceil(0.004 * total))
    left = {k: set(v) for k, v in where.items() if len(v) >= least}
    chosen: list[str] = []
    while left:
        most = max(map(len, left.values()))
        if most < least:
            break
        best = min((k for k, v in left.items() if len(v) >= 0.97 * most), key=lambda k: (k.endswith("*"), -len(k), k))
        chosen.append(best)
        done = left.pop(best)
        left = {k: rest for k, v in left.items() if len(rest := v - done) >= least}
    # words and starts that are frequent enough to be no accident are voters too
    often = max(2 * least, math.ceil(0.02 * total))
    more = sorted((k for k, v in where.items() if len(v) >= often and k not in chosen), key=lambda k: (-len(where[k]), k))
    return chosen + more


def best_cut(z: np.ndarray, post: np.ndarray) -> float:
    """The middle of the widest gap in `z` among those that best part the soft labels."""
    order = np.argsort(z, kind="stable")
    z, post = z[order], post[order]
    cost = np.cumsum(post)[:-1] + np.cumsum((1 - post)[::-1])[::-1][1:]
    gap = np.diff(z)
    cost = np.where(gap > 1e-9, cost, np.inf)
    if not len(cost) or not np.isfinite(cost.min()):
        return 0.0
    near = np.flatnonzero(cost <= cost.min() + 0.5)
    i = near[np.argmax(gap[near])]
    return float((z[i] + z[i + 1]) / 2)


def fit_model(texts: list[str], toxic: np.ndarray) -> Model:
    """A model from texts of distinct words separated by spaces, and their labels."""
    n_on, n_off = int((toxic == 1).sum()), int((toxic == 0).sum())
    if not n_on or not n_off:
        return Model({}, -5.0 if not n_on else 5.0)
    features = lambda text: {k for w in text.split() for k in marks(w)}
    on: Counter[str] = Counter()
    for text, y in zip(texts, toxic):
        if y:
            on.update(features(text))
    least = 2 if n_on < 200 else 3
    off = Counter({k: 0 for k, c in on.items() if c >= least})
    for text, y in zip(texts, toxic):
        if not y:
            off.update(features(text) & off.keys())
    # how much more often than in clean documents, both smoothed by half a document
    odds = {k: ((on[k] + 0.5) / (n_on + 1)) / ((c + 0.5) / (n_off + 1)) for k, c in off.items()}
    names = sorted(odds)
    number = {k: i for i, k in enumerate(names)}
    held = [np.array(sorted(number[k] for k in features(t) & odds.keys()), np.int32) for t in texts]  # the features of each text, taken once
    strong = np.array([odds[k] >= 5 and on[k] >= 4 * off[k] for k in names], bool)
    toxic_rows = np.flatnonzero(toxic == 1).tolist()
    groups = copy_groups([texts[i] for i in toxic_rows])
    chosen = cover([{names[j] for j in held[i][strong[held[i]]].tolist()} for i in toxic_rows], groups)
    if not chosen:
        return Model({}, math.log(n_on / (n_on + n_off)) - 3)
    column = np.full(len(names), -1, np.int64)
    column[[number[k] for k in chosen]] = np.arange(len(chosen))
    votes = np.zeros((len(texts), len(chosen) + 1))
    for i, own in enumerate(held):
        voted = column[own]
        votes[i, voted[voted >= 0]] = 1
        votes[i, -1] = -(not (voted >= 0).any())
    post = label_model(votes, toxic.astype(np.float64))
    where: dict[int, set[int]] = {}
    for i, g in zip(toxic_rows, groups):
        for j in held[i].tolist():
            where.setdefault(j, set()).add(g)
    used = [j for j, g in sorted(where.items()) if len(g) >= SUPPORT and odds[names[j]] >= 2] or [number[k] for k in chosen]
    column = np.full(len(names), -1, np.int64)
    column[used] = np.arange(len(used))
    rows = [at[at >= 0] for at in (column[own] for own in held)]
    w, b = fit_logistic(rows, post, len(used), RIDGE)
    b += 0.4 - best_cut(np.array([b + w[r].sum() for r in rows]), post)
    return Model({names[j]: float(x) for j, x in zip(used, w.tolist()) if abs(x) > 1e-6}, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`(doc_id, score)`, one row per row of `docs (doc_id, text, ...)`; a higher score is likelier toxic.

    A null or empty text has the score of a text with no evidence. Null and repeated ids
    are scored like any other row. Only the text is looked at.
    """
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each feature of the sample's bounded number of texts that has the support

    def run(batches):
        for ids, texts in text_slices(batches):
            yield record_batch(schema, doc_id=ids, score=[sent.value.score(t) for t in texts])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double")
