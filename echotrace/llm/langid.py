"""Language identification by hierarchical discrimination.

A first set of linear support vector machines tells the language family of a text; within
a family, one machine for each pair of languages votes, weighted by margin. Features are
the shares of hashed 1- to 3-grams of the code points of words, so a text's margins are the
mean over its words of the margins of each word, and a word is scored once and then
looked up. The whole text counts.

The machines are fitted on the driver on at most `sample` documents, those of the
smallest hash of (doc_id) among the training rows, an equal share for each language.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrace.llm.linear import fit_slope, fit_svm
from echotrace.llm.slices import kept_rows, lean, prepare, record_batch, text_slices

DIMS = 4096
SAMPLE = 2000
MEMO = 150_000
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"

# Families of ISO 639-1 codes. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "turkic": "az kk ky tk tr tt ug uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
    "sinitic": "yue zh",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


def word_features(word: str) -> list[int]:
    """Numbers of the hashed 1- to 3-grams of code points of a lower-cased word with its ends marked."""
    w = f"^{word}$".encode("utf-32-le", "surrogatepass")
    return [zlib.crc32(w[i : i + n]) % DIMS for n in (4, 8, 12) for i in range(0, len(w) - n + 1, 4)]


def text_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def profile(text: str | None) -> np.ndarray:
    """The share of every feature in a text; all zero if it has no letters."""
    counts = np.zeros(DIMS, np.float32)
    cache: dict[str, list[int]] = {}
    ids: list[int] = []
    for w in text_words(text):
        f = cache.get(w)
        if f is None:
            f = cache[w] = word_features(w)
        ids += f
    if ids:
        counts = np.bincount(ids, minlength=DIMS).astype(np.float32) / len(ids)
    return counts


@dataclass
class Model:
    """Projections of features to margins: one a family, then one for each pair within a family."""

    langs: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # DIMS x margins
    bias: np.ndarray
    slope: np.ndarray
    rows: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.float64))
    memo: dict[str, int] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"rows": np.empty((0, 0)), "memo": {}}

    def _learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.memo]
        if len(self.memo) + len(fresh) > len(self.rows):
            self.memo, fresh = {}, list(words)
            self.rows = np.zeros((max(MEMO, len(fresh)), self.weights.shape[1] + 1))
        if fresh:
            ids = [word_features(w) for w in fresh]
            lens = np.array([len(i) for i in ids])
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            sums = np.add.reduceat(self.weights[np.concatenate(ids)], starts, axis=0)
            base = len(self.memo)
            self.rows[base : base + len(fresh)] = np.column_stack([sums, lens])
            self.memo.update(zip(fresh, range(base, base + len(fresh))))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and its score of every text; `und` and 0 where there are no letters."""
        split = [text_words(t) for t in texts]
        self._learn(set().union(*split))
        out = []
        for words in split:
            if not words or not self.langs:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.rows[np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))].sum(axis=0)
            out.append(self.decide(total[:-1] / total[-1]))
        return out

    def decide(self, mean: np.ndarray) -> tuple[str, float]:
        chance = 1 / (1 + np.exp(-np.clip(self.slope * (mean + self.bias), -40, 40)))
        k = len(self.families)
        by_family = chance[:k] / max(chance[:k].sum(), 1e-12)
        best = int(np.argmax(by_family))
        inside = [i for i, lang in enumerate(self.langs) if family(lang) == self.families[best]]
        votes = dict.fromkeys(inside, 0.0)
        for j, (a, b) in enumerate(self.pairs):
            if a in votes:
                votes[a] += chance[k + j]
                votes[b] += 1 - chance[k + j]
        pick = max(inside, key=lambda i: votes[i])
        share = votes[pick] / max(1, len(inside) - 1) if len(inside) > 1 else 1.0
        return self.langs[pick], float(by_family[best] * share)


def fit(docs: DataFrame, trains: Column, sample: int = SAMPLE) -> Model:
    """A model learned from `text` and non-null `lang` of the rows of `docs` where `trains` holds."""
    prepare(docs.sparkSession)
    rows = docs.where(trains & F.col("lang").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not counts:
        return Model([], [], [], np.zeros((DIMS, 0)), np.zeros(0), np.zeros(0))
    share = max(20, sample // len(counts))
    # rows of the smallest hashes: the bound on the hash makes the sort input small at any size
    chance = F.lit(None)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * share / n + 20 / n))).otherwise(chance)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    some = rows.withColumn("place", place).where(F.col("place") < chance)
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))).where(F.col("r") <= share)
    schema = pa.schema([("lang", pa.string()), ("x", pa.binary())])

    def run(batches):
        for langs, texts in text_slices(batches, ("lang", "text")):
            yield record_batch(schema, lang=langs, x=[profile(t).astype("<f2").tobytes() for t in texts])

    table = some.select("lang", "text").mapInArrow(run, "lang string, x binary").toArrow()  # at most `sample` or 20 a language
    got = sorted((lang, x) for lang, x in zip(table.column("lang").to_pylist(), table.column("x").to_pylist()) if any(x))
    del table
    langs = sorted({lang for lang, _ in got})
    if not langs:
        return Model([], [], [], np.zeros((DIMS, 0)), np.zeros(0), np.zeros(0))
    y = np.array([langs.index(lang) for lang, _ in got])
    x = np.empty((len(got), DIMS + 1), np.float32)
    x[:, DIMS] = 1
    while got:
        x[len(got) - 1, :DIMS] = np.frombuffer(got.pop()[1], "<f2")
    model = fit_model(x, y, langs)
    del x
    lean()  # the driver gives the matrix back
    return model


def fit_model(x: np.ndarray, y: np.ndarray, langs: list[str]) -> Model:
    """A model from profiles, whose last column is one; `x` is standardised in place."""
    z, x = x, x[:, :-1]
    mean = x.mean(axis=0)
    std = np.array([np.sqrt(x[:, i : i + 256].var(axis=0) + 1e-8) for i in range(0, x.shape[1], 256)]).reshape(-1)
    x -= mean
    x /= std * np.float32(np.sqrt(x.shape[1]))
    families = sorted({family(lang) for lang in langs})
    of = np.array([families.index(family(lang)) for lang in langs])[y]
    tasks = [(np.ones(len(y), bool), np.where(of == f, 1.0, -1.0)) for f in range(len(families))]
    pairs = [(a, b) for a in range(len(langs)) for b in range(a + 1, len(langs)) if family(langs[a]) == family(langs[b])]
    tasks += [((y == a) | (y == b), np.where(y == a, 1.0, -1.0)) for a, b in pairs]
    weights, bias, slope = [], [], []
    for rows, label in tasks:
        label = label[rows]
        if len(set(label)) == 1:  # a single family: nothing to tell apart
            w, b, a = np.zeros(x.shape[1]), float(label[0]), 1.0
        else:
            own = z if rows.all() else z[rows]
            w, b = fit_svm(own, label, c=100.0)
            a = fit_slope(own[:, :-1] @ w + b, label)
        scaled = w / std / np.sqrt(x.shape[1])
        weights.append(scaled)
        bias.append(b - float(mean @ scaled))
        slope.append(a)
    return Model(langs, families, pairs, np.array(weights).T.copy(), np.array(bias), np.array(slope))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`(doc_id, lang_pred, score)`, one row per row of `docs (doc_id, text, ...)`.

    A null text, or one without letters, is `und` with score 0; so is everything if the
    model has seen no language. Null and repeated ids are predicted like any other row.
    Only the text is looked at.
    """
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x margins doubles, whatever the input

    def run(batches):
        for ids, texts in text_slices(batches):
            found = sent.value.predict(texts)
            yield record_batch(schema, doc_id=ids, lang_pred=[f[0] for f in found], score=[f[1] for f in found])
        lean()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of `docs` whose text is in a language with a score of at least `least`, as they are; `und` never is."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, lambda texts: [lang != UNKNOWN and score >= least for lang, score in sent.value.predict(texts)])


def held_out(residues: int, residue: int) -> Column:
    """crc32(doc_id as text) mod `residues` is `residue`; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % residues == residue, F.lit(False))
