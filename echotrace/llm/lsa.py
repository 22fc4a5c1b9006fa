"""Benchmark decontamination by latent semantic retrieval.

Terms are the words of the benchmark, with inverse document frequencies over all
documents; any other word weighs as the mean term. The latent space comes from a
distributed randomised singular value decomposition of the TF-IDF matrix of the benchmark
passages: executors multiply their rows of the matrix by a random test matrix and back,
partial products are summed by blocks of terms, and the driver orthonormalises a matrix
of fixed size (Halko, Martinsson and Tropp, 2011). Overlapping windows of every document
are folded in, and window and passage of sufficient cosine are a candidate. Beside them,
whatever the cosine, stands an exact filter: text that covers enough of a passage holds
several of its rarest words close together, so the places of those words give every
candidate that the rules below can accept in a run of up to `SPAN` times the passage's
length, whatever that length is.

A candidate counts if in some such run the longest common subsequence of words covers
enough of the passage; a looser one, a paraphrase, also needs the passage's answer: most
of the rare words of its last sentence, and most of its weight, must stand in the run.
Common words strewn over a long document are no copy, as a run is bounded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.llm.slices import Vocabulary, kept_rows, lean, prepare, record_batch, text_slices

RANK = 64
SLICE = 1_000_000  # bytes of texts searched at once
CHUNK = 16  # words; a window is two chunks, and windows overlap by one
BLOCK_BYTES = 8 << 20  # of benchmark text sent out at once
COSINE = 0.3  # or less, for a passage that the latent space keeps little of
COVERED = 0.6  # share of the passage's words in the common subsequence
LOOSE, ANSWER = 0.4, 0.75
SHORT = 8  # words; a passage of fewer counts only as a whole
SPAN = 2  # passage lengths that the words of a copy lie within; 1 for a short passage
SENTENCE = re.compile(r"(?<=[.!?。？！])\s+|\n+")
TERM_BLOCK = 1024

words_of = Vocabulary.split


def _texts(table: DataFrame, key: str) -> DataFrame:
    return table.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def vocabulary(passages: DataFrame) -> Vocabulary:
    """The distinct words of the passages: as many as the benchmark has, whatever the documents."""
    schema = pa.schema([("term", pa.string())])

    def run(batches):
        for _, texts in text_slices(batches):
            yield record_batch(schema, term=sorted(set().union(*map(words_of, texts))))

    found = passages.mapInArrow(run, "term string").distinct().toArrow().column("term").to_pylist()
    return Vocabulary(sorted(found))


def inverse_frequencies(docs: DataFrame, terms: Vocabulary) -> np.ndarray:
    """The inverse document frequency of every term over all rows of `docs`, and at the end the mean one, for other words."""
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64())])
    sent, n = docs.sparkSession.sparkContext.broadcast(terms), len(terms.words)

    def run(batches):
        df = np.zeros(n + 1, np.int64)
        for _, texts in text_slices(batches, chars=SLICE):
            row, sizes = sent.value.numbers(texts)
            known = np.flatnonzero(row < n)
            own = np.repeat(np.arange(len(texts)) * n, sizes)[known] + row[known]
            # a term counts once, however often a text names it
            if len(texts) * n <= 1 << 23:
                held = np.zeros(len(texts) * n, bool)
                held[own] = True
                df[:n] += np.count_nonzero(held.reshape(-1, n), axis=0)
            else:
                df[:n] += np.bincount(np.unique(own) % n, minlength=n)
            df[n] += len(texts)
        held = np.flatnonzero(df)
        yield record_batch(schema, term=held, df=df[held])

    found = _texts(docs, "doc_id").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row a term
    df = np.zeros(n + 1)
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    idf = np.log((df[n] + 1) / (df[:n] + 1)) + 0.01
    return np.append(idf, idf.mean()).astype(np.float32)


def _weights(words: list[str], terms: Vocabulary, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a passage and their unit-length weights."""
    own, counts = np.unique(np.array([terms.number[w] for w in words], np.int64), return_counts=True)
    w = counts * idf[own].astype(np.float64)
    return own, w / max(np.sqrt((w * w).sum()), 1e-12)


def latent_space(passages: DataFrame, terms: Vocabulary, idf: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """An orthonormal basis (terms x rank) of the leading right singular vectors of the passages."""
    sent = passages.sparkSession.sparkContext.broadcast((terms, idf))
    n = len(terms.words)
    rank = max(1, min(rank, n))
    schema = pa.schema([("block", pa.int32()), ("part", pa.binary())])

    def products(basis):
        def run(batches):
            terms, idf = sent.value
            q = np.random.default_rng(seed).standard_normal((n, rank)) if basis is None else basis.value
            out = np.zeros((n if basis is None else rank, rank))
            for _, texts in text_slices(batches):
                for text in texts:
                    own, w = _weights(words_of(text), terms, idf)
                    if len(own):
                        row = w @ q[own]
                        if basis is None:
                            out[own] += w[:, None] * row
                        else:
                            out += row[:, None] * row
            for i in range(0, len(out), TERM_BLOCK):
                yield record_batch(schema, block=[i], part=[out[i : i + TERM_BLOCK].tobytes()])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(p, np.float64) for p in table.column("part").to_pylist())
            return pa.table({"block": [table.column("block")[0].as_py()], "part": [total.tobytes()]}, schema=schema)

        made = passages.mapInArrow(run, "block int, part binary").groupBy("block").applyInArrow(add, "block int, part binary")
        return np.frombuffer(b"".join(r["part"] for r in sorted(made.collect())), np.float64).reshape(-1, rank)  # of the size of the basis

    q, _ = np.linalg.qr(products(None))
    value, vector = np.linalg.eigh(products(passages.sparkSession.sparkContext.broadcast(q)))
    keep = value > 1e-9 * max(value.max(initial=0), 1e-300)
    return (q @ vector[:, keep]).astype(np.float32)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit for each place of `a` (Hyyrö, 2004)."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := at.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@dataclass
class Passages:
    """Benchmark passages to search for; words are numbers of `terms`."""

    terms: Vocabulary
    ids: list[int]
    words: list[list[int]]
    answers: list[set[int]]
    vectors: np.ndarray
    least: np.ndarray  # the cosine that makes a candidate
    idf: np.ndarray  # of each term, and at the end of any other word
    folded: np.ndarray  # idf times basis, and a last row of zeros
    near: np.ndarray  # the rare words of a passage that a copy of it holds at least
    span: np.ndarray  # the run of words that holds them
    begin: np.ndarray  # of a term's passages in `rare`
    rare: np.ndarray  # the passages that a term is a rare word of

    def verdict(self, item: int, segment: list[int]) -> float:
        """The covered share of the passage if the segment holds it, else 0."""
        words, held = self.words[item], set(segment)
        if sum(map(held.__contains__, words)) < LOOSE * len(words):
            return 0.0
        share = common_subsequence(words, segment) / len(words)
        if len(words) < SHORT:
            return share if share == 1 else 0.0
        if share >= COVERED:
            return share
        if share < LOOSE:
            return 0.0
        weight = self.idf[words]
        inside = np.array([w in held for w in words])
        answer = self.answers[item]
        found = weight[inside].sum() >= COVERED * weight.sum() and len(answer & held) >= ANSWER * len(answer)
        return share if found else 0.0

    def best_run(self, item: int, region: list[int]) -> float:
        """The best verdict on a run of the region: of `span` words, and `2 * CHUNK` more between steps of as many; a short passage goes word by word."""
        best = self.verdict(item, region)
        step = 2 * CHUNK if len(self.words[item]) >= SHORT else 1
        run = int(self.span[item]) + (step if step > 1 else 0)
        if best and len(region) > run:
            best = max(self.verdict(item, region[i : i + run]) for i in range(0, len(region) - run + step, step))
        return best


def rare_words(words: list[int], idf: np.ndarray) -> tuple[set[int], int]:
    """The rarest words of a passage, and how many places of a run must hold one of them if the run holds the passage.

    A run that covers `need` of n words misses at most n - need of them, so it holds m of any
    n - need + m. A run that covers `COVERED` of the weight misses less than the rest of it,
    so of words that weigh more than the rest and the m - 1 heaviest it holds m.
    """
    n = len(words)
    need = n if n < SHORT else int(np.ceil(COVERED * n - 1e-9))
    m = min(need, max(2, n // 8))
    ordered = sorted(words, key=lambda w: (-idf[w], w))
    take = n - need + m
    if n >= SHORT:
        weight = idf[ordered].astype(np.float64)
        each: dict[int, float] = {}
        for w, x in zip(ordered, weight.tolist()):
            each[w] = each.get(w, 0.0) + x
        heaviest = sum(sorted(each.values(), reverse=True)[: m - 1])
        enough = (1 - COVERED + 1e-4) * weight.sum() + heaviest
        take = max(take, int(np.searchsorted(np.cumsum(weight), enough, side="right")) + 1)
    return set(ordered[:take]), m


def passages_of(rows: list[tuple[int, str]], all_terms: Vocabulary, all_idf: np.ndarray, basis: np.ndarray) -> Passages:
    """The passages `(item_id, text)`, with the terms that they have themselves."""
    rows = [(i, text, words) for i, text in rows if (words := words_of(text))]
    terms = Vocabulary(sorted(set().union(*(words for _, _, words in rows))))
    of = np.array([all_terms.number[w] for w in terms.words], np.int64)
    idf, own_basis = np.append(all_idf[of], all_idf[-1]), basis[of]
    ids, numbers, answers, vectors, rare, near = [], [], [], [], [], []
    for item_id, text, words in rows:
        w = [terms.number[x] for x in words]
        last = [s for s in SENTENCE.split(text.strip()) if words_of(s)][-1]
        own = sorted({terms.number[x] for x in words_of(last)}, key=lambda x: (-idf[x], x))
        held, weight = _weights(words, terms, idf)
        ids.append(item_id)
        numbers.append(w)
        answers.append(set(own[: max(1, (len(own) + 1) // 2)]))
        vectors.append(weight @ own_basis[held])
        some, m = rare_words(w, idf)
        rare += [(t, len(near)) for t in some]
        near.append(m)
    v = np.array(vectors, np.float32).reshape(len(ids), basis.shape[1])
    folded = np.concatenate([idf[:-1, None] * own_basis, np.zeros((1, basis.shape[1]), np.float32)]).astype(np.float32)
    rare_term, rare_item = np.array(sorted(rare), np.int64).reshape(-1, 2).T
    begin = np.searchsorted(rare_term, np.arange(len(terms.words) + 2))
    span = np.array([len(w) * (SPAN if len(w) >= SHORT else 1) for w in numbers], np.int64)
    least = np.minimum(COSINE, 0.45 * (v * v).sum(axis=1))
    return Passages(terms, ids, numbers, answers, v, least, idf, folded, np.array(near, np.int64), span, begin, rare_item.copy())


Regions = list[tuple[int, int, int, int]]


def copies(row: np.ndarray, sizes: np.ndarray, known: Passages) -> Regions:
    """`(text, passage, from, to)` where a run of the passage's `span` of words can hold it, by its rarest words."""
    many = known.begin[row + 1] - known.begin[row]
    at = np.flatnonzero(many)
    many = many[at]
    place = np.repeat(at, many)
    item = known.rare[np.repeat(known.begin[row[at]] - np.cumsum(many) + many, many) + np.arange(len(place))]
    order = np.argsort(item * np.int64(len(row)) + place)
    place, item = place[order], item[order]
    last = np.arange(len(place)) + known.near[item] - 1
    inside = np.flatnonzero(last < len(place))
    last = last[inside]
    inside, last = (x[(item[inside] == item[last]) & (place[last] - place[inside] < known.span[item[inside]])] for x in (inside, last))
    ends = np.cumsum(sizes)
    owner = np.searchsorted(ends, place[inside], side="right")
    same = place[last] < ends[owner]
    owner, item, first, end = owner[same], item[inside][same], place[inside][same], place[last][same]
    start, span = (ends - sizes)[owner], known.span[item]
    return list(zip(owner.tolist(), item.tolist(), np.maximum(0, end - start - span + 1).tolist(), (first - start + span).tolist()))


def similar(row: np.ndarray, sizes: np.ndarray, known: Passages) -> Regions:
    """`(text, passage, from, to)` around windows whose cosine with the passage suffices."""
    chunks = -(-sizes // CHUNK)
    owner = np.repeat(np.arange(len(sizes)), chunks)  # the text of each chunk
    place = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    starts = np.repeat(np.cumsum(sizes) - sizes, chunks) + place * CHUNK
    follows = np.append(owner[1:] == owner[:-1], False)  # the next chunk is of the same text

    def windows(x: np.ndarray) -> np.ndarray:
        out = x.copy()
        out[follows] += x[1:][follows[:-1]]
        return out

    other = len(known.folded) - 1
    square = known.idf**2
    norm = np.maximum(windows(np.add.reduceat(square[row], starts)), 1e-12)
    # a window's cosine with any passage is at most the share of its length on terms of the passages
    square[other] = 0
    bound = np.sqrt(windows(np.add.reduceat(square[row], starts)) / norm)
    near = np.flatnonzero(bound >= known.least.min())
    if not len(near):
        return []
    need = np.zeros(len(owner) + 1, bool)
    need[near] = True
    need[near[follows[near]] + 1] = True
    chosen = np.flatnonzero(need[:-1])
    # the words of a chunk side by side; a chunk's missing words are the zero row
    ends = np.append(starts[1:], len(row))[chosen]
    at = starts[chosen, None] + np.arange(CHUNK)
    own = np.where(at < ends[:, None], row[np.minimum(at, len(row) - 1)], other)
    sums = np.zeros((len(owner) + 1, known.folded.shape[1]), np.float32)
    for i in range(0, len(chosen), 512):
        sums[chosen[i : i + 512]] = known.folded[own[i : i + 512]].sum(axis=1)
    two = sums[near] + np.where(follows[near, None], sums[near + 1], 0)
    two /= np.sqrt(norm[near])[:, None]
    rows, items = np.nonzero(two @ known.vectors.T >= known.least)
    rows = near[rows]
    low, span = place[rows] * CHUNK, known.span[items]
    return list(zip(owner[rows].tolist(), items.tolist(), np.maximum(0, low - span).tolist(), (low + 2 * CHUNK + span).tolist()))


def search(texts: list[str | None], known: Passages) -> list[list[tuple[int, float]]]:
    """For each text, the passages it holds as (number, covered share)."""
    hits: list[list[tuple[int, float]]] = [[] for _ in texts]
    if not known.ids:
        return hits
    row, sizes = known.terms.numbers(texts)
    if not len(row):
        return hits
    regions = sorted(copies(row, sizes, known) + similar(row, sizes, known))
    starts = np.cumsum(sizes) - sizes
    best: dict[tuple[int, int], float] = {}
    i = 0
    while i < len(regions):
        text, item, low, high = regions[i]
        i += 1
        while i < len(regions) and regions[i][:2] == (text, item) and regions[i][2] <= high:  # regions that touch are one
            high = max(high, regions[i][3])
            i += 1
        start = int(starts[text])
        share = known.best_run(item, row[start + low : start + min(high, int(sizes[text]))].tolist())
        if share > best.get((text, item), 0.0):
            best[text, item] = share
    for (text, item), share in best.items():
        hits[text].append((item, share))
    return hits


def _blocks(docs: DataFrame, benchmark: DataFrame):
    """Broadcast blocks of passages, of `BLOCK_BYTES` of text each or about that; none if the benchmark has no words."""
    spark = docs.sparkSession
    items = _texts(benchmark, "item_id").where("doc_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    terms = vocabulary(items) if size else Vocabulary([])
    if not terms.words:
        return []
    idf = inverse_frequencies(docs, terms)
    basis = latent_space(items, terms, idf)
    slices = -(-size // BLOCK_BYTES)
    blocks = []
    for i in range(slices):
        some = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)) == i) if slices > 1 else items
        rows = sorted((r["doc_id"], r["text"]) for r in some.toLocalIterator())
        blocks.append(spark.sparkContext.broadcast(passages_of(rows, terms, idf, basis)))
    return blocks


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`(doc_id, contaminated, n_items, item_ids, best_item, best_share)` of the documents that hold a passage.

    `docs` has doc_id and text, `benchmark` item_id and text; other columns are ignored.
    There is a row for each row of `docs` that holds a passage. Null and empty texts hold
    none and, on the benchmark side, are none. Rows with a null doc_id are searched like
    others and returned with a null id. Ties for the best passage go to the smaller item_id.
    All blocks of passages are searched in one pass over the documents.
    """
    spark = docs.sparkSession
    prepare(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("contaminated", pa.bool_()), ("n_items", pa.int64()), ("item_ids", pa.list_(pa.int64())), ("best_item", pa.int64()), ("best_share", pa.float64())])
    ddl = "doc_id long, contaminated boolean, n_items long, item_ids array<long>, best_item long, best_share double"
    blocks = _blocks(docs, benchmark)
    if not blocks:
        return spark.createDataFrame([], ddl)

    def run(batches):
        for ids, texts in text_slices(batches, chars=SLICE):
            held: list[list[tuple[float, int]]] = [[] for _ in texts]
            for sent in blocks:
                for own, hits in zip(held, search(texts, sent.value)):
                    own += [(-share, sent.value.ids[k]) for k, share in hits]
            out = {name: [] for name in schema.names}
            for doc_id, own in zip(ids, held):
                if own:
                    ranked = sorted({k for _, k in own})
                    for name, value in zip(schema.names, (doc_id, True, len(ranked), ranked, min(own)[1], -min(own)[0])):
                        out[name].append(value)
            yield record_batch(schema, **out)
        lean()

    return _texts(docs, "doc_id").mapInArrow(run, ddl)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no passage of `benchmark`, as they are."""
    prepare(docs.sparkSession)
    blocks = _blocks(docs, benchmark)

    def keeps(texts):
        flags = [True] * len(texts)
        for sent in blocks:
            flags = [ok and not hits for ok, hits in zip(flags, search(texts, sent.value))]
        return flags

    return kept_rows(docs, keeps) if blocks else docs
