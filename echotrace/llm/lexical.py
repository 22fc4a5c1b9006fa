"""Ranked lexical search over a reordered, clustered index.

Documents are reordered by recursive graph bisection (Dhulipala et al., "Compressing graphs
and indexes with recursive graph bisection", 2016): a bounded sample of documents is halved
again and again so that the documents of a half share terms, by swapping documents between
the halves while that lowers the cost of the gaps between postings. Each halving leaves the
weights of its terms for either side, and every document of the table goes down the tree by
them. In that order documents are cut into clusters of bounded size, and a cluster's postings
are one row of the index, in document order, with the exact largest contribution of each of
its terms.

A query's bound for a cluster is the sum of its terms' largest contributions there. Clusters
are visited in the order of their bounds, a few at first and then more at a time, and a query
stops when no cluster left has a bound that reaches its k-th best score (Mackenzie, Petri and
Moffat, "Anytime ranking on document-ordered indexes", 2022). A bound that equals the k-th
best score does not stop it: such a cluster may hold a document of equal score and smaller
doc_id. So results are exact.

Queries are taken in blocks of bounded number and vocabulary, and an index holds the postings
of the terms of one block: a column-pruned index of all documents. What is sent to executors
is bounded by the block and by the depth of the tree, whatever the number of documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echotrace.llm.slices import lean, prepare
from echotrace.session import Scratch, cut, few_files

QUERIES, TERMS = 1024, 1 << 17  # most queries, and distinct terms, of a block (a query of more terms is a block of its own)
SAMPLE = 4096  # documents that the halvings are fitted on
DEPTH = 7  # halvings
SLOTS = 1 << 13  # term slots of the graph
SWAPS = 12  # rounds of swaps of a halving
CLUSTER_DOCS, CLUSTER_POSTINGS = 512, 1 << 17  # most documents, and about as many postings, of a cluster
FIRST, MORE = 8, 8  # clusters that a query visits at first; each later round visits so many times more

# Upper-case letters of ASCII become lower case; all other ASCII characters but letters and digits part terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[str]:
    return (text or "").encode().translate(_FOLD).decode().split(" ")


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts one after the other, and the number of the text that each stands in.

    Folding and parting change single ASCII bytes, so they are done on the column's buffer.
    """
    texts = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string())
    texts = pa.concat_arrays([pc.fill_null(texts, "")])
    _, offsets, data = texts.buffers()
    folded = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(_FOLD))
    plain = pa.LargeStringArray.from_buffers(len(texts), offsets, folded, None, 0, texts.offset)
    pieces = pc.split_pattern(plain, " ")
    owners = np.repeat(np.arange(len(texts)), pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
    flat = pieces.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), owners[full.to_numpy(zero_copy_only=False)]


def _lists(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list for each of `n` rows of the values whose row it is; `rows` ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _tokenised(docs: DataFrame, vocabulary) -> DataFrame:
    """`(doc_id, n, tids, tfs)` of all rows: the number of terms, and the terms of the vocabulary with their occurrences."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("tids", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(batches):
        known = pa.array(vocabulary.value, pa.large_string())
        for batch in batches:
            found, owners = _split(batch.column(1))
            rows = batch.num_rows
            n = np.bincount(owners, minlength=rows)
            coded = found.dictionary_encode()
            numbers = pc.fill_null(pc.index_in(coded.dictionary, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = numbers[coded.indices.to_numpy(zero_copy_only=False)] if len(found) else np.zeros(0, np.int64)
            held = at >= 0
            keys, tfs = np.unique(owners[held] * len(known) + at[held], return_counts=True)
            row = keys // max(1, len(known))
            lists = [_lists(keys % max(1, len(known)), row, rows, pa.int32()), _lists(tfs, row, rows, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], schema=schema)
            lean()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n long, tids array<int>, tfs array<int>")


class Bisection:
    """A tree of halvings over term slots: weights of the slots for the left side at each node, and the margin that parts the halves."""

    def __init__(self, depth: int = DEPTH, slots: int = SLOTS):
        self.depth, self.slots = depth, slots
        self.weights = np.zeros((1 << depth, slots), np.float32)
        self.margins = np.zeros(1 << depth, np.float32)

    def fit(self, docs: list[np.ndarray]) -> Bisection:
        own = [np.unique(d % self.slots) for d in docs if len(d)]
        self._halve(own, np.arange(len(own)), 1, 0)
        return self

    def _halve(self, docs: list[np.ndarray], members: np.ndarray, node: int, level: int) -> None:
        if level == self.depth or len(members) < 2:
            return
        flat = np.concatenate([docs[i] for i in members])
        starts = np.append(0, np.cumsum([len(docs[i]) for i in members]))[:-1]
        left = np.zeros(len(members), bool)
        left[: (len(members) + 1) // 2] = True
        lengths = np.diff(np.append(starts, len(flat)))
        cost = lambda d, n: d * np.log2(n / (d + 1))  # noqa: E731  bits of the gaps of a term with d postings among n documents
        for _ in range(SWAPS):
            on_left = np.repeat(left, lengths)
            dl, dr = (np.bincount(flat[x], minlength=self.slots).astype(np.float64) for x in (on_left, ~on_left))
            nl, nr = left.sum(), (~left).sum()
            now = cost(dl, nl) + cost(dr, nr)
            to_right, to_left = now - cost(np.maximum(dl - 1, 0), nl) - cost(dr + 1, nr), now - cost(dl + 1, nl) - cost(np.maximum(dr - 1, 0), nr)
            gains = np.add.reduceat(np.where(on_left, to_right[flat], to_left[flat]), starts)
            ls, rs = np.flatnonzero(left), np.flatnonzero(~left)
            ls, rs = ls[np.argsort(-gains[ls], kind="stable")], rs[np.argsort(-gains[rs], kind="stable")]
            pairs = min(len(ls), len(rs))
            swap = gains[ls[:pairs]] + gains[rs[:pairs]] > 0  # gains fall, so these are the first
            if not swap.any():
                break
            left[ls[:pairs][swap]], left[rs[:pairs][swap]] = False, True
        on_left = np.repeat(left, lengths)
        dl, dr = (np.bincount(flat[x], minlength=self.slots) for x in (on_left, ~on_left))
        self.weights[node] = np.log2((dl + 0.5) / (left.sum() + 1)) - np.log2((dr + 0.5) / ((~left).sum() + 1))
        # documents of the sample go by the weights, too, at the margin that halves them
        sums = np.add.reduceat(self.weights[node][flat], starts)
        self.margins[node] = np.median(sums)
        side = sums > self.margins[node]
        self._halve(docs, members[side], 2 * node, level + 1)
        self._halve(docs, members[~side], 2 * node + 1, level + 1)

    def leaves(self, tids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """The leaf, from 0, of each of `n` documents; `rows` is the document of each of `tids`."""
        node, slots = np.ones(n, np.int64), tids % self.slots
        for _ in range(self.depth):
            sums = np.bincount(rows, self.weights[node[rows], slots], n)
            node = 2 * node + (sums <= self.margins[node])
        return node - (1 << self.depth)


def _contributions(tokenised: DataFrame, weights, tree, total: int, length: int) -> DataFrame:
    """`(doc_id, leaf, sign, tids, parts)` of the documents that hold terms of the block; `parts` are the terms' contributions to a score."""
    schema = pa.schema([("doc_id", pa.int64()), ("leaf", pa.int32()), ("sign", pa.int64()), ("tids", pa.list_(pa.int32())), ("parts", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            tids, rows = batch.column(2).flatten().to_numpy().astype(np.int64), np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy())
            tfs = batch.column(3).flatten().to_numpy().astype(np.int64)
            m = 25 + 75 * batch.column(1).to_numpy() * total // max(1, length)
            parts = weights.value[tids] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[rows]))
            leaf = tree.value.leaves(tids, rows, batch.num_rows)
            with np.errstate(over="ignore"):
                sign = np.zeros(batch.num_rows, np.int64)
                np.add.at(sign, rows, (tids + 1) * (tids + 1) * 0x9E3779B97F4A7C1)  # equal sets stand together
            offsets = batch.column(2).offsets
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaf, pa.int32()), pa.array(sign), pa.ListArray.from_arrays(offsets, pa.array(tids, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(parts))], schema=schema)

    return tokenised.where("size(tids) > 0").mapInArrow(run, "doc_id long, leaf int, sign long, tids array<int>, parts array<long>")


_CLUSTER = pa.schema([
    ("cluster", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("tids", pa.list_(pa.int32())), ("tops", pa.list_(pa.int64())),
    ("starts", pa.list_(pa.int32())), ("places", pa.list_(pa.int16())), ("parts", pa.list_(pa.int64())),
])
_CLUSTER_DDL = "cluster long, doc_ids array<long>, tids array<int>, tops array<long>, starts array<int>, places array<smallint>, parts array<long>"


def _clusters(ordered: DataFrame, most: int) -> DataFrame:
    """The index: a row for each run of documents in the order of the partitions' rows.

    A cluster's documents are numbered by doc_id, nulls last, so that the order of places is
    the order of doc_ids. `starts` are where the postings of each of `tids` begin.
    """

    def cluster(number: int, ids: list, tids: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        lengths = [len(tids[i]) for i in order]
        t, p, places = np.concatenate([tids[i] for i in order]), np.concatenate([parts[i] for i in order]), np.repeat(np.arange(len(ids)), lengths)
        by = np.argsort(t, kind="stable")
        t, p, places = t[by], p[by], places[by]
        own, starts = np.unique(t, return_index=True)
        cells = ([number], [[ids[i] for i in order]], [own], [np.maximum.reduceat(p, starts)], [starts], [places], [p])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _CLUSTER)], schema=_CLUSTER)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        ids, tids, parts, held = [], [], [], 0
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            flat_t, flat_p = batch.column(1).values.to_numpy(), batch.column(2).values.to_numpy()
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                if ids and (len(ids) >= most or held >= CLUSTER_POSTINGS):
                    yield cluster(number, ids, tids, parts)
                    number, ids, tids, parts, held = number + 1, [], [], [], 0
                s = slice(offsets[i], offsets[i + 1])
                ids.append(doc_id), tids.append(flat_t[s].copy()), parts.append(flat_p[s].copy())
                held += offsets[i + 1] - offsets[i]
        if ids:
            yield cluster(number, ids, tids, parts)

    return ordered.select("doc_id", "tids", "parts").mapInArrow(run, _CLUSTER_DDL)


class Queries:
    """A block of queries as arrays: for each term of each query, its number and its occurrences there."""

    def __init__(self, texts: list[Counter], vocabulary: dict[str, int]):
        self.count = len(texts)
        self.size = len(vocabulary)
        self.tids = np.array([vocabulary[t] for c in texts for t in c], np.int64)
        self.times = np.array([n for c in texts for n in c.values()], np.int64)
        self.owner = np.repeat(np.arange(len(texts)), [len(c) for c in texts])

    def bounds(self, tids: np.ndarray, tops: np.ndarray) -> np.ndarray:
        dense = np.zeros(self.size, np.int64)
        dense[tids] = tops
        out = np.zeros(self.count, np.int64)
        np.add.at(out, self.owner, dense[self.tids] * self.times)
        return out

    def of(self, query: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(*np.searchsorted(self.owner, [query, query + 1]))
        return self.tids[s], self.times[s]


def _bounds(index: DataFrame, queries) -> DataFrame:
    """`(query, cluster, bound)` for bounds above 0; only the terms' largest contributions are read."""
    schema = pa.schema([("query", pa.int32()), ("cluster", pa.int64()), ("bound", pa.int64())])

    def run(batches):
        for batch in batches:
            for cluster, tids, tops in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                bound = queries.value.bounds(tids.values.to_numpy(), tops.values.to_numpy())
                some = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), cluster)), pa.array(bound[some])], schema=schema)

    return index.select("cluster", "tids", "tops").mapInArrow(run, "query int, cluster long, bound long")


def _visit(index: DataFrame, visits: DataFrame, queries, k: int) -> DataFrame:
    """`(query, doc_id, score)`: for each visit `(query, cluster)` the cluster's k best documents with a score above 0."""
    schema = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                asked, ids, tids, starts, places, parts = (batch.column(i)[r].values for i in range(6))
                tids, starts, places, parts = (x.to_numpy() for x in (tids, starts, places, parts))
                ends = np.append(starts[1:], len(places))
                which, at, score = [], [], []
                for q in asked.to_pylist():
                    own, times = queries.value.of(q)
                    i = np.searchsorted(tids, own)
                    hit = np.flatnonzero((i < len(tids)) & (tids[np.minimum(i, len(tids) - 1)] == own))
                    sums = np.zeros(len(ids), np.int64)
                    for j in hit:
                        s = slice(starts[i[j]], ends[i[j]])
                        sums[places[s]] += parts[s] * times[j]  # a term has a document once
                    best = np.argsort(-sums, kind="stable")[:k]
                    best = best[sums[best] > 0]
                    which.append(np.full(len(best), q)), at.append(best), score.append(sums[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(which), pa.int32()), ids.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(score))], schema=schema)

    asks = visits.groupBy("cluster").agg(F.collect_list("query").alias("asked"))  # at most a block of queries
    both = asks.join(index, "cluster").select("asked", "doc_ids", "tids", "starts", "places", "parts")
    return both.mapInArrow(run, "query int, doc_id long, score long")


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[Counter], dict[str, int]]]:
    """Blocks of queries: their item ids, their terms, and the numbers of all their terms."""
    ids, texts, vocabulary = [], [], {}
    for r in items.toLocalIterator():
        own = Counter(t for t in terms(r.text) if t)
        if ids and (len(ids) >= QUERIES or len(vocabulary.keys() | own.keys()) > TERMS):
            yield ids, texts, vocabulary
            ids, texts, vocabulary = [], [], {}
        for t in own:
            vocabulary.setdefault(t, len(vocabulary))
        ids.append(r.item_id), texts.append(own)
    if ids:
        yield ids, texts, vocabulary


def _search(docs: DataFrame, texts: list[Counter], vocabulary: dict[str, int], k: int, scratch: Scratch, name: str, depth: int, most: int) -> DataFrame:
    spark = docs.sparkSession
    sc, parts = spark.sparkContext, int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokenised = scratch.store(_tokenised(docs, sc.broadcast(list(vocabulary))), f"{name}-terms", narrow=False)
    row = tokenised.agg(F.count_if(F.col("n") > 0).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in tokenised.select(F.explode("tids").alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("df")).collect():  # at most the block's terms
        df[r.tid] = r.df
    weights = np.array([math.floor(1000 * math.log((2 * row.total + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    # texts that repeat many times would make the sample one text: a set of terms is drawn once
    sets = tokenised.where("size(tids) > 0").withColumn("h", F.xxhash64("tids"))
    some = F.broadcast(sets.select("h").distinct().orderBy("h").limit(SAMPLE))
    slots = F.array_distinct(F.transform("tids", lambda t: t % SLOTS))  # so a sampled document is bounded, too
    sample = [np.array(r.slots, np.int64) for r in sets.join(some, "h").groupBy("h").agg(F.first(slots).alias("slots")).collect()]
    tree = sc.broadcast(Bisection(depth).fit(sample))
    placed = scratch.store(_contributions(tokenised, sc.broadcast(weights), tree, row.total, row.length), f"{name}-parts", narrow=False)
    order = ("leaf", "sign", F.xxhash64("doc_id"))
    index = scratch.store(_clusters(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order), most), f"{name}-index", narrow=False)
    for done in ("terms", "parts"):
        scratch.remove(f"{name}-{done}")

    queries = sc.broadcast(Queries(texts, vocabulary))
    bounds = scratch.store(_bounds(index, queries), f"{name}-bounds", narrow=False)
    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "cluster")
    best, left, step, i = None, bounds, FIRST, 0
    while True:
        visits = scratch.store(left.withColumn("at", F.row_number().over(by_bound)).where(F.col("at") <= step).drop("at"), f"{name}-visits{i}", rows=len(texts) * step)
        found = _visit(index, visits, queries, k)
        found = found if best is None else found.unionByName(best)
        top = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = scratch.store(found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).drop("rank"), f"{name}-best{i}", rows=len(texts) * k)
        floor = best.groupBy("query").agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("floor"))
        floor = floor.select("query", F.when(F.col("held") == k, F.col("floor")).otherwise(1).alias("floor"))
        seen = visits.groupBy("query").agg(F.max_by(F.struct("bound", "cluster"), F.struct(-F.col("bound"), "cluster")).alias("last"))  # the last one visited
        left = left.join(seen, "query").join(floor, "query", "left").where("(bound < last.bound or bound = last.bound and cluster > last.cluster) and bound >= coalesce(floor, 1)")
        left = left.select("query", "cluster", "bound")
        if left.isEmpty():
            return best
        step, i = step * MORE, i + 1


def search(docs: DataFrame, items: DataFrame, k: int = 10, depth: int = DEPTH, cluster_docs: int = CLUSTER_DOCS) -> DataFrame:
    """`(item_id, rank, doc_id, score)`: the `k` documents of the highest score above 0 for each row of `items (item_id, text)`.

    Terms, weights and scores are those of the contract of op 12: whole numbers, a falling
    score, ties by ascending `doc_id`. Other columns of either table are ignored, whatever
    their names. A null or empty text, or one without terms, has no score; a document of
    that kind is not counted in N. Each row of `docs` is a document of its own, also where
    ids repeat; one with a null `doc_id` counts and ranks like any other, after the ids of
    its score. Rows of `items` that are equal are one query; rows that share an `item_id`
    with different texts are ranked one by one under that id. Empty tables give an empty
    result. Documents of any length are read whole.
    """
    spark = docs.sparkSession
    prepare(spark)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().orderBy("item_id", "text")
    out = None
    with Scratch(spark, "lexical") as scratch:
        for b, (ids, texts, vocabulary) in enumerate(_blocks(asked)):
            if not vocabulary:
                continue
            best = _search(docs, texts, vocabulary, k, scratch, f"block{b}", depth, cluster_docs)
            named = spark.createDataFrame(pa.table({"query": pa.array(range(len(ids)), pa.int32()), "item_id": pa.array(ids, pa.int64())}))
            ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
            found = cut(ranked.join(named, "query").select("item_id", "rank", "doc_id", "score"), rows=len(ids) * k)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return few_files(out, rows=1) if len(out.inputFiles()) > 64 else out
