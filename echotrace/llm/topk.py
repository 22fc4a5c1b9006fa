"""Exact top-k inner products by no-random-access aggregation.

Vectors are cut into blocks. A block carries, for every dimension, the list of its
vectors sorted by their value there. Each list is read from both ends in step, from the
top for queries whose weight is positive and from the bottom for the others. After a
depth, what a query has read of a vector gives bounds of its score: a component not
yet read lies between the list's far end and the value where reading stands. Reading
stops for a query when no vector outside its candidates has an upper bound that reaches
the k-th best lower bound, over this block and the floor; the candidates' scores are then
resolved. (Fagin, Lotem and Naor, "Optimal aggregation algorithms for middleware", 2003.)
Bounds of many queries are one matrix product. Depths double; at each, a few queries are
tried first, and only if one of them can stop are the bounds of all taken.

A query's floor is its k-th best score in one block that all queries meet first. It is a
lower bound of its k-th best score anywhere, so it stops reading early in every other
block, and a block is not read at all for queries whose norm times the block's largest
norm stays below it.

Every query block meets every vector block, so the work is the product of their numbers.
Query blocks are dealt out to the vector blocks; vector blocks are copied only as often
as it takes to keep all cores busy. A pair returns k rows a query.

Sums below 2**53 are exact in doubles. Vectors that are too long for that are in blocks
of their own, whose products are taken in whole numbers of any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrace.llm.slices import lean, prepare, record_batch
from echotrace.session import cut

BLOCK = 4096
QUERIES = 1024
LONG_ROWS = 256  # vectors or queries in a block of whole numbers
DEPTHS = (1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 1.0)  # shares of each list read before the bounds are looked at
PROBE = 24  # queries tried first at a depth
FEW = 16  # candidates a query at which their scores are resolved
EXACT = 2.0**52  # largest squared norm of a vector whose products are taken in doubles
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantise(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every component, as doubles."""
    return np.floor(vectors.astype(np.float64) * 256.0)


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every component as a whole number of any size."""
    return np.array([int(np.floor(256.0 * x)) if abs(x) < 1e300 else int(x) * 256 for x in values.ravel().tolist()], object).reshape(values.shape)


def own_pairs(ids: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (query, vector) where both have one id; ids may repeat."""
    order = np.argsort(ids, kind="stable")
    low, high = (np.searchsorted(ids[order], asks, side=s) for s in ("left", "right"))
    n = high - low
    return np.repeat(np.arange(len(asks)), n), order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]


def block_top(x: np.ndarray, order: np.ndarray, q: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of each query in one block, as (query row, vector row, exact score).

    `order[:, d]` lists the rows of `x` by falling value in dimension d. `own` has the pairs of
    a query and a vector that do not count. `floor` has a lower bound of each query's k-th best score.
    """
    n, dims = x.shape
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n, dtype=order.dtype)[:, None], axis=0)
    columns = np.arange(dims)
    top, bottom = x[order[0], columns], x[order[-1], columns]
    pos, neg = np.maximum(q, 0), np.minimum(q, 0)
    excluded = np.zeros((len(q), n), bool)
    excluded[own] = True
    reach = np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max(initial=0)) * (1 + 1e-9)
    todo = np.flatnonzero(reach >= floor)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def look(some: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Which vectors can still be among the best of some queries, and for which of them reading may stop."""
        if depth >= n:
            upper = lower = q[some] @ x.T
        else:
            from_top, from_bottom = place < depth, place >= n - depth
            at_top, at_bottom = x[order[depth - 1], columns], x[order[n - depth], columns]
            upper = pos[some] @ np.where(from_top, x, at_top).T + neg[some] @ np.where(from_bottom, x, at_bottom).T
            lower = pos[some] @ np.where(from_top, x, bottom).T + neg[some] @ np.where(from_bottom, x, top).T
        gone = excluded[some]
        lower = np.where(gone, -np.inf, lower)
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else np.full(len(some), -np.inf)
        inside = (upper >= np.maximum(kth, floor[some])[:, None]) & ~gone
        return inside, (inside.sum(axis=1) <= max(FEW, k)) | (depth >= n)

    for share in DEPTHS:
        if not len(todo):
            break
        depth = max(1, int(np.ceil(share * n)))
        if depth < n and not look(todo[:: -(-len(todo) // PROBE)], depth)[1].any():
            continue
        inside, ready = look(todo, depth)
        qi, vi = np.nonzero(inside & ready[:, None])
        found.append((todo[qi], vi))
        todo = todo[~ready]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    qi = np.concatenate([f[0] for f in found])
    vi = np.concatenate([f[1] for f in found])
    return qi, vi, np.einsum("ij,ij->i", q[qi], x[vi])


def _blocks(rows: DataFrame, parts: int, queries: bool) -> DataFrame:
    """`(block, part, dims, exact, ids, vals, ord)`, rows of one length and kind; `ord` is empty for queries and for whole numbers."""
    schema = pa.schema([("dims", pa.int32()), ("exact", pa.bool_()), ("ids", pa.binary()), ("vals", pa.binary()), ("ord", pa.binary())])

    def run(batches):
        lean()
        held: dict[tuple[int, bool], list] = {}

        def block(dims, exact):
            ids, vectors = zip(*held.pop((dims, exact)))
            x = np.array(vectors, np.float64).reshape(len(ids), dims)
            order = b""
            if exact:
                x = quantise(x)
                order = b"" if queries else np.argsort(-x, axis=0, kind="stable").astype("<u2").tobytes()
            return record_batch(schema, dims=[dims], exact=[exact], ids=[np.array(ids, "<i8").tobytes()], vals=[x.astype("<f8").tobytes()], ord=[order])

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                exact = sum(min(256 * abs(x) + 1, 1e100) ** 2 for x in vector) < EXACT
                key = len(vector), exact
                group = held.setdefault(key, [])
                group.append((vec_id, vector))
                if len(group) == ((QUERIES if queries else BLOCK) if exact else LONG_ROWS):
                    yield block(*key)
        for key in list(held):
            yield block(*key)

    made = rows.repartition(parts).mapInArrow(run, "dims int, exact boolean, ids binary, vals binary, ord binary")
    return cut(made.withColumns({"part": F.spark_partition_id(), "block": F.monotonically_increasing_id()}))


def _big(score: int) -> bytes:
    """What orders scores that a long does not hold, beside the nearest long; the same for all that it holds."""
    if LEAST <= score <= MOST:
        return b"\x80"
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(8, "big") + abs(score).to_bytes(size, "big")
    return b"\xff" + raw if score > 0 else b"\x00" + bytes(255 - b for b in raw)


def _best(row: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the k best ids of each query of a pair of blocks, best first; scores are doubles or whole numbers."""
    dims = row["dims"]
    ids, asks = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
    x, q = (np.frombuffer(row[c], "<f8").reshape(-1, dims) for c in ("vals", "q_vals"))
    own = own_pairs(ids, asks)
    if row["exact"] and row["q_exact"]:
        order = np.frombuffer(row["ord"], "<u2").reshape(-1, dims)
        repeated = len(ids) - len(np.unique(ids))  # so many more rows hold k ids for certain
        floor = np.frombuffer(row["q_floor"], "<f8") if row["q_floor"] else np.full(len(asks), -np.inf)
        qi, vi, score = block_top(x, order, q, own, min(k + repeated, len(ids)), floor)
    else:
        exact = lambda values, done: np.array([int(v) for v in values.ravel().tolist()], object).reshape(values.shape) if done else whole(values)
        product = exact(q, row["q_exact"]) @ exact(x, row["exact"]).T
        inside = np.ones(product.shape, bool)
        inside[own] = False
        qi, vi = np.nonzero(inside)
        score = product[qi, vi]
    at = sorted(range(len(qi)), key=lambda i: (qi[i], -score[i], ids[vi[i]])) if score.dtype == object else np.lexsort((ids[vi], -score, qi))
    qi, vec, score = qi[at], ids[vi[at]], score[at]
    # the first row of an id is its best
    first = np.zeros(len(qi), bool)
    first[np.unique(qi * np.int64(len(ids) + 1) + np.unique(ids, return_inverse=True)[1][vi[at]], return_index=True)[1]] = True
    qi, vec, score = qi[first], vec[first], score[first]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
    return qi[rank < k], vec[rank < k], score[rank < k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: the k best other vectors of every query.

    `vectors` has `vec_id` and `embedding`. Components count as floor(256 * x); scores are
    whole numbers, and ties go to the smaller vec_id. Null vectors, empty ones, those with
    null or non-finite components and rows with a null vec_id take no part; only vectors
    of equal length are compared. Rows that repeat a vec_id are one id: the score of two
    ids is the greatest of their rows' products, so every id takes one rank, and rows of a
    query's own id are no candidates. A score that a long does not hold is ranked as it is
    and given as the nearest long. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks")).where(
        F.col("vec_id").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    stats = clean.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    # rows are dealt out evenly, give or take one a task; some room avoids stub blocks
    v_parts, q_parts = int(stats["n"] // (0.95 * BLOCK)) + 1, int(stats["q"] // (0.95 * QUERIES)) + 1
    v = _blocks(clean.select("vec_id", "embedding"), v_parts, False)
    q = _blocks(clean.where("asks").select("vec_id", "embedding"), q_parts, True)
    q = q.select(*(F.col(c).alias(f"q_{c}") for c in ("block", "dims", "exact", "ids", "vals")))

    # the floors: one block of each length, a bounded number of them, is met by all queries first
    seeds = v.where("exact").groupBy("dims").agg(F.min("block").alias("block")).orderBy("dims").limit(4)
    seeds = {r["dims"]: r.asDict() for r in v.join(F.broadcast(seeds.select("block")), "block").select("dims", "exact", "ids", "vals", "ord").collect()}  # four blocks at most
    sent = spark.sparkContext.broadcast(seeds)

    def floors(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row["q_floor"] = b""
                seed = sent.value.get(row["q_dims"])
                if seed is not None and row["q_exact"]:
                    n = len(row["q_ids"]) // 8
                    qi, _, score = _best(seed | row, k)
                    low = np.full((n, k), -np.inf)
                    low[qi, np.arange(len(qi)) - np.searchsorted(qi, qi)] = score
                    row["q_floor"] = low[:, k - 1].astype("<f8").tobytes()
            yield pa.RecordBatch.from_pylist(rows, schema=floor_schema)

    floor_schema = pa.schema([("q_block", pa.int64()), ("q_dims", pa.int32()), ("q_exact", pa.bool_()), ("q_ids", pa.binary()), ("q_vals", pa.binary()), ("q_floor", pa.binary())])
    q = cut(q.mapInArrow(floors, "q_block long, q_dims int, q_exact boolean, q_ids binary, q_vals binary, q_floor binary"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("big", pa.binary())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                qi, vec, score = _best(row, k)
                score = [int(s) for s in score.tolist()]
                asks = np.frombuffer(row["q_ids"], "<i8")
                yield record_batch(schema, query_id=asks[qi], vec_id=vec, score=[max(LEAST, min(MOST, s)) for s in score], big=[_big(s) for s in score])

    # a vector block is copied for each of `deal` shares of the queries, one but for small tables; query blocks go to all vector blocks
    deal = min(q_parts, -(-2 * spark.sparkContext.defaultParallelism // v_parts))
    pairs_v = v.select("part", "dims", "exact", "ids", "vals", "ord").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    pairs_q = q.withColumns({"deal": F.pmod(F.xxhash64("q_block"), F.lit(deal)).cast("int"), "part": F.explode(F.sequence(F.lit(0), F.lit(v_parts - 1)))})
    met = pairs_v.join(pairs_q.hint("merge"), ["part", "deal"]).where("dims = q_dims")
    near = met.select("dims", "exact", "ids", "vals", "ord", "q_exact", "q_ids", "q_vals", "q_floor").mapInArrow(run, "query_id long, vec_id long, score long, big binary")
    # one exchange, by query, serves the best of each id and the ranks
    near = near.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "big")).alias("s"))
    best_first = Window.partitionBy("query_id").orderBy(F.desc("s.score"), F.desc("s.big"), F.asc("vec_id"))
    return near.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("s.score").alias("score"))
