"""MinHash near-duplicate detection with fast similarity sketching.

A document is the set of its word shingles. The sketch has `size` coordinates and is
filled in rounds (Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching", 2017): in
each of the first `size` rounds every shingle is thrown into one random bin with a
random value, in round `size + j` every shingle is thrown into bin `j`; a bin keeps the
smallest value of the earliest round that reached it. So every coordinate fills, a set
of n shingles costs O(n + size log size) hashes, and the share of equal coordinates of
two sketches concentrates around the Jaccard similarity as if coordinates were
independent. Bands of `rows` coordinates give the buckets; links are confirmed on the
full shingle sets.

Equal sets are one class and carry on as one representative. Representatives of a bucket
are linked through pivots, first the smallest, then a random one, so that a bucket of k
near copies costs k comparisons. What then remains are bucket mates of different
components; among these documents an exact prefix filter with positions finds the pairs
that can reach the similarity, and they are compared in full, so no link between
different texts is given up. With 32
bands of 4 rows a pair at similarity 0.8 shares no bucket with probability below 5e-8;
for lower similarities bands have fewer rows, so that the same holds.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.llm.slices import lean, record_batch, prepare, text_slices
from echotrace.operators.components import connected_components, extended
from echotrace.session import Scratch, cut, release

U64 = np.uint64
MEMO = 100_000
PAIRS_A_HEAD = 256
APART = 5e-8  # chance that a pair at the threshold shares no bucket, at most
MOST_ROWS = 4


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


_memo = _Hashes()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased. A text of fewer than
    k words is one shingle; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, U64)
    h = np.fromiter(map(_memo.__getitem__, words), U64, n)
    w = min(n, k)
    s = np.full(n - w + 1, w, U64)
    for j in range(w):
        s = mix(s + h[j : n - w + 1 + j]) * U64(0x9E3779B97F4A7C15)
    return np.unique(mix(s))


@lru_cache(maxsize=8)
def _seeds(size: int) -> np.ndarray:
    return mix(np.arange(1, 2 * size + 1, dtype=U64) * U64(0xD1342543DE82EF95))


def fast_sketch(items: np.ndarray, size: int) -> np.ndarray:
    """`size` coordinates of a non-empty set of 64-bit hashes; `size` is a power of two."""
    bits = U64(64 - size.bit_length() + 1)
    seeds = _seeds(size)
    out = np.zeros(size, U64)
    empty = np.ones(size, bool)
    first, top = 0, np.iinfo(np.uint64).max
    while first < 2 * size:
        # as many rounds at once as are likely to be needed: size * ln(size) throws in all
        rounds = max(1, min(size, int(size * 3.5 / len(items))))
        last = min(first + rounds, size if first < size else 2 * size)
        h = mix(items[None, :] ^ seeds[first:last, None])
        if first < size:
            bins = (h >> bits).astype(np.int64)
            for r in range(last - first):
                best = np.full(size, top, U64)
                np.minimum.at(best, bins[r], h[r])
                hit = empty & (best != top)
                out[hit] = best[hit] ^ seeds[first + r]
                empty &= ~hit
                if not empty.any():
                    return out
        else:
            low = h.min(axis=1)
            at = np.arange(first - size, last - size)
            fill = empty[at]
            out[at[fill]] = low[fill] ^ seeds[first:last][fill]
            empty[at] = False
        first = last
    return out


def banding(percent: int, size: int = 128) -> tuple[int, int]:
    """`(size, rows)`: the most rows a band that keep `APART` at `percent`, in a sketch of `size` coordinates or, below 13 %, more."""
    if percent < 1:
        raise ValueError("percent is 1 at least: sets without a common shingle share no bucket")
    share = min(percent, 100) / 100
    while True:
        for rows in range(MOST_ROWS, 0, -1):
            if (1 - share**rows) ** (size // rows) <= APART:
                return size, rows
        size *= 2


def sketches(docs: DataFrame, k: int, size: int, rows: int) -> DataFrame:
    """`(doc_id, n, f0, f1, bands, s0, s1)`: set size, fingerprint of the set, band keys, a bit of each coordinate."""
    bands = size // rows
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("f0", pa.int64()), ("f1", pa.int64()), ("bands", pa.list_(pa.int64())), ("s0", pa.int64()), ("s1", pa.int64())]
    )

    def run(batches):
        salt = mix(np.arange(1, bands + 1, dtype=U64))
        for ids, texts in text_slices(batches):
            out = {name: [] for name in schema.names}
            for doc_id, text in zip(ids, texts):
                items = shingle_set(text, k)
                f = s = (0, 0)
                keys: list[int] = []
                if len(items):
                    f = np.frombuffer(hashlib.blake2b(items.tobytes(), digest_size=16).digest(), np.int64).tolist()
                    coords = fast_sketch(items, size)
                    h = salt.copy()
                    for r in range(rows):
                        h = mix(h ^ coords[r::rows][:bands]) * U64(0x9E3779B97F4A7C15)
                    keys = h.view(np.int64).tolist()
                    s = tuple(np.packbits((mix(coords[:128]) >> U64(63)).astype(np.uint8)).view(np.int64).tolist())
                for name, value in zip(schema.names, (doc_id, len(items), *f, keys, *s)):
                    out[name].append(value)
            yield record_batch(schema, **out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n long, f0 long, f1 long, bands array<long>, s0 long, s1 long"
    )


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """`(id, items)` of the documents named in `ids`; only their texts are dealt out."""
    schema = pa.schema([("id", pa.int64()), ("items", pa.binary())])

    def run(batches):
        for doc_ids, texts in text_slices(batches):
            yield record_batch(schema, id=doc_ids, items=[shingle_set(t, k).tobytes() for t in texts])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.join(ids, own["doc_id"] == ids["id"], "left_semi").mapInArrow(run, "id long, items binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs `(a, b)` whose sets meet 100 * intersection >= percent * union."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        lean()
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            xs, ys = batch.column(2), batch.column(3)
            keep_a, keep_b = [], []
            for i in range(len(a)):
                x = np.frombuffer(xs[i].as_buffer(), U64)
                y = np.frombuffer(ys[i].as_buffer(), U64)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                if 100 * small < percent * large:
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * inter >= percent * (len(x) + len(y) - inter):
                    keep_a.append(a[i])
                    keep_b.append(b[i])
            yield record_batch(schema, a=keep_a, b=keep_b)
        lean()

    # a pivot of many pairs is dealt out with a share of them each time
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / PAIRS_A_HEAD)).alias("deal"))
    heads = dealt.select("a", "deal").distinct().join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    tails = dealt.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    both = tails.join(heads.hint("shuffle_hash"), ["a", "deal"]).select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def _screen(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs `(a, b)` that sizes and one-bit sketches in `marks (id, n, s0, s1)` do not rule out.

    Of 128 bits a pair at similarity J differs in (1 - J) / 2, with deviation 3.4 at 0.8; the
    bound is six deviations off, at lower similarities too, so a true pair fails with
    probability below 1e-8.
    """
    differ = (1 - min(percent, 100) / 100) / 2
    far = int(128 * differ + max(128 * 0.165, 6.22 * (128 * differ * (1 - differ)) ** 0.5))
    side = lambda s: marks.select(*(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "s0", "s1")))
    both = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    near = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and bit_count(s0_a ^ s0_b) + bit_count(s1_a ^ s1_b) <= {far}"
    return both.where(near).select("a", "b")


def _prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs `(a, b)` of `sets (id, items, n, comp)` of different components that can reach the similarity.

    An exact filter, after Xiao, Wang, Lin and Yu, "Efficient similarity joins for near
    duplicate detection" (2008): with shingles in one order, rarest first, two sets of
    that similarity share a shingle in their prefixes, and the places of the first shared
    one leave room for the overlap. Two rows of a shingle's own largest component never
    meet, and a row meets only partners of a size that its place allows, by size classes,
    so neither a hub nor a crowd of near misses is paired up within itself.
    """
    slots = 1 << 18
    schema = pa.schema([("slot", pa.int32()), ("c", pa.int64())])

    def count(batches):
        held = np.zeros(slots, np.int64)
        for batch in batches:
            for items in batch.column(0):
                held += np.bincount((np.frombuffer(items.as_buffer(), U64) >> U64(46)).astype(np.int64), minlength=slots)
        at = np.flatnonzero(held)
        yield record_batch(schema, slot=at, c=held[at])

    counts = np.zeros(slots, np.int64)
    found = sets.select("items").mapInArrow(count, "slot int, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()  # two columns of at most `slots` numbers
    counts[found.column("slot").to_numpy()] = found.column("c").to_numpy()
    sent = sets.sparkSession.sparkContext.broadcast(counts)
    post = pa.schema([("token", pa.int64()), ("pos", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("comp", pa.int64())])

    def prefixes(batches):
        for batch in batches:
            ids, comps = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, buffer in enumerate(batch.column(1)):
                items = np.frombuffer(buffer.as_buffer(), U64)
                n = len(items)
                often = sent.value[(items >> U64(46)).astype(np.int64)]
                order = np.lexsort((items, often))[: n - (percent * n + 99) // 100 + 1]
                pos = np.flatnonzero(often[order] > 1)
                tokens = items[order[pos]].view(np.int64)
                m = len(pos)
                yield record_batch(post, token=tokens, pos=pos + 1, id=[ids[i]] * m, n=[n] * m, comp=[comps[i]] * m)

    def merged(batches):
        held, rows = [], 0
        for b in prefixes(batches):
            held.append(b)
            rows += b.num_rows
            if rows > 20_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        lean()

    posts = cut(sets.select("id", "items", "comp").mapInArrow(merged, "token long, pos long, id long, n long, comp long"))
    mixed = posts.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("token")
    posts = cut(posts.join(mixed, "token"))
    main = posts.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"))
    total = 100 + percent
    room = F.least(F.col("n") * 100 / percent, F.col("m_most"))
    cell = lambda size, slack: F.floor(8 * F.log2(size) + slack).cast("int")
    asks = (
        posts.join(main, "token").where("comp <> main")
        .withColumn("m_most", F.expr(f"{total} * (1 + n - pos) / {percent} - n"))
        .where(F.col("m_most") * 100 >= F.col("n") * percent)
        .withColumn("cell", F.explode(F.sequence(cell(F.col("n") * percent / 100, -1e-6), cell(room, 1e-6))))
        .select("token", "cell", *(F.col(c).alias(f"{c}_a") for c in ("id", "n", "pos", "comp")))
    )
    held = posts.select("token", cell(F.col("n"), 1e-9).alias("cell"), *(F.col(c).alias(f"{c}_b") for c in ("id", "n", "pos", "comp")))
    met = asks.join(held, ["token", "cell"]).where(
        f"comp_a <> comp_b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
        f" and {total} * (1 + least(n_a - pos_a, n_b - pos_b)) >= {percent} * (n_a + n_b)"
    )
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, size: int = 128, rows: int | None = None) -> DataFrame:
    """`(doc_id, n_shingles, component_id, kept)`, one row per row of `docs (doc_id, text, ...)`.

    Null and blank texts have no shingles and are linked with nothing. Rows with a null
    `doc_id` take no part: component_id is null and kept is true. Rows that repeat a
    `doc_id` count as one document, which has the links of all of them. Other columns are
    ignored, whatever their names. An empty table gives an empty result. `rows` of a band
    follow from `percent` unless given; `size` is doubled if it is too small for `percent`.
    """
    if rows is None:
        size, rows = banding(percent, size)
    prepare(docs.sparkSession)
    with Scratch(docs.sparkSession, "minhash") as scratch:
        return _components(docs, k, percent, size, rows, scratch)


def _components(docs: DataFrame, k: int, percent: int, size: int, rows: int, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    base = scratch.store(sketches(docs, k, size, rows), "base", narrow=False)
    part = base.where("doc_id is not null and n > 0")
    classes = part.groupBy("f0", "f1").agg(F.min("doc_id").alias("rep"))
    reps = part.join(classes, ["f0", "f1"]).where("doc_id = rep")
    rows_ = scratch.store(reps.select(F.col("doc_id").alias("id"), "n", F.explode("bands").alias("key")), "rows", narrow=False)
    # joins with what grows with the input are hinted to shuffle, so that none is a broadcast; a side as large as the buckets is sorted and may spill
    pivots = rows_.groupBy("key").agg(F.min("id").alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "p")
    shared = scratch.store(rows_.join(pivots.hint("merge"), "key"), "shared")  # rows of buckets with company
    star = shared.where("id <> p").select(F.col("p").alias("a"), F.col("id").alias("b")).distinct()
    scratch.remove("rows")
    ids = scratch.store(shared.select("id").distinct(), "ids")
    marks = scratch.store(reps.select(F.col("doc_id").alias("id"), "n", "s0", "s1").join(ids.hint("shuffle_hash"), "id", "left_semi"), "marks")
    star = scratch.store(_screen(star, marks, percent).distinct(), "pairs-star")
    release(spark)
    # sets of all who share a bucket serve all steps; they are dealt out by id once
    sets = _sets(docs, ids.hint("shuffle_hash"), k).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").checkpoint(eager=True)
    release(spark)

    # each step's links are contracted on the components of the steps before
    comps = connected_components(_confirmed(star, sets, percent), "a", "b")
    release(spark)

    def mixed_buckets(step: str) -> DataFrame:
        """Bucket rows `(key, id, n, comp, id_p, n_p, comp_p)` of the buckets that hold several components; the last three are of a random row of the bucket."""
        node = comps.select(F.col("node").alias("id"), F.col("component").alias("comp"))
        placed = scratch.store(shared.join(node, "id", "left").select("id", "n", F.coalesce("comp", "id").alias("comp"), "key"), f"placed-{step}")
        some = F.xxhash64("id", F.lit(step))
        picked = [F.min_by(c, some).alias(f"{c}_p") for c in ("id", "n", "comp")]
        mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), *picked).where("c0 <> c1")
        return placed.join(mixed.drop("c0", "c1"), "key")

    pairs = mixed_buckets("random").where(f"comp <> comp_p and 100 * least(n, n_p) >= {percent} * greatest(n, n_p)")
    pairs = pairs.select(F.col("id_p").alias("a"), F.col("id").alias("b")).distinct()
    pairs = scratch.store(_screen(pairs, marks, percent).distinct(), "pairs-random")
    scratch.remove("placed-random")
    release(spark)
    comps = extended(comps, _confirmed(pairs, sets, percent), "a", "b")

    release(spark)
    rest = scratch.store(mixed_buckets("rest").select("id", "n", "comp").distinct(), "rest")
    for name in ("placed-rest", "shared"):
        scratch.remove(name)
    pairs = scratch.store(_prefix_pairs(sets.join(rest, "id"), percent), "pairs-rest")
    comps = extended(comps, _confirmed(pairs, sets, percent), "a", "b")

    member = base.join(classes, ["f0", "f1"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("rep")).alias("rep"))
    found = member.join(comps, member["rep"] == comps["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id")
    )
    return cut(found.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each group of near duplicates, that of the smallest doc_id."""
    gone = near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
