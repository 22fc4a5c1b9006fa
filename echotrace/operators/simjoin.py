"""Set-similarity joins by prefix filtering.

With the tokens of every set in one order, rarest first, two sets of Jaccard similarity t
or more share a token among the first n - ceil(t * n) + 1 of each. Only those prefixes
meet, by an equi-join, and every candidate is verified on the full sets. Frequent tokens
stand at the end of the order, so they make no candidates.

Two unrelated long sets often share such a token by chance, and those pairs grow with the
square of the sets. So sets are cut into parts by a hash of their tokens: if two sets have
similarity t or more, one of their parts has it too, as theirs is a mean of the parts'.
Parts have at most a given number of tokens in the mean, and every prefix row carries a
parity bitmap of its part: bitmaps differ in no more bits than the parts in tokens, so a
pair whose bitmaps differ in more than t allows is left out inside the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrace.operators.screening import held, parted
from echotrace.session import cut, keep, ship

FREQUENT = 1 << 18  # tokens whose frequency is broadcast for the order of prefixes, at most
FREQUENT_BYTES = 1 << 23  # of those tokens where they are strings, at most
BITS = 128  # of a part's bitmap
SLICE = 1 << 18  # tokens that are ordered at once
SKETCHES = 8  # least hashes of a set by which near copies first meet
WORDS = 1 << 11  # of 64 bits in the bitmap of a whole set, at most
WORD_BYTES = 1 << 23  # of the dictionary of token hashes of a written file, at most: most tokens are frequent ones
CHEAP = 1 << 14  # pairs whose full sets are compared without a look at such bitmaps first, at most


def document_frequency(sets: DataFrame) -> DataFrame:
    """`(token, df)` over the rows of `sets (tokens, ...)`."""
    return sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def _ranked(frequency: DataFrame) -> pa.Array:
    """The most frequent tokens that fit in the bounds of a broadcast, by frequency and token; all others are rarer."""
    counts = frequency.withColumn("step", F.floor(F.log2("df") * 4).cast("int"))
    least, count, size = None, 0, 0
    for r in sorted(counts.groupBy("step").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("token")).alias("b")).collect(), reverse=True):
        count, size = count + r.c, size + r.b
        if count > FREQUENT or size > FREQUENT_BYTES:
            break
        least = r.step
    found = counts.where(F.col("step") >= F.lit(least)).select("df", "token").toArrow()
    return found.sort_by([("df", "ascending"), ("token", "ascending")]).column("token").combine_chunks()


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """`(ord, token)`: the prefix tokens of every set of `sets (ord, tokens)`, tokens as strings, rarest first and equally rare ones by their bytes.

    `sets` is read twice. Frequent tokens are put in order where the sets are, by a bounded
    broadcast. The rarer tokens of a set come before them, all of them in its prefix if they
    are no more than that; only of other sets the rarer tokens are shuffled to their frequencies.
    """
    ship(sets.sparkSession)
    _checked(threshold)
    frequency = cut(document_frequency(sets).where("df > 1"))
    given, ord_kind = sets.sparkSession.sparkContext.broadcast(_ranked(frequency)), sets.schema["ord"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = given.value
        for rows, size in _slices(batches):
            token, doc = rows.column("tokens").flatten(), np.repeat(np.arange(len(size)), size)
            rank = pc.fill_null(pc.index_in(token, value_set=known), -1).to_numpy().astype(np.int64)
            want = (size - np.ceil(size * threshold - 1e-9) + 1).astype(np.int64)
            rare = np.bincount(doc[rank < 0], minlength=len(size))
            within = np.lexsort((rank, doc))
            first = np.empty(len(doc), bool)
            first[within] = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(want, size)
            some = (rare > want)[doc]  # sets whose rarer tokens are more than the prefix
            taken = np.flatnonzero(np.where(some, rank < 0, first))
            at = pa.array(doc[taken])
            yield pa.RecordBatch.from_arrays([rows.column("ord").take(at), token.take(pa.array(taken)), pa.array(want[doc[taken]].astype(np.int32), mask=~some[taken])], ["ord", "token", "want"])

    found = keep(sets.select("ord", "tokens").mapInArrow(make, f"ord {ord_kind}, token string, want int"))
    unsure = found.where("want is not null").join(frequency, "token", "left").select("ord", "want", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token").alias("t"))
    each = unsure.groupBy("ord").agg(F.first("want").alias("want"), F.sort_array(F.collect_list("t")).alias("ranked"))
    rest = each.select("ord", F.explode(F.slice("ranked", F.lit(1), F.col("want"))).alias("t")).select("ord", "t.token")
    return found.where("want is null").select("ord", "token").unionByName(rest)


def _checked(threshold: float) -> None:
    if not math.isfinite(threshold) or not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")


def frequent_tokens(sets: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` of the most frequent tokens, ascending, with their frequencies; the others are rarer than all of them.

    Any order of tokens makes prefixes lossless, so where more tokens are shared the rest
    counts as equally rare.
    """
    counts = cut(document_frequency(sets).where("df > 1").withColumn("step", F.floor(F.log2("df") * 4).cast("int")))
    least, total = None, 0
    for r in sorted(counts.groupBy("step").count().collect(), reverse=True):  # four steps for each power of two
        if total + r["count"] > most:
            break
        least, total = r.step, total + r["count"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = counts.where(F.col("step") >= least).select("token", "df").toArrow()
    token, df = (found.column(c).to_numpy() for c in ("token", "df"))
    by = np.argsort(token)
    return token[by], df[by]


def _mixed(x: np.ndarray, odd: int) -> np.ndarray:
    return (x ^ (x >> np.uint64(32))) * np.uint64(odd)


def _bitmaps(bit: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Parity bitmaps of the runs from `starts` on, as words of 64 bits."""
    one = np.uint64(1) << (bit & np.uint64(63))
    return [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == w, one, np.uint64(0)), starts).view(np.int64) for w in range(BITS // 64)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows with about SLICE tokens: the rows, their sizes."""
    for batch in batches:
        offsets = batch.column("tokens").offsets.to_numpy()
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
            rows = batch.slice(at, end - at)
            yield rows, np.diff(offsets[at : end + 1]).astype(np.int64)
            at = end


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The same with their tokens, which are hashes."""
    for rows, size in _slices(batches):
        yield rows, size, rows.column("tokens").flatten().to_numpy()


def _bits(token: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(token.view(np.uint64), 0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93) >> np.uint64(64 - (BITS - 1).bit_length())


def _out(rows: pa.RecordBatch, carry: list[str], doc: np.ndarray, n: np.ndarray, pos: np.ndarray, bitmaps: list[np.ndarray], key: np.ndarray) -> pa.RecordBatch:
    at = pa.array(doc)
    own = [rows.column(c).take(at) for c in carry]
    return pa.RecordBatch.from_arrays([*own, pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32)), *map(pa.array, bitmaps), pa.array(key)], [*carry, "n", "pos", "s0", "s1", "token"])


def prefix_rows(sets: DataFrame, threshold: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Prefix rows of the parts of `sets (..., tokens)`: its other columns, n and pos within the part, the part's bitmap s0 and s1, and token.

    A set of n tokens is cut into 4 ** k parts for k from that of the smallest set it may
    be similar to up to its own, so two similar sets have a k in common. `token` is also of k.
    """
    spark = sets.sparkSession
    ship(spark)
    _checked(threshold)
    part = BITS * min(1.0, max(0.25, 2.5 * threshold - 1))  # tokens of a part, so that bitmaps of unrelated parts differ in more bits than the threshold allows
    given, carry = spark.sparkContext.broadcast(common), [c for c in sets.columns if c != "tokens"]

    def level(n: np.ndarray) -> np.ndarray:
        return np.ceil(np.log2(np.maximum(n, 1) / part) / 2).clip(0, 16).astype(np.int64)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, frequency = given.value
        for rows, size, token in _hashes(batches):
            low, high = level(np.ceil(size * threshold - 1e-9)), level(size)
            doc = np.repeat(np.arange(len(size)), size)
            at = np.searchsorted(known, token).clip(0, max(len(known) - 1, 0))
            df = np.where(known[at] == token, frequency[at], 0) if len(known) else np.zeros(len(token), np.int64)
            mix, bit = _mixed(token.view(np.uint64), 0x9E3779B97F4A7C15), _bits(token)
            for k in range(int(low.min()), int(high.max()) + 1):
                mine = np.flatnonzero(((low <= k) & (k <= high))[doc])
                if not len(mine):
                    continue
                group = doc[mine] << (2 * k) | ((mix[mine] >> np.uint64(64 - 2 * k)).astype(np.int64) if k else 0)
                by = np.lexsort((token[mine], df[mine], group))
                mine, group = mine[by], group[by]
                starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                n = np.diff(np.r_[starts, len(group)])
                of = np.repeat(np.arange(len(n)), n)
                pos = np.arange(len(group)) - starts[of] + 1
                bitmaps = _bitmaps(bit[mine], starts)
                first = pos <= (n - np.ceil(n * threshold - 1e-9) + 1)[of]
                of, pos, mine = of[first], pos[first], mine[first]
                key = (token[mine].view(np.uint64) ^ np.uint64(k * 0x2545F4914F6CDD1D & (1 << 64) - 1)).view(np.int64)
                yield _out(rows, carry, doc[mine], n[of], pos, [b[of] for b in bitmaps], key)

    return _mapped(sets, carry, make)


def sketch_rows(sets: DataFrame) -> DataFrame:
    """Rows like those of `prefix_rows` for SKETCHES least hashes of each whole set, by which most near copies meet."""
    ship(sets.sparkSession)
    carry = [c for c in sets.columns if c != "tokens"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, size, token in _hashes(batches):
            rows = rows.filter(pa.array(size > 0))
            size = size[size > 0]
            if not len(size):
                continue
            starts = np.r_[0, np.cumsum(size)[:-1]]
            bitmaps, every, ones = _bitmaps(_bits(token), starts), np.arange(len(size)), np.ones(len(size), np.int64)
            for i in range(SKETCHES):
                odd = (0x9E3779B97F4A7C15 * (2 * i + 3) | 1) & (1 << 64) - 1
                least = np.minimum.reduceat(_mixed(_mixed(token.view(np.uint64), odd), 0xD6E8FEB86659FD93), starts)
                yield _out(rows, carry, every, size, ones, bitmaps, (least + np.uint64(i)).view(np.int64))

    return _mapped(sets, carry, make)


def _mapped(sets: DataFrame, carry: list[str], make) -> DataFrame:
    kinds = ", ".join(f"`{c}` {sets.schema[c].dataType.simpleString()}" for c in carry)
    return sets.select(*carry, "tokens").mapInArrow(make, f"{kinds}, n int, pos int, s0 bigint, s1 bigint, token bigint")


def with_last(sets: DataFrame) -> DataFrame:
    """`sets` as `(ord, acct, last, tokens)`, with `last` the last account."""
    last = F.col("last_acct") if "last_acct" in sets.columns else F.col("acct")
    return sets.select("ord", "acct", last.alias("last"), "tokens")


#: Two rows are apart unless both stand for posts of one and the same account.
APART = "acct_a <> acct_b or last_a <> acct_a or last_b <> acct_b"


def may_reach(threshold: Column, strictly: bool = False) -> Column:
    """Whether two sets whose first common token is at `pos_a` and `pos_b` can have similarity `threshold`, or more than it.

    They share that token and at most what stands behind it in the shorter rest. The margins
    are far below the distance of any such bound to the next whole number.
    """
    need = threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b"))
    least = F.floor(need + 1e-9) + 1 if strictly else F.ceil(need - 1e-9)
    sizes = F.least("n_a", "n_b") / F.greatest("n_a", "n_b")
    return (sizes > threshold if strictly else sizes >= threshold) & (1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= least)


def near(threshold: Column) -> Column:
    """Whether the parts' bitmaps differ in no more bits than parts of similarity `threshold` may differ in tokens."""
    bits = F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))) + F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b")))
    return bits <= (1 - threshold) / (1 + threshold) * (F.col("n_a") + F.col("n_b")) + 1e-6


def side(rows: DataFrame, s: str, *columns: str) -> DataFrame:
    return rows.select("token", *(F.col(c).alias(f"{c}_{s}") for c in columns))


KEYED = ("ord", "acct", "last", "n", "pos", "s0", "s1")


def set_bitmaps(sets: DataFrame) -> DataFrame:
    """`(ord, n, bits)` of `sets (ord, tokens)`: parity bitmaps of 4 to 8 bits a token in a power of two of words, folded by their lowest bits."""
    ship(sets.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, size, token in _hashes(batches):
            words = (1 << np.ceil(np.log2(np.maximum(size, 16) / 16)).astype(np.int64)).clip(1, WORDS)
            offsets = np.r_[0, np.cumsum(words)]
            doc = np.repeat(np.arange(len(size)), size)
            at = _mixed(_mixed(token.view(np.uint64), 0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93) >> np.uint64(32)
            bits = np.zeros(offsets[-1], np.uint64)
            np.bitwise_xor.at(bits, offsets[doc] + ((at >> np.uint64(6)).astype(np.int64) & (words[doc] - 1)), np.uint64(1) << (at & np.uint64(63)))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(bits.view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column("ord"), pa.array(size.astype(np.int32)), lists], ["ord", "n", "bits"])

    return sets.select("ord", "tokens").mapInArrow(make, f"ord {sets.schema['ord'].dataType.simpleString()}, n int, bits array<bigint>")


def _folded(lists: pa.Array, rows: np.ndarray, words: int, to: int) -> np.ndarray:
    return np.bitwise_xor.reduce(lists.take(pa.array(rows)).flatten().to_numpy().view(np.uint64).reshape(len(rows), words // to, to), axis=1)


def plausible(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs `(a, b)` whose sizes, and bitmaps of whole sets, differ by no more than sets of similarity `threshold` do. No similar pair is lost."""
    bitmaps, kind = keep(set_bitmaps(sets)), pairs.schema["a"].dataType.simpleString()
    own = lambda s: side(bitmaps.withColumn("token", F.col("ord")), s, "n", "bits").withColumnRenamed("token", s)
    both = pairs.select("a", "b").join(own("a"), "a").join(own("b"), "b").where(F.least("n_a", "n_b") / F.greatest("n_a", "n_b") >= F.lit(float(threshold)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("bits_a"), batch.column("bits_b")
            words = np.stack([np.diff(v.offsets.to_numpy()) for v in (x, y)], axis=1)
            n = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            differ = np.zeros(len(batch), np.int64)
            for wx, wy in np.unique(words, axis=0):
                rows = np.flatnonzero((words == (wx, wy)).all(axis=1))
                to = min(wx, wy)
                differ[rows] = np.bitwise_count(_folded(x, rows, wx, to) ^ _folded(y, rows, wy, to)).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(differ <= (1 - threshold) / (1 + threshold) * n + 1e-6))

    return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(look, f"a {kind}, b {kind}")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """`(a, b, inter, uni, sim)` of the pairs `(a, b)` whose full sets are similar enough. Both are written: only sets of pairs are shuffled to them.

    A set goes to each of its pairs, so where pairs are many, those that bitmaps of the whole
    sets show to be too different are left out first, before any full set is written or moved.
    """
    pairs = cut(pairs)
    own = lambda: parted(sets.select("ord", "tokens"), pairs.select(F.explode(F.array("a", "b")).alias("ord")), "ord")[0]
    if pairs.count() > CHEAP:
        pairs = cut(plausible(pairs, own(), threshold))
    used = keep(own(), words=WORD_BYTES)
    full = lambda s: used.select(F.col("ord").alias(s), F.col("tokens").alias(f"t{s}"))
    both = pairs.join(full("a"), "a").join(full("b"), "b")
    inter = F.size(F.array_intersect("ta", "tb")).cast("long")
    scored = both.select("a", "b", inter.alias("inter"), (F.size("ta") + F.size("tb")).alias("both"))
    scored = scored.select("a", "b", "inter", (F.col("both") - F.col("inter")).cast("long").alias("uni"))
    return scored.withColumn("sim", F.col("inter") / F.col("uni")).where(F.col("sim") >= F.lit(float(threshold)))


def similar_pairs(sets: DataFrame, threshold: float, stored: bool = False) -> DataFrame:
    """`(a, b, inter, uni, sim)` of sets of different accounts with similarity at least `threshold`; every pair once, a < b.

    `sets` has ord, acct, tokens and no empty set. A row may stand
    for posts of several accounts, with `acct` the first and `last_acct` the last of them;
    only two rows of one and the same account are no pair. Where pairs are not wanted but
    what they connect, see `linking.linked_sets`. `sets` is read several times; it is
    written first unless it is `stored`, that is read from tables that are written.
    """
    _checked(threshold)
    sets = sets if stored else keep(sets, words=WORD_BYTES)
    if threshold == 1:
        return equal_pairs(sets)
    return verified(candidate_pairs(prefix_rows(with_last(sets), threshold, frequent_tokens(sets)), threshold), sets, threshold)


def equal_pairs(sets: DataFrame) -> DataFrame:
    """What `similar_pairs` gives at threshold 1.

    Sets that share their hash with another are grouped by all their tokens, which are
    shuffled for those alone, and no tokens go to pairs.
    """
    keyed = with_last(sets).withColumn("tokens", F.array_sort("tokens")).withColumn("hash", F.xxhash64("tokens"))
    several = cut(keyed.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("hash"))
    met = keep(held(keyed, several, "hash"))
    first = met.groupBy("tokens").agg(F.min("ord").alias("token"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    rows = cut(met.join(first, "tokens").select("ord", "acct", "last", F.size("tokens").cast("long").alias("n"), "token"))
    both = side(rows, "a", "ord", "acct", "last", "n").join(side(rows, "b", "ord", "acct", "last"), "token").where("ord_a < ord_b").where(F.expr(APART))
    return both.select(F.col("ord_a").alias("a"), F.col("ord_b").alias("b"), F.col("n_a").alias("inter"), F.col("n_a").alias("uni"), F.lit(1.0).alias("sim"))


def candidate_pairs(keyed: DataFrame, threshold: float) -> DataFrame:
    t = F.lit(float(threshold))
    both = side(keyed, "a", *KEYED).join(side(keyed, "b", *KEYED), "token").where("ord_a < ord_b").where(F.expr(APART)).where(may_reach(t)).where(near(t))
    return both.select(F.col("ord_a").alias("a"), F.col("ord_b").alias("b")).distinct()


def matches_of(probes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """`(a, b, inter, uni, sim)`: for each of `probes (ord, ms, tokens)` as a, the similar ones of `sets (ord, ms, tokens)` as b whose `ms` is greater.

    No ord is in both. Any one order of tokens makes prefixes lossless, so the frequencies
    are those among the probes, and none is counted over `sets`. Of the sets only prefix rows
    are shuffled whose token may be in the prefix of a probe. Both are read several times.
    """
    _checked(threshold)
    own, t = ("ord", "ms", "n", "pos", "s0", "s1"), F.lit(float(threshold))
    probes, sets = (df.select("ord", "ms", "tokens") for df in (probes, sets))
    common = frequent_tokens(probes)
    rows = keep(prefix_rows(probes, threshold, common))
    met = parted(prefix_rows(sets, threshold, common), rows, "token")[0]
    both = side(rows, "a", *own).join(side(met, "b", *own), "token").where("ms_a < ms_b").where(may_reach(t)).where(near(t))
    pairs = both.select(F.col("ord_a").alias("a"), F.col("ord_b").alias("b")).distinct()
    return verified(pairs, probes.unionByName(sets), threshold)
