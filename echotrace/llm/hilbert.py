"""Sharding along a Hilbert curve, in DataFrame functions only.

Language, source and length of a document are quantised to a cell of a 16 x 16 x 16
grid, each by its own ordered quantiles: a bin is a run of values that holds about a
sixteenth of the rows, so nearby cells have nearby values. The curve index of the cell
orders the documents, and runs of that order become shards, so that a shard covers a
compact box of all three dimensions and its minima and maxima prune whole files. Copies
of one text take the cell of the copy of the smallest doc_id and stay in one shard as
long as they fit into it; in the files they stand apart, so that they widen no other
file's minima and maxima.

The global order comes from a range partitioning and a running count of rows per
partition; no task sees more than a partition, and the driver sees 16 bounds a dimension
and one count a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrace.session import Scratch, cut

BITS = 4
DIMS = 3


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """The place of a grid point on the Hilbert curve (Skilling, 2004)."""
    x = list(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    index = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | v >> b & 1
    return index


def curve() -> Column:
    """The curve index of every cell, as one array literal in cell order."""
    side = 1 << BITS
    return F.lit([hilbert_index((c // side // side, c // side % side, c % side), BITS) for c in range(side**DIMS)])


def _starts(docs: DataFrame, dims: list[Column]) -> list[list]:
    """The least value of each bin of each dimension, a string or a whole number, but the first: at most 15, in order. Nulls are in the first bin.

    The bin of a value is its share of rows before it, over all rows that have one; equal values are counted first.
    """
    side, parts = 1 << BITS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ("dim", "s", "n")
    kinds = [dict(docs.select(v.alias("v")).dtypes)["v"] for v in dims]
    values = docs.select(F.explode(F.array(*(
        F.struct(F.lit(i).alias("dim"), (v if kind == "string" else F.lit(None).cast("string")).alias("s"), (F.lit(None) if kind == "string" else v).cast("long").alias("n"))
        for i, (v, kind) in enumerate(zip(dims, kinds))
    ))).alias("v")).select("v.*").where("s is not null or n is not null")
    counts = cut(values.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")))
    ordered = cut(counts.repartitionByRange(parts, *key).withColumn("part", F.spark_partition_id()))
    sums = ordered.groupBy("dim", "part").agg(F.sum("rows").alias("own"))  # a row for each partition and dimension
    all_of = Window.partitionBy("dim")
    before = F.coalesce(F.sum("own").over(all_of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("dim", "part", before.alias("before"), F.sum("own").over(all_of).alias("total"))
    inside = F.coalesce(F.sum("rows").over(Window.partitionBy("dim", "part").orderBy("s", "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    running = ordered.withColumn("inside", inside).join(F.broadcast(sums), ["dim", "part"])
    bins = running.select(*key, F.floor((F.col("before") + F.col("inside")) * side / F.col("total")).alias("bin"))
    starts: list[list] = [[] for _ in dims]
    for r in bins.groupBy("dim", "bin").agg(F.min(F.struct("s", "n")).alias("low")).orderBy("dim", "bin").collect():  # 16 rows a dimension
        if r["bin"] > 0:
            starts[r["dim"]].append(r["low"]["n"] if r["low"]["s"] is None else r["low"]["s"])
    return starts


def _bin(value: Column, starts: list) -> Column:
    """How many of `starts` the value has reached, spread over the side of the grid."""
    reached = F.lit(0)
    for low in starts:
        reached += F.coalesce((value >= F.lit(low)).cast("int"), F.lit(0))
    return reached * F.lit((1 << BITS) // (len(starts) + 1))


def _cell(docs: DataFrame, text: Column) -> Column:
    dims = [F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")] + [F.octet_length(text)]
    side = 1 << BITS
    cell = F.lit(0)
    for value, starts in zip(dims, _starts(docs, dims)):
        cell = cell * side + _bin(value, starts)
    return cell.cast("int")


def _numbered(df: DataFrame, *keys: str) -> DataFrame:
    """`df` with its `place` in the order of the keys."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    own = ordered.withColumn("part", F.shiftright("at", 33))
    counts = own.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each partition
    starts = F.broadcast(counts.select("part", before.alias("before")))
    return own.join(starts, "part").withColumn("place", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "before")


def layout(docs: DataFrame, shards: int = 16) -> DataFrame:
    """`(doc_id, size, text_crc32, law, shard, slot, grown_shard)`, one row per row of `docs`.

    The law is `rows`: counts of shards are at most one apart. `size` is UTF-8 bytes of
    the text plus one; a null text has none and counts as equal to an empty one. Copies
    of a text split only where a shard is full of copies. Rows with null or repeated
    `doc_id` are placed like any other. `lang` and `source` may be missing or null; other
    columns are ignored. With fewer rows than shards, the last shards stay empty.
    """
    return _placed(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _placed(docs: DataFrame, shards: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """`(doc_id, size, text_crc32, moved, shard, slot)` and the columns of `carry`; `moved` rows stand in another cell than their own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit("second"), text).alias("h2"),
        _cell(docs, text).alias("cell"),
        *carry,
    )
    own = cut(own.withColumn("curve", F.get(curve(), F.col("cell"))).drop("cell"))
    copies = own.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "curve"))["curve"].alias("own_curve")).where("copies > 1")
    placed = own.join(copies, ["h1", "h2"], "left").withColumn("moved", F.coalesce(F.col("own_curve") != F.col("curve"), F.lit(False)))
    placed = placed.withColumn("curve", F.coalesce("own_curve", "curve")).drop("own_curve")
    order = ("curve", "h1", "h2", "doc_id")
    every = cut(_numbered(placed, *order))
    total = every.count()
    room = [total // shards + (s < total % shards) for s in range(shards)]

    # groups of copies go whole to the shard in which they begin
    grouped = every.where("copies > 1")
    begin = grouped.groupBy("h1", "h2").agg(F.min("place").alias("begin"))
    home = F.floor(F.col("begin") * shards / max(total, 1)).cast("int")
    grouped = _numbered(grouped.drop("place").join(begin.select("h1", "h2", home.alias("home")), ["h1", "h2"]), "home", *order)
    grouped = cut(grouped)
    held = {r["home"]: r["n"] for r in grouped.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a shard
    held = [held.get(s, 0) for s in range(shards)]
    first = [sum(held[:s]) for s in range(shards)]
    inside = F.col("place") - F.get(F.lit(first), F.col("home"))
    fits = inside < F.get(F.lit(room), F.col("home"))
    columns = ("doc_id", "size", "text_crc32", "moved", *carry)
    stay = grouped.where(fits).select(*columns, F.col("home").alias("shard"), inside.alias("slot"))

    # single texts fill the rest in curve order; copies that a full shard has no room for come last
    taken = [min(h, r) for h, r in zip(held, room)]
    ends, left = [], 0
    for s in range(shards):
        left += room[s] - taken[s]
        ends.append(left)
    singles = every.where("copies is null").select(*columns, *order[:3], F.lit(0).alias("late")).unionByName(
        grouped.where(~fits).select(*columns, *order[:3], F.lit(1).alias("late"))
    )
    rest = _numbered(singles, "late", *order)
    shard = F.size(F.filter(F.lit(ends), lambda e: e <= F.col("place")))
    starts = [0, *ends[:-1]]
    rest = rest.withColumn("shard", shard).select(
        *columns, "shard", (F.col("place") - F.get(F.lit(starts), F.col("shard")) + F.get(F.lit(taken), F.col("shard"))).alias("slot")
    )
    return stay.unionByName(rest)


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write `docs` under `path`, a folder for each shard: `shard=0` and so on, or `shard_=0` if `docs` has a column `shard`.

    Every row is written once, those with null or repeated `doc_id` too: rows meet their
    places by a number of their own, which is stored with them, so that it stays the same.
    Rows are in slot order within a file; rows that stand with their copies, outside their
    own cell, have files of their own.
    """
    folder = "shard"
    while folder in map(str.lower, docs.columns):
        folder += "_"
    with Scratch(docs.sparkSession, "shards") as scratch:
        numbered = scratch.store(docs.withColumn("__row", F.monotonically_increasing_id()), "rows", narrow=False)
        place = _placed(numbered, shards, ("__row",)).select(F.col("__row").alias("__at"), "moved", F.col("shard").alias("__shard"), "slot")
        place = place.withColumnsRenamed({"moved": "__moved", "slot": "__slot"})
        moved = numbered.join(place, F.col("__row") == F.col("__at"))
        ordered = moved.repartitionByRange(2 * shards, "__shard", "__moved").sortWithinPartitions("__shard", "__moved", "__slot")
        # a file a partition and shard: the two kinds of rows are in different partitions, or in one if they are few
        ordered.select(*docs.columns, F.col("__shard").alias(folder)).write.partitionBy(folder).parquet(path)
