"""Row numbers and neighbours in a global order without bringing all rows into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrace.session import keep

BLOCK = 1 << 16  # rows that one task looks for neighbours in
_PART, _WITHIN = 33, (1 << 33) - 1  # halves of a monotonically increasing id


def global_row_number(df: DataFrame, name: str, coarse: list[Column], fine: list[Column]) -> DataFrame:
    """`df` with `name`: its place, from 1, in the ascending order of `coarse` and then the order of `fine`.

    Rows are numbered within each value of the coarse keys, and the groups' sizes, one row
    a group, are summed up before them. Coarse keys should be fine enough that a group fits
    a task, and few enough to be summed in one. For a falling order negate a coarse key.
    """
    keys = [f"__k{i}" for i in range(len(coarse))]
    keyed = df.withColumns(dict(zip(keys, coarse)))
    sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*(F.col(k).alias(f"{k}s") for k in keys), before.alias("__before"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}s")) for k in keys))
    numbered = keyed.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*fine)))
    out = numbered.join(starts, same).withColumn(name, (F.col("__before") + F.col("__r")).cast("long"))
    return out.select(*df.columns, name)


def place_in_order(df: DataFrame, name: str, order: list[Column | str], parts: int | None = None) -> DataFrame:
    """`df` with `name`: its place, from 1, in `order`.

    Rows are range partitioned and sorted by `order` and written once with their place in
    the partition. The partitions' sizes, one number a partition, are summed up on the
    driver and added. Rows that tie in `order` get places in either order. `df` is read
    twice, once for the ranges' bounds.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = keep(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", _PART)
    sizes = stored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each of `parts`
    starts, total = {}, 0
    for r in sorted(sizes):
        starts[r.part], total = total, total + r.n
    if not starts:
        return stored.withColumn(name, F.lit(0).cast("long")).drop("__m")
    before = F.broadcast(spark.createDataFrame([(p, n) for p, n in starts.items()], "__part long, __before long"))
    at = F.col("__before") + F.col("__m").bitwiseAND(F.lit(_WITHIN)) + 1
    return stored.withColumn("__part", part.cast("long")).join(before, "__part").withColumn(name, at.cast("long")).drop("__part", "__before", "__m")


def place_in_group(df: DataFrame, name: str, group: list[str], order: list[Column | str], parts: int | None = None) -> DataFrame:
    """`df` with `name`: its place, from 1, among the rows of its group; a group of any size is spread over the ranges.

    Nulls of the group columns are a group. See `place_in_order`.
    """
    placed = place_in_order(df, "__place", [*group, *order], parts)
    first = placed.groupBy(*group).agg((F.min("__place") - 1).alias("__first")).select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(group)), "__first")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)))
    return placed.join(first, same).withColumn(name, F.col("__place") - F.col("__first")).select(*df.columns, name)


def following(df: DataFrame, place: str, columns: list[str], k: int, block: int = BLOCK) -> DataFrame:
    """`df` with `next`: the structs of `columns` of the up to `k` rows behind each row, in the order of `place` (unique, gapless).

    Rows are cut into blocks of `block` places; the first `k` rows of a block are also given
    to the block before it, so that each block finds its neighbours alone.
    """
    if not 1 <= k <= block:
        raise ValueError("k must be from 1 to the size of a block")
    own = F.expr(f"({place} - 1) div {block}")
    edge = F.array(own, F.when((F.col(place) - 1) % block < k, own - 1))
    spread = df.withColumn("__own", own).withColumn("__block", F.explode(F.array_compact(edge)))
    by = Window.partitionBy("__block").orderBy(place).rowsBetween(1, k)
    return spread.withColumn("next", F.collect_list(F.struct(*columns)).over(by)).where("__block = __own").drop("__own", "__block")
