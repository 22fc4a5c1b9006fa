"""Rows parted by a filter of fixed size over the keys that they are to meet, so that rows without a partner are not shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = 1 << 11  # of BLOCK_BITS bits, 4 KB: at most 8 MB are broadcast
BLOCK_BITS = 1 << 15  # fixed by the bitmap functions


def parted(rows: DataFrame, keys: DataFrame, *on: str) -> tuple[DataFrame, DataFrame]:
    """The rows of `rows` whose columns `on` may be those of a row of `keys`, and the rows of which they surely are not."""
    at = F.pmod(F.xxhash64(F.lit("screen"), *on), F.lit(BLOCKS * BLOCK_BITS))
    bit = F.col("__at").bitwiseAND(F.lit(BLOCK_BITS - 1))
    block = F.shiftright("__at", BLOCK_BITS.bit_length() - 1)
    blocks = keys.select(at.alias("__at")).select(block.alias("__block"), bit.alias("__bit")).groupBy("__block").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    met = rows.withColumn("__at", at).join(F.broadcast(blocks), block == F.col("__block"), "left")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return met.where(may).select(*rows.columns), met.where(~may).select(*rows.columns)


def held(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """The rows of `rows` whose columns `on` are those of a row of `keys`."""
    return parted(rows, keys, *on)[0].join(keys.select(*on), list(on), "left_semi").select(*rows.columns)
