"""CSV files of any size under the same rules as `posts.split_csv`, read in parallel.

A line break ends a record unless it is quoted, which the number of quotes before it tells:
in a file without misplaced quotes it is even outside quotes. The quotes of each line are
counted, the parities of the file's blocks are summed up, a number a block, and within a
block the lines' running sums give each line its state. Lines up to the next end of a record
are put together, and each record is split by itself. A record with a misplaced quote is
always put together right as far as that quote, as all before it are, so the first error is
found where the file has it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echotrace.functions import text as T
from echotrace.operators.ranking import place_in_order
from echotrace.options import InputValidationError
from echotrace.session import keep, ship
from echotrace.sources.posts import FIELDS, split_csv

BLOCK = ("file", "block")  # where a line's split begins; names of a folder's files are in order


def _lines(spark: SparkSession, path: str) -> DataFrame:
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    where = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return spark.read.text(path, lineSep="\n").select("value", *where, F.monotonically_increasing_id().alias("m"), (quotes % 2).alias("odd"))


def _before(sizes: DataFrame, column: str) -> DataFrame:
    """`(file, block, before)`: sums of `column` over the blocks before each; a row for each block of the files."""
    rows, total, out = sorted(sizes.select(*BLOCK, column).collect()), 0, []
    for r in rows:
        out.append((r.file, r.block, total))
        total += r[column]
    spark = sizes.sparkSession
    return F.broadcast(spark.createDataFrame(out, "file string, block long, before long"))


def _split(records: pd.Series) -> pd.DataFrame:
    cells, errors = [], []
    for record in records:
        try:
            rows = split_csv(record) if record else [[""]]
            cells.append(rows[0])
            errors.append(None)
        except InputValidationError:
            cells.append(None)
            errors.append("a quote inside a field")
    return pd.DataFrame({"cells": cells, "error": errors})


def records(spark: SparkSession, path: str) -> DataFrame:
    """`(record, cells, error)` of a CSV file, or of the files of a folder in the order of their names as one; numbered from 0.

    Carriage returns outside quotes count for nothing, and a byte order mark at the start
    for none. A quote without end, bytes that are no UTF-8 and an empty file are errors.
    """
    ship(spark)
    lines = _lines(spark, path)
    blocks = keep(lines.groupBy(*BLOCK).agg(F.sum("odd").alias("quotes"), F.count_if(~F.is_valid_utf8("value")).alias("bad"), F.count(F.lit(1)).alias("n")))
    total = blocks.agg(F.sum("quotes").alias("quotes"), F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    if not total.n:
        raise InputValidationError(["the CSV file is empty"])
    if total.bad:
        raise InputValidationError(["the file is not valid UTF-8"])
    if total.quotes % 2:
        raise InputValidationError(["CSV: a quote has no end"])
    within = Window.partitionBy(*BLOCK).orderBy("m")
    quotes = F.sum("odd").over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    ended = lines.join(_before(blocks, "quotes"), list(BLOCK)).withColumn("ends", (quotes % 2 == 0).cast("int")).drop("before")
    ended = keep(ended.withColumn("local", F.coalesce(F.sum("ends").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    counts = ended.groupBy(*BLOCK).agg(F.sum("ends").alias("ends"))
    numbered = ended.join(_before(counts, "ends"), list(BLOCK)).select((F.col("before") + F.col("local")).alias("record"), *BLOCK, "m", "value")
    # a record is as many lines as it has quoted breaks and one
    joined = numbered.groupBy("record").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*BLOCK, "m", "value"))), lambda s: s["value"]), "\n").alias("text"))
    mark = F.when((F.col("record") == 0) & F.startswith("text", F.lit("﻿")), F.substr("text", F.lit(2))).otherwise(F.col("text"))
    return joined.select("record", F.pandas_udf(_split, "cells array<string>, error string")(mark).alias("s")).select("record", "s.cells", "s.error")


def scan_posts(spark: SparkSession, path: str) -> DataFrame:
    """Raw posts of a CSV table with a header that names at least the five fields, in any order; `ord` is the place among rows that are not blank.

    Rows of another width than the header's are errors, told with their number as in small
    files. The driver sees the header, numbers of blocks, and the first error.
    """
    rows = keep(records(spark, path))
    blank = ~F.exists("cells", lambda c: T.required_text(c))
    broken = rows.where("error is not null").orderBy("record").limit(1).first()
    if broken:
        raise InputValidationError([f"CSV row {broken.record + 1}: {broken.error}"])
    header = rows.where("record = 0").first().cells
    if not set(FIELDS) <= set(header):
        raise InputValidationError([f"the CSV header needs {', '.join(FIELDS)}"])
    at = {name: i for i, name in enumerate(header)}  # of a repeated name the last counts
    body = rows.where("record > 0").where(~blank)
    ragged = body.where(F.size("cells") != len(header)).orderBy("record").limit(1).first()
    if ragged:
        raise InputValidationError([f"CSV row {body.where(F.col('record') < ragged.record).count() + 2}: it does not have as many fields as the header"])
    whole = rows.where("record > 0").where(blank).isEmpty()
    placed = body.withColumn("place", F.col("record")) if whole else place_in_order(body, "place", ["record"])
    return placed.select((F.col("place") - 1).alias("ord"), *(F.col("cells")[at[f]].alias(f) for f in FIELDS))
