"""Best-fit-decreasing packing of token sequences into fixed windows.

Overlong documents are first cut into full windows; the remainders are packed by best
fit decreasing: longest first, each into the open window with the least capacity that
still takes it, found with a segment tree indexed by remaining capacity. Remainders of
one length are interchangeable, so the plan needs only the histogram of lengths, which
has as many entries as a window has tokens whatever the input size. The driver runs best
fit decreasing on that histogram, a whole run of equal lengths at a time and with the
very windows that piece-by-piece best fit decreasing would give; executors then look up
the place of each piece by its rank among those of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echotrace.llm.fast_encode import SLICE, encoder
from echotrace.llm.slices import record_batch, prepare, text_slices
from echotrace.session import Scratch, cut

PIECES = "part int, rank long, doc_id long, start long, length int, doc_tokens long, ids_crc32 long, ids binary"


class CapacityTree:
    """A segment tree over capacities 0..window that finds the smallest held one from a bound up."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.held = [False] * (2 * self.size)

    def set(self, capacity: int, held: bool) -> None:
        i = capacity + self.size
        self.held[i] = held
        while i > 1:
            i //= 2
            self.held[i] = self.held[2 * i] or self.held[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest held capacity that is at least `need`."""
        i = need + self.size
        if self.held[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.held[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.held[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The plan for `histogram[length]` pieces of each length, and the number of windows.

    A plan row `(length, first, last, window, per, offset)` places the pieces of ranks
    first..last-1 of a length: piece r into window `window + (r - first) // per` at
    `offset + (r - first) % per * length`.
    """
    tree = CapacityTree(window)
    runs: dict[int, list[tuple[int, int]]] = {}  # capacity -> runs (first window, count) of windows
    plan: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def put(capacity: int, first: int, count: int) -> None:
        if count and capacity:
            runs.setdefault(capacity, []).append((first, count))
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        rank, end = 0, histogram[length]
        while rank < end:
            capacity = tree.tightest(length)
            if capacity is None:  # open as many windows as the rest of this length needs
                per = window // length
                need = -(-(end - rank) // per)
                capacity, first, count = window, opened, need
                opened += need
            else:
                first, count = runs[capacity].pop()
                if not runs[capacity]:
                    tree.set(capacity, False)
            per = capacity // length
            full = min(count, (end - rank) // per)
            if full:
                plan.append((length, rank, rank + full * per, first, per, window - capacity))
                rank += full * per
                put(capacity - per * length, first, full)
            if full < count and rank < end:  # the last window of this run takes what is left
                some = end - rank
                plan.append((length, rank, end, first + full, some, window - capacity))
                put(capacity - some * length, first + full, 1)
                rank, full = end, full + 1
            put(capacity, first + full, count - full)
    return plan, opened


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, window: int, with_ids: bool) -> DataFrame:
    """The pieces of every document: full windows first, then the remainder.

    `rank` numbers the pieces of one length within the task `part`.
    """
    schema = pa.schema(
        [("part", pa.int32()), ("rank", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    )

    def run(batches):
        enc, part, seen = encoder(tokenizer_path, end_id, checked), TaskContext.get().partitionId(), Counter()
        for doc_ids, texts in text_slices(batches, chars=SLICE):
            out = {name: [] for name in schema.names}
            ids, sizes = enc.encode(texts)
            raw, end = memoryview(ids.astype("<u4").tobytes()), 0
            for doc_id, total in zip(doc_ids, sizes.tolist()):
                start, end = end, end + total
                for at in range(start, end, window):
                    piece = raw[4 * at : 4 * min(at + window, end)]
                    n = len(piece) // 4
                    values = (part, seen[n], doc_id, at - start, n, total, zlib.crc32(piece), bytes(piece) if with_ids else None)
                    seen[n] += 1
                    for name, value in zip(schema.names, values):
                        out[name].append(value)
            yield record_batch(schema, **out)

    checked = encoder(tokenizer_path).merger is not None
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = 2048, with_ids: bool = True) -> DataFrame:
    """`(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])`, one row per piece.

    Every document has at least its end id; a null text is empty. Rows with a null or
    repeated `doc_id` are packed like any other. `offset` is gapless from 0 within a
    sequence. `ids` (little-endian unsigned 32-bit) can be left out to save storage;
    `ids_crc32` is taken from them either way. Other columns are ignored. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "packing")
    # with ids the result is read from the pieces, which then go with the session
    with nullcontext(scratch) if with_ids else scratch:
        return _packed(docs, tokenizer_path, end_id, window, with_ids, scratch)


def _packed(docs: DataFrame, tokenizer_path: str, end_id: int, window: int, with_ids: bool, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    pieces = scratch.store(cut_pieces(docs, tokenizer_path, end_id, window, with_ids), "pieces", narrow=False)
    if not with_ids:
        pieces = pieces.drop("ids")
    by_part = cut(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    full = histogram.pop(window, 0)
    plan, _ = best_fit_decreasing(histogram, window)
    if full:
        plan = [(window, 0, full, 0, 1, 0)] + [(n, a, b, w + full, per, at) for n, a, b, w, per, at in plan]
    # bounded by the number of lengths, not by the input
    places = spark.createDataFrame(plan, "place_length int, first long, last long, window_id long, per long, at long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_part.select("length", "part", before.alias("before"))
    # a row for each length and task: it grows with the input, so it is never a broadcast
    ranked = pieces.join(offsets.hint("merge"), ["length", "part"]).withColumn("r", F.col("before") + F.col("rank"))
    inside = (F.col("length") == F.col("place_length")) & (F.col("r") >= F.col("first")) & (F.col("r") < F.col("last"))
    out = ranked.join(F.broadcast(places), inside).select(
        *("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens"),
        (F.col("window_id") + F.expr("(r - first) div per")).cast("long").alias("sequence_id"),
        (F.col("at") + F.expr("(r - first) % per") * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
    return out if with_ids else cut(out)
