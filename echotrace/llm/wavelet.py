"""Token ids in wavelet matrix shards.

A shard holds the token ids of a run of documents as a wavelet matrix (Claude,
Navarro and Ordonez, 2015): one bit plane for each bit of the largest id, most
significant first, each plane ordered by the bits above it, with a rank directory, in
which select looks its block up. That is about 17 bits a token for a vocabulary of
50,000, and answers access, rank, select and count from the planes. Layout, little-endian:

    magic "ETWM", u32 planes, u64 tokens, u64 documents,
    i64 doc_id[documents], u64 n_tokens[documents],
    then for each plane: u64 zeros, u32 ones before each 512-bit block, packed bits.

Shards are written through Spark's own writer, each as the only row of a Parquet file of
its own, so that they land on any store and a lost task leaves nothing half-written.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echotrace.llm.fast_encode import SLICE, encoder
from echotrace.llm.slices import lean, record_batch, prepare, text_slices
from echotrace.session import Scratch, cut

MAGIC = b"ETWM"
HEAD = struct.Struct("<4sIQQ")
BLOCK = 512
STEP = 1 << 15  # tokens moved at once; a multiple of 8


def _plane_bytes(n: int) -> int:
    return -(-n // BLOCK) * (BLOCK // 8)


def build(ids: np.ndarray, doc_ids: list[int], n_tokens: list[int]) -> bytes:
    """The shard of a run of documents with the concatenated `ids`."""
    n = len(ids)
    planes = max(1, int(ids.max()).bit_length()) if n else 1
    a = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    b = np.empty_like(a)
    out = [HEAD.pack(MAGIC, planes, n, len(doc_ids)), np.array(doc_ids, "<i8").tobytes(), np.array(n_tokens, "<u8").tobytes()]
    for level in range(planes - 1, -1, -1):
        ones = (a & a.dtype.type(1 << level)).astype(bool)
        packed = np.zeros(_plane_bytes(n), np.uint8)
        bits = np.packbits(ones, bitorder="little")
        packed[: len(bits)] = bits
        counts = np.bitwise_count(packed.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        before = np.cumsum(counts, dtype=np.uint32) - counts
        zeros = n - int(counts.sum())
        low, high = 0, zeros
        for start in range(0, n, STEP):  # index arrays of a step stay in the cache
            own, part = ones[start : start + STEP], a[start : start + STEP]
            off, on = np.flatnonzero(~own), np.flatnonzero(own)
            part.take(off, out=b[low : low + len(off)], mode="clip")
            part.take(on, out=b[high : high + len(on)], mode="clip")
            low, high = low + len(off), high + len(on)
        out += [struct.pack("<Q", zeros), before.astype("<u4").tobytes(), packed.tobytes()]
        a, b = b, a
    return b"".join(out)


class WaveletMatrix:
    """A shard opened from its bytes."""

    def __init__(self, payload: bytes):
        magic, self.planes, self.n, docs = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix shard")
        at = HEAD.size
        self.doc_ids = np.frombuffer(payload, "<i8", docs, at)
        self.n_tokens = np.frombuffer(payload, "<u8", docs, at + 8 * docs)
        at += 16 * docs
        size = _plane_bytes(self.n)
        self.zeros, self.before, self.bits = [], [], []
        for _ in range(self.planes):
            self.zeros.append(struct.unpack_from("<Q", payload, at)[0])
            self.before.append(np.frombuffer(payload, "<u4", size * 8 // BLOCK, at + 8))
            at += 8 + size * 8 // BLOCK * 4
            self.bits.append(np.frombuffer(payload, np.uint8, size, at))
            at += size

    def _bit(self, plane: int, i: int) -> int:
        return int(self.bits[plane][i >> 3]) >> (i & 7) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones of a plane before place i."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        block = i // BLOCK
        bits = self.bits[plane][block * BLOCK // 8 : (i >> 3) + 1].copy()
        bits[-1] &= (1 << (i & 7)) - 1
        return int(self.before[plane][block]) + int(np.bitwise_count(bits).sum())

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            bit, ones = self._bit(p, i), self._ones(p, i)
            value = value << 1 | bit
            i = self.zeros[p] + ones if bit else i - ones
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before place i."""
        if token >> self.planes:
            return 0
        first, last = 0, min(i, self.n)
        for p in range(self.planes):
            a, b = self._ones(p, first), self._ones(p, last)
            if token >> (self.planes - 1 - p) & 1:
                first, last = self.zeros[p] + a, self.zeros[p] + b
            else:
                first, last = first - a, last - b
        return last - first

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _place(self, plane: int, bit: int, k: int) -> int:
        """The place of occurrence k (from 0) of a bit in a plane: its block by the directory, then its word and bit."""
        before = self.before[plane].astype(np.int64)
        if not bit:
            before = np.arange(len(before), dtype=np.int64) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        own = self.bits[plane][block * BLOCK // 8 : (block + 1) * BLOCK // 8]
        at = np.flatnonzero(np.unpackbits(own, bitorder="little") == bit)
        return block * BLOCK + int(at[k - before[block]])

    def select(self, token: int, k: int) -> int:
        """The place of occurrence k (from 0) of a token: down to its run in the last plane's order, then up plane by plane."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        first, bits = 0, [token >> (self.planes - 1 - p) & 1 for p in range(self.planes)]
        for p, bit in enumerate(bits):
            ones = self._ones(p, first)
            first = self.zeros[p] + ones if bit else first - ones
        at = first + k
        for p in range(self.planes - 1, -1, -1):
            at = self._place(p, 1, at - self.zeros[p]) if bits[p] else self._place(p, 0, at)
        return at

    def tokens(self) -> np.ndarray:
        """All ids, in one pass from the last plane up."""
        a = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        up = np.empty_like(a)
        for p in range(self.planes - 1, -1, -1):
            low, high = 0, self.zeros[p]
            a[high:] |= a.dtype.type(1 << (self.planes - 1 - p))
            for start in range(0, self.n, STEP):
                part = up[start : start + STEP]
                own = np.unpackbits(self.bits[p][start // 8 : (start + STEP) // 8], count=len(part), bitorder="little").view(bool)
                off, on = np.flatnonzero(~own), np.flatnonzero(own)
                part[off] = a[low : low + len(off)]
                part[on] = a[high : high + len(on)]
                low, high = low + len(off), high + len(on)
            a, up = up, a
        return a


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shard_tokens: int = 1 << 22) -> None:
    """Write the shards of `docs (doc_id, text, ...)` in ascending doc_id order.

    A shard ends with the document that brings it to `shard_tokens` tokens. A null text is
    empty; rows with a null `doc_id` have no place in the order and are left out; rows that
    repeat a `doc_id` all stay, next to each other. Other columns are ignored.
    """
    spark = docs.sparkSession
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        enc, part, seq = encoder(tokenizer_path, end_id, checked), TaskContext.get().partitionId(), 0
        runs: list[np.ndarray] = []
        doc_ids: list[int] = []
        sizes: list[int] = []

        def shard():
            nonlocal seq, runs, doc_ids, sizes
            ids = np.concatenate(runs)
            row = record_batch(schema, part=[part], seq=[seq], n_tokens=[len(ids)], payload=[build(ids, doc_ids, sizes)])
            seq, runs, doc_ids, sizes = seq + 1, [], [], []
            return row

        total = 0
        for own, texts in text_slices(batches, chars=SLICE):
            flat, counts = enc.encode(texts)
            ends, first, start = np.cumsum(counts), 0, 0
            while first < len(own):
                # documents up to the one that fills the shard
                last = min(len(own), int(np.searchsorted(ends, start + shard_tokens - total)) + 1)
                stop = int(ends[last - 1])
                runs.append(flat[start:stop].astype(np.uint16 if flat.max(initial=0) < 1 << 16 else np.uint32))
                doc_ids += own[first:last]
                sizes += counts[first:last].tolist()
                total += stop - start
                first, start = last, stop
                if total >= shard_tokens:
                    total = 0
                    yield shard()
        if doc_ids:
            yield shard()

    prepare(spark)
    checked = encoder(tokenizer_path).merger is not None
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where("doc_id is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = own.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    # the planes are as dense as a codec would make them; a file a shard
    ordered.mapInArrow(run, "part int, seq int, n_tokens long, payload binary").write.options(compression="none", maxRecordsPerFile=1).parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """`(doc_id, start, n_tokens, ids_crc32[, ids])` of every document, read back from the shards."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        lean()
        for batch in batches:
            for part, seq, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                matrix = WaveletMatrix(payload.as_py())
                raw = memoryview(matrix.tokens().astype("<u4").tobytes())
                sizes = matrix.n_tokens.astype(np.int64)
                ends = np.cumsum(sizes)
                ids = [raw[4 * (e - n) : 4 * e] for n, e in zip(sizes.tolist(), ends.tolist())]
                k = len(ids)
                sums = [zlib.crc32(x) for x in ids]
                yield record_batch(
                    schema, part=[part] * k, seq=[seq] * k, doc_id=matrix.doc_ids, at=ends - sizes, n_tokens=sizes, ids_crc32=sums, ids=[bytes(x) for x in ids] if with_ids else [None] * k
                )

    shards = spark.read.schema("part int, seq int, n_tokens long, payload binary").parquet(path)
    docs = shards.select("part", "seq", "payload").mapInArrow(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    if not with_ids:
        docs = docs.drop("ids")
    before = lambda column, *by: F.coalesce(F.sum(column).over(Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1).orderBy("part" if not by else "seq")), F.lit(0))
    sizes = cut(shards.select("part", "seq", "n_tokens"))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", before("n").alias("part_start"))
    starts = sizes.select("part", "seq", before("n_tokens", "part").alias("shard_start")).join(parts, "part")
    start = (F.col("part_start") + F.col("shard_start") + F.col("at")).cast("long").alias("start")
    return docs.join(starts, ["part", "seq"]).select("doc_id", start, "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """`(doc_id, start, n_tokens, ids_crc32)` after writing all of `docs` and reading the files back."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "wavelet")
    path = f"{scratch.path}/shards"
    try:
        write_shards(docs, path, tokenizer_path, end_id)
        return cut(read_documents(spark, path, with_ids=False))
    finally:
        scratch.drop()
