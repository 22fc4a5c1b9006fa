"""Helpers for operators that stream Arrow batches through Python, in bounded memory."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from echotrace.session import ship

CHARS = 400_000  # characters handled at once, so that token lists stay small
BATCH_BYTES = "4m"


def prepare(spark: SparkSession) -> None:
    """Ship the package, and bound Arrow batches by bytes: a batch of long rows must not fill a worker.

    A smaller bound that the session has set already stays.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = (spark.conf.get(key) or "").rstrip("bB")
    if not known.isdigit() or int(known) > 4 << 20:
        spark.conf.set(key, BATCH_BYTES)


def lean() -> None:
    """Let a Python worker give freed memory back: idle workers live on between tasks."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def text_slices(batches, columns: tuple[str, ...] = ("doc_id", "text"), chars: int = CHARS) -> Iterator[tuple[list, ...]]:
    """Rows of the batches as lists by column, in slices of about `chars` bytes of the last column."""
    lean()
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        sizes = pc.binary_length(cols[-1]).fill_null(0).to_pylist()
        start = used = 0
        for i, n in enumerate(sizes):
            used += n
            if used >= chars:
                yield tuple(c.slice(start, i + 1 - start).to_pylist() for c in cols)
                start, used = i + 1, 0
        if start < len(sizes):
            yield tuple(c.slice(start).to_pylist() for c in cols)
    lean()


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def kept_rows(docs: DataFrame, keeps: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of `docs` whose `text` passes `keeps`, as they are: no join, so null and repeated ids make no difference."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string())
            slim = pa.RecordBatch.from_arrays([texts], ["text"])
            flags = [bool(x) for (some,) in text_slices([slim], ("text",)) for x in keeps(some)]
            yield batch.filter(pa.array(flags, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


class Vocabulary:
    """Numbers of known words, in place, over whole texts; any other word has the number `len(words)`.

    Words are `[^\\W_]+` of the lower-cased text. A batch of texts is split at blanks, its distinct
    pieces are split into words and numbered, and the numbers are gathered by array operations.
    """

    WORD = re.compile(r"[^\W_]+")
    GAPPED = re.compile(r"[^\W_]+|\0")

    def __init__(self, words: list[str]):
        self.words = words
        self.number = {w: i for i, w in enumerate(words)} | {"\0": -1}

    def __getstate__(self):
        return self.words

    def __setstate__(self, words):
        self.__init__(words)

    @classmethod
    def split(cls, text: str | None) -> list[str]:
        return cls.WORD.findall((text or "").lower())

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of the texts one after the other, and how many words each text has."""
        lowered = [(t or "").lower() for t in texts]
        lowered = [t.replace("\0", " ") if "\0" in t else t for t in lowered]
        pieces = pc.ascii_split_whitespace(pa.array(lowered, pa.large_string()))
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self.GAPPED.findall("\0".join(distinct) + "\0") if distinct else []
        known = np.fromiter(map(self.number.get, found, repeat(len(self.words))), np.int64, len(found))
        gaps = np.flatnonzero(known < 0)
        sizes = np.diff(gaps, prepend=-1) - 1
        store, at = known[known >= 0], coded.indices.to_numpy()
        n = sizes[at]
        after = np.append(0, np.cumsum(n))
        numbers = store[np.repeat((np.cumsum(sizes) - sizes)[at] - after[:-1], n) + np.arange(after[-1])]
        return numbers, np.diff(after[np.cumsum(pc.list_value_length(pieces).to_numpy())], prepend=0)
