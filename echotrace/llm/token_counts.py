"""Token counts of documents with the whole-token shortcut.

A vocabulary string that encodes alone as one token counts one wherever it stands as a
pre-token, with no merging; `Encoder.whole_tokens` proves this for every string of the
vocabulary, on the driver and before any text is read, and the table is sent out. All other
pre-tokens are merged, each distinct one once a batch of texts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.llm.fast_encode import SLICE, encoder
from echotrace.llm.slices import record_batch, prepare, text_slices


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """`(doc_id, n_bytes, n_tokens, over_limit)`, one row per row of `docs (doc_id, text, ...)`.

    A null text counts as empty: no bytes, no tokens, not over the limit. Rows with a null
    or repeated `doc_id` are counted like any other. Other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        enc = encoder(tokenizer_path, None, checked)
        for ids, sizes, texts in text_slices(batches, ("doc_id", "n_bytes", "text"), SLICE):
            counts = enc.count(texts, whole.value)
            yield record_batch(schema, doc_id=ids, n_bytes=sizes, n_tokens=counts, over_limit=[c > limit for c in counts])

    prepare(docs.sparkSession)
    checked = encoder(tokenizer_path).merger is not None
    whole = docs.sparkSession.sparkContext.broadcast(frozenset(encoder(tokenizer_path).whole_tokens()))  # at most the vocabulary
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
