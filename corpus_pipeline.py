"""The training-corpus pipeline: documents in, packed token sequences out.

Each stage works on all rows that the stage before it kept, written as Parquet and read
again. All but the last return the columns of `documents`.

In every stage very long texts are read whole, an empty table stays empty, and further
columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echotrace.llm import langid, line_dedup, lsa, minhash, packing
from echotrace.llm.queries import tokenizer_path
from echotrace.session import Scratch

SURE = 0.3  # least score of a language that a document is kept for


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows; texts without letters and with no likely language go.

    Rows are judged one by one by their text: null and repeated ids stay or go like any
    other, and an empty table stays empty.
    """
    return langid.identified(docs, langid.fit(docs, ~langid.held_out(4, 2)), SURE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that an earlier document holds; a document that loses all its lines goes.

    Rows with a null doc_id stay as they are; rows that repeat a doc_id are one holder.
    """
    return line_dedup.rewrite(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates on five-word shingles, that of the smallest doc_id.

    Rows with a null doc_id and rows without words stay; rows that repeat a doc_id stay or go together.
    """
    return minhash.one_of_each(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a benchmark passage; null and repeated ids make no difference."""
    return lsa.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into windows of 2048; a null text is its end id alone."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, window=2048, with_ids=False)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: No SQL: language models, sketches, latent spaces and tokenizers are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, "pipeline") as scratch:
        for i, (_, stage) in enumerate(STAGES[:-1]):
            docs = scratch.store(stage(spark, docs, sf_dir), f"stage{i}", narrow=False)
        return STAGES[-1][1](spark, docs, sf_dir)  # written to the shared folder, so that the stages' tables can go
