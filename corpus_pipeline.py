"""A training corpus from raw documents: five stages, each on all that the one before kept.

Each stage but the last returns rows of documents with all their columns, whatever those are called.  Of awkward rows:
a null text, an empty one or one without a letter names no language, so the first stage drops it; a null lang, source
or doc_id is a value like any other there and later.  Rows that repeat an id are rows of their own; copies and near
copies leave one row, of a tie the one of least id and text hash.  Empty tables pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tomeweaver.llm import language_id, mixing, ngram_join, packing, toxicity
from tomeweaver.llm.queries import table
from tomeweaver.llm.store import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is near a centroid of some language; learned from all labelled rows."""
    model = language_id.fit(docs)
    return language_id.without_rejected(docs, model)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold; learned from the labels of those that are left."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of 0.8 or more connect."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, three times at most; a source of words keeps some."""
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of at most 1024 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language_id", identify_language), ("toxicity", drop_toxic), ("ngram_join", join_near_copies), ("mixing", mix_sources), ("packing", pack_windows)]

#: Models and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
