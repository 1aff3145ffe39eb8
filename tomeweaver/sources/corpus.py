"""The corpus as tables, and the settings that search, graph and ranking share."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_count

BOOKS = "id bigint, title string, author string, language string, word_count int, storage_key string, source_url string, content_sha256 string, content_bytes bigint, status string"
READY = "READY"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df by ``key`` over as many partitions as there are cores, where its files give fewer; else as it is.

    A few files of one row group each are read by as many tasks.  Their rows are moved before their texts are split into
    words, and what is then grouped by ``key`` and more is not moved again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table, as the planner has them."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def books(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text, lang) as books with their text."""
    label = F.lpad(F.col("doc_id").cast("string"), 7, "0")
    return documents.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("doc "), label).alias("title"), F.lit(None).cast("string").alias("author"), F.col("lang").alias("language"), word_count(F.col("text")).alias("word_count"),
        F.concat(F.lit("doc_"), label, F.lit(".txt")).alias("storage_key"), F.lit(None).cast("string").alias("source_url"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_sha256"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("content_bytes"), F.lit(READY).alias("status"), "text",
    )


@dataclass(frozen=True)
class Similarity:
    min_df: int = 2
    max_df_ratio: float = 0.10
    min_max_df: int = 3
    max_df: int = 200
    min_length: int = 3
    min_shared: int = 2
    min_score: float = 0.05
    neighbors: int = 20

    def __post_init__(self):
        if self.min_df < 2 or not 0 < self.max_df_ratio <= 1 or self.min_max_df < self.min_df or self.max_df < self.min_max_df or self.min_length < 1 or self.min_shared < 1 or not 0 <= self.min_score <= 1 or self.neighbors < 1:
            raise ValueError("Similarity settings out of range")

    def ceiling(self, indexed: int) -> int:
        """The highest document frequency of a feature."""
        return min(self.max_df, max(self.min_max_df, math.ceil(indexed * self.max_df_ratio)))


@dataclass(frozen=True)
class Ranking:
    damping: float = 0.85
    tolerance: float = 1e-10
    max_iterations: int = 200
    lexical_weight: float = 0.85
    pagerank_weight: float = 0.15

    def __post_init__(self):
        if not 0 < self.damping < 1 or self.tolerance <= 0 or self.max_iterations < 1 or self.lexical_weight < 0 or self.pagerank_weight < 0 or self.lexical_weight + self.pagerank_weight <= 0:
            raise ValueError("Ranking settings out of range")

    @property
    def weights(self) -> tuple[float, float]:
        total = self.lexical_weight + self.pagerank_weight
        return self.lexical_weight / total, self.pagerank_weight / total


@dataclass(frozen=True)
class Suggestions:
    seeds: int = 3
    max_seeds: int = 5
    limit: int = 10
    max_limit: int = 50
    neighbors_per_seed: int = 20

    def __post_init__(self):
        if not 1 <= self.seeds <= self.max_seeds or not 1 <= self.limit <= self.max_limit or not 1 <= self.neighbors_per_seed <= 100:
            raise ValueError("Suggestion settings out of range")

    def check(self, seeds: int, limit: int) -> None:
        if not 1 <= seeds <= self.max_seeds or not 1 <= limit <= self.max_limit:
            raise ValueError("Number of seeds or suggestions out of range")


#: Words that are never features of a book.
STOP_WORDS = (
    "the and that this with from have has had was were are been for not but you your his her she him they them their our ours who what when where which would could should "
    "there here into onto than then too very can all any some one two out about over under again only also"
).split()
