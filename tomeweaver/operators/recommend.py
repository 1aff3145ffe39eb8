"""Suggestions from the neighbours of seeds, with the reasons for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .similarity import both_ways


def weighted_seeds(seeds: DataFrame) -> DataFrame:
    """seeds(book_id, title, search_rank, final_score) with weight: a seed's share of the positive scores, or equal shares.  A few rows."""
    total = seeds.agg(F.sum(F.greatest(F.lit(0.0), "final_score")).alias("total_"), F.count("*").alias("n_"))
    weight = F.when(F.col("total_") > 0, F.greatest(F.lit(0.0), "final_score") / F.col("total_")).otherwise(1.0 / F.col("n_"))
    return seeds.crossJoin(total).withColumn("weight", weight).drop("total_", "n_")


def reasons(seeds: DataFrame, edges: DataFrame, per_seed: int = 20) -> DataFrame:
    """One row for each seed and neighbour that is no seed: seed_id, seed_title, search_rank, weight, book_id, jaccard, contribution."""
    s = weighted_seeds(seeds).select(F.col("book_id").alias("src"), F.col("title").alias("seed_title"), "search_rank", "weight")
    near = both_ways(edges).join(F.broadcast(s), "src")
    near = near.withColumn("r_", F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), "dst"))).where(F.col("r_") <= per_seed)
    near = near.join(F.broadcast(s.select(F.col("src").alias("dst"))), "dst", "left_anti")
    return near.select(F.col("src").alias("seed_id"), "seed_title", "search_rank", "weight", F.col("dst").alias("book_id"), F.col("score").alias("jaccard"), (F.col("weight") * F.col("score")).alias("contribution"))


def suggestions(seeds: DataFrame, edges: DataFrame, books: DataFrame, limit: int = 10, per_seed: int = 20) -> DataFrame:
    """The best candidates with score, best_jaccard, supporting_seeds and their reasons, the strongest first."""
    one = F.struct((-F.col("contribution")).alias("minus"), "search_rank", "seed_id", "seed_title", "weight", "jaccard", "contribution")
    c = reasons(seeds, edges, max(limit, per_seed)).groupBy("book_id").agg(F.sum("contribution").alias("score"), F.max("jaccard").alias("best_jaccard"), F.count("*").alias("supporting_seeds"), F.sort_array(F.collect_list(one)).alias("reasons"))
    c = c.withColumn("reasons", F.transform("reasons", lambda x: x.dropFields("minus")))
    b = books.select(F.col("id").alias("book_id"), "title", "author", "language")
    return c.join(b, "book_id").orderBy(F.desc("score"), F.desc("best_jaccard"), F.desc("supporting_seeds"), F.lower("title"), "book_id").limit(limit)


def for_book(books: DataFrame, edges: DataFrame, book_id: int, limit: int = 10) -> DataFrame:
    """Suggestions from a single READY book."""
    seed = books.where((F.col("id") == book_id) & (F.col("status") == "READY")).select(F.col("id").alias("book_id"), "title", F.lit(1).alias("search_rank"), F.lit(1.0).alias("final_score"))
    return suggestions(seed, edges, books, limit, limit)
