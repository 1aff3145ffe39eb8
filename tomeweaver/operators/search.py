"""Dictionary match, lexical score, hybrid rank and pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import checked_pattern, keyword
from ..sources.corpus import READY, Ranking


def contains(term: Column, query: str) -> Column:
    return F.contains(term, F.lit(keyword(query)))


def matches(spark, term: Column, regex: str) -> Column:
    return F.rlike(term, F.lit("(?i)" + checked_pattern(spark, regex)))


def lexical(index: DataFrame, match: Column) -> DataFrame:
    """book_id, lexical_score, matched_terms.  The predicate runs in the scan of the postings."""
    return index.where(match).groupBy("book_id").agg(F.sum("occurrences").alias("lexical_score"), F.count("*").alias("matched_terms"))


def lexical_of(postings: DataFrame, terms: DataFrame, few: bool) -> DataFrame:
    """book_id, lexical_score, matched_terms of these terms(term); ``few`` says that they may be broadcast."""
    found = postings.join(F.broadcast(terms) if few else terms, "term", "left_semi")
    return found.groupBy("book_id").agg(F.sum("occurrences").alias("lexical_score"), F.count("*").alias("matched_terms"))


def ranked(candidates: DataFrame, books: DataFrame, ranks: DataFrame | None = None, settings: Ranking = Ranking()) -> DataFrame:
    """Candidates with normalised and final scores.  ranks(book_id, score) are current scores, or None if there are none."""
    lw, pw = settings.weights
    c = candidates.join(books.where(F.col("status") == READY).select(F.col("id").alias("book_id"), "title", "author", "language", "word_count"), "book_id")
    top = candidates.agg(F.max("lexical_score").cast("double").alias("top_"))  # one row
    c = c.crossJoin(F.broadcast(top)).withColumn("normalized_lexical", F.when(F.col("top_") > 0, F.col("lexical_score") / F.col("top_")).otherwise(0.0))
    if ranks is None:
        c = c.withColumns({"pagerank": F.lit(0.0), "normalized_pagerank": F.lit(0.0), "final_score": F.col("normalized_lexical")})
    else:
        best = ranks.agg(F.max("score").alias("best_"))  # one row
        c = c.join(ranks.select("book_id", F.col("score").alias("pagerank")), "book_id", "left").fillna({"pagerank": 0.0}).crossJoin(F.broadcast(best))
        use = F.coalesce(F.col("best_") > 0, F.lit(False))
        c = c.withColumn("normalized_pagerank", F.when(use, F.col("pagerank") / F.col("best_")).otherwise(0.0))
        c = c.withColumn("final_score", F.when(use, F.col("normalized_lexical") * lw + F.col("normalized_pagerank") * pw).otherwise(F.col("normalized_lexical"))).drop("best_")
    return c.drop("top_")


ORDER = (F.desc, ("final_score", "lexical_score", "matched_terms"))


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("final_score"), F.desc("lexical_score"), F.desc("matched_terms"), F.lower("title"), "book_id")


def page_of(rows: DataFrame, page: int, size: int) -> DataFrame:
    """A page of ordered rows: page from 0, size held within 1 and 100."""
    page, size = max(page, 0), min(max(size, 1), 100)
    return in_order(rows).offset(page * size).limit(size)


@dataclass
class SearchPage:
    query: str
    page: int
    size: int
    total_elements: int
    total_pages: int
    matched_index_terms: int
    pagerank_applied: bool
    lexical_weight: float
    pagerank_weight: float
    content: DataFrame
