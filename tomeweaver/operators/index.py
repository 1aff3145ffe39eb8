"""Inverted index: term and document frequencies, changes to them, and status."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN, canonical
from ..sources.corpus import READY

#: Postings that a batch between Python and the JVM holds, or those of one text.
BATCH = 200_000


def counted(books: DataFrame) -> DataFrame:
    """books(id, text) -> book_id, term, occurrences in each row's text, counted where the text is read."""
    kind = books.schema["id"].dataType.simpleString()

    def run(batches):
        find = re.compile(TOKEN).findall
        for b in batches:
            ids, places, terms, counts = b.column("id"), [], [], []

            def out():
                return pa.RecordBatch.from_arrays([ids.take(pa.array(places, pa.int64())), pa.array(terms, pa.string()), pa.array(counts, pa.int32())], ["book_id", "term", "occurrences"])

            for i, text in enumerate(b.column("text")):
                n = Counter(find(text.as_py()))
                places += [i] * len(n)
                terms += n.keys()
                counts += n.values()
                if len(terms) >= BATCH:
                    yield out()
                    places, terms, counts = [], [], []
            if terms:
                yield out()

    return books.select("id", canonical(F.col("text")).alias("text")).mapInArrow(run, f"book_id {kind}, term string, occurrences int")


def merged(counts: DataFrame) -> DataFrame:
    """One row for a book and term, where several rows of texts have the same id."""
    return counts.groupBy("book_id", "term").agg(F.sum("occurrences").cast("int").alias("occurrences"))


def postings(books: DataFrame) -> DataFrame:
    """books(id, text) -> book_id, term, occurrences."""
    return merged(counted(books))


def postings_by_term(books: DataFrame, parts: int) -> DataFrame:
    """The same, dealt out by term over so many parts and sorted in each; only ids that repeat have their counts merged."""
    dealt = counted(books).repartition(parts, "term")
    once = books.groupBy("id").count().where("count > 1").isEmpty()
    return (dealt if once else merged(dealt)).sortWithinPartitions("term")


def failures(books: DataFrame, index: DataFrame) -> DataFrame:
    """Books that gave no token."""
    return books.join(index.select(F.col("book_id").alias("id")), "id", "left_anti")


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").cast("int").alias("document_frequency"))


def changed_frequency(frequency: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Document frequencies after postings were added and removed; terms without any go."""
    delta = frequency.select("term", F.col("document_frequency").cast("bigint").alias("n"))
    delta = delta.unionAll(added.select("term", F.lit(1).cast("bigint"))).unionAll(removed.select("term", F.lit(-1).cast("bigint")))
    return delta.groupBy("term").agg(F.sum("n").cast("int").alias("document_frequency")).where("document_frequency > 0")


def term_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Postings only in new (added) or only in old (removed): book_id, term, change.  Both meet in one shuffle; a null id equals none."""
    sides = new.select("book_id", "term", F.lit("added").alias("change")).unionAll(old.select("book_id", "term", F.lit("removed")))
    met = sides.groupBy("book_id", "term").agg(F.count_if(F.col("change") == "added").alias("new"), F.count_if(F.col("change") == "removed").alias("old"))
    loose = F.col("book_id").isNull() | F.col("term").isNull()
    # as many rows as a join that keeps each side's rows without a partner would leave
    added, removed = (F.when(loose | (F.col(other) == 0), F.array_repeat(F.lit(change), F.col(side).cast("int"))).otherwise(F.array()) for change, side, other in (("added", "new", "old"), ("removed", "old", "new")))
    return met.select("book_id", "term", F.explode(F.concat(added, removed)).alias("change"))


def reindexed(index: DataFrame, books: DataFrame) -> DataFrame:
    """The index with these books' postings in place of their old ones."""
    return index.join(books.select(F.col("id").alias("book_id")), "book_id", "left_anti").unionByName(postings(books))


def stats(index: DataFrame) -> DataFrame:
    return index.groupBy("book_id").agg(F.count("*").alias("unique_terms"), F.sum("occurrences").alias("total_tokens"))


def indexed(books: DataFrame, index: DataFrame) -> DataFrame:
    return books.join(index.select(F.col("book_id").alias("id")), "id", "left_semi")


def pending(books: DataFrame, index: DataFrame, limit: int = 50) -> DataFrame:
    """The next READY books without postings, by id."""
    if not 1 <= limit <= 2000:
        raise ValueError("The number of books must be from 1 to 2000")
    return books.where(F.col("status") == READY).join(index.select(F.col("book_id").alias("id")), "id", "left_anti").orderBy("id").limit(limit)


def status(books: DataFrame, index: DataFrame) -> DataFrame:
    ready = books.where(F.col("status") == READY)
    done = indexed(ready, index).agg(F.count("*").alias("indexed_books"))
    terms = index.agg(F.countDistinct("term").alias("terms"), F.count("*").alias("postings"))
    return ready.agg(F.count("*").alias("ready_books")).crossJoin(done).crossJoin(terms).select("ready_books", "indexed_books", (F.col("ready_books") - F.col("indexed_books")).alias("pending_books"), "terms", "postings")  # one row each


def postings_for(index: DataFrame, term: str) -> DataFrame:
    return index.where(F.col("term") == term).orderBy(F.desc("occurrences"), "book_id")
