"""The engine as one object: catalogue, index, search, suggestions, graph and ranking over stored tables.

Tables in the store: books (with their texts), postings (a folder for each batch of books, sorted by term), terms (the
dictionary with document frequencies), edges and ranks, and one row of state for each of the last two.  Errors:
``LookupError`` for what is not there, ``ValueError`` for a wrong argument, ``RuntimeError`` for a wrong state; see
``error_response``.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import checked_pattern, keyword
from ..operators import index, pagerank, recommend, search, similarity
from ..sources import catalog
from ..sources.corpus import BOOKS, READY, Ranking, Similarity, Suggestions
from ..sources.store import Store, dropped, written

POSTINGS = "book_id bigint, term string, occurrences int"
#: Matched terms that are broadcast to the postings; more are joined by a shuffle.
FEW_TERMS = 200_000
PRIVATE = ["text", "storage_key", "content_sha256"]
#: The status of an error of a wrong state in each area.
CONFLICT = {"indexing": 409, "similarity": 409, "ranking": 400, "catalog": 422}


def error_response(error: Exception, area: str = "search") -> tuple[int, dict[str, str]]:
    """Status and body for an error of the engine, as an HTTP layer would send them."""
    status = 404 if isinstance(error, LookupError) else CONFLICT.get(area, 400) if isinstance(error, RuntimeError) else 400
    return status, {"error": str(error.args[0] if error.args else error)}


def _now() -> datetime.datetime:
    return datetime.datetime.now()


class Engine:
    def __init__(self, spark: SparkSession, root: str, similarity_settings: Similarity = Similarity(), ranking: Ranking = Ranking(), suggestion_settings: Suggestions = Suggestions()):
        self.spark, self.store = spark, Store(spark, root)
        self.similarity, self.ranking, self.suggestion = similarity_settings, ranking, suggestion_settings

    def _table(self, name: str) -> DataFrame:
        df = self.store.read(name)
        if df is None:
            raise LookupError(f"There is no table {name} yet")
        return df

    def _postings(self) -> DataFrame:
        found = self.store.read("postings")
        return self.spark.createDataFrame([], POSTINGS) if found is None else found

    def _ready(self) -> DataFrame:
        return self._table("books").where(F.col("status") == READY)

    def _state(self, name: str) -> Row | None:
        df = self.store.read(name)
        return None if df is None else df.first()

    def _put_state(self, name: str, **values) -> None:
        self.store.replace(name, self.spark.createDataFrame([Row(**values)]))

    # catalogue

    def load(self, books: DataFrame) -> None:
        """Takes books with their text; new or changed texts lose their postings."""
        old = self.store.read("books")
        self.store.replace("books", books)
        if old is not None:
            self._keep_postings(old, self._table("books"))

    def _keep_postings(self, old: DataFrame, new: DataFrame) -> bool:
        """Drops the postings of books that went or whose text changed; whether there were such books."""
        same = old.join(new.select("id", "content_sha256"), ["id", "content_sha256"], "left_semi")
        if old.count() == same.count():
            return False
        kept = self.store.read("postings")
        if kept is not None:
            self._replace_postings(kept.join(same.select(F.col("id").alias("book_id")), "book_id", "left_semi"))
        return True

    def generate_catalog(self, root: str, path: str) -> dict[str, int | bool]:
        """Brings the catalogue file in line with the text files under ``root``."""
        return catalog.generate(self.spark, root, path)

    def sync_catalog(self, root: str, path: str, prune: bool = False, minimum: int = catalog.MIN_WORDS) -> dict[str, int | bool]:
        """Generates the catalogue, reads its files and takes them as books.

        Books whose text changed lose their postings; with ``prune`` books that are in no entry go, with all that derives
        from them, never their files.  New, changed or lost texts drop graph and ranks.
        """
        if minimum < catalog.MIN_WORDS:
            raise ValueError(f"The least number of words must be {catalog.MIN_WORDS} or more")
        return self._sync(root, path, prune, minimum)

    def _sync(self, root: str, path: str, prune: bool, minimum: int) -> dict[str, int | bool]:
        self.generate_catalog(root, path)
        rows = written(catalog.book_rows(catalog.read_files(self.spark, root), catalog.read_csv(self.spark, path)), "catalog-rows")
        catalog.checked(rows, minimum)
        old = self.store.read("books")
        old = self.spark.createDataFrame([], BOOKS + ", text string") if old is None else old
        diff = written(catalog.sync_diff(old, rows, prune), "catalog-diff")
        n = {r.action: r.books for r in catalog.sync_counts(diff).collect()}
        dirty = n.get("insert", 0) > 0 or not diff.where("dirty").isEmpty()
        if set(n) - {"unchanged", "keep"}:
            self.store.replace("books", catalog.synced(old, rows.drop("valid"), diff))
            self._keep_postings(old, self._table("books"))
        if dirty:
            for name in ("edges", "edges_state", "ranks", "ranks_state"):
                self.store.drop(name)
        dropped(diff)
        entries = rows.count()
        dropped(rows)
        return {"entries": entries, "inserted": n.get("insert", 0), "updated": n.get("update", 0), "unchanged": n.get("unchanged", 0), "deleted": n.get("delete", 0), "graph_invalidated": dirty}

    def catalog_status(self, path: str) -> dict[str, int]:
        """Entries of the catalogue file, READY books and those of them that are indexed."""
        ready = self._ready() if self.store.folders("books") else self.spark.createDataFrame([], BOOKS)
        return {"entries": catalog.read_csv(self.spark, path).count(), "ready_books": ready.count(), "indexed_books": index.indexed(ready, self._postings()).count()}

    # index

    def _replace_postings(self, postings: DataFrame) -> None:
        self.store.replace("postings", postings.repartitionByRange("term").sortWithinPartitions("term"))
        self._count_terms()

    def _count_terms(self) -> None:
        # a row a term, from partial counts of each task
        self.store.replace("terms", index.document_frequency(self._postings()))

    def index_all(self, max_books: int = 50) -> DataFrame:
        """Indexes the next READY books without postings, as a folder of their own; returns those without a token.

        The dictionary takes up the batch's own counts; the postings of earlier batches are not read or written again.
        """
        books, old = self._table("books"), self._postings()
        todo = written(index.pending(books, old, max_books).select("id", "title", "text"), "index-todo")
        terms = self.store.read("terms")
        new = written(index.postings(todo), "index-batch")
        self.store.append("postings", new.sortWithinPartitions("term"))
        added = index.document_frequency(new)
        if terms is not None:
            added = terms.unionByName(added).groupBy("term").agg(F.sum("document_frequency").cast("int").alias("document_frequency"))
        self.store.replace("terms", added)
        without = written(index.failures(todo.select("id", "title"), new), "index-failures")
        dropped(new)
        dropped(todo)
        return without

    def index_book(self, book_id: int) -> dict[str, int]:
        """Indexes a READY book anew, in place of its postings; what came and went among its terms."""
        book = self._table("books").where(F.col("id") == book_id)
        if book.isEmpty():
            raise LookupError(f"No book {book_id}")
        if book.where(F.col("status") == READY).isEmpty():
            raise RuntimeError(f"Book {book_id} is not {READY}")
        old = self._postings()
        new = written(index.postings(book.select("id", "text")), "index-book")
        if new.isEmpty():
            raise RuntimeError(f"Book {book_id} has no token")
        n = {r.change: r["count"] for r in index.term_changes(old.where(F.col("book_id") == book_id), new).groupBy("change").count().collect()}
        self._replace_postings(old.where(F.col("book_id") != book_id).unionByName(new))
        got = index.stats(new).first()
        dropped(new)
        return {"unique_terms": got.unique_terms, "total_tokens": got.total_tokens, "added": n.get("added", 0), "removed": n.get("removed", 0)}

    def compact(self) -> None:
        """The postings of all batches as one folder, dealt out by term, so that a search reads the parts of its terms."""
        postings, edges, ranks = self._table("postings"), self.store.folders("edges"), self.store.folders("ranks")
        states = {n: self.store.folders(n) for n in ("edges_state", "ranks_state")}
        self._replace_postings(postings)
        for name, folders in (("edges", edges), ("edges_state", states["edges_state"]), ("ranks", ranks), ("ranks_state", states["ranks_state"])):
            if folders:  # the postings are the same, so what derives from them stands
                self.store._point(name, folders)

    def status(self) -> DataFrame:
        return index.status(self._table("books"), self._postings())

    # graph and ranking

    def rebuild_graph(self) -> dict[str, int]:
        """Builds the graph of the whole index; its candidates, those over the least score, and the edges stored."""
        stats = similarity.build_stats(self._table("postings"), self.similarity)
        self.store.replace("edges", stats.edges.orderBy("a", "b"))
        self._put_state("edges_state", built_at=_now(), candidates=stats.candidates, qualifying=stats.qualifying, stored=self._table("edges").count())
        s = self._state("edges_state")
        return {"candidates": s.candidates, "qualifying": s.qualifying, "stored": s.stored}

    def graph_status(self) -> dict[str, object]:
        """Eligible terms, edges, books that have one, and when the graph was built (None without one)."""
        state, edges = self._state("edges_state"), self.store.read("edges")
        out = {"indexed_books": self._postings().select("book_id").distinct().count(), "edges": 0, "connected_books": 0, "built_at": state.built_at if state else None}
        if edges is not None:
            r = similarity.status(edges).first()
            out |= {"edges": r.edges, "connected_books": r.connected_books}
        return out

    def rebuild_ranks(self) -> pagerank.Result:
        nodes = self._ready().select(F.col("id").alias("book_id"))
        n = nodes.count()
        if n == 0:
            raise RuntimeError("At least one READY book is required")
        edges = self._table("edges").select("a", "b", F.col("score").alias("weight"))
        result = pagerank.pagerank(nodes, edges, self.ranking)
        self.store.replace("ranks", result.scores)
        s = self.ranking
        self._put_state("ranks_state", computed_at=_now(), damping=s.damping, tolerance=s.tolerance, max_iterations=s.max_iterations, iterations=result.iterations, converged=result.converged, final_delta=result.deltas[-1] if result.deltas else 0.0, node_count=n, edge_count=edges.count())
        return result

    def ranking_status(self) -> dict[str, object]:
        """Counts, the last run, and whether its scores are available (one for each READY book) and stale (older than the graph)."""
        state, graph, ranks, edges = self._state("ranks_state"), self._state("edges_state"), self.store.read("ranks"), self.store.read("edges")
        ready, scores = self._ready().count(), 0 if ranks is None else ranks.count()
        available = state is not None and scores == ready > 0
        stale = not available or (graph is not None and state.computed_at < graph.built_at)
        run = state.asDict() if state else dict.fromkeys(("computed_at", "iterations", "converged", "final_delta", "node_count", "edge_count"))
        lw, pw = self.ranking.weights
        return {"ready_books": ready, "similarity_edges": 0 if edges is None else edges.count(), "stored_scores": scores, "available": available, "stale": stale, "similarity_built_at": graph.built_at if graph else None, "lexical_weight": lw, "pagerank_weight": pw} | run

    def current_ranks(self) -> DataFrame | None:
        """Scores, if a run gave one to each READY book and no graph is newer than it."""
        state, graph, ranks = self._state("ranks_state"), self._state("edges_state"), self.store.read("ranks")
        if state is None or ranks is None:
            return None
        ready = self._ready().count()
        fresh = graph is None or state.computed_at >= graph.built_at
        return ranks if fresh and state.node_count == ready and ranks.count() == ready else None

    def top_ranked(self, limit: int = 20) -> DataFrame:
        return pagerank.top(self._table("ranks"), self._table("books"), limit)

    # search

    def _search(self, query: str, match: Column, page: int, size: int) -> search.SearchPage:
        """The dictionary is scanned for the terms, and the postings once for theirs; the rest reads the candidates."""
        page, size = max(page, 0), min(max(size, 1), 100)
        terms = written(self._table("terms").where(match).select("term"), "search-terms")
        n_terms = terms.count()
        found = written(search.lexical_of(self._table("postings"), terms, n_terms <= FEW_TERMS), "search-candidates")
        total, ranks = found.count(), self.current_ranks()
        best = ranks.agg(F.max("score")).first()[0] if ranks is not None and total else None
        applied = best is not None and best > 0
        rows = search.ranked(found, self._table("books"), ranks if applied else None, self.ranking)
        lw, pw = self.ranking.weights if applied else (1.0, 0.0)
        content = search.page_of(rows, page, size)
        place = F.row_number().over(W.orderBy(F.desc("final_score"), F.desc("lexical_score"), F.desc("matched_terms"), F.lower("title"), "book_id"))  # one page of rows
        return search.SearchPage(query, page, size, total, -(-total // size), n_terms, applied, lw, pw, content.withColumn("position", F.lit(page * size) + place))

    def search(self, q: str, page: int = 0, size: int = 20) -> search.SearchPage:
        return self._search(keyword(q), search.contains(F.col("term"), q), page, size)

    def search_regex(self, regex: str, page: int = 0, size: int = 20) -> search.SearchPage:
        return self._search(checked_pattern(self.spark, regex), search.matches(self.spark, F.col("term"), regex), page, size)

    def _suggest(self, found: search.SearchPage, limit: int) -> DataFrame:
        rows = found.content.orderBy("position").select("book_id", "title", "final_score").collect()  # the seeds, five at most
        seeds = self.spark.createDataFrame([(r.book_id, r.title, i, r.final_score) for i, r in enumerate(rows, 1)], "book_id bigint, title string, search_rank int, final_score double")
        return recommend.suggestions(seeds, self._table("edges"), self._table("books"), limit, self.suggestion.neighbors_per_seed)

    def suggestions(self, q: str, seeds: int = 3, limit: int = 10) -> DataFrame:
        self.suggestion.check(seeds, limit)
        return self._suggest(self.search(q, 0, seeds), limit)

    def regex_suggestions(self, regex: str, seeds: int = 3, limit: int = 10) -> DataFrame:
        self.suggestion.check(seeds, limit)
        return self._suggest(self.search_regex(regex, 0, seeds), limit)

    def book_suggestions(self, book_id: int, limit: int = 10) -> DataFrame:
        self.suggestion.check(1, limit)
        self.book(book_id)
        return recommend.for_book(self._table("books"), self._table("edges"), book_id, limit)

    def neighbors(self, book_id: int, limit: int = 10) -> DataFrame:
        if self._table("books").where(F.col("id") == book_id).isEmpty():
            raise LookupError(f"No book {book_id}")
        return similarity.neighbors(self._table("edges"), book_id, limit)

    # books

    def book(self, book_id: int) -> DataFrame:
        found = self._ready().where(F.col("id") == book_id)
        if found.isEmpty():
            raise LookupError(f"No book {book_id}")
        return found.drop(*PRIVATE)

    def books(self, page: int = 0, size: int = 20) -> DataFrame:
        page, size = max(page, 0), min(max(size, 1), 100)
        return self._ready().drop(*PRIVATE).orderBy("id").offset(page * size).limit(size)

    def count_by_status(self) -> DataFrame:
        return self._table("books").groupBy("status").agg(F.count("*").alias("books"))

    def health(self) -> dict[str, str]:
        return {"status": "UP"}
