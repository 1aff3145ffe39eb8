import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tomeweaver.operators import index, pagerank, recommend, search, similarity
from tomeweaver.plans import benchmark, registry
from tomeweaver.plans.engine import Engine, error_response
from tomeweaver.plans.registry import oracle_sql, queries
from tomeweaver.sources import catalog, corpus, store
from tomeweaver.streaming.incremental import index_arrivals

SF = "/root/testdata/sf0.001"
BOOKS = "id bigint, title string, author string, language string, word_count int, storage_key string, source_url string, content_sha256 string, content_bytes bigint, status string, text string"


def some_books(spark, texts):
    return spark.createDataFrame([(i, f"Book {i}", None, "en", 9, f"{i}.txt", None, str(hash(t)), len(t), "READY", t) for i, t in texts.items()], BOOKS)


def test_frequencies(spark):
    posts = index.postings(some_books(spark, {1: "Dog dog DOG, café CAFE cat.", 2: "dog 12", 3: ""}))
    assert {(r.book_id, r.term): r.occurrences for r in posts.collect()} == {(1, "dog"): 3, (1, "cafe"): 2, (1, "cat"): 1, (2, "dog"): 1}
    assert {r.term: r.document_frequency for r in index.document_frequency(posts).collect()} == {"dog": 2, "cafe": 1, "cat": 1}


def test_term_changes_meet_in_one_shuffle(spark):
    key = ["book_id", "term"]
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (None, "n", 1), (3, "c", 1), (3, "c", 1), (4, None, 1)], "book_id bigint, term string, occurrences int")
    new = spark.createDataFrame([(1, "a", 5), (1, "c", 1), (2, "a", 1), (None, "n", 1), (5, "x", 1), (4, None, 1)], "book_id bigint, term string, occurrences int")
    want = [(*r, "added") for r in new.join(old, key, "left_anti").select(*key).collect()] + [(*r, "removed") for r in old.join(new, key, "left_anti").select(*key).collect()]
    got = index.term_changes(old, new)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want)) and len(want) == 9
    assert "Join" not in got._jdf.queryExecution().sparkPlan().toString()


def test_stored_postings_are_dealt_out_by_size(spark, monkeypatch):
    texts = [(1, "dog Dog cat"), (1, "dog's dog"), (None, "cat cat"), (None, "cat"), (2, None), (3, "élan-vital")]
    b = spark.createDataFrame(texts, "id bigint, text string")
    want = {(1, "dog", 3), (1, "cat", 1), (1, "dog's", 1), (None, "cat", 3), (3, "elan-vital", 1)}
    once = b.where("id > 1")
    for got, w in ((index.postings(b), want), (index.postings_by_term(b, 3), want), (index.postings_by_term(once, 3), {x for x in want if x[0] == 3})):
        assert {tuple(r) for r in got.collect()} == w and got.count() == len(w)
    monkeypatch.setattr(registry, "PART", 20_000)
    monkeypatch.setattr(registry, "_STORED", {})
    posts = registry.stored_postings(spark, SF)
    assert len(posts.inputFiles()) > 2 * spark.sparkContext.defaultParallelism
    where = posts.select("term", F.input_file_name().alias("f")).distinct().groupBy("term").count()
    assert where.where("count > 1").isEmpty()


def test_matches(spark):
    t = spark.createDataFrame([(x,) for x in ("cat", "cot", "scatter", "cut", "dog", "man", "gentleman", "catalogue")], "term string")
    terms = lambda c: sorted(r.term for r in t.where(c).collect())
    assert terms(search.matches(spark, F.col("term"), "c(a|o)t")) == ["cat", "catalogue", "cot", "scatter"]
    assert terms(search.matches(spark, F.col("term"), "^CAT$")) == ["cat"]
    assert terms(search.contains(F.col("term"), "MAN")) == ["gentleman", "man"]


def ranked(spark, lex, scores, **settings):
    c = spark.createDataFrame([(b, s, 1) for b, s in lex.items()], "book_id bigint, lexical_score bigint, matched_terms bigint")
    r = spark.createDataFrame(list(scores.items()), "book_id bigint, score double") if scores else None
    return search.in_order(search.ranked(c, some_books(spark, {b: "" for b in lex}), r, corpus.Ranking(**settings))).collect()


def test_hybrid_rank(spark):
    assert [r.book_id for r in ranked(spark, {1: 100, 2: 95}, {1: 0.1, 2: 0.4})] == [2, 1]
    assert [r.book_id for r in ranked(spark, {1: 100, 2: 95}, None)] == [1, 2]
    assert ranked(spark, {1: 100, 2: 95}, {1: 0.0, 2: 0.0})[0].final_score == 1.0


def test_jaccard_choice(spark):
    counts = spark.createDataFrame([(1, 4), (2, 4), (3, 3)], "book_id bigint, features int")
    pairs = spark.createDataFrame([(1, 2, 2), (1, 3, 1), (2, 3, 2)], "a bigint, b bigint, shared int")
    scored = similarity.scored_pairs(pairs, counts)
    e = similarity.top_edges(scored, corpus.Similarity(min_score=0.0, neighbors=1)).collect()
    assert {(r.a, r.b) for r in e} == {(1, 2), (2, 3)} and {r.score for r in e if r.a == 1} == {2 / 6}
    assert corpus.Similarity().ceiling(5) == 3 and corpus.Similarity().ceiling(1664) == 167
    with pytest.raises(ValueError):
        corpus.Similarity(min_df=1)


def ranks(spark, nodes, edges, **kw):
    n = spark.createDataFrame([(x,) for x in nodes], "book_id bigint")
    e = spark.createDataFrame(edges, "a bigint, b bigint, weight double")
    return pagerank.pagerank(n, e, corpus.Ranking(tolerance=1e-12, max_iterations=200), **kw)


def test_pagerank(spark):
    two = {r.book_id: r.score for r in ranks(spark, [1, 2], [(1, 2, 0.7)]).scores.collect()}
    assert abs(two[1] - 0.5) < 1e-10 and abs(two[2] - 0.5) < 1e-10
    chain = {r.book_id: r.score for r in ranks(spark, [1, 2, 3], [(1, 2, 1.0), (2, 3, 1.0)]).scores.collect()}
    assert chain[2] > chain[1] and abs(chain[1] - chain[3]) < 1e-10
    lone = {r.book_id: r.score for r in ranks(spark, [1, 2, 3], [(1, 2, 1.0), (3, 3, 1.0), (1, 9, 1.0), (1, 3, 0.0)]).scores.collect()}
    assert lone[3] > 0 and abs(sum(lone.values()) - 1) < 1e-10


def test_pagerank_jobs_agree_with_kernel(spark):
    n = spark.createDataFrame([(x,) for x in range(4)], "book_id bigint")
    e = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.2)], "a bigint, b bigint, weight double")
    s = corpus.Ranking(max_iterations=3)
    a, b = (pagerank.pagerank(n, e, s, small) for small in (10**6, 0))
    assert np.allclose(a.deltas, b.deltas) and not a.converged
    assert np.allclose([r.score for r in a.scores.orderBy("book_id").collect()], [r.score for r in b.scores.orderBy("book_id").collect()])


def test_pagerank_in_parts_is_a_job_for_many_iterations(spark):
    rng = np.random.default_rng(5)
    pairs = {tuple(sorted(int(x) for x in p)) for p in rng.integers(0, 150, (400, 2)) if p[0] != p[1]}
    n = spark.createDataFrame([(x * 7,) for x in range(200)], "book_id bigint")
    e = spark.createDataFrame([(a * 7, b * 7, float(rng.uniform(0.05, 1))) for a, b in sorted(pairs)], "a bigint, b bigint, weight double")
    one = pagerank.pagerank(n, e)
    spark.sparkContext.setJobGroup("parts", "")
    many = pagerank.pagerank(n, e, small=300)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("parts"))
    spark.sparkContext.setJobGroup("others", "")
    assert one.converged and many.converged and many.iterations == one.iterations > 2 * pagerank.STRIDE
    assert jobs < one.iterations
    assert np.allclose(one.deltas, many.deltas, rtol=1e-6, atol=1e-14)
    rows = [{r.book_id: r.score for r in x.scores.collect()} for x in (one, many)]
    assert len(rows[0]) == len(rows[1]) == 200 and all(abs(rows[0][k] - rows[1][k]) < 1e-12 for k in rows[0])


def test_suggestions(spark):
    seeds = spark.createDataFrame([(1, "Seed A", 1, 1.0), (2, "Seed B", 2, 0.5)], "book_id bigint, title string, search_rank int, final_score double")
    edges = spark.createDataFrame([(1, 3, 0.6, 1, 1), (1, 4, 0.5, 1, 1), (1, 2, 0.95, 1, 1), (2, 3, 0.9, 1, 1), (2, 5, 0.4, 1, 1)], "a bigint, b bigint, score double, shared int, union_size int")
    got = recommend.suggestions(seeds, edges, some_books(spark, {i: "" for i in range(1, 6)})).collect()
    assert len(got) == 3 and got[0].book_id == 3 and abs(got[0].score - 0.7) < 1e-12 and got[0].supporting_seeds == 2
    assert [x.seed_id for x in got[0].reasons] == [1, 2]


def test_catalog_csv(tmp_path):
    head = "storage_key,title,author,language,source_url\n"
    e = catalog.parse_csv(head + 'any/path/opaque.txt,"This, not the file name","Author ""A""",en,\n\n')
    assert e == [{"storage_key": "any/path/opaque.txt", "title": "This, not the file name", "author": 'Author "A"', "language": "en", "source_url": None}]
    for bad in ("a.txt,T,,,\na.txt,T,,,", 'a.txt,"T"x,,,', 'a.txt,T"x,,,', 'a.txt,"T,,,', ",T,,,", "a.txt,,,,", "a.txt,T,,"):
        with pytest.raises(ValueError):
            catalog.parse_csv(head + bad)
    with pytest.raises(ValueError):
        catalog.parse_csv("key,title\n")
    path = str(tmp_path / "c.csv")
    assert catalog.write_csv_if_changed(path, e) and not catalog.write_csv_if_changed(path, e)
    assert catalog.parse_csv(open(path).read()) == e


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.txt").write_bytes(b"Book content")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    assert catalog.storage_keys(str(tmp_path)) == ["bad.txt", "sub/a.txt"] and catalog.storage_keys(str(tmp_path / "none")) == []
    for key in ("../outside.txt", "/tmp/outside.txt", "", None, "sub/./a.txt", "none.txt"):
        with pytest.raises(ValueError):
            catalog.resolve(str(tmp_path), key)
    rows = {r.storage_key: r for r in catalog.read_files(spark, str(tmp_path)).collect()}
    assert rows["sub/a.txt"].content_bytes == 12 and len(rows["sub/a.txt"].content_sha256) == 64 and rows["sub/a.txt"].valid
    assert not rows["bad.txt"].valid and rows["bad.txt"].text is None


def test_engine_end_to_end(spark, tmp_path):
    texts = {1: "kazan walked kazan north river snow", 2: "kazan river snow wolf north", 3: "river snow wolf tent", 4: "12 34"}
    e = Engine(spark, str(tmp_path), corpus.Similarity(min_length=3, neighbors=2))
    e.load(some_books(spark, texts))
    assert sorted(r.id for r in e.index_all(2).collect()) == [] and len(e.store.folders("postings")) == 1
    assert [r.id for r in e.index_all().collect()] == [4] and len(e.store.folders("postings")) == 2
    # the dictionary that the batches have built is the one that all postings give
    assert {(r.term, r.document_frequency) for r in e._table("terms").collect()} == {(r.term, r.document_frequency) for r in index.document_frequency(e._postings()).collect()}
    counts = e.rebuild_graph()
    assert counts["stored"] == e.graph_status()["edges"] > 0 and counts["candidates"] >= counts["qualifying"] >= counts["stored"]
    assert e.search("kazan").content.first().book_id == 1 and not e.search("kazan").pagerank_applied
    assert not e.ranking_status()["available"] and e.ranking_status()["stale"]
    result = e.rebuild_ranks()
    status = e.ranking_status()
    assert status["available"] and not status["stale"] and status["iterations"] == result.iterations and status["node_count"] == 4
    page = e.search("KAZAN", size=1)
    assert result.converged and page.total_elements == 2 and page.total_pages == 2 and page.pagerank_applied and page.pagerank_weight == 0.15
    assert [r.position for r in e.search("kazan", 1, 1).content.collect()] == [2]
    assert e.search("zebra").total_pages == 0 and e.search("zebra").content.count() == 0 and not e.search("zebra").pagerank_applied
    assert e.search_regex("r.v").total_elements == 3 and e.search_regex("r.v").matched_index_terms == 1
    assert e.suggestions("walked").count() >= 1 and e.book_suggestions(1).count() >= 1 and e.neighbors(4).count() == 0
    before = e.search("kazan").content.collect()
    e.compact()
    assert len(e.store.folders("postings")) == 1 and e.search("kazan").content.collect() == before
    e.rebuild_graph()
    assert e.current_ranks() is None and e.ranking_status()["stale"]
    e.rebuild_ranks()
    # a book indexed anew: the same postings, and what derives from them is gone
    assert e.index_book(1) == {"unique_terms": 5, "total_tokens": 6, "added": 0, "removed": 0}
    assert e.store.read("edges") is None and e.current_ranks() is None and e.search("kazan").total_elements == 2
    with pytest.raises(RuntimeError):
        e.index_book(4)
    for call in (e.book, e.index_book, e.neighbors, e.book_suggestions):
        with pytest.raises(LookupError):
            call(99)
    assert {(r.status, r.books) for r in e.count_by_status().collect()} == {("READY", 4)}
    assert error_response(LookupError("No book 9")) == (404, {"error": "No book 9"})
    assert [error_response(RuntimeError("x"), a)[0] for a in ("indexing", "ranking", "catalog", "search")] == [409, 400, 422, 400] and error_response(ValueError("x"))[0] == 400


def test_a_book_that_is_not_ready_is_not_found(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.load(some_books(spark, {1: "one two", 2: "three four"}).withColumn("status", F.when(F.col("id") == 1, "READY").otherwise("NEW")))
    e.index_all()
    assert e.status().first().indexed_books == 1 and e.book(1).count() == 1
    with pytest.raises(LookupError):
        e.book(2)
    with pytest.raises(RuntimeError):
        e.index_book(2)


def test_catalogue_generate_and_sync(spark, tmp_path):
    root, path = tmp_path / "books", str(tmp_path / "catalog.csv")
    root.mkdir()
    english = "the cat and the mouse in the house with his friends for a feast that was not on the roof of the town "
    (root / "a_river.txt").write_text("Title: The River\nAuthor: Jane Doe\nLanguage: French\n\n" + english * 50)
    (root / "b.txt").write_text("THE ROAD\n\nby Jules Verne\n\nCHAPTER I\n\n" + english * 50)
    e = Engine(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        e.sync_catalog(str(root), path, minimum=10)
    with pytest.raises(ValueError, match="least is"):
        e.sync_catalog(str(root), path)
    sync = lambda prune=False: e._sync(str(root), path, prune, 100)
    assert sync() == {"entries": 2, "inserted": 2, "updated": 0, "unchanged": 0, "deleted": 0, "graph_invalidated": True}
    got = {r.storage_key: r for r in e._table("books").collect()}
    assert (got["a_river.txt"].title, got["a_river.txt"].author, got["a_river.txt"].language) == ("The River", "Jane Doe", "fr")
    assert (got["b.txt"].title, got["b.txt"].author, got["b.txt"].language) == ("THE ROAD", "Jules Verne", "en") and sorted(r.id for r in got.values()) == [1, 2]
    e.index_all()
    e.rebuild_graph()
    assert sync() == {"entries": 2, "inserted": 0, "updated": 0, "unchanged": 2, "deleted": 0, "graph_invalidated": False} and e.store.read("edges") is not None
    # what the catalogue says stays; a changed text loses its postings; ids stay
    lines = open(path).read().replace("THE ROAD", "My Road")
    open(path, "w").write(lines)
    (root / "a_river.txt").write_text("Title: The River\n\n" + english * 60)
    (root / "c.txt").write_text("plain " * 200)
    assert sync() == {"entries": 3, "inserted": 1, "updated": 2, "unchanged": 0, "deleted": 0, "graph_invalidated": True}
    now = {r.storage_key: r for r in e._table("books").collect()}
    assert now["b.txt"].title == "My Road" and now["c.txt"].title == "c" and now["c.txt"].id == 3 and now["a_river.txt"].id == got["a_river.txt"].id
    assert {r.book_id for r in e._postings().select("book_id").distinct().collect()} == {now["b.txt"].id} and e.store.read("edges") is None
    (root / "b.txt").unlink()
    assert sync()["deleted"] == 0 and e._table("books").count() == 3
    assert sync(True)["deleted"] == 1 and e._table("books").count() == 2 and e._postings().isEmpty()
    assert e.catalog_status(path) == {"entries": 2, "ready_books": 2, "indexed_books": 0}


def test_pairs_are_counted_in_bounded_parts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    ids = [int(x) for x in [-(1 << 62), (1 << 62) + 1, 0, *rng.integers(-(1 << 61), 1 << 61, 37)]]
    terms = {b: {int(t) for t in rng.integers(0, 60, rng.choice([1, 4, 30]))} for b in ids}
    rows = [(b, f"term{t}") for b in ids for t in terms[b]] + [(None, "term1"), (None, "term2")]
    features = spark.createDataFrame(rows, "book_id bigint, term string")
    monkeypatch.setattr(similarity, "PART", 100)
    monkeypatch.setattr(similarity, "BATCH", 50)
    seen, count = [], similarity._counts

    def watched(*args):
        sizes = spark.sparkContext.accumulator(0)
        seen.append(sizes)

        def run(t):
            sizes.add(1)
            return count(*args)(t)

        return run

    monkeypatch.setattr(similarity, "_counts", watched)
    shared = {(a, b): len(terms[a] & terms[b]) for a in ids for b in ids if a < b}
    for least in (0.0, 0.05, 0.2):
        got = {(r.a, r.b): r for r in similarity.qualifying_pairs(features, 2, least).collect()}
        want = {k: n for k, n in shared.items() if n >= 2 and n / len(terms[k[0]] | terms[k[1]]) >= least}
        assert {k: r.shared for k, r in got.items()} == want
        assert all(r.union_size == len(terms[a] | terms[b]) and r.score == r.shared / r.union_size for (a, b), r in got.items())
    assert len(seen) == 3 and all(x.value > 10 for x in seen)
    assert {(r.a, r.b): r.shared for r in similarity.pair_intersections(features).collect()} == {k: n for k, n in shared.items() if n >= 2}
    assert similarity.pair_intersections(features.where("term = 'none'")).isEmpty()


def test_graph_of_bounded_pairs_is_the_graph_of_all(spark):
    import random

    rng = random.Random(4)
    rows = [(b, f"term{t}", 1) for b in range(80) for t in {rng.randrange(200) for _ in range(rng.choice([3, 8, 40, 120]))}]
    posts = spark.createDataFrame(rows, "book_id bigint, term string, occurrences int")
    for s in (corpus.Similarity(max_df_ratio=1.0), corpus.Similarity(max_df_ratio=1.0, min_score=0.3, neighbors=2), corpus.Similarity(max_df_ratio=1.0, min_score=0.0)):
        want = similarity.build_stats(posts, s).edges
        assert sorted(similarity.build_graph(posts, s).collect()) == sorted(want.collect())


def test_titles_with_odd_line_ends(tmp_path):
    head = "storage_key,title,author,language,source_url\n"
    assert catalog.parse_csv(head + "a.txt,one\u0085two\u2028three\x0bfour\x0cfive,,,\r\nb.txt,T,,,\rc.txt,U,,,")[0]["title"] == "one\u0085two\u2028three\x0bfour\x0cfive"


def test_migration(spark):
    b = spark.createDataFrame([(1, "/data/a/x.txt", "READY"), (2, "C:\\b\\y.txt", "READY"), (3, "z.txt", "FAILED")], "id bigint, local_path string, status string")
    assert {(r.id, r.storage_key) for r in catalog.migrated(b).collect()} == {(1, "x.txt"), (2, "y.txt")}


def test_benchmark_files(spark, tmp_path):
    paths = benchmark.run(spark, SF, str(tmp_path))
    lines = [open(p, encoding="utf-8").read().splitlines() for p in paths]
    assert [x[0] for x in lines] == ["books,milliseconds", "iteration,delta", "kind,query,milliseconds", "rank,term,frequency"]
    assert len(lines[1]) == 21 and len(lines[2]) == 11 and len(lines[3]) == 1001


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError):
        store.shared_dir(Session)


def test_sync_is_idempotent(spark):
    b = some_books(spark, {1: "a", 2: "b"}).select(*catalog.COLUMNS, "content_sha256")
    assert {r.action for r in catalog.sync_diff(b, b).collect()} == {"unchanged"}
    assert {(r.storage_key, r.action, r.dirty) for r in catalog.sync_diff(b, b.where("storage_key = '1.txt'"), True).collect()} == {("1.txt", "unchanged", False), ("2.txt", "delete", True)}


def test_stream_equals_batch(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([(1, "a cat"), (2, "a dog")], "doc_id bigint, text string")
    docs.write.parquet(src)
    index_arrivals(spark, src, "doc_id bigint, text string", sink, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(sink).select("book_id", "term", "occurrences")
    want = index.postings(docs.withColumnRenamed("doc_id", "id"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", ["term_frequencies", "simple_search_lexical", "similarity_edges", "pagerank_10_iters", "catalog_merge", "detect_language"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as from '{SF}/documents.parquet'")
    a, b = queries()[name](spark, SF).toPandas(), con.sql(oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda x: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in x[cols].itertuples(index=False))
    assert rows(a) == rows(b)
