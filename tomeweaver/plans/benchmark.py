"""Timings of the engine's parts over a corpus, as four CSV files: graph, PageRank, dictionary search, and word frequencies."""

from __future__ import annotations

import csv
import os
import time
from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import search, similarity
from ..sources.corpus import Similarity
from . import registry

#: Sizes of the graph's runs, and searches.
PREFIXES, WORDS, PATTERNS = (100, 300, 500, 1000), ("man", "adventure", "love", "time", "night"), ("m(an|en)", "l[a-z]+e", "t[a-z]+e", "n[a-z]+t", "a[a-z]+d")


def _write(path: str, names: list[str], rows: Iterable[tuple]) -> None:
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(names)
        out.writerows(rows)


def _ms(run) -> int:
    start = time.perf_counter()
    run()
    return round(1000 * (time.perf_counter() - start))


def run(spark: SparkSession, sf_dir: str, out: str) -> list[str]:
    """Writes bench_jaccard.csv, bench_pagerank.csv, bench_search.csv and bench_zipf.csv into the driver's folder ``out``; their paths."""
    os.makedirs(out, exist_ok=True)
    paths = {n: os.path.join(out, f"bench_{n}.csv") for n in ("jaccard", "pagerank", "search", "zipf")}
    posts, terms = registry.stored_postings(spark, sf_dir), registry.dictionary(spark, sf_dir)
    books = posts.agg(F.countDistinct("book_id")).first()[0]
    sizes = [n for n in PREFIXES if n < books] + [None]
    some = lambda n: posts if n is None else posts.where(F.col("book_id") < n)
    _write(paths["jaccard"], ["books", "milliseconds"], [(books if n is None else n, _ms(lambda n=n: similarity.build_graph(some(n), Similarity()).count())) for n in sizes])
    _write(paths["pagerank"], ["iteration", "delta"], [(r.iteration, r.delta) for r in registry.pagerank_convergence(spark, sf_dir).collect()])
    searches = [("kmp", w, search.contains(F.col("term"), w)) for w in WORDS] + [("regex", p, search.matches(spark, F.col("term"), p)) for p in PATTERNS]
    _write(paths["search"], ["kind", "query", "milliseconds"], [(k, q, _ms(lambda m=m: terms.where(m).count())) for k, q, m in searches])
    _write(paths["zipf"], ["rank", "term", "frequency"], [(r["rank"], r.term, r.frequency) for r in registry.zipf_top1000(spark, sf_dir).orderBy("rank").collect()])
    return list(paths.values())
