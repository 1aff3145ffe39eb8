"""The registry's queries in DuckDB's SQL."""

from __future__ import annotations

from ..functions import language
from ..functions.text import MULTIPLE, SINGLE, TOKEN
from ..sources.corpus import STOP_WORDS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical(col: str) -> str:
    c = f"translate(coalesce({col}, ''), {_q(''.join(SINGLE))}, {_q(''.join(SINGLE.values()))})"
    for k, v in MULTIPLE.items():
        c = f"replace({c}, {_q(k)}, {_q(v)})"
    return f"lower(strip_accents({c}))"


def _posts(name: str, col: str, where: str = "true") -> str:
    return f"{name} as materialized (select doc_id book_id, term, count(*)::integer occurrences from (select doc_id, unnest(regexp_extract_all({_canonical(col)}, {_q(TOKEN)})) term from documents where {where}) group by all)"


TITLE = "'doc ' || lpad(doc_id::varchar, 7, '0')"
KEY = "'doc_' || lpad(doc_id::varchar, 7, '0') || '.txt'"
WORDS = "len(regexp_extract_all(coalesce(text, ''), '\\p{L}+(?:[''’\\-]\\p{L}+)*'))::integer"
STOP = ", ".join(map(_q, STOP_WORDS))
POSTS = _posts("posts", "text")
BOOKS = f"books as (select doc_id id, {TITLE} title, null::varchar author, lang as language, {WORDS} word_count, {KEY} storage_key, null::varchar source_url, sha256(coalesce(text, '')) content_sha256, strlen(coalesce(text, ''))::bigint content_bytes, 'READY' status from documents)"
DF = "df as (select term, count(*)::integer document_frequency from posts group by term)"
ELIGIBLE = f"eligible as (select * from df where document_frequency between 2 and (select least(200, greatest(3, ceil(count(distinct book_id) * 0.1::double)))::integer from posts) and length(term) >= 3 and term not in ({STOP}))"
FEATURES = "features as (select book_id, term from posts join eligible using (term)), counts as (select book_id, count(*)::integer features from features group by book_id)"
INTER = "inter as (select x.book_id a, y.book_id b, count(*)::integer shared from features x join features y on x.term = y.term and x.book_id < y.book_id group by all having count(*) >= 2)"
PAIRS = "pairs as (select a, b, shared::double / (p.features + q.features - shared) score, shared, (p.features + q.features - shared)::integer union_size from inter join counts p on p.book_id = a join counts q on q.book_id = b)"
EDGES = """ends as (select *, unnest([a, b]) node from pairs where score >= 0.05),
edges as (select distinct a, b, score, shared, union_size from (select *, row_number() over (partition by node order by score desc, shared desc, a desc, b desc) r from ends) where r <= 20),
both_ways as (select a src, b dst, score from edges union all select b, a, score from edges)"""
GRAPH = f"{POSTS}, {DF}, {ELIGIBLE}, {FEATURES}, {INTER}, {PAIRS}, {EDGES}"


def _pagerank(iterations: int) -> str:
    return f"""{GRAPH}, n as (select count(*) c from documents),
degree as (select src, sum(score) d from both_ways group by src),
flow as (select b.src, b.dst, b.score / d.d share, d.d from both_ways b join degree d using (src) union all select doc_id, doc_id, 0, d.d from documents left join degree d on d.src = doc_id),
pr(i, book_id, r) as (select 0, doc_id, 1.0::double / c from documents, n
  union all select s.i + 1, f.dst, (0.15::double + 0.85::double * s.loose) / max(n.c) + 0.85::double * sum(s.r * f.share)
  from (select i, book_id, r, sum(case when degree.d is null then r else 0 end) over () loose from pr left join degree on degree.src = pr.book_id where i < {iterations}) s join flow f on f.src = s.book_id cross join n group by s.i, f.dst, s.loose)"""


def _ranks(iterations: int) -> str:
    return f"{_pagerank(iterations)}, ranks as (select book_id, r score from pr where i = {iterations})"


def _lexical(match: str) -> str:
    return f"lex as (select book_id, sum(occurrences)::bigint lexical_score, count(*) matched_terms from posts where {match} group by book_id)"


THE, MEN = "contains(term, 'the')", "regexp_matches(term, 'm(an|en)', 'i')"
EDGE_OUT = "select a, b, round(score, 12) score, shared, union_size from edges"
#: Iterations that the default tolerance takes at sf0.01.
FULL = 104
ORDERED = "order by final_score desc, lexical_score desc, matched_terms desc, lower(title), book_id"
PLAIN = f"plain as (select book_id, {TITLE} title, lexical_score, matched_terms, lexical_score::double / max(lexical_score) over () final_score from lex join documents on doc_id = book_id)"
HYBRID = f"""hybrid as (select l.book_id, {TITLE} title, lexical_score, matched_terms, lexical_score::double / max(lexical_score) over () normalized_lexical, r.score / (select max(score) from ranks) normalized_pagerank
  from lex l join documents on doc_id = l.book_id join ranks r on r.book_id = l.book_id),
plain as (select *, normalized_lexical * 0.85::double + normalized_pagerank * 0.15::double final_score from hybrid)"""
SUGGEST = """seeds as (select book_id, title, row_number() over (order by final_score desc, lexical_score desc, matched_terms desc, lower(title), book_id) search_rank, final_score from plain qualify search_rank <= 3),
weighted as (select *, final_score / sum(final_score) over () weight from seeds),
near as (select s.book_id seed_id, s.weight, e.dst book_id, e.score jaccard, row_number() over (partition by s.book_id order by e.score desc, e.dst) r from weighted s join both_ways e on e.src = s.book_id),
why as (select *, weight * jaccard contribution from near where r <= 20 and book_id not in (select book_id from seeds)),
best as (select book_id, sum(contribution) score, max(jaccard) best_jaccard, count(*) supporting_seeds from why group by book_id order by score desc, best_jaccard desc, supporting_seeds desc, book_id limit 10)
select b.book_id, round(b.score, 9) score, round(best_jaccard, 9) best_jaccard, supporting_seeds, seed_id, round(contribution, 9) contribution from best b join why using (book_id)"""
BENCH = f"bench as (select doc_id book_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) term from documents), terms as (select * from bench where length(term) >= 3 and term not in ({STOP}))"
PART = POSTS.replace("where true", "where lang is distinct from 'es'")
NEW = _posts("fresh", "regexp_replace(lower(text), '\\bthe\\b', ' ', 'g') || ' added'")
CHANGES = "changes as (select book_id, term, 'added' as change from fresh anti join posts using (book_id, term) union all select book_id, term, 'removed' from posts anti join fresh using (book_id, term))"


def _sync(prune: bool) -> str:
    return f"""{BOOKS}, new as (select id, storage_key, case when id % 11 = 0 then title || ' rev' else title end title, author, language, source_url, content_sha256 sha from books where language is distinct from 'de'),
old as (select id, storage_key, title, author, language, source_url, case when id % 13 = 0 then '0' else content_sha256 end sha from books where language is distinct from 'fr'),
diff as (select coalesce(n.storage_key, o.storage_key) storage_key, case when o.storage_key is null then 'insert' when n.storage_key is null then '{"delete" if prune else "keep"}'
  when n.sha = o.sha and n.title = o.title and n.language is not distinct from o.language then 'unchanged' else 'update' end as action,
  coalesce(({"n.storage_key is null" if prune else "false"}) or (o.storage_key is not null and n.storage_key is not null and n.sha <> o.sha), false) dirty
  from new n full join old o on n.storage_key = o.storage_key)"""


def _detect() -> str:
    rows = ", ".join(f"({_q(c)}, {_q(w)})" for c, ws in language.WORDS.items() for w in ws.split())
    return f"""with lists(code, word) as (values {rows}),
s as (select row_number() over () id, doc_id, case when length(text) > 12000 then substr(text, 4001) else coalesce(text, '') end t from documents),
w as (select id, doc_id, regexp_extract_all(lower(t), '\\p{{L}}+') w from s),
whole as (select id, doc_id, len(w) total, length(array_to_string(w, '')) letters from w),
each as (select id, unnest(w) word from w),
scores as (select id, code, count(*) score, count(distinct word) different from each join lists using (word) group by id, code),
best as (select id, max_by(code, score) code, max(score) score, max_by(different, score) different, coalesce(list_reverse_sort(list(score))[2], 0) runner from scores group by id)
select doc_id, case when letters >= 80 and different >= 5 and score >= 10 and score >= total * 0.05 and score > runner * 1.2 then code end detected from whole left join best using (id)"""


def _language_code() -> str:
    names = {"en": ["English", "eng", "anglais"], "fr": ["French", "fra", "Français", "francais"], "de": ["German", "deu", "DEUTSCH", "allemand"], "es": ["Spanish", "spa", "español", "espagnol"]}
    rows = ", ".join(f"({_q(c)}, {_q(n)})" for c, ns in names.items() for n in ns)
    return f"""with l as (select distinct lang from documents where lang is not null), names(code, given) as (values {rows})
select given, code language_code from names join l on lang = code union all select upper(lang), lang from l union all select ' ' || lang || ' ', lang from l union all select lang || 'x', null from l"""


ORACLES = {
    "canonical_text": f"select doc_id, sha256({_canonical('text')}) canonical_sha from documents",
    "fold_compatibility": f"select doc_id, sha256({_canonical('text')}) canonical_sha from documents",
    "tokenize": f"select doc_id, unnest(range(len(t))) as position, unnest(t) as token from (select doc_id, regexp_extract_all({_canonical('text')}, {_q(TOKEN)}) t from documents)",
    "term_frequencies": f"with {POSTS} select * from posts",
    "document_frequency": f"with {POSTS}, {DF} select * from df",
    "book_index_stats": f"with {POSTS} select book_id, count(*) unique_terms, sum(occurrences)::bigint total_tokens from posts group by book_id",
    "word_counts": f"with {BOOKS} select id, word_count from books",
    "min_word_gate": f"with {BOOKS} select id, word_count from books where word_count < 500",
    "doc_fingerprint": f"with {BOOKS} select storage_key, content_bytes, content_sha256 from books",
    "postings_for_term": f"with {POSTS} select * from posts where term = 'thing'",
    "kmp_term_match": f"with {POSTS} select distinct term from posts where contains(term, 'man')",
    "regex_term_match": f"with {POSTS} select distinct term from posts where {MEN}",
    "simple_search_lexical": f"with {POSTS}, {_lexical(THE)} select * from lex",
    "regex_search_lexical": f"with {POSTS}, {_lexical(MEN)} select * from lex",
    "simple_search_page2": f"with {POSTS}, {_lexical(THE)}, {PLAIN} select book_id, title, lexical_score, matched_terms, round(final_score, 9) final_score from plain {ORDERED} limit 20 offset 20",
    "simple_search_ranked": f"with recursive {_ranks(FULL)}, {_lexical(THE)}, {HYBRID} select book_id, lexical_score, matched_terms, round(normalized_lexical, 9) normalized_lexical, round(normalized_pagerank, 6) normalized_pagerank, round(final_score, 6) final_score from plain",
    "eligible_terms": f"with {POSTS}, {DF}, {ELIGIBLE} select * from eligible",
    "feature_counts": f"with {POSTS}, {DF}, {ELIGIBLE}, {FEATURES} select * from counts",
    "pair_intersections": f"with {POSTS}, {DF}, {ELIGIBLE}, {FEATURES}, {INTER} select * from inter",
    "jaccard_pairs": f"with {GRAPH} select a, b, round(score, 12) score, shared, union_size from pairs",
    "similarity_edges": f"with {GRAPH} {EDGE_OUT}",
    "similarity_rebuild_stats": f"with {GRAPH} select (select count(*) from pairs) candidates, (select count(*) from pairs where score >= 0.05) qualifying, (select count(*) from edges) stored",
    "weighted_degree": f"with {GRAPH} select src book_id, round(sum(score), 9) as degree from both_ways group by src",
    "neighbors_of_book": f"with {GRAPH} select case when a = 1 then b else a end book_id, round(score, 12) score, shared, union_size from edges where a = 1 or b = 1 order by edges.score desc, book_id limit 20",
    "jaccard_prefix_300": f"with {GRAPH.replace('where true', 'where doc_id < 300')} {EDGE_OUT}",
    "similarity_status": f"with {GRAPH} select count(*) edges, (select count(distinct src) from both_ways) connected_books from edges",
    "pagerank_10_iters": f"with recursive {_ranks(10)} select book_id, round(score, 10) score from ranks",
    "pagerank_scores": f"with recursive {_ranks(FULL)} select book_id, round(score, 8) score from ranks",
    "pagerank_top": f"with recursive {_ranks(10)} select book_id, {TITLE} title, round(score, 10) score from ranks join documents on doc_id = book_id order by ranks.score desc, book_id limit 20",
    "pagerank_stats": f"with recursive {_ranks(10)} select count(*) nodes, round(sum(score), 9) score_sum, round(min(score), 9) score_min, round(max(score), 9) score_max from ranks",
    "pagerank_convergence": f"with recursive {_pagerank(20)} select y.i::integer iteration, round(sum(abs(y.r - x.r)), 9) delta from pr x join pr y on y.i = x.i + 1 and y.book_id = x.book_id group by y.i",
    "search_suggestions": f"with recursive {_ranks(FULL)}, {_lexical(THE)}, {HYBRID}, {SUGGEST}",
    "regex_suggestions": f"with {GRAPH}, {_lexical(MEN)}, {PLAIN}, {SUGGEST}",
    "book_suggestions": f"with {GRAPH}, plain as (select doc_id book_id, {TITLE} title, 1 lexical_score, 1 matched_terms, 1.0::double final_score from documents where doc_id = 1), {SUGGEST.replace('r <= 20', 'r <= 10')}",
    "zipf_top1000": f"with {BENCH} select term, count(*) frequency, (row_number() over (order by count(*) desc, term))::integer as rank from terms group by term order by frequency desc, term limit 1000",
    "bench_features": f"with {BENCH} select book_id, count(*) features from (select book_id, term from terms group by all having count(*) >= 2) group by book_id",
    "indexed_books": f"with {PART}, {BOOKS} select id, title from books where id in (select book_id from posts)",
    "pending_books": f"with {PART}, {BOOKS} select id, title from books where id not in (select book_id from posts) order by id limit 50",
    "indexing_status": f"with {PART}, {BOOKS} select (select count(*) from books) ready_books, count(distinct book_id) indexed_books, (select count(*) from books) - count(distinct book_id) pending_books, count(distinct term) terms, count(*) postings from posts",
    "list_books": f"with {BOOKS} select id, title, author, language, word_count, source_url, status from books order by id limit 20",
    "term_set_difference": f"with {POSTS}, {NEW}, {CHANGES} select * from changes",
    "df_delta": f"with {NEW} select term, count(*)::integer document_frequency from fresh group by term",
    "filename_label": f"select {KEY} storage_key, {TITLE} as label from documents",
    "basename_of_path": "select page_id, regexp_replace(url, '^.*[/\\\\]', '') basename from pages",
    "catalog_sync_diff": f"with {_sync(False)} select * from diff",
    "catalog_sync_counts": f"with {_sync(True)} select action, count(*) books, count(*) filter (dirty) dirty from diff group by action",
    "catalog_merge": f"with {BOOKS} select storage_key, case when language is distinct from 'fr' and id % 2 = 0 then 'Own ' || title else 'Found ' || title end title, case when language is distinct from 'fr' and id % 5 = 0 then 'Somebody' else 'Anon' end author, language, source_url from books",
    "detect_language": _detect(),
    "language_code": _language_code(),
    "metadata_extract": """select doc_id, case lang when 'en' then 'A ' || doc_id || ' of Things' when 'fr' then 'LE VOYAGE ' || doc_id when 'de' then 'Emma ' || doc_id else 'Strahlen ' || doc_id end title,
  case lang when 'en' then 'Jane Doe' when 'fr' then 'Jules Verne' when 'de' then 'Jane Austen' else 'Marie Curie' end author, case lang when 'en' then 'English' end language_name,
  case lang when 'en' then 'https://example.org/' || doc_id when 'de' then 'https://www.gutenberg.org/ebooks/1' || doc_id end source_url from documents""",
}
