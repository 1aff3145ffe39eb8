"""The ten operators as queries over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, license_scan, lm_score, mixing, ngram_join, packing, quality_rules, token_count, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, mod n; of a null doc_id, 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % n


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.language_id(docs, language_id.fit(docs, remainder(3) != 1))
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score", "similarity", "rejected")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, counts = lm_score.fit(docs, remainder(7) != 2)
    return lm_score.lm_score(docs, remainder(7) == 2, model, counts)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    found = toxicity.toxicity(docs, model)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1_license_scan says of the base phrases, which SQL can say too."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4_lm_score counts beside its network, which SQL can count too."""
    return op4_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7_quality_rules counts before its learned rules, which SQL can count too."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", *quality_rules.BASE, "base_failed")


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_ngram_join, op3_language_id, op4_lm_score, op5_packing, op6_token_counts, op7_quality_rules, op8_toxicity, op9_mixing, op10_topk, license_base, lm_base, quality_base)}

#: Texts with A-Z lower-cased, and their words.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"

NGRAM_SQL = f"""
with recursive d as materialized (select row_number() over () k, doc_id, regexp_extract_all({LOWER}, {SPACED}) w from documents),
s as materialized (select k, doc_id, case when len(w) >= 5 then list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end s from d),
named as materialized (select *, case when len(s) = 0 then k else min(k) over (partition by list_sort(s)) end node from s),
node as materialized (select k, s from named where node = k),
each as materialized (select k, unnest(s) x from node),
met as (select a.k a, b.k b, count(*) n from each a join each b on a.x = b.x and a.k < b.k group by all),
link as materialized (select a, b from met join node p on p.k = a join node q on q.k = b where 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
both_ways as materialized (select a, b from link union all select b, a from link),
reach as (select k a, k b from node union select r.a, l.b from reach r join both_ways l on l.a = r.b),
least as materialized (select node, min(doc_id) doc_id from named group by node),
found as (select a, min(doc_id) component_id from reach join least on least.node = b group by a)
select doc_id, len(s)::bigint n_shingles, case when len(s) = 0 then doc_id else component_id end component_id from named join found on a = node"""

LICENSE_SQL = f"""
with d as (select doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
p as (select doc_id, len(w)::bigint n_words, [i for i in range(1, len(w) + 1) if w[i] = 'cc' and w[i + 1] = 'by'] c,
  [i for i in range(1, len(w) + 1) if w[i] = 'general' and w[i + 1] = 'public' and w[i + 2] = 'license'] g,
  [i for i in range(1, len(w) + 1) if w[i] = 'all' and w[i + 1] = 'rights' and w[i + 2] = 'reserved'] r from d)
select doc_id, n_words, (len(c) + len(g) + len(r))::bigint n_base, (list_min(c || g || r) - 1)::bigint first_word, (list_max(c || g || r) - 1)::bigint last_word,
  concat_ws(',', case when len(c) > 0 then 'cc-by' end, case when len(g) > 0 then 'gpl' end, case when len(r) > 0 then 'reserved' end) base_labels from p"""

#: The remainder of crc32 by a bit a step, then counts by word; the end is the empty word, which no text has.
LM_SQL = f"""
with recursive d as materialized (select row_number() over () k, doc_id, coalesce(doc_id::varchar, '') id, regexp_extract_all({LOWER}, {SPACED}) || [''] w from documents),
crc(k, i, x) as (select k, 0, 4294967295::bigint from d
  union all select k, i + 1, xor(y >> 1, (y & 1) * 3988292384) from (select c.k, i, case when i % 8 = 0 then xor(x, ascii(substr(id, i // 8 + 1, 1))::bigint) else x end y from crc c join d on d.k = c.k where i < 8 * length(id))),
held as materialized (select d.k, doc_id, w, xor(x, 4294967295) % 7 = 2 held_out from d join crc c on c.k = d.k and i = 8 * length(id)),
each as materialized (select k, held_out, unnest(w) x from held),
counts as materialized (select x, count(*) c from each where not held_out group by x),
total as (select sum(c)::bigint n, count(*) v from counts),
sums as (select k, count(*) n_tokens, count(c) n_known, sum(log10((coalesce(c, 0) + 1)::double / (n + v + 1))) base_score from each left join counts using (x) cross join total group by k)
select doc_id, held_out, n_tokens, n_known, n train_tokens, round(base_score, 5) base_score from held join sums using (k) cross join total"""

QUALITY_SQL = f"""
with d as materialized (select row_number() over () k, doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), {SPACED}) w from documents),
windows as (select k, unnest([{{'i': i, 'x': w[i : i + 2]}} for i in range(1, len(w) - 1)]) v from d),
again as (select k, v.i i from windows qualify count(*) over (partition by k, v.x) > 1),
places as (select k, count(distinct i + j) n from again, unnest([0, 1, 2]) u(j) group by k),
base as (select doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
  (select (count(*) - count(distinct x))::bigint from unnest(string_split(t, chr(10))) u(x) where regexp_matches(x, {SPACED})) n_dup_lines, coalesce(n, 0)::bigint n_repeat_words from d left join places using (k))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from base"""

TOPK_SQL = """
with v as (select vec_id, [floor(64.0::double * x::double)::bigint for x in embedding] e from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id query_id, c.vec_id, coalesce(list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)]), 0)::bigint score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 20"""

ORACLE_SQL = {"op2_ngram_join": NGRAM_SQL, "license_base": LICENSE_SQL, "lm_base": LM_SQL, "quality_base": QUALITY_SQL, "op9_mixing": mixing.oracle_sql(), "op10_topk": TOPK_SQL}
