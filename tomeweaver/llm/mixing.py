"""Mixing sources to target weights by Sainte-Laguë apportionment.

DataFrame functions only.  Each source's target is its weight's share of all
words, held at ``REPEATS`` times its own words with the excess shared anew.  All
words make blocks of equal size; blocks go to sources by the highest quotients
target / (2j + 1), and each source's blocks to its shards by the highest
quotients of shard words.  A shard's documents stand in an order drawn from the
seed, and its quota is the first blocks of that stream, which starts over when
it is used up.  ``mix`` has blocks of a share of a shard, as its SQL does, so a
source of less than half a block takes nothing; ``mixed_documents`` has finer
ones, at most ``FINE`` of the smallest target, so every source with a target of
a document takes part.

A source has a shard for each ``SHARD_DOCS`` documents, so a hot source is
dealt out evenly, and a shard's window holds about as many rows; rows that share an
id, a size and an input partition are one row of it, so a hot id is not gathered.
Windows over all sources hold a row for each.  Only
quotients near the boundary are ranked: with n parties and B seats Sainte-Laguë
gives a party with share s of the seats at least s(1 - n/2B) - 1/2 of them and
at most s(1 + n/2B) + 1/2, so seats below that range are given without ranking.

Nulls: null text has size 0, a null source is a source (the last), a null
doc_id draws as the text "null".  Rows that repeat an id are rows of their own.
Sources without words have target 0; an empty table gives no rows.  Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written

REPEATS, SHARD_DOCS, BLOCKS_PER_SHARD, SEED = 3, 4096, 64, "mix-1"
#: A fine block is no more than this share of the smallest target, and no less than a word.
FINE = 0.01


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long")


def seats(parties: DataFrame, group: list[str], votes: str, total: str, order: str, name: str) -> DataFrame:
    """parties with ``name``: seats by the highest quotients votes / (2j + 1), of ``total`` in each group; ties to the smaller ``order``."""
    g = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    p = parties.withColumn("n_", F.sum(F.when(F.col(votes) > 0, 1).otherwise(0)).over(g)).withColumn("v_", F.sum(votes).over(g).cast("double"))
    share = F.col(total).cast("double") * F.col(votes).cast("double") / F.col("v_")
    slack = F.col("n_").cast("double") / (2.0 * F.col(total).cast("double"))
    sure = F.when((F.col(votes) > 0) & (F.col(total) > 0), F.greatest(F.lit(0.0), F.floor(share * (1.0 - slack) - 0.5) - 1.0)).otherwise(0.0).cast("long")
    most = F.when((F.col(votes) > 0) & (F.col(total) > 0), F.ceil(share * (1.0 + slack) + 0.5) + 1.0).otherwise(0.0).cast("long")
    p = p.withColumn("sure_", sure).withColumn("most_", most).withColumn("left_", F.col(total) - F.sum("sure_").over(g))
    seat = p.select(*group, order, "sure_", "left_", F.col(votes).alias("votes_"), F.explode(F.sequence(F.col("sure_"), F.greatest("sure_", F.col("most_") - 1))).alias("j_"))
    quotient = F.col("votes_").cast("double") / (2.0 * F.col("j_").cast("double") + 1.0)
    ranked = seat.where(F.col("votes_") > 0).withColumn("r_", F.row_number().over(g.orderBy(quotient.desc(), F.col(order), F.col("j_"))))
    won = ranked.where(F.col("r_") <= F.col("left_")).groupBy(*group, order).agg(F.count("*").alias("won_"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, order)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return p.alias("a").join(won.alias("b"), cond, "left").select("a.*", (F.col("a.sure_") + F.coalesce(F.col("b.won_"), F.lit(0))).alias(name)).drop("n_", "v_", "sure_", "most_", "left_")


def mix(docs: DataFrame, seed: str = SEED, fine: bool = False) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, size, source_size, target, taken."""
    # where a row stands is written with it, so that it is the same in all that follows
    base = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "mix-sizes")
    per = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # a row for each source from here: one window over them is small
    one = W.partitionBy(F.lit(0))
    src = per.withColumn("rn", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", (F.col("rn") - 1) % 3 + 1)
    src = src.withColumn("total", F.sum("source_size").over(one)).withColumn("cap", REPEATS * F.col("source_size"))
    by = one.orderBy(F.col("cap").cast("double") / F.col("w"), "rn")
    level = (F.col("total") - F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).cast("double") / F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing))
    src = src.withColumn("level", level).withColumn("level", F.max("level").over(one))
    src = src.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")))
    src = src.withColumn("shards", F.ceil(F.col("n_docs") / F.lit(float(SHARD_DOCS))).cast("long"))
    src = src.withColumn("block", F.greatest(F.lit(1).cast("long"), F.floor(F.col("total").cast("double") / (F.sum("shards").over(one) * BLOCKS_PER_SHARD))))
    if fine:
        least = F.floor(FINE * F.min(F.when(F.col("target") > 0, F.col("target"))).over(one))
        src = src.withColumn("block", F.greatest(F.lit(1).cast("long"), F.least("block", least)))
    src = src.withColumn("blocks", F.floor(F.col("total").cast("double") / F.col("block") + 0.5))
    src = seats(src, [], "target", "blocks", "rn", "quota")
    src = written(src.select(F.col("source").alias("source_"), "rn", "source_size", "target", "shards", "block", "quota"), "mix-sources")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = base.join(src, F.col("source").eqNullSafe(F.col("source_"))).withColumn("key", key).withColumn("shard", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("shards"))
    cells = rows.groupBy("rn", "shard").agg(F.sum("size").alias("cell"), F.first("quota").alias("quota"), F.first("block").alias("block"))
    cells = seats(cells, ["rn"], "cell", "quota", "shard", "given")
    cells = cells.withColumn("words", F.least(F.col("given") * F.col("block"), REPEATS * F.col("cell"))).select("rn", "shard", "cell", "words")
    cells = cells.withColumn("full", F.when(F.col("cell") > 0, F.floor(F.col("words").cast("double") / F.col("cell"))).otherwise(0)).withColumn("rest", F.col("words") - F.col("full") * F.col("cell"))
    # the words before a row in its shard: those before all rows of its key, size and input partition, and of that run the
    # rows before it; so rows that share an id (or have none) are counted where they stand and never gathered in one task
    run = ["rn", "shard", "key", "size", "part"]
    runs = rows.groupBy(*run).agg((F.count("*") * F.col("size")).alias("run_words"))
    runs = runs.withColumn("run_before", F.coalesce(F.sum("run_words").over(W.partitionBy("rn", "shard").orderBy("key", "size", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.join(cells.select("rn", "shard", "full", "rest"), ["rn", "shard"]).drop("run_words")
    out = rows.withColumn("nth", F.row_number().over(W.partitionBy(*run).orderBy("place")) - 1).join(runs, run).withColumn("before", F.col("run_before") + F.col("nth") * F.col("size"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("full") * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it: taken / size, rounded half up; rows without words go.

    Rows that agree in doc_id, source and size share their taken words evenly.
    """
    plan = mix(docs, seed, fine=True).where("size > 0").groupBy("doc_id", "source", "size").agg(F.floor(F.sum("taken").cast("double") / (F.count("*") * F.col("size")) + 0.5).cast("int").alias("copies")).where("copies > 0")
    plan = plan.select(F.col("doc_id").alias("doc_id_"), F.col("source").alias("source_"), F.col("size").alias("size_"), "copies")
    d = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    j = d.join(plan, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_")))
    return j.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def oracle_sql() -> str:
    """The same in DuckDB's SQL."""

    def apportion(name: str, parties: str, group: str, votes: str, total: str, order: str, out: str) -> str:
        over = f"partition by {group}" if group else ""
        g = f"{group}," if group else ""
        using = f"{group}, {order}" if group else order
        return f"""
{name}_a as (select *, sum(case when {votes} > 0 then 1 else 0 end) over ({over}) n_, (sum({votes}) over ({over}))::double v_ from {parties}),
{name}_b as (select *, case when {votes} > 0 and {total} > 0 then greatest(0.0, floor({total}::double * {votes}::double / v_ * (1.0::double - n_::double / (2.0::double * {total}::double)) - 0.5::double) - 1.0::double)::bigint else 0 end sure_,
  case when {votes} > 0 and {total} > 0 then (ceil({total}::double * {votes}::double / v_ * (1.0::double + n_::double / (2.0::double * {total}::double)) + 0.5::double) + 1.0::double)::bigint else 0 end most_ from {name}_a),
{name}_c as (select *, {total} - sum(sure_) over ({over}) left_ from {name}_b),
{name}_d as (select {g} {order}, left_, {votes} votes_, unnest(range(sure_, greatest(sure_, most_ - 1) + 1)) j_ from {name}_c where {votes} > 0),
{name}_e as (select *, row_number() over ({over} order by votes_::double / (2.0::double * j_::double + 1.0::double) desc, {order}, j_) r_ from {name}_d),
{name}_f as (select {g} {order}, count(*) won_ from {name}_e where r_ <= left_ group by all),
{name} as (select {name}_c.*, sure_ + coalesce(won_, 0) {out} from {name}_c left join {name}_f using ({using}))"""

    return f"""
with base as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::bigint size from documents),
per as (select source, sum(size)::bigint source_size, count(*) n_docs from base group by source),
s1 as (select *, row_number() over (order by source nulls last) rn from per),
s2 as (select *, (rn - 1) % 3 + 1 w, (sum(source_size) over ())::bigint total, {REPEATS} * source_size cap, ceil(n_docs / {SHARD_DOCS}.0::double)::bigint shards from s1),
s3 as (select *, (total - coalesce(sum(cap) over (order by cap::double / w, rn rows between unbounded preceding and 1 preceding), 0))::double / (sum(w) over (order by cap::double / w, rn rows between current row and unbounded following))::double level_ from s2),
s4 as (select *, least(cap::double, max(level_) over () * w) target, greatest(1, floor(total::double / ((sum(shards) over ()) * {BLOCKS_PER_SHARD})::double))::bigint block from s3),
s5 as (select *, floor(total::double / block::double + 0.5::double)::bigint blocks from s4),
{apportion("src", "s5", "", "target", "blocks", "rn", "quota").lstrip()},
rws as (select b.*, src.rn, src.source_size, src.target, src.block, src.quota, md5('{SEED}:' || coalesce(b.doc_id::varchar, 'null')) key, ('0x' || substr(md5('{SEED}:' || coalesce(b.doc_id::varchar, 'null')), 1, 8))::bigint % src.shards shard from base b join src on b.source is not distinct from src.source),
cl as (select rn, shard, sum(size)::bigint cell, first(quota)::bigint quota, first(block) block from rws group by rn, shard),
{apportion("cells", "cl", "rn", "cell", "quota", "shard", "given").lstrip()},
done as (select rn, shard, cell, least(given * block, {REPEATS} * cell)::bigint words_ from cells),
ful as (select *, case when cell > 0 then floor(words_::double / cell::double)::bigint else 0 end full_ from done),
st as (select *, coalesce(sum(size) over (partition by rn, shard order by key, size rows between unbounded preceding and 1 preceding), 0)::bigint before_ from rws)
select doc_id, size, source_size, target, (full_ * size + greatest(0, least(size, words_ - full_ * cell - before_)))::bigint taken from st join ful using (rn, shard)"""
