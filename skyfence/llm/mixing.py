"""Mixing sources to target weights by weighted random order and prefix sums, in DataFrame functions only.

Every row gets the key -ln(u) / w (Efraimidis and Spirakis): u is a uniform number made from the row's id, w its quality
weight. In ascending key order, heavier rows tend to come first. A source's budget is its target: as many complete epochs
as fit come first, then rows in key order until their summed size is nearest to what is left.

Hot sources: a source's order is cut into ranges of about as many rows, found by Spark from samples of the keys; the prefix sum
runs inside each range, with the sums of the ranges before it added. Rows equal in id and text are one row with a count there. No
window holds a whole source, and none holds all rows of one id.

Rows: sources of null form a group of their own, which comes last. Texts of null or without words have size 0, are never
taken and change nothing. Rows equal in id and text share a key and are taken one after the other; rows without id get their key from
the text. Ties of keys go by id, size and a hash of the text, so reruns agree. Sources without words get a target of 0. Extra columns
are not read; ``mixed_documents`` keeps them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfence.llm.common import WORD, all_columns, stored

#: Targets stop at so many times their source's size; with whole epochs first, no row is taken more often.
REPEATS = 3
#: Characters that prose has few of.
SIGNS = "0123456789#*$%&|<>{}[]=_/\\^~@+"


def uniform(value: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of seed and value, or of the text's md5 without a value."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(value.cast("string"), F.md5(text.cast("binary")))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0 and 1, from what prose has in common.

    The product of three parts: 1 for words that with the space between take 6 characters on average, less the farther from it; less for
    digits and signs of markup, code and tables, a half where they are a fifth of all characters; less for texts under 50 words.
    """
    length = F.greatest(F.length(text), F.lit(1))
    mean = F.length(text) / F.greatest(size, F.lit(1))
    signs = (F.length(text) - F.length(F.translate(text, SIGNS, ""))) / length
    return 1.0 / (1.0 + F.abs(mean - 6.0) / 3.0) / (1.0 + 5.0 * signs) * (F.least(size, F.lit(50)) + 50) / 100.0


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """One narrow row per document: doc_id, source, size, h (hash of the text), key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", "source", text.alias("text"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    key = -F.ln(uniform(F.col("doc_id"), F.col("text"), seed)) / quality_weight(F.col("text"), F.col("size"))
    return rows.select("doc_id", "source", "size", F.xxhash64("text").alias("h"), key.alias("key"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: shares by weight 1, 2, 3, 1, ... in the order of the names, the excess over the cap reshared.

    Resharing until none is above its cap ends where targets are weight x level, or the cap: in ascending order of cap / weight,
    a source is capped as long as the level left by those before it reaches its own ratio; the first that is not sets the level.
    One row per source, one window.
    """
    named = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("weight", (F.row_number().over(named) - 1) % 3 + 1).withColumn("cap", REPEATS * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    before, rest, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    capped = F.col("ratio") <= F.col("level")
    rows = rows.withColumn("level", F.first(F.when(~capped, F.col("level")), ignorenulls=True).over(every)).withColumn("capped", F.col("level").isNull() | (F.col("ratio") <= F.col("level")))
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def mixed_groups(docs: DataFrame, seed: str, rows_per_range: int) -> DataFrame:
    """doc_id, source, size, h, copies, source_size, target, epochs, again: rows equal in id, source and text as one.

    Each of the ``copies`` is taken ``epochs`` times, the first ``again`` of them once more.
    """
    groups = sized(docs, seed).groupBy("doc_id", "source", "size", "h", "key").agg(F.count("*").alias("copies"))
    groups = stored(groups.withColumn("of", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))), "mix-sizes")
    ranges = max(1, -(-groups.count() // rows_per_range))
    rows = stored(groups.repartitionByRange(ranges, "of", "key").withColumn("range", F.spark_partition_id()), "mix-ranges")
    both = F.col("size") * F.col("copies")
    earlier = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("of", "range").agg(F.sum(both).alias("in_range"))
    sums = sums.withColumn("offset", F.coalesce(F.sum("in_range").over(earlier), F.lit(0))).drop("in_range")
    targets = source_targets(rows.select("source", both.alias("size")))
    known = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("of")
    sums = sums.join(targets.select(known, "source_size", "target"), "of")
    inside = Window.partitionBy("of", "range").orderBy("key", "doc_id", "size", "h").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, ["of", "range"])
    rows = rows.withColumn("ahead", F.col("offset") + F.coalesce(F.sum(both).over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    # Copy i (from 0) is taken again where 2 * (ahead + i * size) + size <= 2 * left.
    further = F.floor((2 * left - 2 * F.col("ahead") - F.col("size")) / (2 * F.greatest("size", F.lit(1)))) + 1
    again = F.least(F.greatest(further.cast("long"), F.lit(0)), F.col("copies"))
    worth = F.col("size") > 0
    return rows.withColumn("epochs", epochs).select(
        "doc_id", "source", "size", "h", "copies", "source_size", "target", F.when(worth, F.col("epochs")).otherwise(0).alias("epochs"), F.when(worth, again).otherwise(0).alias("again"))


def mix(docs: DataFrame, seed: str = "mix", rows_per_range: int = 5000) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs for every row of ``docs``.

    ``rows_per_range``: about so many rows meet in one window, whatever the size of the source.
    """
    rows = mixed_groups(docs, seed, rows_per_range).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    epochs = F.col("epochs") + F.when(F.col("i") <= F.col("again"), 1).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size")).alias("taken"), epochs.cast("long").alias("epochs"))


def mixed_documents(docs: DataFrame, seed: str = "mix", rows_per_range: int = 5000) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns kept.

    Counts and rows meet by id, source and text. Of rows equal in these, those with the smaller hash of all columns are taken once more
    where only some are; rows equal in all columns stand for each other. Only such a split group, at most one of each source, is put in order.
    """
    rows = docs.select(
        F.struct(*all_columns(docs)).alias("row"), F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")).alias("who"),
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("of"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"), F.xxhash64(*all_columns(docs)).alias("all"))
    group = ["who", "of", "h"]
    counts = mixed_groups(docs, seed, rows_per_range).select(
        F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")).alias("who"),
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("of"), "h", "copies", "epochs", "again")
    counts = stored(counts.where("epochs > 0 or again > 0"), "mix-counts")
    alike = counts.where("again in (0, copies)").select(*group, (F.col("epochs") + (F.col("again") > 0).cast("long")).alias("times"))
    split = counts.where("again not in (0, copies)")
    # Both sides are dealt out at every size: the counts grow with the documents.
    out = rows.join(alike.hint("merge"), group).select("row", "times")
    kinds = rows.select(*group, "all").join(split, group).groupBy(*group, "all", "epochs", "again").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("all").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.least(F.greatest(F.col("again") - before, F.lit(0)), F.col("n"))
    kinds = kinds.select(*group, "all", (F.col("epochs") * F.col("n") + more).alias("times")).where("times > 0")
    kinds = stored(kinds, "mix-split")
    once = rows.join(kinds, [*group, "all"]).groupBy(*group, "all").agg(F.first("row").alias("row"), F.first("times").alias("times"))
    out = out.unionByName(once.select("row", "times"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


#: What ``mix`` returns, for DuckDB.
MIX_SQL = r"""
with sized as (
  select doc_id, source, coalesce(text, '') as text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from {docs}),
keyed as (
  select doc_id, source, size,
    hash(text) as h,
    -ln((('0x' || substr(md5('mix' || coalesce(doc_id::varchar, md5(text))), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
      / (1.0::double / (1.0::double + abs(length(text)::double / greatest(size, 1) - 6.0::double) / 3.0::double)
        / (1.0::double + 5.0::double * ((length(text) - length(translate(text, '0123456789#*$%&|<>{{}}[]=_/\^~@+', '')))::double / greatest(length(text), 1))) * (least(size, 50) + 50) / 100.0::double) as key
  from sized),
sources as (
  select source, source_size, weight, 3 * source_size as cap, (3 * source_size)::double / weight as ratio
  from (select source, sum(size)::bigint as source_size, (row_number() over (order by source is null, source) - 1) % 3 + 1 as weight from keyed group by source)),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by ratio, source is null, source rows between current row and unbounded following) as level0
  from sources),
targets as (
  select source, source_size, case when level is null or ratio <= level then cap::double else weight * level end as target
  from (select *, first_value(case when ratio > level0 then level0 end ignore nulls) over (order by ratio, source is null, source rows between unbounded preceding and unbounded following) as level from levels)),
placed as (
  select k.doc_id, k.source, k.size, t.source_size, t.target,
    coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size, k.h rows between unbounded preceding and 1 preceding), 0) as ahead,
    case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as epochs
  from keyed k join targets t on k.source is not distinct from t.source)
select doc_id, source, size::bigint as size, source_size, target,
  (epochs + case when 2 * ahead + size <= 2 * (target - epochs * source_size) then 1 else 0 end) * (size > 0)::bigint as epochs
from placed"""
