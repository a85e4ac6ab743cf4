"""Mixing sources to target weights by systematic sampling.

A source's target is its weight's share of all words, stopped at 3 times what the source has; what is over goes to the
other sources by weight, until none is above. In order of size over weight the sources that are stopped come first, and
whether one is follows from the sums before it: running totals settle all targets at once, for any number of sources.
Every document of a source expects the same number of copies, target over size. Along the source, in order of size (so that
short and long documents are drawn alike), the expected copies add up; with one random offset a document is taken once for
each integer that its stretch of the sum crosses.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, running_totals

MOST = 3
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: Fixes the offset of a run.
SEED = 20250101


def word_count(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(scratch: Scratch, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(name, size, target, each) of sources (name, size) in order of name, the weights repeating.

    each: copies times 2**20 of every document, a whole number, so that sums of any length stay exact. A source without
    words has target 0, as all have where there are no words at all. Sums of words and weights are whole numbers too.
    """
    one, all_of = F.lit(1).cast("long"), math.lcm(*weights)
    ranked = running_totals(scratch, sizes.select("name", "size", F.lit(0).alias("g"), one.alias("one")), ["g"], ["name"], ["one"])
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("start_one") % len(weights) + 1).cast("int"))
    known = ranked.select("name", "size", "g", weight.alias("weight"), (F.col("size") * most).alias("cap")).withColumn("turn", F.col("size") * (F.lit(all_of) / F.col("weight")).cast("long"))
    whole = scratch.table(known.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weights")), "whole")
    turned = running_totals(scratch, known, ["g"], ["turn", "name"], ["cap", "weight"]).crossJoin(F.broadcast(whole))  # one row
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    stopped = (wide("words") - wide("start_cap")) * wide("weight") > wide("cap") * (wide("weights") - wide("start_weight"))
    turned = scratch.table(turned.withColumn("stopped", stopped), "stopped")
    over = turned.agg(F.coalesce(F.sum(F.when(F.col("stopped"), F.col("cap"))), F.lit(0)).alias("over"), F.coalesce(F.sum(F.when(F.col("stopped"), F.col("weight"))), F.lit(0)).alias("out"))
    j = turned.crossJoin(F.broadcast(over))  # one row
    left = (F.col("words") - F.col("over")).cast("double") * F.col("weight")
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(F.coalesce(F.try_divide(left, F.col("weights") - F.col("out")), F.lit(0.0)))
    each = F.when(F.col("stopped") & (F.col("size") > 0), F.lit(most << 20)).otherwise(F.least(F.lit(most << 20), F.round(F.coalesce(F.try_divide(F.col("target") * (1 << 20), F.col("size")), F.lit(0.0))))).cast("long")
    return j.withColumn("target", target).select("name", "size", "target", each.alias("each"))


def mix(scratch: Scratch, docs: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The columns of docs, then source_size, target, copies and taken (size times copies).

    Null sources are one source, the last. A document without words is never above its size: it may be taken, at no
    words. Sources without words have target 0 and take nothing. Equal rows may be taken differently, but always the
    same number of them. An empty table gives an empty result. Copies come whole; a source's words miss its target by
    less than its largest document or so.
    """
    spark = docs.sparkSession
    added = ("source_size", "target", "copies", "taken")
    own = [c for c in docs.columns if c not in added]
    # Texts, if docs has any, stay where they are until each row's copies are known.
    kept = scratch.table(docs.select(*own).withColumn("_row", F.monotonically_increasing_id()), "rows")
    rows = kept.select("_row", F.when(F.col(source).isNull(), "~").otherwise(F.concat(F.lit("="), F.col(source))).alias("_s"), F.col(size).alias("_z"), F.col(key).alias("_k"), F.lit(1).cast("long").alias("_one"))
    sizes = scratch.table(rows.groupBy("_s").agg(F.sum("_z").alias("size")).withColumnRenamed("_s", "name"), "sizes")
    plan = scratch.table(source_targets(scratch, sizes, weights, most), "plan").select(F.col("name").alias("_s"), F.col("size").alias("source_size"), "target", F.col("each").alias("_each"))
    placed = running_totals(scratch, rows, ["_s"], ["_z", "_k"], ["_one"])
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("_s")), F.lit(1 << 20))
    j = placed.join(plan, "_s").withColumn("_offset", offset)
    upto = lambda n: F.expr(f"({n} * _each + _offset) div 1048576")
    copies = (upto("(start__one + 1)") - upto("start__one")).alias("copies")
    each = scratch.table(j.select("_row", "source_size", "target", copies, (F.col("_z") * copies).alias("taken")), "copies")
    # Always by a shuffle of both, as texts move the same way at every size.
    return kept.join(each.hint("merge"), "_row").select(*own, *added)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, size, source_size, target, taken, copies; see mix()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(Scratch(spark, "op8"), docs).drop("source")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, source_size, target, documents) of the mixture of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix(Scratch(spark, "targets"), docs)
    return mixed.groupBy("source", "source_size").agg(F.round(F.max("target"), 6).alias("target"), F.count("*").alias("documents"))


#: The same by windows over the sources.
TARGETS_ORACLE = f"""
WITH s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS z, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w FROM s),
t AS (SELECT *, sum(z) OVER () AS words, sum(w) OVER () AS ws, coalesce(sum({MOST} * z) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS gone FROM w WINDOW o AS (ORDER BY z / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (words - caps) * w > {MOST} * z * (ws - gone) AS stopped FROM t),
r AS (SELECT *, coalesce(sum({MOST} * z) FILTER (WHERE stopped) OVER (), 0) AS over, coalesce(sum(w) FILTER (WHERE stopped) OVER (), 0) AS taken FROM c)
SELECT source, CAST(z AS BIGINT) AS source_size, round(CASE WHEN stopped THEN CAST({MOST} * z AS DOUBLE) ELSE CAST((words - over) * w AS DOUBLE) / (ws - taken) END, 6) AS target, n AS documents FROM r"""

assert math.log2(MOST << 20) < 31
