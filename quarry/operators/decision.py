"""From evidence to a decision: buckets, policy, contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import clamp
from ..plans.scratch import Scratch
from .catalogue import eligible
from .identifiers import retrieve_identifiers
from .lexical import retrieve

HIGH = 0.9


def bucket() -> Column:
    """The kind of evidence of a row of (candidates, issues, exact_unique, codes)."""
    first = F.get("candidates", F.lit(0))
    return (
        F.when(F.size("candidates") == 0, "no_candidate")
        .when(F.size("issues") > 0, "blocked")
        .when((F.size("codes") == 1) & (F.get("codes", F.lit(0)) == first["code"]), "identifier")
        .when(F.col("exact_unique"), "lexical_exact")
        .when(first["score"] >= HIGH, "lexical_high")
        .otherwise("lexical_other")
    )


def decide(retrieval: DataFrame, evidence: DataFrame | None, policy: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Per line: bucket, item_code, confidence, decision, reason_code, candidates. policy: (bucket, enabled, probability).

    evidence: none takes the codes that retrieve() has put beside each line, so that no line moves. keep: more columns of the retrieval.
    """
    j = retrieval.where("codes is not null") if evidence is None else retrieval.drop("codes").join(evidence.select("line_id", "codes"), "line_id")
    j = j.withColumn("bucket", bucket())
    j = j.join(policy.select("bucket", "enabled", "probability"), "bucket", "left")
    auto = (F.size("issues") == 0) & F.coalesce("enabled", F.lit(False)) & (F.size("candidates") > 0)
    rejected = F.array_contains("issues", "not_an_item")
    reason = F.when(F.size("issues") > 0, F.get("issues", F.lit(0))).when(auto & (F.col("bucket") == "identifier"), "identifier_verified").otherwise(F.col("bucket"))
    return j.select(
        "line_id",
        *keep,
        "bucket",
        F.when(auto, F.get("candidates", F.lit(0))["code"]).otherwise("").alias("item_code"),
        F.coalesce("probability", F.lit(0.0)).alias("confidence"),
        F.when(rejected, "reject").when(auto, "auto").otherwise("review").alias("decision"),
        reason.alias("reason_code"),
        F.transform("candidates", lambda c: F.struct(c["code"].alias("item_code"), clamp(c["score"]).alias("score"))).alias("candidates"),
    )


def match(scratch: Scratch, lines: DataFrame, catalogue: DataFrame, policy: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """A decision for each line."""
    evidence = retrieve_identifiers(scratch, lines, catalogue, aliases)
    return decide(scratch.table(retrieve(scratch, lines, catalogue, evidence), "retrieval"), None, policy)


def review_only(lines: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Sends every line to review: what automation is compared with."""
    known = catalogue.select("tenant").distinct().withColumn("k", F.lit(True))
    none = F.array().cast("array<struct<item_code:string,score:double>>")
    return lines.join(known, "tenant", "left").select("line_id", F.lit("").alias("item_code"), F.lit(0.0).alias("confidence"), F.lit("review").alias("decision"), F.when(F.col("k"), "baseline_review").otherwise("unknown_tenant").alias("reason_code"), none.alias("candidates"))


def violations(results: DataFrame, lines: DataFrame | None, catalogue: DataFrame) -> DataFrame:
    """(line_id, broken): the rules of the result contract that a row breaks; rows that break none are left out.

    lines give results their tenants; none where results have a column of them. Rows meet the catalogue once, code by code,
    with the rules that they break by themselves as bits; only what is broken moves on from there.
    """
    ok = catalogue.where(eligible()).select("tenant", F.col("item_code").alias("code"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1)
    rank = F.transform("candidates", lambda c: F.struct((-c["score"]).alias("s"), c["item_code"].alias("c")))
    rules = {
        "unknown_decision": ~F.coalesce(F.col("decision").isin("auto", "review", "reject"), F.lit(False)),
        "confidence_range": ~finite(F.col("confidence")),
        "reason_token": ~F.coalesce(F.col("reason_code").rlike("^[a-z][a-z0-9_]*$"), F.lit(False)),
        "auto_needs_code": (F.col("decision") == "auto") != (F.col("item_code") != ""),
        "ineligible_item": None,
        "too_many_candidates": F.size("candidates") > 3,
        "duplicate_candidates": F.size(F.array_distinct("candidates.item_code")) < F.size("candidates"),
        "ineligible_candidate": None,
        "score_range": F.exists("candidates", lambda c: ~finite(c["score"])),
        "unsorted_candidates": F.array_sort(rank) != rank,
        "item_not_first": (F.col("item_code") != "") & ~F.coalesce(F.get("candidates", F.lit(0))["item_code"] == F.col("item_code"), F.lit(False)),
    }
    bit = {n: F.lit(1 << i) for i, n in enumerate(rules)}
    none = F.lit(0)
    alone = none
    for n, c in rules.items():
        alone = alone if c is None else alone + F.when(c, bit[n]).otherwise(none)
    codes, own = F.array_distinct("candidates.item_code"), F.col("item_code")
    entry = lambda code, bits: F.struct(code.cast("string").alias("code"), bits.alias("bits"))
    nothing = F.array().cast("array<struct<code:string,bits:int>>")
    # No code stands for what a row breaks by itself: it meets nothing in the catalogue, and so stays.
    each = F.concat(
        F.when(alone != 0, F.array(entry(F.lit(None), alone))).otherwise(nothing),
        F.coalesce(F.transform(codes, lambda c: entry(c, bit["ineligible_candidate"] + F.when((own != "") & (c == own), bit["ineligible_item"]).otherwise(none))), nothing),
        F.when((own != "") & ~F.coalesce(F.array_contains(codes, own), F.lit(False)), F.array(entry(own, bit["ineligible_item"]))).otherwise(nothing),
    )
    known = ["tenant"] if lines is None else []
    rows = results.select("line_id", *known, F.monotonically_increasing_id().alias("row"), each.alias("each")).where(F.size("each") > 0)
    rows = rows if lines is None else rows.join(lines.select("line_id", "tenant"), "line_id")
    rows = rows.select("row", "line_id", "tenant", F.explode("each").alias("e")).select("row", "line_id", "tenant", "e.*")
    found = rows.join(ok, ["tenant", "code"], "left_anti").groupBy("row", "line_id").agg(F.bit_or("bits").alias("bits"))
    return found.select("line_id", F.array_compact(F.array(*(F.when(F.col("bits").bitwiseAND(b) != 0, n) for n, b in bit.items()))).alias("broken"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one has more often than the other; empty if a rerun gave the same."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
