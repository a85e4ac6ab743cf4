"""Evidence from item codes, barcodes and buyers' own codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_date
from ..functions.stats import number
from ..functions.text import IDENTIFIER_TOKEN, NUMBER, without_words
from ..plans.scratch import Scratch
from .catalogue import completed, eligible

EVIDENCE = ("line_id", "codes", "sources", "issues")


def identifier_index(catalogue: DataFrame) -> DataFrame:
    """(tenant, value, code, source) of every item code and barcode."""
    cat = completed(catalogue)
    pairs = F.explode(F.array(F.struct(F.col("item_code").alias("value"), F.lit("item_code").alias("source")), F.struct(F.col("barcode").alias("value"), F.lit("barcode").alias("source"))))
    return cat.select("tenant", F.col("item_code").alias("code"), pairs.alias("p")).select("tenant", "p.value", "code", "p.source").where("value <> ''").distinct()


def identifier_hits(lines: DataFrame, index: DataFrame) -> DataFrame:
    """(line_id, value, code, source): what the tokens of the text and the explicit barcode name in the line's tenant."""
    values = F.array_distinct(F.concat(F.regexp_extract_all("raw_text", F.lit(IDENTIFIER_TOKEN), F.lit(0)), F.when(F.col("raw_barcode") != "", F.array("raw_barcode")).otherwise(F.array().cast("array<string>"))))
    return lines.select("line_id", "tenant", F.explode(values).alias("value")).join(index, ["tenant", "value"]).select("line_id", "value", "code", "source")


def alias_evidence(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """(line_id, code, issue): active targets of buyers' codes, and what is wrong with them. Dates include both ends; blank is open."""
    asked = lines.where("buyer_sku <> ''").select("line_id", "tenant", "customer_id", F.col("buyer_sku").alias("customer_sku"), iso_date(F.col("order_date")).alias("day"))
    start = F.when(F.col("valid_from") == "", F.lit("0001-01-01").cast("date")).otherwise(iso_date(F.col("valid_from")))
    end = F.when(F.col("valid_to") == "", F.lit("9999-12-31").cast("date")).otherwise(iso_date(F.col("valid_to")))
    known = aliases.select("tenant", "customer_id", "customer_sku", F.col("item_code").alias("target"), start.alias("start"), end.alias("end"), ((F.col("source") != "confirmed_order") | (F.coalesce(number(F.col("confidence")), F.lit(-1.0)) != 1)).alias("weak"))
    j = asked.join(known, ["tenant", "customer_id", "customer_sku"], "left")
    valid = F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") <= F.col("end"))
    j = j.withColumn("found", F.col("target").isNotNull()).withColumn("bad", F.col("found") & ~F.coalesce(valid, F.lit(False))).withColumn("active", F.coalesce(F.col("found") & valid & F.col("day").between(F.col("start"), F.col("end")), F.lit(False)))
    per = j.groupBy("line_id").agg(
        F.bool_or("found").alias("found"),
        F.first("day").isNull().alias("no_day"),
        F.bool_or("bad").alias("bad"),
        F.bool_or("active").alias("any_active"),
        F.bool_or(F.col("active") & F.col("weak")).alias("weak"),
    )
    dated = ~F.col("no_day")
    issues = F.array_compact(
        F.array(
            F.when(~F.col("found"), "unresolved_buyer_sku"),
            F.when(~dated, "invalid_order_date"),
            F.when(dated & F.col("bad"), "invalid_alias_dates"),
            F.when(dated & F.col("weak"), "untrusted_alias_metadata"),
            F.when(dated & F.col("found") & ~F.col("any_active"), "no_date_valid_alias"),
        )
    )
    no = F.lit(None).cast("string")
    return j.where("active").select("line_id", F.col("target").alias("code"), no.alias("issue")).distinct().unionByName(per.select("line_id", no.alias("code"), F.explode(issues).alias("issue")))


def retrieve_identifiers(scratch: Scratch, lines: DataFrame, catalogue: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Per line its evidence: eligible codes, sources and issues, each sorted. aliases: none is a cold start."""
    cat = completed(catalogue)
    index = identifier_index(cat)
    # Written, so that Spark knows it to be small before it moves lines to it.
    known = scratch.table(cat.select("tenant").distinct().withColumn("tenant_known", F.lit(True)), "tenants")
    lines = lines.join(known, "tenant", "left").withColumn("tenant_known", F.coalesce("tenant_known", F.lit(False)))
    own = lines.where("tenant_known")
    hits = scratch.table(identifier_hits(own, index), "hits")
    barcode = own.where("raw_barcode <> ''").join(hits.select("line_id", F.col("value").alias("raw_barcode")).distinct(), ["line_id", "raw_barcode"], "left_anti").select("line_id", F.lit("unresolved_explicit_barcode").alias("issue"))
    if aliases is not None:
        by_alias = alias_evidence(own, aliases)
    else:
        asked = own.where("buyer_sku <> ''")
        bad_day = F.when(iso_date(F.col("order_date")).isNull(), "invalid_order_date")
        by_alias = asked.select("line_id", F.lit(None).cast("string").alias("code"), F.explode(F.array_compact(F.array(F.lit("unresolved_buyer_sku"), bad_day))).alias("issue"))
    by_alias = scratch.table(by_alias, "aliases")
    targets = hits.select("line_id", "code", "source").unionByName(by_alias.where("code is not null").select("line_id", "code", F.lit("buyer_alias").alias("source")))
    values = hits.groupBy("line_id").agg(F.collect_set("value").alias("values"))
    item = cat.select("tenant", F.col("item_code").alias("code"), eligible().alias("eligible"), F.concat("item_name", F.lit(" "), "description").alias("described"))
    # One row for each line and target: numbers of the text, without the identifiers, that the item does not have.
    each = targets.select("line_id", "code").distinct().join(own.select("line_id", "tenant", "raw_text"), "line_id").join(item, ["tenant", "code"], "left").join(values, "line_id", "left")
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)))
    bare = without_words(F.col("raw_text"), F.coalesce("values", F.array().cast("array<string>")))
    ok = F.coalesce("eligible", F.lit(False))
    each = each.select("line_id", "code", ok.alias("ok"), (ok & (F.size(F.array_except(numbers(bare), numbers(F.col("described")))) > 0)).alias("odd"))
    per_line = each.groupBy("line_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("code")))).alias("codes"), F.bool_or(~F.col("ok")).alias("ineligible"), F.bool_or("odd").alias("odd"))
    sources = targets.groupBy("line_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    more = barcode.unionByName(by_alias.where("issue is not null").select("line_id", "issue")).groupBy("line_id").agg(F.collect_set("issue").alias("more"))
    j = lines.select("line_id", "tenant_known").join(per_line, "line_id", "left").join(sources, "line_id", "left").join(more, "line_id", "left")
    none = F.array().cast("array<string>")
    issues = F.concat(
        F.array_compact(
            F.array(
                F.when(~F.col("tenant_known"), "unknown_tenant"),
                F.when(F.col("n") > 1, "identifier_conflict"),
                F.when(F.col("ineligible"), "ineligible_identifier_target"),
                F.when(F.col("odd"), "numeric_text_conflict_or_unparsed_quantity"),
            )
        ),
        F.coalesce("more", none),
    )
    out = j.select("line_id", F.coalesce("codes", none).alias("codes"), F.coalesce("sources", none).alias("sources"), F.array_sort(issues).alias("issues"))
    out = scratch.table(out, "evidence")
    scratch.drop(hits, by_alias)
    return out
