"""A split that leaks nothing: lines that share a text, target, alias or barcode stay together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_key
from ..plans.scratch import Scratch
from .components import connected_components

SALT = "quarry-split-v1"


def link_keys(lines: DataFrame) -> DataFrame:
    """(line_id, key) of lines (line_id, tenant, raw_text, label, customer_id, buyer_sku, raw_barcode)."""
    sep = "\u0001"
    key = lambda kind, *cols: F.concat_ws(sep, F.lit(kind), "tenant", *cols)
    keys = F.array_compact(
        F.array(
            key("text", word_key(F.col("raw_text"))),
            F.when(F.col("label") != "", key("target", F.col("label"))),
            F.when(F.col("buyer_sku") != "", key("alias", F.col("customer_id"), F.col("buyer_sku"))),
            F.when(F.col("raw_barcode") != "", key("barcode", F.col("raw_barcode"))),
        )
    )
    return lines.select("line_id", F.explode(keys).alias("key"))


def line_groups(scratch: Scratch, lines: DataFrame) -> DataFrame:
    """(line_id, root): the smallest line_id that shared keys reach. A key of any size makes a star, not its pairs."""
    keys = scratch.table(link_keys(lines), "keys")
    least = scratch.table(keys.groupBy("key").agg(F.min("line_id").alias("least")), "least")
    edges = keys.join(least, "key").where("line_id <> least").select(F.col("line_id").alias("a"), F.col("least").alias("b"))
    found = connected_components(scratch, edges)
    return lines.select("line_id").join(found.withColumnRenamed("node", "line_id"), "line_id", "left").select("line_id", F.coalesce("component", "line_id").alias("root"))


def build_split(scratch: Scratch, lines: DataFrame, salt: str = SALT) -> DataFrame:
    """(line_id, partition, group): group is the SHA-256 of the salt and the group's sorted ids; a quarter is validation."""
    groups = scratch.table(line_groups(scratch, lines), "groups")
    named = groups.groupBy("root").agg(F.sha2(F.concat(F.lit(salt + "|"), F.array_join(F.array_sort(F.collect_list("line_id")), "|")), 256).alias("group"))
    share = F.conv(F.substring("group", 1, 8), 16, 10).cast("long") % 4
    return groups.join(named, "root").select("line_id", F.when(share == 0, "validation").otherwise("development").alias("partition"), "group")
