"""Files in and out: CSV without guesses, catalogues by tenant, JSON, hashes."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of order lines; those after the fifth may be missing and are then blank.
LINE_COLUMNS = ("line_id", "tenant", "customer_id", "order_date", "raw_text", "channel", "qty", "uom_text", "unit_price", "buyer_sku", "raw_barcode", "notes")
CATALOGUE_COLUMNS = ("item_code", "item_name", "disabled")
ALIAS_COLUMNS = ("tenant", "customer_id", "customer_sku", "item_code", "valid_from", "valid_to", "source", "confidence")
PREDICTION_COLUMNS = ("line_id", "item_code", "confidence", "decision", "reason_code", "candidates")


def read_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """Every column a string, blank for blank, as leading zeros and blanks carry meaning. A byte-order mark is dropped.

    Raises where the header repeats a name or lacks a required one; rows of another width fail when they are read.
    """
    head = spark.read.text(path).limit(1).collect()
    if not head:
        raise ValueError(f"no header in {path}")
    names = next(csv.reader([head[0][0].lstrip("\ufeff")]))
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"{path} repeats columns: {', '.join(twice)}")
    if lacking := sorted(set(required).difference(names)):
        raise ValueError(f"{path} lacks columns: {', '.join(lacking)}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=True, multiLine=True, escape='"', nullValue="\u0000", emptyValue="").csv(path)
    return df.na.fill("")


def read_order_lines(spark: SparkSession, path: str, labelled: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(lines, labels): labels (line_id, label) stay apart from what a matcher sees. Line ids must be there and unique."""
    required = (*LINE_COLUMNS[:5], *(["gt_item_code"] if labelled else []))
    rows = read_csv(spark, path, required)
    if not rows.groupBy("line_id").count().where("count > 1 or line_id = ''").isEmpty():
        raise ValueError("missing or duplicate line_id")
    lines = rows.select(*(F.col(c) if c in rows.columns else F.lit("").alias(c) for c in LINE_COLUMNS))
    return lines, rows.select("line_id", F.col("gt_item_code").alias("label")) if labelled else None


def read_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """All catalogue_<tenant>.csv of a folder, with the tenant of each file's name. Codes must be there and unique in it."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/catalogue_*.csv")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    paths = sorted(s.getPath().toString() for s in found) if found else []
    if not paths:
        raise ValueError("no catalogue files found")
    out = None
    for p in paths:
        one = read_csv(spark, p, CATALOGUE_COLUMNS).withColumn("tenant", F.lit(p.rpartition("/catalogue_")[2].removesuffix(".csv")))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    out = out.na.fill("")
    if not out.groupBy("tenant", "item_code").agg(F.count("*").alias("n"), F.bool_or(~F.col("disabled").isin("0", "1")).alias("odd")).where("n > 1 or odd or item_code = ''").isEmpty():
        raise ValueError("invalid or duplicate catalogue item")
    return out


def read_aliases(spark: SparkSession, path: str, cold_start: bool = False) -> DataFrame:
    """Buyers' own codes; none at all for a cold start."""
    if cold_start:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in ALIAS_COLUMNS))
    return read_csv(spark, path, ALIAS_COLUMNS)


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, enabled, probability, n, correct) of a policy file."""
    entry = "struct<n:long,correct:long,probability:double>"
    j = spark.read.schema(f"enabled_buckets array<string>, buckets map<string,{entry}>").option("multiLine", True).json(path)
    return j.select("enabled_buckets", F.explode("buckets").alias("bucket", "b")).select("bucket", F.array_contains("enabled_buckets", F.col("bucket")).alias("enabled"), "b.probability", "b.n", "b.correct")


def write_policy(fitted: DataFrame, path: str) -> None:
    """What fit_buckets() gives as one JSON document that read_policy() reads: a row for each kind of evidence, a handful."""
    entry = F.struct("bucket", F.struct("n", "correct", "probability", "observed_precision", "wilson_low", "wilson_high"))
    policy = fitted.agg(F.array_sort(F.collect_list(F.when(F.col("enabled"), F.col("bucket")))).alias("enabled_buckets"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("buckets"))
    policy.coalesce(1).write.mode("overwrite").json(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, partition, group) as a split has been written. A line must be in one partition."""
    rows = spark.read.schema("line_id string, partition string, `group` string").json(path)
    if not rows.groupBy("line_id").count().where("count > 1 or line_id is null").isEmpty() or not rows.where("partition is null or partition not in ('development', 'validation')").isEmpty():
        raise ValueError(f"no split in {path}")
    return rows


def read_golden(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file, gzipped or not."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length, sha256) of every file."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "length", F.sha2("content", 256).alias("sha256"))


def formatted_predictions(results: DataFrame) -> DataFrame:
    """Results as text: eight decimals, candidates as code:score with bars between."""
    packed = F.array_join(F.transform("candidates", lambda c: F.concat(c["item_code"], F.lit(":"), F.format_string("%.8f", c["score"]))), "|")
    return results.select("line_id", "item_code", F.format_string("%.8f", "confidence").alias("confidence"), "decision", "reason_code", packed.alias("candidates"))


def write_predictions(results: DataFrame, path: str, single: bool = False) -> None:
    """CSV in fixed column order. single: one file, for results that one task can hold."""
    out = formatted_predictions(results)
    (out.coalesce(1) if single else out).write.mode("overwrite").options(header=True, lineSep="\n", emptyValue="").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
