"""Token counts through a cache of digests.

A text's count is stored under the SHA-256 of its content (null is empty) and the SHA-256 of the tokenizer's file. Known
digests are joined to their counts; of the others each distinct text is encoded once and its count appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows
from .tokens import encoder, tokenizer_digest, tokenizer_path

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def count_misses(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of (digest, content); every row is encoded."""

    def count(batches):
        import pyarrow as pa

        enc = encoder(path)
        for b in batches:
            n = enc.counts(b.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return texts.mapInArrow(count, "digest binary, n_tokens long")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(docs: DataFrame, cache: str, text: str = "text", tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """The columns of docs, then n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    cache: folder of the cache, made if missing; runs that append at once may store a digest twice, which is read once.
    Null and empty texts have 0 bytes and 0 tokens; repeated rows stay repeated; an empty table gives an empty result.
    Columns of docs named as the new ones are replaced by them. Texts are encoded whole.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    version = tokenizer_digest(path)
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(content, 256))
    known = read_cache(spark, cache).where(F.col("tokenizer") == version)
    some = docs.select(digest.alias("digest"), content.alias("content")).groupBy("digest").agg(F.first("content").alias("content"))
    misses = some.join(known.select("digest"), "digest", "left_anti")
    with arrow_rows(spark):
        count_misses(misses, path).select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    # Grouped by more than the join's key: the join then deals both sides itself and can split a digest that is hot.
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest", "tokenizer").agg(F.max("n_tokens").alias("_n")).select(F.col("digest").alias("_digest"), "_n")
    own = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(*(F.col(f"`{c}`") for c in own), F.octet_length(content).cast("long").alias("n_bytes"), digest.alias("_digest"))
    out = rows.join(stored, "_digest", "left")
    return out.select(*(F.col(f"`{c}`") for c in own), "n_bytes", F.col("_n").alias("n_tokens"), (F.col("_n") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, with a cache that starts empty, so that each run encodes each distinct text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, Scratch(spark, "op7").path("cache")).drop("text")
