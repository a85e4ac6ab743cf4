"""From documents to packed sequences: quality, near-duplicates, secrets, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing, packing, quality, secrets, simhash
from quarry.llm.common import Scratch, arrow_rows, spare


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents' labels, scores at 0.3 or more; their rows as they were.

    Null and empty texts have the score of no words; very long texts count whole. Repeated rows and repeated or null
    doc_ids are scored row by row. Without labels of both kinds every row has one score. An empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scratch = Scratch(spark, "stage3")
    model = quality.fit(scratch, docs.select("doc_id", "text"), labels)
    name = spare(docs.columns, "quality_score")
    with arrow_rows(spark):
        return scratch.table(quality.score(docs, model, name=name).where(F.col(name) >= quality.THRESHOLD).select(*docs.columns), "kept")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one of smallest doc_id (null ones last; of equal ones any); rows without links stay.

    Rows are told apart by a number, written once, as doc_ids may be null or repeated. Texts without words, null and empty
    ones alike, are copies of each other. Texts of any length count whole. An empty table gives no rows.
    """
    scratch = Scratch(spark, "stage9")
    rows = scratch.table(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    gone = scratch.table(simhash.later_rows(scratch, rows.select("doc.doc_id", "doc.text", "row"), "row"), "gone")
    return rows.join(gone, "row", "left_anti").select("doc.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mask; n_chars follows the text.

    Null and empty texts stay as they are, with their n_chars; a null source is no path. Very long texts are scanned whole,
    repeated rows each. An empty table gives no rows.
    """
    out = secrets.redacted(docs, secrets.train(spark))
    length = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*(length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, its row as it was.

    A null source is one source, the last; a null or empty text has no words. Repeated rows and ids are rows of their own;
    of equal ones any may be taken. No document comes more than 3 times. An empty table gives no rows.
    """
    sized = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    mixed = mixing.mix(Scratch(spark, "stage8"), sized, size="words")
    return mixed.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; their columns are those of packing.PIECES alone.

    Null and empty texts are their end id; repeated rows and null ids are packed each. An empty table gives no rows.
    """
    return packing.pack(Scratch(spark, "stage6"), docs.select("doc_id", "text", "source"))


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("mixture", mix_sources), ("packing", pack_sequences)]

#: Classifier, fingerprints and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        after = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(docs)
        docs = after
    return docs
