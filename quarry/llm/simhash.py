"""SimHash near-duplicates, linked by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 4 bits exactly if some value is within 2 bits of both. So every fingerprint emits all
values within 2 bits of itself, and fingerprints that emit the same value are linked; being within 2 bits of it they are
within 4 of each other, all of them, so a chain through the group keeps every connection without its pairs. Such a group
has at most the 2,081 fingerprints of a ball.

Fingerprints that cannot have a partner need not emit. 4 differing bits leave at least 4 of 8 bytes alike, so partners
share one of the 70 choices of 4 bytes. Fingerprints that share no such key with another are left out before the balls;
this finds all that have a partner and some that have none.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, connected_components, partitions

SHINGLE, RADIUS, SEED = 4, 4, 42
_word = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """A text without words: 0. Fewer than k words: one shingle of them all."""
    import xxhash

    # bytes.lower changes A-Z alone; split() takes the six white-space bytes of the word pattern
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        hashes = [h(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [h(joined[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    v = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(v), 100_000):
        ones += np.unpackbits(v[i : i + 100_000].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(v), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, row: str | None = None) -> DataFrame:
    """(doc_id, fp), and the column named by row: fp as a signed 64-bit integer."""
    more = [row] if row else []

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, k) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], ["doc_id", "fp", *more])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text, *more).mapInArrow(run, "doc_id long, fp long" + "".join(f", `{c}` long" for c in more))


def _masks(radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(64), r)], np.uint64)


def may_have_partner(fps: DataFrame) -> DataFrame:
    """Of distinct fingerprints (fp), those that share 4 of their 8 bytes, at the same places, with another; and a few more."""
    choices = list(combinations(range(8), 4))

    def keys(batches):
        for b in batches:
            fp = b.column(0).to_numpy()
            byte = fp.view(np.uint8).reshape(-1, 8).astype(np.int64)
            for s in range(0, len(fp), 5000):
                x = byte[s : s + 5000]
                key = np.stack([(n << 32) | (x[:, c[0]] << 24) | (x[:, c[1]] << 16) | (x[:, c[2]] << 8) | x[:, c[3]] for n, c in enumerate(choices)], 1)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(fp[s : s + 5000], len(choices)))], ["key", "fp"])

    def shared(batches):
        # Rows come sorted; the first and last of a batch or partition stay, as their neighbours are out of sight.
        for b in batches:
            key, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            if len(key):
                same = key[1:] == key[:-1]
                keep = np.zeros(len(key), bool)
                keep[1:] |= same
                keep[:-1] |= same
                keep[[0, -1]] = True
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(fp[keep]))], ["fp"])

    n = partitions(fps.sparkSession)
    dealt = fps.mapInArrow(keys, "key long, fp long").repartitionByRange(n, "key", "fp").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(shared, "fp long").distinct()


def ball_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between fingerprints (fp, distinct) that keep every connection at `radius` or fewer differing bits."""
    masks = _masks(radius // 2)

    def balls(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for s in range(0, len(fp), 100):
                v = (fp[s : s + 100, None] ^ masks[None]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(np.repeat(fp[s : s + 100].view(np.int64), len(masks)))], ["variant", "fp"])

    out = fps.repartition(partitions(fps.sparkSession)).mapInArrow(balls, "variant long, fp long")
    prior = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = out.select("fp", prior.alias("other")).where("other is not null").select(F.col("other").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(scratch: Scratch, docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach.

    Documents without words, null ones included, have fingerprint 0 and link as any other. Rows that repeat a doc_id come
    once each; a null doc_id is never a component's name, unless nothing else is in it. An empty table gives no rows.
    """
    # Grouped by more than the later joins' key: those then deal both sides themselves and can split a hot fingerprint.
    with arrow_rows(docs.sparkSession):
        rows = scratch.table(fingerprints(docs, key, text, k), "fingerprints")
    of_class = _firsts(scratch, rows, F.col("doc_id"))
    return rows.join(of_class, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))


def _firsts(scratch: Scratch, rows: DataFrame, value) -> DataFrame:
    """(fp, first) for every fingerprint of rows: the least value among the rows that links reach."""
    classes = scratch.table(rows.groupBy("fp").agg(F.min(value).alias("own")), "classes")
    likely = scratch.table(may_have_partner(classes.select("fp")), "likely")
    links = ball_links(likely)
    members = connected_components(scratch, links)
    named = members.join(classes, members["node"] == classes["fp"]).select("node", "component", "own")
    least = named.groupBy("component").agg(F.min("own").alias("first"))
    named = scratch.table(named.drop("own").join(least, "component").select(F.col("node").alias("fp"), "first"), "named")
    return scratch.table(classes.join(named, "fp", "left").select("fp", F.coalesce("first", "own").alias("first")), "components")


def later_rows(scratch: Scratch, docs: DataFrame, row: str, key: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """The row numbers (column row, one for each row of docs) of all rows but the first of their group of linked rows.

    First is the smallest doc_id, null ones last, and of equal ones the smallest row number.
    """
    with arrow_rows(docs.sparkSession):
        rows = scratch.table(fingerprints(docs, key, text, k, row), "fingerprints")
    of_class = _firsts(scratch, rows, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("at")))
    return rows.join(of_class, "fp").where(F.col(row) != F.col("first.at")).select(row)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole documents; see near_duplicates()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(Scratch(spark, "op9"), docs)
