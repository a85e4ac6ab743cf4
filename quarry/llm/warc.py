"""WARC archives, index first.

Writing gives an index: file, offset, length, URL and digest of every record. Reading starts from rows of that index:
they are sorted by file and offset and ranges that touch, or nearly so, become one read. Each record is its own gzip
member, so that a range can be read alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, open_file, write_file

#: Equal payloads of at least so many bytes are stored once.
LEAST_BYTES = 100
#: Bytes between two ranges that are read along, and the most bytes of one read.
GAP, MOST = 64 << 10, 8 << 20
INDEX = "path string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c >= " " and c != "\x7f")


def _record(page_id, url, kind: str, digest: str, size: int, refers_to, payload: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    h = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    size = int(h["content-length"])
    if len(rest) != size + 4:
        raise ValueError("a record's length is wrong")
    return h | {"payload": rest[:size]}


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for each row; gives the index of what was written (see INDEX). Run it once: keep the result.

    Among equal payloads of at least `least` bytes the smallest page_id is the response and the others revisit it,
    without payload; rows that repeat that page_id are responses too. A null html is an empty payload. Line breaks and
    other control characters are left out of URLs. A task that runs again writes a file of another name.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("digest"))
    # Grouped by more than the join's key: the join then deals both sides itself and can split a digest that is hot.
    first = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first_id")
    rows = rows.join(first, F.col("digest") == F.col("d"), "left").drop("d")

    def write(batches):
        import uuid

        from pyspark import TaskContext

        uri = f"{folder}/archive-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        index: dict[str, list] = {f.split()[0]: [] for f in INDEX.split(", ")}
        at = 0

        def records():
            nonlocal at
            for b in batches:
                for r in b.to_pylist():
                    payload = r["html"].encode("utf-8", "surrogatepass")
                    revisit = r["first_id"] is not None and r["first_id"] != r["page_id"]
                    kind, refers = ("revisit", r["first_id"]) if revisit else ("response", None)
                    z = zlib.compressobj(3, zlib.DEFLATED, 31)
                    out = z.compress(_record(r["page_id"], r["url"], kind, r["digest"], r["size"], refers, b"" if revisit else payload)) + z.flush()
                    for k, v in (("path", uri), ("offset", at), ("length", len(out)), ("page_id", r["page_id"]), ("url", r["url"]), ("payload_digest", r["digest"]), ("payload_bytes", r["size"]), ("record_type", kind), ("refers_to", refers)):
                        index[k].append(v)
                    at += len(out)
                    yield out

        write_file(uri, records())
        kinds = {"string": pa.string(), "long": pa.int64()}
        table = pa.table({f.split()[0]: pa.array(index[f.split()[0]], kinds[f.split()[1]]) for f in INDEX.split(", ")})
        yield from table.to_batches(max_chunksize=10_000)

    return rows.mapInArrow(write, INDEX)


def ranges(offsets: list[int], lengths: list[int], gap: int = GAP, most: int = MOST) -> Iterator[tuple[int, int, int, int]]:
    """Coalesced reads of sorted records: (first record, end record, offset, bytes)."""
    s = 0
    while s < len(offsets):
        e, end = s + 1, offsets[s] + lengths[s]
        while e < len(offsets) and offsets[e] - end <= gap and offsets[e] + lengths[e] - offsets[s] <= most:
            end = max(end, offsets[e] + lengths[e])
            e += 1
        yield s, e, offsets[s], end - offsets[s]
        s = e


def read_records(index: DataFrame) -> DataFrame:
    """The records of some rows of an index (see RECORD), as the archives have them; digests of payloads are verified.

    The rows' files stay in their partitions; only sorting within them is needed, as a file's rows are written together.
    """

    def read(batches):
        f, path = None, None
        try:
            for b in batches:
                paths, offsets, lengths = (b.column(c).to_pylist() for c in ("path", "offset", "length"))
                s = 0
                while s < len(paths):
                    e = s
                    while e < len(paths) and paths[e] == paths[s]:
                        e += 1
                    if paths[s] != path:
                        if f:
                            f.close()
                        f, path = open_file(paths[s]), paths[s]
                    for i, j, at, size in ranges(offsets[s:e], lengths[s:e]):
                        f.seek(at)
                        raw = f.read(size)
                        out = []
                        for k in range(s + i, s + j):
                            r = parse_record(zlib.decompress(raw[offsets[k] - at : offsets[k] - at + lengths[k]], 31))
                            digest = r["warc-payload-digest"].removeprefix("sha256:")
                            response = r["warc-type"] == "response"
                            if response and hashlib.sha256(r["payload"]).hexdigest() != digest:
                                raise ValueError(f"{path}: the digest at {offsets[k]} is wrong")
                            own = lambda x: None if x == "<urn:page:null>" else int(x[10:-1])
                            out.append((own(r["warc-record-id"]), r["warc-target-uri"], int(r["x-payload-length"]), digest, r["warc-type"], own(r["warc-refers-to"]) if not response else None, r["payload"].decode("utf-8", "surrogatepass") if response else None))
                        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], [x.split()[0] for x in RECORD.split(", ")])
                    s = e
        finally:
            if f:
                f.close()

    return index.select("path", "offset", "length").sortWithinPartitions("path", "offset").mapInArrow(read, RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, stored as a response; very long payloads are stored whole. Of equal payloads the one of
    smallest page_id is the response, as are all rows that repeat that id with it. Rows of null page_id are never referred to,
    and are responses. An empty table gives no rows.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    scratch = Scratch(spark, "op2")
    index = scratch.table(write_archives(pages, scratch.path("archives")), "index")
    return read_records(index).drop("url", "payload")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM q LEFT JOIN f USING (payload_digest)
"""
